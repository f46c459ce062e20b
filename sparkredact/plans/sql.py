"""DuckDB SQL of the queries."""

from __future__ import annotations

from ..functions.vocab import CANONICAL, META_WORDS, SERVER_THRESHOLDS

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMAIL = r"(?:^|[ \t\n,;(<])[A-Za-z0-9._+\-]+@[A-Za-z0-9.\-]*"
_IP = r"(?:^|[^A-Za-z0-9.])[0-9][0-9.]*"
_PHONE, _DIGITS = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[0-9]{16}"


def _hits(src: str, key: str, text: str, pattern: str, lead: str, label: str, valid: str = "true") -> str:
    """Matches with byte and character offsets; ``lead`` matches what a hit has before its value."""
    both = f"(?s)(.*?)({pattern}|\\z)"
    return f"""
    SELECT doc_id, '{label}' AS label, CAST(be - strlen(v) AS BIGINT) AS st, CAST(be AS BIGINT) AS en, CAST(ce - length(v) AS BIGINT) AS cst, CAST(ce AS BIGINT) AS cen, v FROM (
      SELECT doc_id, regexp_replace(h, '{lead}', '') AS v, h, sum(strlen(g) + strlen(h)) OVER w AS be, sum(length(g) + length(h)) OVER w AS ce
      FROM (SELECT {key} AS doc_id, unnest(regexp_extract_all({text}, '{both}', 1)) AS g, unnest(regexp_extract_all({text}, '{both}', 2)) AS h,
                   unnest(range(len(regexp_extract_all({text}, '{both}', 1)))) AS k FROM {src})
      WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE h <> '' AND {valid}"""


def _emails(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    ok = "contains(split_part(v, '@', 2), '.') AND NOT starts_with(split_part(v, '@', 2), '.') AND NOT ends_with(v, '.')"
    return _hits(src, key, text, _EMAIL, r"^[ \t\n,;(<]", "email_address", ok)


def _ips(src: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return _hits(src, key, text, _IP, r"^[^0-9]", "ip_address", rf"regexp_full_match(v, '{_OCTET}(\.{_OCTET}){{3}}')")


_WORD = r"[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|[^\s]"
_FOUND = f"f AS ({_emails()} UNION ALL {_ips()})"
_DETECTED = _FOUND
_ROW = "doc_id, st AS start_byte, en AS end_byte, v AS value, label"
_BASE = f"""
h AS (SELECT doc_id, label, st, en, v, 1 AS o FROM ({_hits('documents', 'doc_id', 'text', _PHONE, '^$', 'phone_number')})
  UNION ALL SELECT doc_id, label, st, en, v, 2 FROM ({_hits('documents', 'doc_id', 'text', _DIGITS, '^$', 'bank_account_number')})
  UNION ALL SELECT doc_id, 'person_name', st, en, v, 3 FROM ({_emails()})
  UNION ALL SELECT doc_id, label, st, en, v, 4 FROM ({_ips()})),
c AS (SELECT doc_id, label, st, en, v, CAST(((doc_id * 31 + st) % 100) / 100.0::DOUBLE AS FLOAT) AS score, o * 1000000000::BIGINT + st AS ord FROM h
  UNION ALL SELECT doc_id, 'passport_number', st, st + 4, substr(v, 1, 4), CAST(((doc_id * 17 + st) % 100) / 100.0::DOUBLE AS FLOAT), (o + 10) * 1000000000::BIGINT + st FROM h)"""
_SCORE = "round(CAST(score AS DOUBLE), 4) AS score"
_LIMITS = " ".join(f"WHEN label = '{k}' THEN {v}" for k, v in SERVER_THRESHOLDS.items())
_VALUES = ", ".join(f"('{k.upper()}', '{v}')" for k, v in CANONICAL.items())
_META_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in META_WORDS)
_TYPES = "string_agg(DISTINCT label, ', ' ORDER BY label)"


def _rewrite(repl: str) -> str:
    return f"""
WITH {_FOUND},
p AS (SELECT f.*, text, coalesce(lag(cen) OVER (PARTITION BY f.doc_id ORDER BY cst), 0) AS before FROM f JOIN documents d ON d.doc_id = f.doc_id),
g AS (SELECT doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(cst - before AS BIGINT)) || {repl}, '' ORDER BY cst) AS head, max(cen) AS tail FROM p GROUP BY 1)
SELECT g.doc_id, head || substr(text, CAST(tail + 1 AS BIGINT)) AS redacted FROM g JOIN documents d ON d.doc_id = g.doc_id"""


def _valid(name: str) -> str:
    d = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
    return {
        "government_id": f"regexp_full_match(value, '[A-Za-z0-9 -]{{6,20}}') AND {d} > 0",
        "phone_number": f"{d} BETWEEN 7 AND 15 AND regexp_full_match(value, '[0-9 +()-]*')",
        "email_address": "contains(value, '@') AND contains(value, '.')",
        "passport_number": f"strlen(value) BETWEEN 6 AND 12 AND regexp_matches(value, '[A-Za-z]') AND {d} > 0",
        "license_plate": "strlen(value) BETWEEN 3 AND 15 AND regexp_matches(value, '[A-Za-z0-9]')",
        "bank_account_number": f"{d} BETWEEN 8 AND 20 AND regexp_full_match(value, '[0-9 -]*')",
        "date_of_birth": f"{d} >= 4",
    }[name]


_VALID = " UNION ALL ".join(
    f"SELECT '{k}' AS as_label, CAST(sum(CASE WHEN {_valid(k)} THEN 1 ELSE 0 END) AS BIGINT) AS valid, count(*) AS checked FROM (SELECT trim(v) AS value FROM c)"
    for k in ("government_id", "phone_number", "email_address", "passport_number", "license_plate", "bank_account_number", "date_of_birth")
)

_DEDUP = f"""
WITH RECURSIVE {_BASE},
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, score DESC, ord) AS rn FROM c),
r AS (SELECT doc_id, rn, st, en, label, v, score, 1 AS slot FROM s WHERE rn = 1
  UNION ALL
  SELECT doc_id, rn, CASE WHEN stay THEN st ELSE s_st END, CASE WHEN stay THEN en ELSE s_en END, CASE WHEN stay THEN label ELSE s_label END, CASE WHEN stay THEN v ELSE s_v END,
         CASE WHEN stay THEN score ELSE s_score END, CASE WHEN s_st < en THEN slot ELSE slot + 1 END
  FROM (SELECT r.doc_id, s.rn, r.st, r.en, r.label, r.v, r.score, r.slot, s.st AS s_st, s.en AS s_en, s.label AS s_label, s.v AS s_v, s.score AS s_score,
     (s.st < r.en AND NOT ((s.label = r.label AND s.en - s.st > r.en - r.st) OR (s.label <> r.label AND s.score > r.score * 1.3::FLOAT))) AS stay
     FROM r JOIN s ON s.doc_id = r.doc_id AND s.rn = r.rn + 1)),
d AS (SELECT doc_id, slot, arg_max(st, rn) AS st, arg_max(en, rn) AS en, arg_max(label, rn) AS label, arg_max(v, rn) AS v, arg_max(score, rn) AS score FROM r GROUP BY 1, 2)
SELECT {_ROW}, {_SCORE} FROM d"""

_MESSAGES = "l AS (SELECT *, doc_id || '.' || line AS id FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents))"
_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}]"
_PER_DOC = f"WITH {_DETECTED} SELECT doc_id, count(*) AS n_entities, {_TYPES} AS types FROM f GROUP BY 1"

ORACLE_SQL = {
    "detect_documents": _PER_DOC,
    "scan_emails": f"SELECT {_ROW}, 0.9::DOUBLE AS score FROM ({_emails()})",
    "scan_ips": f"SELECT {_ROW}, 1.0::DOUBLE AS score FROM ({_ips()})",
    "scan_pages": f"SELECT {_ROW}, CASE WHEN label = 'ip_address' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS score FROM ({_emails('pages', 'page_id', 'html')} UNION ALL {_ips('pages', 'page_id', 'html')})",
    "scan_char_offsets": f"SELECT doc_id, cst AS char_start, cen AS char_end, v AS value FROM ({_emails()})",
    "entity_counts": f"WITH {_DETECTED} SELECT lang, source, count(*) AS entities, CAST(sum(CASE WHEN label = 'email_address' THEN 1 ELSE 0 END) AS BIGINT) AS emails FROM f JOIN documents d ON d.doc_id = f.doc_id GROUP BY ROLLUP (lang, source)",
    "has_cjk": r"SELECT lang, CAST(sum(CASE WHEN regexp_matches(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}]') THEN 1 ELSE 0 END) AS BIGINT) AS cjk, count(*) AS docs FROM documents GROUP BY 1",
    "word_split": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|[^\s]')) AS BIGINT) AS n_words FROM documents",
    "span_windows": r"SELECT doc_id, CAST(CASE WHEN n >= 8 THEN 8 * n - 28 ELSE n * (n + 1) / 2 END AS BIGINT) AS n_windows FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|[^\s]')) AS n FROM documents)",
    "length_guard": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CASE WHEN strlen(text) > 5000 THEN 'text_too_long' END AS error FROM documents",
    "canonicalize": f"SELECT * FROM (VALUES {_VALUES}, ('unheard of', 'unheard of')) t(label, canonical)",
    "validate_formats": f"WITH {_BASE} {_VALID}",
    "meta_filter": rf"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' AND (regexp_replace(w, '\s', '', 'g') = '' OR regexp_replace(regexp_replace(lower(w), '^[\s.,;:!?()\[\]{{}}，。；：]+', ''), '[\s.,;:!?()\[\]{{}}，。；：]+$', '') IN ({_META_LIST})) GROUP BY 1",
    "strip_context": "SELECT c_custkey, c_name AS stripped FROM customer",
    "reclassify": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'contact number' ELSE 'person_name' END AS label, CASE WHEN c_custkey % 2 = 0 THEN greatest(0.35, (c_custkey % 10) / 10.0) ELSE (c_custkey % 10) / 10.0 END::DOUBLE AS score FROM customer",
    "expand_emails": f"SELECT {_ROW}, 0.8::DOUBLE AS score FROM ({_emails()})",
    "threshold_default": f"WITH {_BASE} SELECT {_ROW}, {_SCORE} FROM c WHERE score >= 0.25::FLOAT",
    "threshold_by_label": f"WITH {_BASE} SELECT {_ROW}, {_SCORE} FROM c WHERE score >= CAST(CASE {_LIMITS} ELSE 0.25 END AS FLOAT)",
    "review_flags": f"WITH {_BASE} SELECT label AS type, score < 0.6::FLOAT AS needs_review, count(*) AS n FROM c GROUP BY 1, 2",
    "dedup_spans": _DEDUP,
    "redact_label": _rewrite("'[' || upper(label) || ']'"),
    "redact_hash": _rewrite("'[' || upper(label) || '_' || left(sha256(v), 8) || ']'"),
    "redact_consistent": _rewrite("'ENTITY_' || left(sha256(v), 6)"),
    "redact_asterisk": _rewrite("repeat('*', length(v))"),
    "redact_block": _rewrite("'███'"),
    "role_views": f"""
WITH {_FOUND}, r AS (SELECT unnest(['admin', 'analyst', 'support_lead', 'auditor', 'guest']) AS role),
p AS (SELECT f.*, role, text, coalesce(lag(cen) OVER (PARTITION BY f.doc_id, role ORDER BY cst), 0) AS before FROM f JOIN documents d ON d.doc_id = f.doc_id CROSS JOIN r),
g AS (SELECT doc_id, role, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(cst - before AS BIGINT)) || CASE WHEN role IN ('analyst', 'support_lead', 'guest') AND label = 'ip_address' THEN '[GOVERNMENT_ID]' WHEN role = 'guest' THEN '[EMAIL_ADDRESS]' ELSE v END, '' ORDER BY cst) AS head, max(cen) AS tail FROM p GROUP BY 1, 2)
SELECT g.doc_id, role, head || substr(text, CAST(tail + 1 AS BIGINT)) AS view FROM g JOIN documents d ON d.doc_id = g.doc_id""",
    "pseudonyms": f"""
WITH {_FOUND}, l AS (SELECT doc_id, v, dense_rank() OVER (PARTITION BY doc_id ORDER BY last DESC) AS n FROM (SELECT doc_id, v, max(cst) AS last FROM f WHERE label = 'email_address' GROUP BY 1, 2)),
p AS (SELECT f.*, text, n, coalesce(lag(cen) OVER (PARTITION BY f.doc_id ORDER BY cst), 0) AS before FROM f JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN l ON l.doc_id = f.doc_id AND l.v = f.v),
g AS (SELECT doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(cst - before AS BIGINT)) || CASE WHEN label = 'email_address' THEN 'PATIENT_' || lpad(CAST(n AS VARCHAR), 3, '0') ELSE '[DOB_REDACTED]' END, '' ORDER BY cst) AS head, max(cen) AS tail FROM p GROUP BY 1)
SELECT g.doc_id, head || substr(text, CAST(tail + 1 AS BIGINT)) AS deidentified FROM g JOIN documents d ON d.doc_id = g.doc_id""",
    "regulation": f"WITH {_BASE} SELECT label AS type, label IN ('person_name', 'government_id', 'phone_number', 'email_address', 'street_address', 'date_of_birth') AS pdpa_relevant, true AS gdpr_relevant, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "span_scores": "SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(len(embedding)), lambda i: CAST(embedding[i + 1] AS DOUBLE) * CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)))), 4) AS score FROM embeddings",
    "classify_softmax": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, 'l' || CAST(list_position(e, list_max(e)) - 1 AS VARCHAR) AS label, round(1 / list_sum(list_transform(e, lambda v: exp(v - list_max(e)))), 4) AS score FROM x",
    "classify_multilabel": "SELECT vec_id, array_to_string(list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN 'l' || CAST(i - 1 AS VARCHAR) ELSE '' END), lambda x: x <> ''), ',') AS labels FROM embeddings",
    "rate_limit": """
WITH RECURSIVE s AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, true AS admitted, [t] AS held FROM s WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.rn, s.event_id, len(list_filter(r.held, lambda h: h >= s.t - 86400000000)) < 2,
    CASE WHEN len(list_filter(r.held, lambda h: h >= s.t - 86400000000)) < 2 THEN list_append(list_filter(r.held, lambda h: h >= s.t - 86400000000), s.t) ELSE list_filter(r.held, lambda h: h >= s.t - 86400000000) END
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT event_id, admitted FROM r""",
    "audit_log": f"WITH {_DETECTED}, a AS (SELECT doc_id, count(*) AS n, {_TYPES} AS types, max(CASE WHEN label = 'ip_address' THEN 1.0 ELSE 0.9 END) AS top FROM f GROUP BY 1) SELECT d.doc_id, 'pii_scan' AS event, coalesce(n, 0) AS entities_found, coalesce(types, '') AS entity_types, CAST(coalesce(top, 0) AS DOUBLE) AS highest_confidence FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id",
    "source_report": f"WITH {_DETECTED}, n AS (SELECT source, count(*) AS scanned FROM documents GROUP BY 1) SELECT n.source, any_value(scanned) AS scanned, count(DISTINCT f.doc_id) AS flagged, count(f.doc_id) AS entities, coalesce({_TYPES}, '') AS types FROM n LEFT JOIN documents d ON d.source = n.source LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1",
    "batch_stats": f"WITH {_DETECTED} SELECT (SELECT count(*) FROM documents) AS scanned, count(DISTINCT doc_id) AS flagged, count(*) AS entities FROM f",
    "conversation_scan": "SELECT role, count(*) AS scanned, CAST(0 AS BIGINT) AS flagged, CAST(0 AS BIGINT) AS entities, '' AS types FROM conversations WHERE length(text) >= 10 GROUP BY 1",
    "strict_match": f"""
WITH {_FOUND}, g AS (SELECT DISTINCT doc_id, st, en, label FROM f), p AS (SELECT doc_id, st, en + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS en, label FROM g WHERE doc_id % 5 <> 0),
m AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS ig, p.doc_id IS NOT NULL AS ip FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.st = p.st AND g.en = p.en AND g.label = p.label),
c AS (SELECT label, sum(CASE WHEN ig AND ip THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN ig THEN 1 ELSE 0 END) AS ng, sum(CASE WHEN ip THEN 1 ELSE 0 END) AS np FROM m GROUP BY 1),
e AS (SELECT label, tp / np AS precision, tp / ng AS recall, 2 * tp / (ng + np) AS f1, ng AS support FROM c)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM e
UNION ALL SELECT '(all)', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM e""",
    "scan_report": f"WITH {_DETECTED} SELECT 'doc/' || CAST(doc_id AS VARCHAR) || '.txt' AS file, count(*) AS count, {_TYPES} AS types FROM f GROUP BY 1",
    "line_annotations": f"WITH {_DETECTED}, x AS (SELECT DISTINCT f.doc_id, label, v, text FROM f JOIN documents d ON d.doc_id = f.doc_id) SELECT 'doc/' || CAST(doc_id AS VARCHAR) || '.txt' AS file, CAST(len(string_split(split_part(text, v, 1), chr(10))) AS BIGINT) AS line, label AS type FROM x",
    "column_classes": f"""
WITH v AS (SELECT column_name, doc_id, x FROM (SELECT doc_id, text, lang, source, CASE WHEN contains(text, '@') THEN text END AS reachable FROM documents) UNPIVOT (x FOR column_name IN (text, lang, source, reachable))),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY doc_id) AS k FROM v) WHERE k <= 100 AND length(x) > 3),
s AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS n, row_number() OVER (PARTITION BY column_name ORDER BY doc_id) AS j FROM o),
t AS (SELECT column_name, n, column_name || ' ' || doc_id AS id, x FROM s WHERE j <= 50),
f AS ({_emails('t', 'id', 'x')} UNION ALL {_ips('t', 'id', 'x')}),
e AS (SELECT column_name, n, label, count(*) AS k FROM f JOIN t ON t.id = f.doc_id GROUP BY 1, 2, 3),
c AS (SELECT column_name, n, CAST(sum(k) AS BIGINT) AS entities, first(label ORDER BY k DESC, label) AS dominant_type, string_agg(label || ': ' || k, ', ' ORDER BY label) AS type_distribution FROM e GROUP BY 1, 2)
SELECT 'documents' AS table_name, column_name, n AS samples_checked, entities AS entities_found, round(entities / n, 2) AS pii_ratio, dominant_type, type_distribution,
  CASE WHEN entities / n > 0.3 THEN 'PII' WHEN entities / n > 0.1 THEN 'POSSIBLE_PII' ELSE 'UNLIKELY_PII' END AS classification FROM c""",
    "merge_spans": rf"""
WITH f AS ({_hits('documents', 'doc_id', 'text', _WORD, '^$', '')}),
n AS (SELECT doc_id, st, en, cst, cen, CASE WHEN length(v) % 3 = 0 THEN 'street_address' ELSE 'person_name' END AS name FROM f),
b AS (SELECT *, CASE WHEN name = lag(name) OVER w AND st - lag(en) OVER w <= 2 THEN 0 ELSE 1 END AS is_new FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY st)),
g AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY st) AS run FROM b),
m AS (SELECT doc_id, min(st) AS start_byte, max(en) AS end_byte, min(cst) AS cst, max(cen) AS cen, any_value(name) AS label FROM g GROUP BY doc_id, run)
SELECT m.doc_id, start_byte, end_byte, substr(text, cst + 1, cen - cst) AS value, label, 0.5::DOUBLE AS score FROM m JOIN documents d ON d.doc_id = m.doc_id""",
    "chunked_audit": f"""
WITH t AS (SELECT doc_id || ':' || k AS id, source, doc_id AS object_id, substr(text, k * 10000 + 1, 10000) AS x FROM (SELECT *, unnest(range((length(text) + 9999) // 10000)) AS k FROM documents)),
f AS ({_emails('t', 'id', 'x')} UNION ALL {_ips('t', 'id', 'x')})
SELECT source AS bucket, object_id, count(*) AS entities_found, {_TYPES} AS entity_types FROM f JOIN t ON t.id = f.doc_id GROUP BY 1, 2""",
    "log_scan": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) // 50 AS BIGINT) AS batch FROM l WHERE length(trim(x, ' ')) >= 20),
t AS (SELECT doc_id || ':' || batch AS id, doc_id AS d, batch, string_agg(x, chr(10) ORDER BY i) AS x FROM n GROUP BY doc_id, batch),
f AS ({_emails('t', 'id', 'x')} UNION ALL {_ips('t', 'id', 'x')})
SELECT d AS doc_id, batch, count(*) AS entities FROM f JOIN t ON t.id = f.doc_id GROUP BY 1, 2""",
    "structured_fields": """
WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
s AS (SELECT vec_id, i, i % 2 AS instance, CASE WHEN i % 4 < 2 THEN 'head' ELSE 'tail' END AS field, CAST(1 / (1 + exp(-CAST(x AS DOUBLE))) AS FLOAT) AS score FROM c),
b AS (SELECT vec_id, instance, field, CAST(first(i ORDER BY score DESC, i) AS VARCHAR) AS i, max(score) AS score FROM s WHERE score >= 0.5::FLOAT GROUP BY 1, 2, 3)
SELECT h.vec_id, h.i AS head, t.i AS tail, round(CAST(h.score + t.score AS DOUBLE) / 2, 4) AS score FROM b h JOIN b t ON t.vec_id = h.vec_id AND t.instance = h.instance AND h.field = 'head' AND t.field = 'tail'""",
    "bio_decode": rf"""
WITH f AS ({_hits('documents', 'doc_id', 'text', _WORD, '^$', '')}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS i, length(v) % 4 AS m FROM f),
t AS (SELECT *, CAST((i * 37) % 100 / 100.0::DOUBLE AS FLOAT) AS prob, CASE WHEN m = 3 THEN 'ADDR' ELSE 'NAME' END AS name FROM n),
a AS (SELECT *, m <> 0 AND prob >= 0.08::FLOAT AS ok FROM t),
b AS (SELECT *, CASE WHEN m >= 2 AND lag(ok) OVER w AND lag(name) OVER w = name THEN 0 ELSE 1 END AS is_new FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(is_new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b WHERE ok),
m AS (SELECT doc_id, min(st) AS start_byte, max(en) AS end_byte, min(cst) AS cst, max(cen) AS cen, any_value(name) AS label, max(prob) AS prob FROM g GROUP BY doc_id, run)
SELECT m.doc_id, start_byte, end_byte, substr(text, cst + 1, cen - cst) AS value, label, round(CAST(prob AS DOUBLE), 4) AS score FROM m JOIN documents d ON d.doc_id = m.doc_id""",
    "sentence_chunks": r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), '. ') AS p FROM documents),
r AS (SELECT doc_id, 1 AS i, CAST(NULL AS VARCHAR) AS done, p[1] || '. ' AS now FROM s
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN over THEN trim(now, ' ') END, CASE WHEN over THEN CASE WHEN len(own) > 40 THEN array_to_string(own[-40:], ' ') ELSE '' END || ' ' ELSE now END || next || '. '
  FROM (SELECT *, CASE WHEN over THEN list_filter(regexp_split_to_array(now, '\s+'), lambda w: w <> '') END AS own
    FROM (SELECT r.doc_id, i, now, p[i + 1] AS next, length(now) + length(p[i + 1]) > 1500 AND now <> '' AS over FROM r JOIN s ON s.doc_id = r.doc_id WHERE i < len(p)))),
c AS (SELECT doc_id, i, done AS t FROM r WHERE done IS NOT NULL UNION ALL SELECT r.doc_id, i + 1, trim(now, ' ') FROM r JOIN s ON s.doc_id = r.doc_id AND i = len(p) WHERE trim(now, ' ') <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk, CAST(length(t) AS BIGINT) AS n_chars FROM c""",
    "buckets_report": f"""
WITH {_DETECTED}, n AS (SELECT source, count(*) AS files FROM documents GROUP BY 1), e AS (SELECT d.source, f.doc_id, label FROM f JOIN documents d ON d.doc_id = f.doc_id)
SELECT n.source AS bucket, any_value(files) AS files, count(DISTINCT doc_id) AS files_with_pii, count(doc_id) AS total_entities, coalesce({_TYPES}, '') AS types FROM n LEFT JOIN e ON e.source = n.source GROUP BY 1
UNION ALL SELECT '(all)', (SELECT count(*) FROM documents), count(DISTINCT doc_id), count(*), coalesce({_TYPES}, '') FROM e""",
    "slack_scan": f"""
WITH {_MESSAGES}, m AS (SELECT * FROM l WHERE length(x) >= 10), f AS ({_emails('m', 'id', 'x')} UNION ALL {_ips('m', 'id', 'x')})
SELECT source AS channel, id AS ts, m.doc_id AS user, count(*) AS entity_count, {_TYPES} AS types FROM f JOIN m ON m.id = f.doc_id GROUP BY 1, 2, 3""",
    "ticket_scan": f"""
WITH {_MESSAGES}, m AS (SELECT * FROM l WHERE CASE WHEN line = 0 THEN x <> '' ELSE length(x) >= 10 END), f AS ({_emails('m', 'id', 'x')} UNION ALL {_ips('m', 'id', 'x')}),
t AS (SELECT m.doc_id AS ticket_id, line, count(*) AS entities, {_TYPES} AS types FROM f JOIN m ON m.id = f.doc_id GROUP BY 1, 2)
SELECT ticket_id, CASE WHEN line = 0 THEN 'description' ELSE 'comment_' || (line - 1) END AS source, CASE WHEN line > 0 THEN CAST((line - 1) % 2 AS VARCHAR) END AS author, entities, types FROM t""",
    "whatsapp_scan": f"""
WITH {_MESSAGES}, n AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1) // 20 AS BIGINT) AS batch FROM l WHERE line % 7 <> 6),
t AS (SELECT doc_id || ':' || batch AS id, doc_id AS d, batch, string_agg(trim(x, ' '), chr(10) ORDER BY line) AS x FROM n GROUP BY doc_id, batch HAVING count(*) = 20),
f AS ({_emails('t', 'id', 'x')} UNION ALL {_ips('t', 'id', 'x')})
SELECT d AS doc_id, batch, count(*) AS entities FROM f JOIN t ON t.id = f.doc_id GROUP BY 1, 2""",
    "sql_functions": f"""
WITH {_FOUND}, r AS ({_rewrite("'[' || upper(label) || ']'")}), n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n, regexp_matches(text, '{_CJK}') AS cjk, coalesce(redacted, text) AS redacted FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
WHERE contains(text, '@') OR regexp_matches(text, '[0-9][.][0-9]')""",
}
