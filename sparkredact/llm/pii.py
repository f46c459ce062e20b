"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. Every distinct value is a
protected entity. Terms (runs of letters) of the documents that hold it may give it away: with n documents
in the corpus, IC(e) = log2(n / n_e) is what the entity discloses itself, and PMI(t, e) =
log2(n * n_te / (n_t * n_e)) what the term discloses of it, where n_t, n_e and n_te count the documents
with the term, with the entity and with both, wherever in the text they are. In every document that
holds the term, it is generalised where PMI comes within ``SLACK_BITS`` of IC, so that it leaves that
much doubt about the entity at most, and removed where it reaches IC, that is, where the term occurs
nowhere without the entity; ``SUPPORT`` documents must show the two together.

A generalised term gives way to the class of its form: a capitalised word, one in capitals, any other.

All is DataFrame functions. Spans are found inside the row; the counts are aggregations with partial
sums; the corpus is joined with the candidate terms only. The patterns have possessive repeats and
start at the head of a run, so a very long run costs time in proportion. Places are running sums of the
lengths of matches and of what lies between them, so a text with very many matches does too.

Defined cases: null text is empty and has no spans; repeated rows (same id and text) count once in the
statistics and get the same spans; a null id is an id like others; an empty table gives no rows;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, materialize, small, table

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SUPPORT = 2
SLACK_BITS = 1.0
TERM = r"\p{L}+"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Classes that terms are generalised to: words in capitals, capitalised words, others.
CLASSES = ((r"\A\p{Lu}{2,}\z", "[ACRONYM]"), (r"\A\p{Lu}", "[NAME]"), ("", "[TERM]"))
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"
#: Items that a fold takes before it sets aside what it has, and spans that are cut out of one part of a text; no effect on results.
RUN = 128


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(13, 19) & let(digits, luhn)


def running(values: Column, start: Column, step) -> Column:
    """What ``step`` makes of ``start`` and the values up to each place. Finished runs are set aside, as a step copies all that it holds."""
    longs = "array<bigint>"

    def of(x: Column) -> Column:
        runs = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))

        def run(acc: Column, k: Column) -> Column:
            first = F.struct(acc["now"].alias("now"), F.array().cast(longs).alias("out"))
            one = lambda a, v: let(step(a["now"], v), lambda n: F.struct(n.alias("now"), F.concat(a["out"], F.array(n)).alias("out")))
            return let(F.aggregate(F.slice(x, k * RUN + 1, F.lit(RUN)), first, one), lambda r: F.struct(r["now"].alias("now"), F.concat(acc["out"], r["out"]).alias("out")))

        return F.aggregate(runs, F.struct(start.cast("long").alias("now"), F.array().cast(longs).alias("out")), run, lambda a: a["out"])

    return let(values, of)


def placed(parts: Column, before: Column | None = None) -> Column:
    """Spans of strings that follow each other in a text; with ``before``, of what lies in front of each."""
    gap = (lambda i: F.length(F.get(before, i))) if before is not None else (lambda i: F.lit(0))
    ends = running(F.transform(parts, lambda p, i: (gap(i) + F.length(p)).cast("long")), F.lit(0), lambda a, n: a + n)
    return let(ends, lambda e: F.transform(parts, lambda p, i: F.struct((F.get(e, i) - F.length(p)).cast("long").alias("start"), F.get(e, i).alias("end"), p.alias("value"))))


def base_spans(text: Column, kind: str) -> Column:
    """Spans (start, end, value) of one kind, in code points, end exclusive."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    sign = {"email": text.contains("@"), "ip": text.contains("."), "phone": text.contains("+"), "card": text.rlike("[0-9][ -]?[0-9]")}[kind]
    none = F.array().cast(_SPANS)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    place = lambda m: let(F.split(text, pattern, -1), lambda gaps: F.filter(placed(m, gaps), lambda s: _valid(kind, s["value"])))
    return F.when(sign, let(matches, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))).otherwise(none)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), _text(text_col))


def _base(text_col: str) -> Column:
    return F.struct(*[base_spans(_text(text_col), k).alias(k) for k in KINDS])


def text_terms(text: Column) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(pii_key, terms)``: for documents that need it, the terms to generalise (False) or remove (True)."""
    text = _text(text_col)
    found = docs.select(_key(id_col, text_col).alias("pii_key"), text.alias("text"), _base(text_col).alias("base")).filter(sum((F.size(f"base.{k}") for k in KINDS), F.lit(0)) > 0)

    def of(kind: str) -> Column:
        return F.transform(f"base.{kind}", lambda s: F.xxhash64(F.lit(kind), F.lower(s["value"])))

    rows = found.select("pii_key", F.array_distinct(F.flatten(F.array(*map(of, KINDS)))).alias("entities"), text_terms(F.col("text")).alias("terms")).dropDuplicates(["pii_key"])
    rows = materialize(rows, "pii-entities")
    held = rows.select("pii_key", F.explode("entities").alias("entity"))
    n_e = materialize(held.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= SUPPORT), "pii-n-e")  # others have no pair with support
    held = held.join(small(n_e), "entity").groupBy("pii_key").agg(F.collect_list("entity").alias("entities"))
    both = rows.select("pii_key", "terms").join(held, "pii_key").select("entities", F.explode("terms").alias("term")).select("term", F.explode("entities").alias("entity"))
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= SUPPORT)
    pairs = materialize(pairs, "pii-pairs")
    candidates = materialize(pairs.select("term").distinct(), "pii-terms")
    n_terms = candidates.count()
    corpus = docs.select(_key(id_col, text_col).alias("pii_key"), text.alias("text"))
    n = corpus.count()
    own = corpus.select("pii_key", F.explode(text_terms(F.col("text"))).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        n_t = own.join(F.broadcast(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:  # sums meet, not words: a very frequent one is a row for each task
        n_t = own.groupBy("term").agg(F.count("*").alias("n_t")).join(candidates, "term", "left_semi")
    scored = pairs.join(n_t, "term").join(n_e, "entity")
    ic = F.log2(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    shown = scored.filter((ic > 0) & (pmi >= ic - SLACK_BITS - 1e-9)).groupBy("term").agg(F.max(F.col("n_te") >= F.col("n_t")).alias("gone"))
    shown = materialize(shown, "pii-shown")
    hit = own.join(small(shown), "term").select("pii_key", "term", "gone").distinct()
    return hit.groupBy("pii_key").agg(F.array_sort(F.collect_list(F.struct("term", "gone"))).alias("terms"))


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the words of ``text`` that are among ``terms`` and outside the spans ``base``."""
    pieces = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    known = lambda s: F.exists(terms, lambda t: t["term"] == F.lower(s["value"])) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    return F.filter(let(pieces, lambda p: placed(p)), known)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """``docs`` with a struct ``out_col`` of span arrays ``email, ip, card, phone, term``, and ``terms`` with what to do with each term."""
    if out_col in docs.columns:
        raise ValueError(f"docs have a column {out_col} already")
    more = "_" * max(map(len, docs.columns))  # makes names that no column of docs has
    key, terms, base = f"key{more}", f"terms{more}", f"base{more}"
    told = materialize(disclosing_terms(docs, id_col, text_col), "pii-document-terms").withColumnsRenamed({"pii_key": key, "terms": terms})
    joined = docs.withColumns({key: _key(id_col, text_col), base: _base(text_col)}).join(small(told), key, "left")
    every = F.concat(*[F.col(base)[k] for k in KINDS])
    spans = F.when(F.col(terms).isNotNull(), term_spans(_text(text_col), F.col(terms), every)).otherwise(F.array().cast(_SPANS))
    return joined.select(*docs.columns, F.struct(*[F.col(base)[k].alias(k) for k in KINDS], spans.alias("term"), F.col(terms).alias("terms")).alias(out_col))


def rewrite(text: Column, spans: Column) -> Column:
    """``text`` with labels for ``spans`` (start, end, label), which are sorted and may overlap.

    A span that reaches further than those before it puts its label after what lies between. Runs of spans
    are cut out of the text first, so that none is sought from the text's start.
    """

    def of(x: Column) -> Column:
        reach = running(F.transform(x, lambda s: s["end"]), F.lit(0), lambda a, e: F.greatest(a, e))

        def cuts(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
            each = F.transform(x, lambda s, i: F.struct(before(i).alias("at"), F.greatest(s["start"], before(i)).alias("start"), s["end"].alias("end"), s["label"].alias("label")))
            return F.filter(each, lambda s: s["end"] > s["at"])

        def parts(c: Column) -> Column:
            def run(k: Column) -> Column:
                own = F.slice(c, k * RUN + 1, F.lit(RUN))

                def cut(some: Column) -> Column:
                    first, last = F.element_at(some, 1)["at"], F.element_at(some, -1)["start"]
                    inside = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))
                    return let(inside, lambda t: F.array_join(F.transform(some, lambda s: F.concat(F.substring(t, (s["at"] - first + 1).cast("int"), (s["start"] - s["at"]).cast("int")), s["label"])), ""))

                return let(own, cut)

            runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int")), run)
            return F.concat(F.array_join(runs, ""), F.substring(text, (F.element_at(c, -1)["end"] + 1).cast("int"), F.lit(2147483647)))

        return let(let(reach, cuts), parts)

    return let(spans, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(text))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its label or class, or removed; texts without spans stay as they are."""
    out = "pii" + "_" * max(map(len, docs.columns))
    found = find_spans(docs, id_col, text_col, out)
    spans = F.col(out)

    def labelled(kind: str, label) -> Column:
        return F.transform(spans[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s["value"]).alias("label")))

    def wider(value: Column) -> Column:
        gone = F.exists(spans["terms"], lambda t: t["gone"] & (t["term"] == F.lower(value)))
        form = F.when(gone, "")
        for pattern, label in CLASSES:
            form = form.when(value.rlike(pattern), label)
        return form

    every = F.array_sort(F.concat(*[labelled(k, lambda _, k=k: F.lit(LABELS[k])) for k in KINDS], labelled("term", wider)))
    return found.withColumn(text_col, rewrite(F.col(text_col), every)).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def say(kind: str) -> Column:
        return F.transform(f"pii_spans.{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    said = {k: say(k) for k in (*KINDS, "term")}
    return found.select(
        "doc_id", *[F.size(f"pii_spans.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[said[k] for k in KINDS]), ","), 256).alias("base_sha256"), F.array_join(F.concat(*said.values()), ",").alias("spans"),
    )
