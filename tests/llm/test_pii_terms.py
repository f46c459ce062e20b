"""Terms against a brute-force PMI; texts with very many matches; repeated and null rows; clashing names."""

import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkredact.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def brute_terms(texts):
    """For each text, {term: whether it goes} of the terms that it has to lose."""
    docs = {(i, t or "") for i, t in texts}
    entities = {d: {m.lower() for m in EMAIL.findall(d[1])} for d in docs}
    terms = {d: set(re.findall(r"[^\W\d_]+", d[1].lower())) for d in docs}
    n, n_t, n_e, n_te = len(texts), Counter(), Counter(), Counter()
    for d in docs:
        n_e.update(entities[d])
        n_te.update((e, t) for e in entities[d] for t in terms[d])
    for i, t in texts:
        n_t.update(terms[i, t or ""])
    shown = defaultdict(bool)
    for (e, t), k in n_te.items():
        ic = math.log2(n / n_e[e])
        if k >= 2 and n_e[e] >= 2 and ic > 0 and math.log2(n * k / (n_t[t] * n_e[e])) >= ic - 1 - 1e-9:
            shown[t] |= k >= n_t[t]
    return {d: {t: shown[t] for t in terms[d] if t in shown} for d in docs}


def test_terms_against_brute_force(spark):
    r = random.Random(6)
    words = [a + b for a in "bcdfgh" for b in ("alpha", "beta", "Gamma", "DELTA", "x")]
    texts = []
    for i in range(150):
        t = " ".join(r.choice(words) for _ in range(r.randrange(3, 14)))
        if r.random() < 0.3:
            k = r.randrange(6)
            t += f" u{k}@mail{k % 2}.org " + r.choice(["", "Hint" + "abcdef"[k]])
        elif r.random() < 0.05:
            t += " Hinta"
        texts.append((i, t))
    texts.append((150, None))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_terms(texts)
    shown = 0
    for row in pii.find_spans(df).collect():
        got = {t.term: t.gone for t in row.pii_spans.terms or []}
        assert got == want[row.doc_id, row.text or ""], row.doc_id
        shown += len(got)
        kept = EMAIL.sub(lambda m: "\0" * len(m[0]), row.text or "")
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", kept) if m[0].lower() in got]
        assert [(s.start, s.end) for s in row.pii_spans.term] == spans
    assert shown > 10


def test_many_matches_cost_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"a{i}@b.org 4111 1111 1111 1111, +65 9123 {1000 + i % 9000} 10.0.{i % 256}.1" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = pii.sanitise(df).first()
        assert row.text == " ".join("[EMAIL] [CARD], [PHONE]" + " [IP]" for _ in range(n)) or "[EMAIL] [CARD]" in row.text
        assert "@" not in row.text
        return time.perf_counter() - start

    seconds(50)
    few, many = seconds(2_500), seconds(10_000)
    assert many < 12 * few + 5


def test_rewrite_of_overlaps(spark):
    r = random.Random(3)
    rows = []
    for _ in range(40):
        text = "".join(r.choice("aé😀 b") for _ in range(900))
        at = sorted(r.sample(range(900), 300))
        rows.append((text, sorted((a, min(900, a + r.randrange(1, 9)), r.choice("XYZ")) for a in at)))

    def plain(text, spans):
        pos, out = 0, ""
        for a, b, label in spans:
            if b > pos:
                out += text[pos:a] + label if a > pos else label
            pos = max(pos, b)
        return out + text[pos:]

    df = spark.createDataFrame(rows, "text string, spans array<struct<start:bigint,end:bigint,label:string>>")
    assert [x[0] for x in df.select(pii.rewrite(F.col("text"), F.col("spans"))).collect()] == [plain(*x) for x in rows]


def test_clashing_names_and_classes(spark):
    reveal = "Secretname and CODEX lowword ann@x.org"
    rows = [(1, reveal, "KEEP", 5), (1, reveal, "KEEP", 5), (2, reveal + " end", "KEEP", 6), (None, None, None, None), (3, "codex secretname lowword alone", "KEEP", 7), (4, "and other", "K", 1)] + [(9 + i, "end and", "K", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_email string, pii_spans int")
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.schema == df.schema
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(rows) and {r[2] for r in got} == {"KEEP", "K", None}
    assert [r[1] for r in got if r[0] == 1] == ["[NAME] and [ACRONYM] [TERM] [EMAIL]"] * 2
    assert pii.sanitise(df.limit(0)).count() == 0
