"""Small fixtures against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkredact.llm import divide_skip, language_id, mixing, ngram_join, packing, pii, pu_quality, quality_rules, shingles, token_files, tokens

R = random.Random(5)
VOCAB = ["alpha", "Beta", "gamma,", "delta", "éta", "x", "of", "the"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, r=R):
    return "".join(r.choice(VOCAB) + r.choice([" ", " ", "\n", "\t "]) for _ in range(n))


def near(text, r=R):
    w = text.split(" ")
    w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
    return " ".join(w)


BASE = [" ".join(f"w{R.randrange(10**6)}" for _ in range(120)) for _ in range(6)]
TEXTS = [None, "", " \n\t", "one two three", "One two\nthree", BASE[0], BASE[0].upper(), near(BASE[0]), near(near(BASE[0])), BASE[1], near(BASE[1]), BASE[2], BASE[3] + " " + BASE[4], BASE[4], prose(300), "word " * 400, "x" * 70_000 + " " + BASE[5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(grams)
        rep = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([(i, "short" if i < 90 else BASE[i % 6], "bad" if i < 95 else f"h{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(bad).collect()}
    assert not kept[92] and kept[200]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(sets):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_ngram_join(spark, docs):
    sets = shingle_sets(TEXTS)
    out, links = ngram_join.near_duplicates(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute_components(sets), strict=True))}
    assert all(a.a != a.b for a in links.collect())
    assert ngram_join.near_duplicates(docs.limit(0))[0].count() == 0


def test_ngram_join_of_a_large_near_group(spark):
    r = random.Random(2)
    base = " ".join(f"v{i}" for i in range(70))
    texts = [base] * 3
    for _ in range(60):
        t = base
        for _ in range(r.randrange(4)):
            t = near(t, r)
        texts.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(df)[0].collect()}
    assert list(got[i] for i in range(len(texts))) == brute_components(shingle_sets(texts))


def test_divide_skip():
    r = random.Random(4)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randrange(1, 40))) for _ in range(r.randrange(1, 12))]
        least = r.randrange(1, 12)
        count = Counter(x for y in lists for x in y)
        want = sorted((k, n) for k, n in count.items() if n >= least)
        assert sorted(divide_skip.divide_skip(lists, least)) == want == sorted(divide_skip.merge_skip(lists, least))


def test_shingles_by_segment(monkeypatch):
    want = shingles.shingle_set(prose(500, random.Random(1)))
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    assert (shingles.shingle_set(prose(500, random.Random(1))) == want).all()


def test_mixing(spark, docs):
    rows = mixing.mix_plan(docs, shard_words=200).collect()
    assert len(rows) == len(TEXTS)
    source = {i: [None, "a", "b", "c"][i % 4] for i in range(len(TEXTS))}
    size = {s: sum(r["size"] for r in rows if source[r.doc_id] == s) for s in ("a", "b", "c", None)}
    for s in size:
        own = [r for r in rows if source[r.doc_id] == s]
        assert all(r.taken <= 3 * r["size"] and r.taken == sum(d["words"] for d in r.draws) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].target <= 3 * size[s]
    assert sum({source[r.doc_id]: r.target for r in rows}.values()) == pytest.approx(sum(size.values()))
    again = {r.doc_id: r.draws for r in mixing.mix_plan(docs.repartition(3), shard_words=200).collect()}
    assert again == {r.doc_id: r.draws for r in rows}
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 37), (2, 5), (3, 22)], "rank int, blocks long")
    cells = mixing.shard_quotas(quotas, 3).collect()
    assert {k: sum(c.blocks for c in cells if c["rank"] == k) for k in (1, 2, 3)} == {1: 37, 2: 5, 3: 22}
    totals = [sum(c.blocks for c in cells if c.shard == k) for k in range(8)]
    assert max(totals) - min(totals) <= 1


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD = ["a  b", " a", "a ", "a\n b", "a\n  b", "", "   ", "don't  x", "a \n b", "<|endoftext|> hi", "é 12 3.4,5", "\n \n", "a   b", "tab\t x", "　 y"]


def test_encoder(path):
    e = tokens.TextEncoder(path, cache_parts=5)
    texts = ODD + [t or "" for t in TEXTS] + [prose(200)]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_and_packing(spark, docs, path, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs.repartition(5), out, tokenizer=path, end_id=2)
    got = {r.doc_id: r for r in token_files.with_crc32(token_files.read_tokens(spark, out)).collect()}
    at = 0
    for i, x in enumerate(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes()))
        at += len(x) + 1
    pieces = packing.token_pieces(docs, tokenizer=path, size=64, with_ids=True)
    packed = packing.pack(pieces, size=64).collect()
    seqs = {}
    for r in packed:
        x = [*ids[r.doc_id], 0]
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in ids)
    full = {r.sequence_id: len(r.ids) for r in packing.sequences(packing.pack(pieces, size=64), pieces).collect()}
    assert sum(full.values()) == sum(r.length for r in packed)
    token_files.write_tokens(docs.limit(0), out + "0", tokenizer=path, end_id=2)
    assert token_files.read_tokens(spark, out + "0").count() == 0 == packing.pack_documents(docs.limit(0)).count()


def test_best_fit_closes_the_fullest():
    b = packing.BestFit(10, limit=2)
    assert [b.place(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(k, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in v.split(".")), "phone": 9 <= len(d) <= 15, "card": 13 <= len(d) <= 19 and luhn}[k]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(k, m[0])] for k, p in PATTERNS.items()}


def test_pii(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab.@-+%0123459 ( )x,\n.") for _ in range(60)) for _ in range(1500)]
    texts += [None, "", "1.2.3.4.5.6.7.8", "a@b.c%d@e.f", "é😀 4111 1111 1111 1111 x@y.z", "a" * 50_000 + "@", "1" * 50_000, "a@" + "b." * 5_000 + "c", "+1" + " " * 20_000]
    reveal = "plain words here secretword john@x.org and more words there"
    texts += [reveal, reveal + " again", *["other plain words here and more there"] * 4]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    n = 0
    for row in pii.find_spans(df).collect():
        for k, want in base_spans(texts[row.doc_id]).items():
            assert [(s.start, s.end) for s in row.pii_spans[k]] == want, (k, texts[row.doc_id][:80])
        n += 1
    assert n == len(texts)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    k = len(texts) - 6
    assert clean[k] == "plain words here  [EMAIL] and more words there" and clean[k + 2] == texts[k + 2] and clean[1500] is None
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.sanitise(df).columns == df.columns
    assert hashlib.sha256(b"").hexdigest()


def test_language_id(spark):
    r = random.Random(9)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "straße", "über"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i in range(240) for k in [["aa", "bb"][i % 2]]]
    rows += [(240, None, "aa"), (241, "123 !", "bb"), (242, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language_id.identify(df, language_id.train_on_folds(df), ["doc_id"]).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].lang_pred == rows[i][2] and 0 < out[i].score <= 1 for i in held)
    assert [out[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3
    none = language_id.train_on_folds(df.limit(0))
    assert {x.lang_pred for x in language_id.identify(df.limit(5), none, ["doc_id"]).collect()} <= {"und"}


def test_pu_quality(spark):
    r = random.Random(8)
    make = lambda good: " ".join(("w%d" if good else "#$%%%d***") % r.randrange(999) for _ in range(60))
    rows = [(i, make(i % 4 > 0)) for i in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    model, prior = pu_quality.train_on_folds(df, labels)
    out = {x.doc_id: x.score for x in pu_quality.score(df, model, ["doc_id"]).collect()}
    assert all((out[i] >= pu_quality.THRESHOLD) == (i % 4 > 0) for i in range(600)) and 0.5 < prior < 0.95
    assert out[600] == out[601]
    none, _ = pu_quality.train_on_folds(df, labels.limit(0))
    assert {x.score for x in pu_quality.score(df.limit(3), none, ["doc_id"]).collect()} == {0.5}
    assert df.select(F.lit(1)).count() == 602
