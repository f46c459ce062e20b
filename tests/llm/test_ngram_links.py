"""Links between classes come from DivideSkip alone; numbers of links, repeated ids, nulls, extra columns."""

import random

import pytest

from sparkredact.llm import ngram_join

WORDS = [f"w{i}" for i in range(5000)]


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w[: len(w) - r.randrange(4)]))
    return out


def corpus():
    r = random.Random(3)
    texts = [None, "", " ", "one", "One", "one two three four"]
    for size, n, edits in ((90, 70, 3), (40, 30, 2), (300, 25, 8), (12, 20, 1), (150, 12, 4)):
        base = [r.choice(WORDS) for _ in range(size)]
        texts += variants(r, base, n, edits) + [" ".join(base)] * 3
    passage = [r.choice(WORDS) for _ in range(60)]
    for _ in range(40):  # a passage that many hold, in texts that differ
        own = [r.choice(WORDS) for _ in range(r.randrange(5, 60))]
        texts.append(" ".join(own + passage))
    return texts


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts):
    sets = sets_of(texts)
    links = {i: set() for i in range(len(texts))}
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                links[i].add(j)
                links[j].add(i)
    return links


def reached(links, i):
    seen, todo = {i}, [i]
    while todo:
        todo += (new := links[todo.pop()] - seen)
        seen |= new
    return seen


@pytest.mark.parametrize("small_parts", [False, True])
def test_against_brute_force(spark, monkeypatch, small_parts):
    if small_parts:
        for name, value in dict(LOCAL_SHINGLES=300, LOCAL_CLASSES=7, SENT_ROWS=50, BLOCK_CLASSES=5, BLOCK_SHINGLES=800, PORTION_CLASSES=4).items():
            monkeypatch.setattr(ngram_join, name, value)
    texts = corpus()
    rows = [(i, t, -1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links int, class string")
    links = brute(texts)
    out, pairs = ngram_join.near_duplicates(df)
    got = {r.doc_id: (r.component_id, r.n_links, r.class_id) for r in out.collect()}
    sets = sets_of(texts)
    same = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    assert got == {i: (min(reached(links, i)), len(links[i]), same[frozenset(sets[i])] if sets[i] else i) for i in links}
    assert all(r.b in links[r.a] for r in pairs.collect())


def test_links_between_classes_come_from_the_search(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = sets_of(texts)
    found, _ = ngram_join.near_duplicates(df)
    assert found.filter("component_id <> class_id").count() > 50
    # in this process, the search finds what its inverted lists give and nothing without them
    import numpy as np

    block = ngram_join.Block([1, 2, 3], [4, 4, 5], [1, 1, 1], [np.array([1, 2, 3, 4]), np.array([5, 6, 7, 8]), np.array([1, 2, 3, 4, 9])])
    assert block.search(0, 4, np.array([1, 2, 3, 4])).tolist() == [0, 2]
    monkeypatch.setattr(ngram_join, "divide_skip", lambda lists, least: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert block.search(0, 4, np.array([1, 2, 3, 4])).tolist() == []
    calls = [c for c in ngram_join.Block.search.__code__.co_names if "skip" in c]
    assert calls == ["divide_skip"] and len({frozenset(s) for s in sets}) < len(sets)


def test_ids_that_repeat_or_are_null(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    rows = [(5, a), (5, b), (5, b), (None, a), (None, a + " more"), (7, b), (None, None), (8, None), (None, " ".join(WORDS[200:230]))]
    out, links = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect()), key=str)
    assert got == sorted([(5, 26, 5, 2), (5, 26, 5, 2), (5, 26, 5, 2), (None, 26, 5, 2), (None, 27, 5, 2), (7, 26, 5, 2), (None, 0, None, 0), (8, 0, 8, 0), (None, 26, None, 0)], key=str)
    assert out.select("group").distinct().count() == 4  # no words, a, b, the last
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_sets_travel_once(spark, monkeypatch):
    """Whole sets are exchanged on the way to the blocks only, also where nothing is broadcast."""
    plans, write = {}, ngram_join.materialize

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ngram_join, "materialize", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus()[:120]
        got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    links = brute(texts)
    assert {r.doc_id: r.n_links for r in got} == {i: len(links[i]) for i in links} and any(links.values())
    assert plans["block-links"].count("Exchange") == 1
