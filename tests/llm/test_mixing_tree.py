"""The whole mix against SQL with a tree of many shards; what is returned comes from the tree's leaves."""

import random

import duckdb
import pytest

from sparkredact.llm import mixing

R = random.Random(7)
ROWS = [(i, " ".join("w" for _ in range(R.choice([0, 1, 5, 30, 60, 400]))), R.choice([None, "a", "b", "c", "d", "d", "d", "d"])) for i in range(300)]
ROWS += [(300, None, "a"), (300, "other text of the id", "a"), (301, "w " * 3000, "e")]


def say(draws):
    return ",".join(f"{d['pass']}:{d.block}:{d.words}:{d.shard}:{d.place}" for d in draws)


@pytest.mark.parametrize("shard_words", [500, 10**9])
def test_against_sql(spark, shard_words):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken, say(r.draws)) for r in mixing.mix_plan(docs, shard_words=shard_words).collect())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", ROWS)
    want = sorted((r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in con.execute(mixing.op8_sql(shard_words)).fetchall())
    assert got == want
    shards = {d.split(":")[3] for r in got for d in r[5].split(",") if d}
    assert len(shards) == 1 if shard_words > 10**6 else len(shards) > 16


def test_leaves_decide(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = mixing.mix_plan(docs, shard_words=500).collect()
    source = {r[0]: r[2] for r in ROWS}
    for s in {r[2] for r in ROWS}:
        own = [r for r in rows if source[r.doc_id] == s]
        assert all(r.taken <= 3 * r["size"] and r.taken == sum(d.words for d in r.draws) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    real = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a: real(*a).filter("shard <> 3"))
    less = mixing.mix_plan(docs, shard_words=500).collect()
    lost = sum(d.words for r in rows for d in r.draws if d.shard == 3)
    assert lost > 0 and sum(r.taken for r in rows) - sum(r.taken for r in less) == lost


def test_take_with_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (1, "a b d", "s", 2), (None, "x y", None, 3), (2, None, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, draws int").withColumnRenamed("draws", "key")
    out = mixing.take(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {r for r in rows if r[1]}
    assert mixing.take(docs.limit(0)).count() == 0 and mixing.mix_plan(docs).count() == 5
