"""Quality rules by document and by host, with host failure rates shrunk by an empirical beta prior.

Each document gets counts (words, symbols, repeated lines, words in repeated 3-word windows) and the
base verdict. Failures are summed by host (the ``source`` column); the prior Beta(a, b) is fitted to
the hosts' rates by moments; a host is distrusted if its posterior mean rate exceeds
``max_host_rate``, and then all its documents go. Small hosts stay near the corpus rate, so a host
is not judged by a handful of documents.

All is array functions inside the row, one aggregation with a row for each host, and a join of narrow
rows with the hosts; no group of rows ever meets in one task. 3-word windows are compared by 64-bit
hash inside one text.

Defined cases: null or empty text has no words and fails; a null source belongs to no host, so such
a document stands on its own verdict; repeated rows count as documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, small, table, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host whose shrunk rate of failures is above this is distrusted.
MAX_HOST_RATE = 0.5
WINDOW = 3


def repeated_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``ws``, first ones included."""

    def covered(h: Column) -> Column:
        # windows ordered by (hash, place); those with an equal neighbour repeat
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        # a window adds as many words as lie before the next repeated window, three at most
        count = lambda p: F.aggregate(p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
        return let(let(ordered, places), count)

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(WINDOW)]))
    none = F.lit(0).cast("long")
    return F.when(F.size(ws) < WINDOW, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def document_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        *keep, let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"))).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.select(*keep, F.col("w.n_words"), F.col("w.word_chars"), "n_symbols", "n_dup_lines", F.col("w.n_repeat_words")).withColumn("base_failed", failed)


def host_verdicts(counts: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, host_docs, host_failures, host_rate, host_ok)`` with rates shrunk to the prior.

    With the mean m and variance v of the hosts' rates, Beta(a, b) has a + b = m(1 - m)/v - 1. Where
    v leaves none (one host, or all alike), a + b is the mean number of documents of a host.
    """
    hosts = counts.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg("host_docs").alias("n"))
    strength = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.col("n"))
    prior = prior.select((F.col("m") * strength).alias("a"), strength.alias("s"))
    shrunk = (F.col("host_failures") + F.col("a")) / (F.col("host_docs") + F.col("s"))
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, its host's shrunk rate and ``kept``."""
    counts = materialize(document_counts(docs, text_col, (id_col, host_col)), "quality-counts")
    hosts = materialize(host_verdicts(counts, host_col, max_rate), "quality-hosts")
    joined = counts.join(small(hosts), counts[host_col] == hosts["host"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).drop("host")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, source, t, w, len(w) AS n_words FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM n WHERE n_words >= 3)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT n.doc_id, source, CAST(n_words AS BIGINT) AS n_words, CAST(length(list_aggregate(list_append(w, ''), 'string_agg', '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM n LEFT JOIN p ON p.doc_id = n.doc_id LEFT JOIN l ON l.doc_id = n.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
o AS (SELECT source, count(*) AS docs, sum(CAST(base_failed AS INT)) AS fails, sum(CAST(base_failed AS INT)) / count(*) AS r FROM f WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT avg(r) AS m, var_pop(r) AS v, avg(docs) AS n FROM o),
s AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE n END AS s FROM m),
k AS (SELECT source, (fails + m * s) / (docs + s) <= 0.5 AS ok FROM o, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM f LEFT JOIN k ON f.source = k.source
"""
