"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in a pseudo-random order, pass after pass. A pass is cut
into blocks of equal length, the rest of it being a shorter one. A source's quota is the number of blocks
that its target takes: whole passes, then blocks of one more pass in a permuted order, the last one in part.
The tree shares the quotas out among output shards: at each node, half of the node's blocks go left, and how
many of each source is a multivariate hypergeometric draw, done exactly by selection sampling on the counts
alone. A leaf so has a number of blocks of each source, and takes the next ones in the source's permuted
order: disjoint, and each once a pass. What a document gives is what of it lies in blocks that leaves have
taken; inside a shard, these draws have a hashed order of their own.

Only DataFrame functions are used. Documents meet by (source, hash bucket), of which each source has 4096,
so a source with a third of all rows is spread over thousands of groups; what is kept for a source or bucket
is a sum. Drawn blocks meet the shards by (source, block), where a block's documents are few. Quotas of all
sources lie in one row for each node; sources are meant to be few, as every one has a weight.

Defined cases: null text has size 0 and takes nothing; null source is a source of its own, ordered last;
repeated rows are separate documents, and rows with equal ids go by their text; an empty table gives an
empty result; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, let, materialize, small, table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"
SHARD_WORDS = 4_000_000
BLOCKS_PER_SHARD = 64
BUCKET_HEX = 3
#: Primes; a block's place in the permuted order is its number times one that doesn't divide their number.
STRIDES = (1_000_003, 999_983)
#: Blocks of a source that a step of the tree's sampling holds as an array.
RUN = 4_096
DRAW = "array<struct<pass:bigint,block:bigint,words:bigint,head:boolean,shard:bigint,place:bigint>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number(*parts: Column) -> Column:
    """48 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row for each source.

    A source's weight goes by its rank in code point order (null last), weights repeating. All words
    are shared by weight; a target stops at ``max_repeat`` times its source and the excess is reshared.
    With sources ordered by cap over weight, a source stops exactly if what is left for it and those
    after it, shared by weight, reaches its cap; so one running sum replaces the rounds.
    """
    ranked = sizes.select("source", "source_size", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    cap = F.col("source_size") * float(max_repeat)
    every, by = W.partitionBy(), W.orderBy((cap / F.col("weight")).asc(), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    sums = weighted.select(
        "*", cap.alias("cap"), F.sum("source_size").over(every).cast("double").alias("total"), F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum(cap).over(by), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(by), F.lit(0.0)).alias("weight_before"),
    )
    full = sums.withColumn("full", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("all_weight") - F.col("weight_before")))
    left = full.select(
        "*", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)).alias("full_cap"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(every), F.lit(0.0)).alias("full_weight"),
    )
    share = (F.col("total") - F.col("full_cap")) * F.col("weight") / (F.col("all_weight") - F.col("full_weight"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(share)
    return left.select("source", "source_size", "rank", target.alias("target"), F.floor(target + 0.5).cast("long").alias("want"))


def _split(node: Column, quotas: Column, seed: str) -> Column:
    """Quotas of the left child: half of the node's blocks, drawn without replacement.

    Source by source and block by block, a block goes left with probability (places left) / (blocks
    left); the counts that come out are a multivariate hypergeometric draw.
    """
    longs = "array<bigint>"
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(F.floor(total / 2).cast("long").alias("places"), total.alias("left"), F.array().cast(longs).alias("got"))

    def source(acc: Column, q: Column) -> Column:
        first = F.struct(acc["places"].alias("places"), acc["left"].alias("left"))

        def block(a: Column, j: Column) -> Column:
            u = number(F.lit(seed), node, F.size(acc["got"]), j) / float(1 << 48)
            return F.struct((a["places"] - F.when(u * a["left"] < a["places"], 1).otherwise(0)).alias("places"), (a["left"] - 1).alias("left"))

        def run(a: Column, k: Column) -> Column:
            return F.aggregate(F.sequence(k * RUN, F.least(k * RUN + RUN, q) - 1), a, block)

        runs = F.when(q > 0, F.sequence(F.lit(0).cast("long"), F.floor((q - 1) / RUN).cast("long"))).otherwise(F.array().cast(longs))
        return let(F.aggregate(runs, first, run), lambda b: F.struct(b["places"].alias("places"), b["left"].alias("left"), F.concat(acc["got"], F.array(acc["places"] - b["places"])).alias("got")))

    return F.aggregate(quotas, start, source, lambda a: a["got"])


def shard_quotas(quotas: DataFrame, depth: int, seed: str = SEED) -> DataFrame:
    """``quotas(rank, blocks)`` to ``(rank, shard, first, blocks)``: the blocks of each source that each of 2**depth shards takes."""
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("x"))
    nodes = one.select(F.lit(0).cast("long").alias("node"), F.transform("x", lambda s: s["blocks"]).alias("q"), F.transform("x", lambda s: s["rank"]).alias("ranks"))
    for level in range(depth):
        got = nodes.withColumn("l", _split(F.col("node"), F.col("q"), f"{seed}/{level}"))
        right = F.zip_with("q", "l", lambda a, b: a - b)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        nodes = got.select("ranks", F.explode(both).alias("c")).select("c.node", "c.q", "ranks")
        if level % 6 == 5:  # 64 times as many nodes as before
            nodes = nodes.repartition("node")
    cells = nodes.select("node", F.explode(F.arrays_zip("ranks", "q")).alias("c")).select(F.col("c.ranks").alias("rank"), F.col("node").alias("shard"), F.col("c.q").alias("blocks"))
    before = F.coalesce(F.sum("blocks").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cells.select("rank", "shard", before.alias("first"), "blocks").filter("blocks > 0")


def _keys(docs: DataFrame, id_col: str, text_col: str, seed: str) -> tuple[Column, Column]:
    """A document's place in its stream, and what tells rows apart that have equal ids and texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    return key, F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t and t != "variant"])


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, key, row, size, source_size, target, taken, draws)`` of every row of ``docs``.

    ``draws`` has a (pass, block, words, head, shard, place) for each drawn block that the document lies in,
    ``head`` if its first word is drawn there; ``key`` and ``row`` are those of ``take``.
    """
    key, row = _keys(docs, id_col, text_col, seed)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), key.alias("key"), row.alias("row"))
    base = materialize(base.withColumn("bucket", F.substring("key", 1, BUCKET_HEX)), "mix-sizes")
    buckets = materialize(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = materialize(source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat), "mix-targets")
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("want"), F.lit(0))).first()
    depth = max(0, (max(1, total // shard_words) - 1).bit_length())
    block = max(1, total // (BLOCKS_PER_SHARD << depth))
    sizes = targets.withColumns({"whole": F.floor(F.col("source_size") / block), "passes": F.floor(F.col("want") / F.greatest("source_size", F.lit(1)))})
    sizes = sizes.withColumns({"own": F.col("whole") + (F.col("source_size") > F.col("whole") * block).cast("long"), "rest": F.col("want") - F.col("passes") * F.col("source_size")})
    sizes = sizes.withColumn("more", F.least(F.ceil(F.col("rest") / block), F.col("own")))
    quotas = materialize(sizes.withColumns({"blocks": F.col("passes") * F.col("own") + F.col("more"), "last": F.when(F.col("more") > 0, F.col("rest") - (F.col("more") - 1) * block).otherwise(block)}), "mix-quotas")
    shards = materialize(shard_quotas(quotas.select("rank", "blocks"), depth, seed), "mix-shards")
    drawn = shards.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("draw"))

    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = base.withColumn("inside", inside).join(small(offsets), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    per_source = quotas.select(F.col("source").alias("s"), "rank", "source_size", "target", "whole", "own", "blocks", "last")
    placed = placed.withColumn("at", F.col("before") + F.col("inside")).join(small(per_source, n_sources), F.col("source").eqNullSafe(F.col("s")))

    def lies(p: int) -> Column:
        n = F.greatest("whole", F.lit(1))
        stride = F.when(n % STRIDES[0] != 0, STRIDES[0]).otherwise(STRIDES[1])
        shift = number(F.lit(seed), F.coalesce("source", F.lit("")), F.lit(p))

        def draw(x: Column) -> Column:
            draw = F.col("own") * p + F.when(x < F.col("whole"), (x * stride + shift) % n).otherwise(F.col("whole"))
            end = F.least(F.col("at") + F.col("size"), x * block + F.when(draw == F.col("blocks") - 1, F.least(F.col("last"), F.lit(block))).otherwise(block))
            words = end - F.greatest("at", x * block)
            return F.struct(F.lit(p).cast("long").alias("pass"), x.alias("block"), words.alias("words"), (x * block <= F.col("at")).alias("head"), draw.alias("draw"))

        return F.transform(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)), draw)

    every = F.when(F.col("size") > 0, F.concat(*map(lies, range(max_repeat))))
    wanted = F.filter(F.coalesce(every, F.array().cast("array<struct<pass:bigint,block:bigint,words:bigint,head:boolean,draw:bigint>>")), lambda d: (d["draw"] < F.col("blocks")) & (d["words"] > 0))
    placed = materialize(placed.select("doc_id", "key", "row", "rank", "at", "size", "source_size", "target", wanted.alias("draws")), "mix-placed")
    # a document that gives words is told by where it starts
    each = placed.filter(F.size("draws") > 0).withColumn("d", F.explode("draws")).withColumn("draw", F.col("d.draw")).drop("draws")
    met = each.join(small(drawn), ["rank", "draw"])
    place = number(F.lit(seed), F.col("d.pass"), F.col("d.block"), F.col("key"))
    one = F.struct("d.pass", "d.block", "d.words", "d.head", F.col("shard").cast("long").alias("shard"), place.alias("place"))
    same = ["doc_id", "key", "row", "size", "source_size", "target"]
    taken = met.groupBy("rank", "at", *same).agg(F.sum("d.words").alias("taken"), F.array_sort(F.collect_list(one)).cast(DRAW).alias("draws")).drop("rank", "at")
    none = placed.filter(F.size("draws") == 0).select(*same, F.lit(0).cast("long").alias("taken"), F.array().cast(DRAW).alias("draws"))
    return taken.unionByName(none)


def take(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """A row of ``docs`` for each time that the mix takes a document's first word, by shard and in the shard's order.

    Texts stay whole, so a source comes near its target but for documents that lie across the ends of blocks.
    """
    plan = mix_plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options)
    more = "_" * max(map(len, docs.columns))  # makes names that no column of docs has
    key, row, shard, place = (n + more for n in ("key", "row", "shard", "place"))
    short = lambda k: F.conv(F.substring(k, 1, 15), 16, 10).cast("long")
    heads = plan.filter("taken > 0").select(short(F.col("key")).alias(key), F.col("row").alias(row), F.explode(F.filter("draws", lambda d: d["head"])).alias("d"))
    heads = materialize(heads.select(key, row, F.col("d.shard").cast("int").alias(shard), F.col("d.place").alias(place), F.col("d.pass").alias("p")), "mix-takes")
    keys = _keys(docs, id_col, text_col, seed)
    keyed = docs.withColumns({key: short(keys[0]), row: keys[1]})
    if not heads.groupBy(key, row, "p").count().filter("count > 1").isEmpty():  # rows alike in all: any stands for them
        keyed = keyed.dropDuplicates([key, row])
    taken = keyed.join(small(heads.drop("p"), row_bytes=48), [key, row])
    return taken.repartition(shard).sortWithinPartitions(shard, place, key).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    say = F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["block"].cast("string"), d["words"].cast("string"), d["shard"].cast("string"), d["place"].cast("string")))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(say, ",").alias("draws"))


def op8_sql(shard_words: int = SHARD_WORDS) -> str:
    """The whole of it in DuckDB's SQL: targets, quotas, the tree block by block, draws. Block numbers go from 0."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM c
      WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - cap_before) * weight >= cap * (all_weight - weight_before) AS is_full FROM b),
l AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS full_cap, coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0) AS full_weight FROM f),
t AS (SELECT source, rank, source_size, CASE WHEN is_full THEN cap ELSE (total - full_cap) * weight / (all_weight - full_weight) END AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM t),
h0 AS (SELECT coalesce(sum(want), 0)::BIGINT AS total FROM g),
h1 AS (SELECT total, CASE WHEN total // {shard_words} <= 1 THEN 0 ELSE length(bin(total // {shard_words} - 1)) END::INT AS depth FROM h0),
h AS (SELECT depth, greatest(1, total // (64 * (1::BIGINT << depth)))::BIGINT AS block FROM h1),
q0 AS (SELECT *, source_size // block AS whole, want // greatest(source_size, 1) AS passes FROM g, h),
q1 AS (SELECT *, whole + CAST(source_size > whole * block AS BIGINT) AS own, want - passes * source_size AS rest FROM q0),
q2 AS (SELECT *, least((rest + block - 1) // block, own) AS more FROM q1),
q AS (SELECT *, passes * own + more AS blocks, CASE WHEN more > 0 THEN rest - (more - 1) * block ELSE block END AS last FROM q2),
n AS (SELECT 0 AS level, 0::BIGINT AS node, list(blocks::BIGINT ORDER BY rank) AS q, (sum(blocks) // 2)::BIGINT AS places, sum(blocks)::BIGINT AS rest, 0::BIGINT AS j, []::BIGINT[] AS got, 0::BIGINT AS own FROM q HAVING count(*) > 0
  UNION ALL
  SELECT level + side.up, node * (1 + side.up) + side.r,
    CASE WHEN side.up = 0 THEN q WHEN side.r = 0 THEN got ELSE list_transform(q, lambda x, i: x - got[i]) END,
    CASE WHEN side.up = 0 THEN places - take WHEN side.r = 0 THEN list_sum(got)::BIGINT // 2 ELSE (list_sum(q)::BIGINT - list_sum(got)::BIGINT) // 2 END,
    CASE WHEN side.up = 0 THEN rest - one WHEN side.r = 0 THEN list_sum(got)::BIGINT ELSE list_sum(q)::BIGINT - list_sum(got)::BIGINT END,
    CASE WHEN side.up = 0 AND one = 1 THEN j + 1 ELSE 0 END,
    CASE WHEN side.up = 1 THEN [] WHEN one = 1 THEN got ELSE list_append(got, own) END,
    CASE WHEN side.up = 0 AND one = 1 THEN own + take ELSE 0 END
  FROM (SELECT *, CAST(j < q[len(got) + 1] AS INT) AS one, CAST(j < q[len(got) + 1] AND ('0x' || substr(md5('mix/' || level || ':' || node || ':' || len(got) || ':' || j), 1, 12))::BIGINT / 281474976710656.0 * rest < places AS INT) AS take
        FROM n, h WHERE level < depth AND len(got) < len(q) UNION ALL SELECT n.*, h.*, 0, 0 FROM n, h WHERE level < depth AND len(got) = len(q)) m,
       (VALUES (0, 0), (1, 0), (1, 1)) side(up, r) WHERE side.up = CAST(len(got) = len(q) AS INT)),
v AS (SELECT node AS shard, unnest(range(1, len(q) + 1)) AS rank, unnest(q) AS blocks FROM n, h WHERE level = depth),
y AS (SELECT rank, shard, blocks, coalesce(sum(blocks) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM v),
z AS (SELECT rank, shard, unnest(range(first::BIGINT, (first + blocks)::BIGINT)) AS draw FROM y),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d),
e0 AS (SELECT p.doc_id, p.k, p.size, p.pos, q.*, pass, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS x FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source, (VALUES (0), (1), (2)) o(pass) WHERE size > 0),
e1 AS (SELECT *, pass * own + CASE WHEN x < whole THEN (x * CASE WHEN whole % 1000003 <> 0 THEN 1000003 ELSE 999983 END + ('0x' || substr(md5('mix:' || coalesce(source, '') || ':' || pass), 1, 12))::BIGINT) % greatest(whole, 1) ELSE whole END AS draw FROM e0),
e2 AS (SELECT *, least(pos + size, x * block + CASE WHEN draw = blocks - 1 THEN least(last, block) ELSE block END) - greatest(pos, x * block) AS words FROM e1 WHERE draw < blocks),
e AS (SELECT e2.k, e2.pos, e2.rank, words, pass, x, shard, ('0x' || substr(md5('mix:' || pass || ':' || x || ':' || k), 1, 12))::BIGINT AS place FROM e2 JOIN z ON z.rank = e2.rank AND z.draw = e2.draw WHERE words > 0),
a AS (SELECT rank, pos, sum(words)::BIGINT AS taken, string_agg(pass || ':' || x || ':' || words || ':' || shard || ':' || place, ',' ORDER BY pass, x) AS draws FROM e GROUP BY 1, 2)
SELECT p.doc_id, p.size, q.source_size, q.target, coalesce(a.taken, 0) AS taken, coalesce(a.draws, '') AS draws
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source LEFT JOIN a ON a.rank = q.rank AND a.pos = p.pos AND p.size > 0
"""


OP8_SQL = op8_sql()
