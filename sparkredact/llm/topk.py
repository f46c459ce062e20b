"""Exact top-k inner-product search: columnar branch and bound.

Vectors are turned into integers and laid out vertically, one array per dimension. For a query, the
dimensions go by falling weight; scores are accumulated block of dimensions by block, and after each
block Cauchy-Schwarz on the remaining mass bounds what a candidate can still gain. Candidates whose
upper bound is below the k-th lower bound are dropped and the survivors compacted, so later blocks
touch few columns. Bounds only ever drop candidates that can't be among the k, so results are exact.

Queries go in blocks of bounded rows and bytes that every task gets, and the candidates are read once a
block, so blocks are as large as a worker holds easily; each task keeps k candidates a query,
and these are merged by query. Vectors with a null, NaN or infinite component, null vectors and null
ids take no part. Vectors are compared only with queries of as many dimensions. Rows that repeat a
query's id are the query's own; a repeated candidate id counts once a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, table

SCALE = 1024.0
#: Queries of a block at most, and their components' bytes at most.
QUERY_BLOCK, QUERY_BYTES = 16_384, 8 << 20
DIM_BLOCK = 16
OUT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    known = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: fine(x.cast("double"))))
    return known.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def by_dimension(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vertical matrix of dims x n) for each number of dimensions in a list column."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else lens
    for d in np.unique(lens):
        own = np.nonzero(lens == d)[0]
        yield ids[own], flat[starts[own][None, :] + np.arange(d)[:, None]]


class QueryBlock:
    """Queries of one dimension with the masses (norms) of what remains after each block of dimensions."""

    def __init__(self, ids: np.ndarray, vertical: np.ndarray):
        self.ids, self.q = ids, vertical.T.copy()
        self.order = np.argsort(-np.abs(self.q), axis=1, kind="stable")

    def search(self, ids: np.ndarray, x: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Merge the candidates ``x`` (dims x n) into ``best``, the (scores, ids) of each query so far."""
        dims = x.shape[0]
        top = float(np.abs(x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(dims, 1)
        kind = np.float64 if top < 2**52 else object
        x, squares = x.astype(kind), x.astype(np.float64) ** 2
        for i, own in enumerate(self.ids):
            q, order = self.q[i].astype(kind), self.order[i]
            alive = np.nonzero(ids != own)[0]
            score = np.zeros(len(alive), dtype=kind)
            x_left, q_left = squares.sum(axis=0)[alive] if kind is object else self._mass(squares)[alive], float((self.q[i].astype(np.float64) ** 2).sum())
            floor = best[i][0][-1] if len(best[i][0]) >= k else None
            for at in range(0, dims, DIM_BLOCK):
                some = order[at : at + DIM_BLOCK]
                part = x[some] if len(alive) == x.shape[1] else x[np.ix_(some, alive)]
                score = score + q[some] @ part
                x_left = np.maximum(x_left - (squares[some] if len(alive) == x.shape[1] else squares[np.ix_(some, alive)]).sum(axis=0), 0)
                q_left = max(q_left - float((self.q[i][some].astype(np.float64) ** 2).sum()), 0.0)
                if at + DIM_BLOCK >= dims or len(alive) <= k:
                    continue
                gain = np.sqrt(x_left * q_left) * (1 + 1e-9) + 1
                now = score.astype(np.float64)
                low = np.partition(now - gain, len(now) - k)[len(now) - k]
                low = max(low, float(floor)) if floor is not None else low
                keep = now + gain >= low
                alive, score, x_left = alive[keep], score[keep], x_left[keep]
            scores = np.concatenate([best[i][0], np.array([int(s) for s in score], dtype=object) if kind is object else score.astype(np.int64)])
            them = np.concatenate([best[i][1], ids[alive]])
            first = np.lexsort((them, [-s for s in scores] if kind is object else -scores))[:k]
            best[i] = scores[first], them[first]

    def _mass(self, squares: np.ndarray) -> np.ndarray:
        if getattr(self, "_of", None) is not squares:
            self._of, self._sum = squares, squares.sum(axis=0)
        return self._sum


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best candidates for each query; both (vec_id, v)."""
    spark = queries.sparkSession
    asked = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(query_block, QUERY_BYTES // (8 * max(dims, 1))))))
    found: DataFrame | None = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        held = [(i, v.astype(np.int64)) for i, v in by_dimension(rows["vec_id"].to_numpy(), rows["v"].combine_chunks())] if rows.num_rows else []
        sent = spark.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            groups = {v.shape[0]: QueryBlock(i, v) for i, v in sent.value}
            best = {d: [(np.array([], dtype=np.int64), np.array([], dtype=np.int64)) for _ in g.ids] for d, g in groups.items()}
            for batch in batches:
                for ids, x in by_dimension(batch.column(0).to_numpy(), batch.column(1)):
                    if x.shape[0] in groups:
                        groups[x.shape[0]].search(ids, x, best[x.shape[0]], k)
            for d, g in groups.items():
                n = [len(s) for s, _ in best[d]]
                if sum(n):
                    cols = np.repeat(g.ids, n), np.concatenate([i for _, i in best[d]]), np.concatenate([s for s, _ in best[d]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        part = candidates.select("vec_id", "v").mapInArrow(search, OUT)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(every.filter(F.col("vec_id") % 100 == 0), every)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d, len(v) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM e q JOIN e c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
