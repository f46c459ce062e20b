"""Token ids in Parquet list columns: written in ascending document order, read back selectively.

A file has the columns ``doc_id, shard, shard_start, n_tokens, tokens``. The list column is
dictionary-encoded (its ids are few), the running columns delta-encoded; row groups and pages have set
sizes, and page indexes let a reader skip to documents by ``doc_id`` and take metadata without ids. A
shard is a range of ids, sorted; ``shard_start`` is the number of ids before the document in its shard,
so a document's place in the whole needs the shards' totals only.

Defined cases: null text is empty and has the end id alone; null ids come last; rows with equal ids
follow each other by text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, slices, small, table
from .tokens import encode_column, ids_crc32

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, tokens array<int>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of ``docs`` under ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = encode_column(batch.column(1).to_pylist(), tokenizer, end_id)
            lens = np.array([len(x) for x in ids], dtype=np.int64)
            ends = np.cumsum(lens)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(done + ends - lens), pa.array(lens), lists], names=["doc_id", "shard", "shard_start", "n_tokens", "tokens"])
            done += int(lens.sum())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#shard_start": "false",
    }
    ranged.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The file columns and ``start``, the number of ids of all documents before; only columns asked for are read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(small(before), F.col("shard") == F.col("of")).drop("of").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows with ``tokens``."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sums = [ids_crc32(flat[at[i] : at[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer=tokenizer_path(), end_id=2)
    return with_crc32(read_tokens(spark, path))
