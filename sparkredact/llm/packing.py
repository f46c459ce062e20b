"""Best-fit packing into sequences of bounded length, online and with a fixed number of open bins.

Documents longer than a sequence are cut so that all pieces but the first are full; full pieces are
sequences of their own. The others are packed as they arrive: each goes to the open bin with the least free
space that holds it. Open bins are kept by free space, and a bitset says which free spaces occur, so the
best bin is the lowest set bit at or above the piece's length. The number of open bins is fixed; when one
more is needed, the fullest is closed.

Pieces are dealt by hash to tasks, about ``GROUP_PIECES`` each, and arrive in the order of their documents;
a task holds its open bins only. What tasks leave open is little against what they fill.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; rows with a null id
come first; equal ids go by piece and content; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .token_files import tokenizer_path
from .tokens import encode_column, ids_crc32

SEQUENCE = 2048
OPEN_BINS = 256
GROUP_PIECES = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_points(n: int, size: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: the first has n mod ``size`` ids, or ``size``."""
    return [0, *range((n - 1) % size + 1, n, size)]


def token_pieces(docs: DataFrame, *, tokenizer: str, end_id: int = 0, size: int = SEQUENCE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids, at most ``size`` long; with their ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode_column(batch.column(1).to_pylist(), tokenizer, end_id), strict=True):
                at = cut_points(len(ids), size)
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    rows.append((doc, k, a, b - a, ids_crc32(ids[a:b]), ids[a:b].astype(np.int32)) if with_ids else (doc, k, a, b - a, ids_crc32(ids[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


class BestFit:
    """Bins of ``size`` with at most ``limit`` open ones; ``place`` gives a piece's bin and offset."""

    def __init__(self, size: int = SEQUENCE, limit: int = OPEN_BINS):
        self.size, self.limit = size, limit
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
        self.bits = 0  # which of these lists have a bin
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_

    def _put(self, bin_: int, space: int) -> None:
        if space:
            self.free[space].append(bin_)
            self.bits |= 1 << space
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            bin_ = self._take(space)
        else:
            if length < self.size and self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, space, self.made = self.made, self.size, self.made + 1
        self._put(bin_, space - length)
        return bin_, self.size - space


def pack(pieces: DataFrame, *, size: int = SEQUENCE, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES, count: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = TaskContext.get().partitionId() << 40, BestFit(size, open_bins)
        for b in slices(batches):
            at = [bins.place(n) for n in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + s for s, _ in at], type=pa.int64()), pa.array([o for _, o in at], type=pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    groups = max(1, -(-(pieces.count() if count is None else count) // group_pieces))
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32", "length").mapInArrow(place, PACKED)


def sequences(packed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences, put together from pieces that carry their ids.

    Repeated rows have the same pieces, so one of each will do.
    """
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    own = pieces_with_ids.select(*[F.col(c).alias(f"own_{c}") for c in same], "ids").dropDuplicates([f"own_{c}" for c in same])
    rows = packed.join(own, [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in same])
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    pieces = materialize(token_pieces(docs, tokenizer=tokenizer or tokenizer_path(), size=size), "pieces")
    return pack(pieces, size=size)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
