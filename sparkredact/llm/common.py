"""What the operators of this subpackage share: words, shared storage, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only after its rows were counted, if with the bytes of a row they come to this at most.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 160
BROADCAST_ROWS = BROADCAST_BYTES // ROW_BYTES

#: Rows of an Arrow batch that a worker takes and sends on at once.
SLICE_ROWS = 512
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, one of our own if all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share; intermediate tables go there")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="sparkredact-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/sparkredact/{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Meanwhile Arrow batches have ``SLICE_ROWS`` rows at most, as a batch lies in memory twice, beside the JVM's heap and in the worker.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(min(SLICE_ROWS, int(before)) if int(before) > 0 else SLICE_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_ROWS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its counted rows, of ``row_bytes`` each, come to BROADCAST_BYTES at most, else unchanged."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable) -> Iterable:
    """Arrow batches in slices of few rows, so that what a worker holds beside a batch is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def give_back() -> None:
    """Free the encoder that tasks of another operator left in this worker, as Spark uses its workers again.

    For tasks that hold much and encode nothing; those that encode build it anew when there is none.
    """
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is None or not tokens.encoder.cache_info().currsize:
        return
    tokens.encoder.cache_clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors give back what earlier work grew their heaps by and left empty, which a JVM else keeps.

    A collection in each core's task: an executor whose cores are all busy is left as it is. For work that needs little
    of the JVM and much beside it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()
