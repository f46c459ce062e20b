"""Sliding-window admission: a request is admitted if fewer than the limit were admitted in the window before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 60


def admissions(times: Column, limit: int, window_seconds: float = WINDOW_SECONDS) -> Column:
    """(ts, admitted) for sorted times in microseconds; what was refused doesn't count against later ones.

    An admission exactly as old as the window still counts. Only the admissions that can still count
    are kept while folding. A limit of 0 admits all.
    """
    if limit == 0:
        return F.transform(times, lambda t: F.struct(t.alias("ts"), F.lit(True).alias("admitted")))
    window = int(window_seconds * 1_000_000)
    start = F.struct(F.array().cast("array<bigint>").alias("held"), F.array().cast("array<struct<ts:bigint,admitted:boolean>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        held = F.filter(acc["held"], lambda h: h >= t - window)
        ok = F.size(held) < limit
        return F.struct(F.when(ok, F.concat(held, F.array(t))).otherwise(held).alias("held"), F.concat(acc["out"], F.array(F.struct(t.alias("ts"), ok.alias("admitted")))).alias("out"))

    return F.aggregate(times, start, step, lambda a: a["out"])


def rate_limit(df: DataFrame, key_col: str, ts_col: str, limit: int, window_seconds: float = WINDOW_SECONDS, order_col: str | None = None) -> DataFrame:
    """``df`` with ``admitted``, each key's rows in time order.

    The admissions of a key depend on one another, so a key's rows go through one task, but as a
    sorted stream of Arrow batches whose state is the admissions of one window, never the whole group.
    """
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    order = [key_col, "_micros", *([order_col] if order_col else [])]
    rows = df.withColumn("_micros", micros)
    schema = df.schema.add("admitted", "boolean")
    window = int(window_seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = object(), []
        for b in batches:
            out = []
            for k, t in zip(b[key_col], b["_micros"], strict=True):
                if k != key and not (pd.isna(k) and pd.isna(key)):
                    key, held = k, []
                held = [h for h in held if h >= t - window]
                ok = limit == 0 or len(held) < limit
                if ok and limit:
                    held.append(t)
                out.append(ok)
            yield b.drop(columns="_micros").assign(admitted=out)

    return rows.repartition(key_col).sortWithinPartitions(*order).mapInPandas(run, schema)
