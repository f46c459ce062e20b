"""Detection, audit counts and admission over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import WINDOW_SECONDS
from ..operators.pipeline import Config, detect


def detect_stream(stream: DataFrame, text_col: str = "text", config: Config = Config()) -> DataFrame:
    """The batch columns over a stream: stateless, so any output mode and trigger goes."""
    return detect(stream, text_col, config=config)


def audit_counts(detected: DataFrame, ts_col: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Entities by type in event-time windows; rows later than the watermark are left out."""
    rows = detected.withWatermark(ts_col, late).select(ts_col, F.explode("entities").alias("e"))
    return rows.groupBy(F.window(ts_col, window), F.col("e.type").alias("type")).agg(F.count("*").alias("entities"))


def rate_limit_stream(stream: DataFrame, key_col: str, ts_col: str, limit: int, window_seconds: float = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, ts, admitted); a key's state is its admissions of one window and goes once the watermark is a window past them.

    Rows are taken in time order within a micro-batch. Refused rows leave the state as it is.
    """
    kind = dict(stream.dtypes)[key_col]

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for t in rows["ts"]:
            now = t.value // 1000
            held = [h for h in held if h >= now - int(window_seconds * 1_000_000)]
            ok = limit == 0 or len(held) < limit
            if ok and limit:
                held.append(now)
            out.append(ok)
        state.update((held,))
        last = int(rows["ts"].max().value // 1_000_000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(window_seconds * 1_000) + 1)
        yield pd.DataFrame({"key": [key[0]] * len(rows), "ts": rows["ts"].to_numpy(), "admitted": out})

    rows = stream.select(F.col(key_col).alias("key"), F.col(ts_col).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(admit, f"key {kind}, ts timestamp, admitted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
