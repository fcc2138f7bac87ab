"""Structured Streaming: freshness windows, sessions and a stateful streak of bad rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freshness(stream: DataFrame, by: str, ts: str, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Rows, first and last time per tumbling window; rows later than `late` are left out."""
    w = F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(by, F.col("w.start").alias("start"), "n", "first", "last")


def sessions(stream: DataFrame, by: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Islands of rows no further than `gap` apart."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def bad_streaks(stream: DataFrame, by: str, ts: str, bad: str, most: int) -> DataFrame:
    """(key, ts, streak): bad rows at which a key has had more than `most` in a row; the state is one counter a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for t, is_bad in zip(rows[ts], rows[bad], strict=True):
            streak = streak + 1 if is_bad else 0
            if streak > most:
                out.append((key[0], t, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["key", "ts", "streak"]).astype({"streak": "int64"})

    keyed = stream.select(F.col(by).cast("long").alias(by), ts, bad)
    return keyed.groupBy(by).applyInPandasWithState(run, "key long, ts timestamp, streak long", "streak long", "append", "NoTimeout")
