"""Structured Streaming forms: idempotent append, tumbling and sliding bars, keyed latches and trackers.

All take a streaming (or batch) DataFrame of ticks or bars and return one; the
caller picks sink and trigger.  Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def bar_columns():
    """Aggregates of a bar over ``price, ts, volume``."""
    return [
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n_ticks"),
    ]


def append_once(rows: DataFrame, keys: list[str], time_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, however often it arrives within the watermark."""
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def tumbling_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of fixed intervals, given out when the watermark has passed their end."""
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "symbol").agg(*bar_columns())
    return out.select("symbol", F.col("w.start").alias("minute"), *[c for c in out.columns if c not in ("w", "symbol")])


def sliding_volume(ticks: DataFrame, span: str = "6 hours", step: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Volume and flow over overlapping intervals."""
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), "symbol").agg(F.sum("volume").alias("volume"), F.sum(F.col("side") * F.col("volume")).alias("flow"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "volume", "flow")


def sessions(ticks: DataFrame, gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    """Trading sessions: runs of ticks without a longer gap."""
    out = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count("*").alias("n_ticks"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ticks", "volume")


def missing_intervals(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (symbol, minute) pairs without a closed bar: the work list for late files."""
    return expected.join(bars.select("symbol", "minute"), ["symbol", "minute"], "left_anti")


LATCH_OUT = "symbol long, ts timestamp, state string, exited boolean"
LATCH_STATE = "run int, exited boolean, state string, waiting int"


def latch(rows: DataFrame, persist: int = 2, switch: int = 2) -> DataFrame:
    """Per symbol, in order within each batch: an exit signal that lasts ``persist`` rows latches for good; a new label holds after ``switch`` rows.

    ``rows`` has ``symbol, ts, label, exit_signal``.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, exited, current, waiting = state.get if state.exists else (0, False, None, 0)
        pdf = pd.concat(list(parts)).sort_values("ts", kind="stable")
        states, exits = [], []
        for label, signal in zip(pdf["label"], pdf["exit_signal"]):
            run = run + 1 if signal else 0
            exited = bool(exited or run >= persist)
            if current is None:
                current, waiting = label, 0
            elif label != current:
                waiting += 1
                if waiting >= switch:
                    current, waiting = label, 0
            else:
                waiting = 0
            states.append("exit" if exited else current)
            exits.append(exited)
        state.update((int(run), exited, current, int(waiting)))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"].to_numpy(), "state": states, "exited": exits})

    return rows.groupBy("symbol").applyInPandasWithState(step, LATCH_OUT, LATCH_STATE, "append", GroupStateTimeout.NoTimeout)


TRACK_OUT = "symbol long, ts timestamp, gain double, max_gain double, days int, outcome string"
TRACK_STATE = "entry double, top double, days int"


def track(bars: DataFrame, expire: int = 30, win: float = 0.5, lose: float = -0.3) -> DataFrame:
    """A position from each symbol's first bar: gain, highest gain, and the outcome once it expires."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, top, days = state.get if state.exists else (None, None, 0)
        pdf = pd.concat(list(parts)).sort_values("ts", kind="stable")
        out = []
        for ts, close in zip(pdf["ts"], pdf["close"]):
            if entry is None:
                entry = top = float(close)
            if days >= expire:
                continue
            days += 1
            top = max(top, float(close))
            gain, best = close / entry - 1, top / entry - 1
            outcome = None if days < expire else "success" if best >= win else "fail" if gain <= lose else "neutral"
            out.append((key[0], ts, gain, best, days, outcome))
        state.update((entry, top, int(days)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "gain", "max_gain", "days", "outcome"])

    return bars.groupBy("symbol").applyInPandasWithState(step, TRACK_OUT, TRACK_STATE, "append", GroupStateTimeout.NoTimeout)


def merge_newer(batch: DataFrame, path: str, keys: list[str]) -> None:
    """``foreachBatch`` sink: append the rows whose keys the table at ``path`` doesn't hold."""
    spark = batch.sparkSession
    try:
        stored = spark.read.parquet(path).select(*keys)
        batch = batch.join(stored, keys, "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.dropDuplicates(keys).write.mode("append").parquet(path)
