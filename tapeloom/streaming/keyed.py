"""Keyed streams with state that ends: adaptive states with a hold, and tracked positions with a ledger.

Rows of a key wait until the watermark passes them and are then taken in the
order of their time, however the batches cut them; so a stream gives the rows of
the batch operators over the same input.  Rows behind the watermark, and those
without a time, are dropped.  A key's state is one row, the waiting rows and
what is held in flat arrays: it comes with the key's rows, in one batch with
many other keys', and costs no call to the store.  A time-out takes the waiting
rows and closes what is over; a key with neither has no state.  Keys pass as
text: a missing one among whole numbers would make floating ones of its
neighbours in the batch.  Times are microseconds inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MISSING = int(np.iinfo(np.int64).min)
#: Cells of a matrix of positions and prices.
CELLS = 1 << 18


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started within keep their state on disk."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _InOrder:
    """Keeps a key's rows until the watermark has passed them, then calls ``advance`` with these, oldest first.

    ``waiting`` and ``held`` are the fields of a row and of what is held, ``out`` the schema of the rows given.
    """

    waiting: list[tuple[str, str]]
    held: list[tuple[str, str]]
    out: str

    def order(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def advance(self, held: np.ndarray, due: np.ndarray, now: int) -> tuple[np.ndarray, dict]:
        """What is held after the rows that are due, and columns to give; the watermark is ``now``."""
        raise NotImplementedError

    def until(self, held: np.ndarray) -> int | None:
        """When something held ends by itself."""
        return None

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, held = (np.frombuffer(b, k) for b, k in zip(state.get if state.exists else (b"", b""), (self.waiting, self.held)))
        if not state.hasTimedOut:
            rows = np.concatenate([rows, *map(self._packed, parts)])
        ms = state.getCurrentWatermarkMs()
        now = ms * 1000
        is_due = rows["us"] <= now
        due, rest = rows[is_due], rows[~is_due]
        held, columns = self.advance(held, due[self.order(due)], now)
        # a time-out is when the watermark is beyond it
        times = [-(-int(rest["us"].min()) // 1000) - 1] if len(rest) else []
        if (end := self.until(held)) is not None:
            times.append(end // 1000)
        if times:
            state.update((rest.tobytes(), held.tobytes()))
            state.setTimeoutTimestamp(max(min(times), ms + 1))
        elif len(held):
            state.update((b"", held.tobytes()))
        elif state.exists:
            state.remove()
        n = len(columns["us"])
        if n:
            yield pd.DataFrame({"symbol": np.full(n, key[0], object), **columns})

    def _packed(self, pdf: pd.DataFrame) -> np.ndarray:
        out = np.empty(len(pdf), self.waiting)
        for c in out.dtype.names:
            out[c] = pdf[c].to_numpy()
        return out


def _by_symbol(rows: DataFrame, fold: _InOrder) -> DataFrame:
    """The fold's rows (``symbol`` and its columns, times as microseconds) for each symbol of ``symbol, ts`` and numbers."""
    kinds = dict(rows.dtypes)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(MISSING)).alias(c)
    columns = [whole(c) if k == "i8" else F.col(c).cast("double").alias(c) for c, k in fold.waiting if c != "us"]
    read = rows.where("ts IS NOT NULL").select(F.col("symbol").cast("string").alias("symbol"), "ts", F.unix_micros("ts").alias("us"), *columns)
    out = read.groupBy("symbol").applyInPandasWithState(fold.__call__, f"symbol string, {fold.out}", "waiting binary, held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("symbol", F.col("symbol").cast(kinds["symbol"]))


class _Adaptive(_InOrder):
    waiting = [("us", "i8"), ("scan_no", "i8"), ("accum_score", "f8"), ("breakout_score", "f8"), ("collapse_score", "f8"), ("up_prob", "f8")]
    held = [("scan_no", "i8")]
    out = "us long, scan_no long, state string, held long"

    def __init__(self, hold_scans: int):
        self.hold_scans = hold_scans

    def order(self, rows):
        return np.lexsort((rows["scan_no"], rows["us"]))

    def advance(self, held, due, now):
        entry = int(held["scan_no"][0]) if len(held) else None
        states, ages = [], []
        for _, scan, accum, broke, collapse, p in due.tolist():
            if p < 0.3 and collapse > 0.5:
                collapse = min(1.0, collapse * 1.3)
            elif p < 0.4:
                accum, broke = accum * 0.7, broke * 0.7
            elif p > 0.6:
                accum, broke = min(1.0, accum * 1.1), min(1.0, broke * 1.1)
            age = None
            if collapse >= 1.0:
                state, entry = "collapse", None
            elif collapse < 1.0 and broke > 0.5 and broke >= accum:
                state, entry = "breakout", scan
            elif entry is not None and scan - entry < self.hold_scans:
                state, age = "hold", scan - entry
            elif entry is not None:
                state, entry = "idle", None
            else:
                state = "accumulation" if accum > 0.5 else "idle"
            states.append(state)
            ages.append(age)
        return np.array([] if entry is None else [(entry,)], self.held), {"us": due["us"], "scan_no": due["scan_no"], "state": states, "held": pd.array(ages, "Int64")}


def adaptive_stream(scored: DataFrame, hold_scans: int = 3, late: str = "1 day") -> DataFrame:
    """``symbol, ts, scan_no, state, held`` of scored scans (``symbol, ts, scan_no``, the scores of ``adaptive_scores``)."""
    out = _by_symbol(scored.withWatermark("ts", late), _Adaptive(hold_scans))
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "scan_no", "state", "held")


SUCCESS, LOSS, FAIL = 0.30, -0.10, 0.10


class _Positions(_InOrder):
    #: ``ends`` is a pick's end, and missing for a price
    waiting = [("us", "i8"), ("ends", "i8"), ("price", "f8")]
    #: entry time, end, entry price, highest price, last price, worst fall from the highest, bars
    held = [("us", "i8"), ("ends", "i8"), ("entry", "f8"), ("top", "f8"), ("last", "f8"), ("fall", "f8"), ("bars", "i8")]
    out = "entry_us long, us long, kind string, gain double, max_gain double, drawdown double, bars_held long, result string"

    def order(self, rows):
        p = rows["price"]
        return np.lexsort((np.where(np.isnan(p), -np.inf, p), rows["ends"] == MISSING, rows["us"]))

    def advance(self, held, due, now):
        is_price = due["ends"] == MISSING
        prices, picks = due[is_price], due[~is_price & (due["price"] > 0)]
        dearest = np.ones(len(picks), bool)  # of one entry time: the last
        dearest[:-1] = picks["us"][1:] != picks["us"][:-1]
        picks = picks[dearest]
        own = np.zeros(len(held) + len(picks), self.held)
        own[: len(held)] = held
        new = own[len(held) :]
        new["us"], new["ends"] = picks["us"], picks["ends"]
        new["entry"] = new["top"] = new["last"] = picks["price"]
        first, past = (np.searchsorted(prices["us"], own[c], "right") for c in ("us", "ends"))
        n = past - first
        step = max(1, CELLS // max(1, int(n.max(initial=0))))
        parts = [self._marks(own[a : a + step], prices, first[a : a + step], n[a : a + step]) for a in range(0, len(own), step)]
        over = own["ends"] < now
        parts.append(self._closed(own[over]))
        return own[~over], {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    @staticmethod
    def _marks(own: np.ndarray, prices: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict:
        """Marks by each position's ``n`` prices from ``first`` on, a line a position; ``own`` is brought forward."""
        place = np.arange(n.max(initial=0))
        there = place < n[:, None]
        at = np.where(there, first[:, None] + place, 0)
        price = np.where(there, prices["price"][at], np.nan) if len(place) else np.empty(at.shape)
        top = np.fmax.accumulate(np.column_stack([own["top"], price]), axis=1)[:, 1:]
        fall = np.fmin.accumulate(np.column_stack([own["fall"], price / top - 1]), axis=1)[:, 1:]
        entry, bars = own["entry"][:, None], own["bars"][:, None] + place + 1
        line = there.nonzero()[0]
        out = {
            "entry_us": own["us"][line], "us": prices["us"][at[there]], "kind": np.full(len(line), "mark", object), "gain": (price / entry - 1)[there], "max_gain": (top / entry - 1)[there], "drawdown": fall[there],
            "bars_held": bars[there], "result": np.full(len(line), None, object),
        }
        some = np.flatnonzero(n)
        last = n[some] - 1
        for c, x in (("top", top), ("last", price), ("fall", fall), ("bars", bars)):
            own[c][some] = x[some, last]
        return out

    @staticmethod
    def _closed(own: np.ndarray) -> dict:
        gain, best = own["last"] / own["entry"] - 1, own["top"] / own["entry"] - 1
        gain = np.where(np.isnan(gain), 0, gain)
        result = np.full(len(own), "neutral", object)
        for verdict, met in (("fail", best < FAIL), ("loss", gain < LOSS), ("success", best >= SUCCESS)):  # the last that is met counts
            result[met] = verdict
        return {"entry_us": own["us"], "us": own["ends"], "kind": np.full(len(own), "closed", object), "gain": gain, "max_gain": best, "drawdown": own["fall"], "bars_held": own["bars"], "result": result}

    def until(self, held):
        return int(held["ends"].min()) if len(held) else None


def position_stream(picks: DataFrame, prices: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Marks of every open position with each price, and a ledger row when it expires ``days`` after its entry.

    ``picks`` has ``symbol, ts, price`` (the entry), ``prices`` ``symbol, ts, price``;
    a symbol may have many positions, one for each entry time.  The columns are
    those of ``operators.positions``.
    """
    ends = F.unix_micros(F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ends")
    rows = picks.select("symbol", "ts", ends, "price").unionByName(prices.select("symbol", "ts", F.lit(MISSING).alias("ends"), "price"))
    out = _by_symbol(rows.withWatermark("ts", late), _Positions())
    return out.select("symbol", F.timestamp_micros("entry_us").alias("entry_ts"), F.timestamp_micros("us").alias("ts"), "kind", "gain", "max_gain", "drawdown", "bars_held", "result")
