"""Kernels that no built-in expresses well: batched over Arrow, one partition's or one symbol's rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import rolling

ENTRIES = [f"r{i}{j}" for i in range(4) for j in range(i, 4)]


def _spectrum_entropy(entries: pd.DataFrame) -> pd.Series:
    rho = np.zeros((len(entries), 4, 4))
    values = entries.to_numpy(float)
    for k, name in enumerate(ENTRIES):
        i, j = int(name[1]), int(name[2])
        rho[:, i, j] = rho[:, j, i] = values[:, k]
    ok = np.isfinite(values).all(axis=1)
    out = np.full(len(entries), np.nan)
    eig = np.clip(np.linalg.eigvalsh(rho[ok]), 1e-15, None)
    eig /= eig.sum(axis=1, keepdims=True)
    out[ok] = -(eig * np.log(eig)).sum(axis=1)
    return pd.Series(out)


def von_neumann(coherence: DataFrame) -> DataFrame:
    """Entropy of the density matrix's spectrum, from its ten entries."""
    entropy = F.pandas_udf(_spectrum_entropy, "double")(F.struct(*ENTRIES))
    return coherence.select("symbol", "trade_date", F.when(~F.isnan(entropy), entropy).alias("spectrum_entropy"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 along the last axis, ties sharing their mean."""
    less = (x[..., :, None] > x[..., None, :]).sum(axis=-1)
    same = (x[..., :, None] == x[..., None, :]).sum(axis=-1)
    return less + (same + 1) / 2


def _sorted_ranks(x: np.ndarray) -> np.ndarray:
    """``average_ranks`` of each line, by sorting; lines that hold NaN are compared pair by pair."""
    order = np.argsort(x, axis=1)
    v = np.take_along_axis(x, order, 1)
    at = np.arange(x.shape[1])
    ranks = np.broadcast_to(at + 1.0, x.shape).copy()
    tied = np.flatnonzero((v[:, 1:] == v[:, :-1]).any(1))
    if len(tied):
        own = v[tied]
        edge = np.ones((len(tied), len(at) + 1), bool)
        edge[:, 1:-1] = own[:, 1:] != own[:, :-1]
        first = np.maximum.accumulate(np.where(edge[:, :-1], at, 0), axis=1)
        last = np.minimum.accumulate(np.where(edge[:, 1:], at, len(at))[:, ::-1], axis=1)[:, ::-1]
        ranks[tied] = (first + last) / 2 + 1
    out = np.empty(x.shape)
    np.put_along_axis(out, order, ranks, 1)
    for k in np.flatnonzero(np.isnan(v[:, -1])):
        out[k] = average_ranks(x[k])
    return out


def window_ics(x: np.ndarray, y: np.ndarray, starts: np.ndarray, window: int, block: int = 4096) -> np.ndarray:
    """Rank correlation of x and y in each window from its start on; NaN where one of them is constant."""
    views = [np.lib.stride_tricks.sliding_window_view(v, window) if len(starts) else v for v in (x, y)]
    out = np.full(len(starts), np.nan)
    for k in range(0, len(starts), block):
        a, b = (_sorted_ranks(v[starts[k : k + block]]) for v in views)
        sa, sb = a.std(1), b.std(1)
        ok = (sa > 0) & (sb > 0)
        both = ((a - a.mean(1)[:, None]) * (b - b.mean(1)[:, None])).mean(1)
        out[k : k + block][ok] = both[ok] / (sa * sb)[ok]
    return out


def _summary(ics: np.ndarray) -> tuple:
    """Number of windows, their mean, and it over the deviation."""
    ics = ics[~np.isnan(ics)]
    sd = np.std(ics, ddof=1) if len(ics) > 1 else np.nan
    mean = float(np.mean(ics)) if len(ics) else np.nan
    return len(ics), mean if len(ics) else None, mean / sd if sd and sd == sd else None


IC = "n_windows int, mean_ic double, ic_ir double"


def rolling_rank_ic(rows: DataFrame, window: int = 60, step: int = 5) -> DataFrame:
    """Rank correlation of factor and forward return in windows, ranked anew in each; its mean over deviation.

    ``rows`` has ``symbol, factor, trade_date, value, fwd_5``; a group is one
    symbol's history of one factor.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trade_date")
        x, y = pdf["value"].to_numpy(float), pdf["fwd_5"].to_numpy(float)
        got = _summary(window_ics(x, y, np.arange(0, len(x) - window + 1, step), window))
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["factor"].iloc[0], *got)], columns=["symbol", "factor", "n_windows", "mean_ic", "ic_ir"])

    return rows.select("symbol", "factor", "trade_date", "value", "fwd_5").groupBy("symbol", "factor").applyInPandas(one, f"symbol long, factor string, {IC}")


def panel_rank_ic(panel: DataFrame, factors: tuple[str, ...], window: int = 60, step: int = 5) -> DataFrame:
    """``rolling_rank_ic`` of a panel with a column a factor, all factors of many symbols at once.

    Rows are as ``rolling.by_symbol`` gives them, a symbol's in one partition by
    date: they aren't shuffled again.
    """
    read = panel.selectExpr("symbol", "trade_date", "CAST(fwd_5 AS DOUBLE) AS fwd_5", *(f"CAST({f} AS DOUBLE) AS {f}" for f in factors))

    def run(batches):
        for table in rolling.whole_symbols(batches):
            rows = rolling.Rows(table)
            out = []
            for f in factors:
                there = table.column(f).is_valid().to_numpy(zero_copy_only=False)
                codes = rows.codes[there]
                if not len(codes):
                    continue
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                sizes = np.diff(np.append(first, len(codes)))
                counts = np.maximum((sizes - window) // step + 1, 0)
                ends = np.cumsum(counts)
                starts = np.repeat(first, counts) + step * (np.arange(ends[-1]) - np.repeat(ends - counts, counts))
                ics = window_ics(rows[f][there], rows["fwd_5"][there], starts, window)
                names = table.column("symbol").filter(pa.array(there)).take(pa.array(first)).to_pylist()
                out += [(name, f, *_summary(ics[end - n : end])) for name, n, end in zip(names, counts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((table.schema.field("symbol").type, pa.string(), pa.int32(), pa.float64(), pa.float64()))], names=["symbol", "factor", "n_windows", "mean_ic", "ic_ir"])

    return read.mapInArrow(run, f"symbol {dict(panel.dtypes)['symbol']}, factor string, {IC}")
