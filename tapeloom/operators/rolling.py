"""Rolling features of symbols' bars in one pass over sorted rows: Spark shuffles by symbol and sorts, NumPy takes the windows of a batch at once.

Spark's sliding frames go over a window's rows again for every row and every
function; here a window's rows are one line of a matrix, so that a function is
one array operation for thousands of rows.  The features are those of the SQL
operators that the functions name, which stay as the general form and as the
twins' text; tests compare the two.  Missing values are NaN inside.  A symbol's
bars (one a date) are in one batch; matrices hold ``BLOCK`` lines at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
CODES = (0, 1, 3, 4, 6, 7)
NAMELESS = {"nameless": "CAST(symbol IS NULL AS INT)"}  # joins by symbol find nothing for these rows
SYMMETRIC = tuple((i, j) for i in range(4) for j in range(i, 4))


def by_symbol(rows: DataFrame, columns: dict[str, str], kernel: Callable[[Rows], dict], out: str, together: bool = False) -> DataFrame:
    """``symbol, trade_date`` and the kernel's columns (``out``: their schema), of which it sees ``columns``: name and expression.

    ``together``: a symbol's rows may be in one partition already, as bars of trades
    that were shuffled by symbol; a row number leaves it to Spark to see that.
    """
    kinds = dict(rows.dtypes)
    read = rows.selectExpr("symbol", "trade_date", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items()])
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches):
        for table in whole_symbols(batches):
            got = kernel(Rows(table))
            arrays = [a if (a := got[n]).dtype == bool else a.astype(float) for n in names]
            yield pa.RecordBatch.from_arrays([table.column("symbol"), table.column("trade_date"), *(pa.array(a, from_pandas=True) for a in arrays)], names=["symbol", "trade_date", *names])

    placed = read.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date"))) if together else read.repartition("symbol").sortWithinPartitions("symbol", "trade_date")
    return placed.mapInArrow(run, f"symbol {kinds['symbol']}, trade_date {kinds['trade_date']}, {out}")


def _codes(table: pa.RecordBatch) -> np.ndarray:
    return pc.dictionary_encode(table.column("symbol"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def whole_symbols(batches):
    """The sorted rows in batches that end where a symbol ends."""
    open_: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        codes = _codes(b)
        first = int(np.argmax(codes != codes[0])) if (codes != codes[0]).any() else b.num_rows
        last = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if first < b.num_rows else 0
        if open_ and open_[-1].column("symbol")[-1].as_py() != b.column("symbol")[0].as_py():
            yield _joined(open_)
            open_ = []
        if first == b.num_rows:
            open_.append(b)
        else:
            yield _joined([*open_, b.slice(0, last)])
            open_ = [b.slice(last)]
    if open_:
        yield _joined(open_)


def places(codes: np.ndarray) -> np.ndarray:
    """Number of each row among its code's neighbouring rows, from 0."""
    at = np.arange(len(codes))
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Rows:
    """Columns of whole symbols' rows, with functions of windows that don't reach over a symbol's start."""

    def __init__(self, table: pa.RecordBatch | None = None, codes: np.ndarray | None = None, cols: dict | None = None):
        self.table = table
        self.codes = _codes(table) if codes is None else codes
        self.cols = {n: table.column(n).to_numpy(zero_copy_only=False) for n in table.schema.names[2:]} if cols is None else cols
        self.at = places(self.codes)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.cols[name]

    def of(self, mask: np.ndarray) -> Rows:
        """Only some of the rows; windows go over these."""
        return Rows(codes=self.codes[mask], cols={n: x[mask] for n, x in self.cols.items()})

    def lag(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        out = np.full(len(x), np.nan)
        out[k:] = x[:-k] if k else x
        out[self.at < k] = np.nan
        return out

    def lead(self, x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(x), np.nan)
        out[:-k] = np.where(self.codes[k:] == self.codes[:-k], x[k:], np.nan)
        return out

    def each(self, fn: Callable, n: int, *xs: np.ndarray, end: int = 0):
        """``fn`` of the matrices of windows of n rows, oldest first, that end ``end`` rows back; NaN before the symbol's start."""
        padded = [np.concatenate([np.full(n - 1 + end, np.nan), x]) for x in xs]
        views = [np.lib.stride_tricks.sliding_window_view(p, n)[: len(x)] for p, x in zip(padded, xs)]
        places_ = np.arange(n)
        parts = []
        for a in range(0, len(self.at), BLOCK):
            own = self.at[a : a + BLOCK]
            start = np.maximum(n - 1 + end - own, 0)[:, None]
            parts.append(fn(*(np.where(places_ >= start, v[a : a + BLOCK], np.nan) for v in views)))
        if isinstance(parts[0], tuple):
            return tuple(np.concatenate(p) for p in zip(*parts))
        return np.concatenate(parts)

    def moments(self, x: np.ndarray, n: int, least: int | None = None, end: int = 0):
        """Mean and population variance of the window's values; missing below ``least`` values."""
        least = n if least is None else least
        return self.each(lambda v: _moments(v, least), n, x, end=end)

    def mean(self, x, n, least=None, end=0):
        least = n if least is None else least

        def one(v):
            there = ~np.isnan(v)
            m = there.sum(1)
            return np.where(m >= max(least, 1), np.where(there, v, 0).sum(1) / np.maximum(m, 1), np.nan)

        return self.each(one, n, x, end=end)

    def sd(self, x, n, least=None):
        return np.sqrt(self.moments(x, n, least)[1])

    def most(self, x, n, least=None, end=0):
        least = n if least is None else least
        return self.each(lambda v: np.where((~np.isnan(v)).sum(1) >= max(least, 1), np.fmax.reduce(v, 1), np.nan), n, x, end=end)

    def count(self, x, n):
        return self.each(lambda v: (~np.isnan(v)).sum(1), n, x)


def _moments(v: np.ndarray, least: int = 1):
    """Mean and variance about a value of the window's own, so that equal values have none."""
    there = ~np.isnan(v)
    m = there.sum(1)
    zero = np.fmin.reduce(v, 1)
    d = np.where(there, v - zero[:, None], 0)
    mean = d.sum(1) / np.maximum(m, 1)
    d = np.where(there, d - mean[:, None], 0)
    ok = m >= max(least, 1)
    return np.where(ok, zero + mean, np.nan), np.where(ok, (d * d).sum(1) / np.maximum(m, 1), np.nan)


def clip(x, lo, hi):
    return np.clip(x, lo, hi)


def over(a, b):
    """a / b, missing where b is 0."""
    return a / np.where(b == 0, np.nan, b)


def div(a, b):
    return a / np.where(np.abs(b) > 1e-12, b, np.nan)


def or0(x, default=0.0):
    return np.where(np.isnan(x), default, x)


def pattern(rows: Rows, x: np.ndarray) -> np.ndarray:
    """``windows.pattern``."""
    a, b = rows.lag(x, 2), rows.lag(x, 1)
    code = 4.0 * (a > b) + 2 * (a > x) + (b > x)
    return np.where(np.isnan(a) | np.isnan(b) | np.isnan(x), np.nan, code)


def pattern_entropy(rows: Rows, code: np.ndarray, n: int) -> np.ndarray:
    """``windows.permutation_entropy`` of full windows: counts are differences of running whole numbers, a count's term is made once."""
    w = n - 2
    first = np.arange(len(code)) - np.minimum(rows.at, w - 1)
    term = np.array([0.0] + [(c / w) * math.log(c / w) for c in range(1, w + 1)])
    total, terms = 0, 0.0
    for k in CODES:
        run = np.concatenate([[0], np.cumsum(code == k)])
        c = run[1:] - run[first]
        total, terms = total + c, terms + term[c]
    return np.where(total == w, -terms / math.log(6.0), np.nan)


def irreversibility(v: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """``windows.irreversibility_of(3)`` of windows whose values are at their end; missing for fewer than two pairs."""
    half = 0.5 * sd[:, None]
    s = np.where(v > half, 2, np.where(v < -half, 0, 1))
    there = ~np.isnan(v)
    pairs = np.where(there[:, :-1] & there[:, 1:], 3 * s[:, :-1] + s[:, 1:], -1).astype(np.int8)
    total = (pairs >= 0).sum(1)
    terms = 0.0
    for i in range(3):
        for j in range(i + 1, 3):
            a, b = (pairs == i * 3 + j).sum(1), (pairs == j * 3 + i).sum(1)
            both = (a > 0) & (b > 0)
            terms = terms + np.where(both, (a - b) * np.log(np.where(both, a, 1) / np.where(both, b, 1)), 0)
    return np.where(total > 1, np.maximum(0, terms / np.maximum(total, 1)), np.nan)


def eigenvalues(c: np.ndarray):
    """Real part and modulus of ``windows.dominant_eigenvalue`` of centred values at the windows' end (NaN before them)."""
    m = (~np.isnan(c)).sum(1)
    c = np.where(np.isnan(c), 0, c)
    with np.errstate(all="ignore"):
        r, a1, a2 = (c * c).sum(1) / m + 1e-8, (c[:, :-1] * c[:, 1:]).sum(1) / (m - 1), (c[:, :-2] * c[:, 2:]).sum(1) / (m - 2)
        p1, p2 = over(a1 * r - a1 * a2, r * r - a1 * a1), over(r * a2 - a1 * a1, r * r - a1 * a1)
        disc = p1 * p1 + 4 * p2
        root = p1 + np.sign(p1) * np.sqrt(np.maximum(disc, 0))
        real = np.where(disc >= 0, root / 2, p1 / 2)
        size = np.where(disc >= 0, np.abs(root) / 2, np.sqrt(np.maximum(-p2, 0)))
    gone = np.isnan(disc)
    return np.where(gone, np.nan, real), np.where(gone, np.nan, size)


def histogram_entropy(v: np.ndarray, bins: int = 10) -> np.ndarray:
    """``windows.entropy_of`` of full windows without a gap."""
    n = v.shape[1]
    if n < 5:
        return np.full(len(v), 999.0)
    lo, hi = v.min(1), v.max(1)
    spread = hi > lo
    width = np.where(spread, hi - lo, 1)[:, None]
    b = np.minimum(np.floor((v - lo[:, None]) / width * bins + 5e-10), bins - 1).astype(np.int64)
    counts = np.bincount((b + bins * np.arange(len(v))[:, None]).ravel(), minlength=bins * len(v)).reshape(len(v), bins)
    # the text's logarithms, added from the first bin on: where two windows' shares are equal, the last bits decide whether their difference is above 0
    terms = np.array([0.0] + [(c / n) * math.log(c / n) for c in range(1, n + 1)])[counts]
    return np.where(spread, -np.add.accumulate(terms, axis=1)[:, -1], 0.0)


def hurst(rows: Rows, moves: dict[int, np.ndarray], n: int) -> np.ndarray:
    """``windows.hurst_of``, within 0 and 1."""
    num = sx = sy = sxx = sxy = 0.0
    for k, m in moves.items():
        if k >= n:
            continue
        v = rows.mean(m, n - k, 1)
        ok = v > 0
        y, x = np.log(np.where(ok, v, 1)), math.log(k)
        num, sx, sy, sxx, sxy = num + ok, sx + ok * x, sy + y, sxx + ok * x**2, sxy + x * y
    slope = np.where(num >= 2, (num * sxy - sx * sy) / np.where(num >= 2, num * sxx - sx * sx, 1), np.nan)
    return np.where(rows.at >= n - 1, clip(or0(slope / 2, 0.5), 0, 1), np.nan)


def physics(bars: DataFrame, short: int = 10, long: int = 40, entry: float = 0.1, persist: int = 2) -> DataFrame:
    """``scores.physics``."""
    far, zn = max(short, long), max(long, 12)
    ps, pl = max(3, short // 3), max(5, long // 3)

    def kernel(r: Rows) -> dict:
        def z(x):
            mean, var = r.moments(x, zn, zn // 3)
            return div(x - mean, np.sqrt(var))

        close = r["close"]
        moves = {k: (close - r.lag(close, k)) ** 2 for k in (2, 4, 8, 16) if k < far}
        ma_s, ma_l, prev_high = r.mean(close, short, ps), r.mean(close, long, pl), r.most(close, long, pl, end=1)
        vol_z = z(r.sd(r["ret"], short, ps))
        energy = clip((0.60 * z(r["mf_sum"]) + 0.40 * z(np.log(1 + np.fmax(r["amount_sum"], 0)))) / 2.5, -1, 1)
        temperature = clip((0.65 * z(r["turnover_sum"]) - 0.85 * vol_z) / 2.0, -1, 1)

        def relative(v):
            out = np.full(len(v), np.nan)
            full = ~np.isnan(v).any(1)
            es, el = (histogram_entropy(v[full][:, -n:]) for n in (short, long))
            out[full] = over(el - es, np.abs(el))
            return out

        term = lambda x, scale: clip(x / scale, -1, 1)
        ma_term, spread_term, breakout_term = term(over(close, ma_s) - 1, 0.10), term(over(ma_s, ma_l) - 1, 0.12), term(over(close, prev_high) - 1, 0.08)
        entropy_term, fractal_term = term(r.each(relative, far, r["ret"]), 0.25), term(hurst(r, moves, short) - hurst(r, moves, long), 0.12)
        order = clip(0.45 * ma_term + 0.35 * spread_term + 0.20 * breakout_term, -1, 1)
        switch = clip(0.40 * breakout_term + 0.30 * entropy_term + 0.30 * fractal_term, -1, 1)
        phase = clip(0.55 * entropy_term + 0.45 * fractal_term, -1, 1)
        score = clip(0.25 * energy + 0.15 * temperature + 0.30 * order + 0.20 * phase + 0.10 * switch, -1, 1)
        least = r.each(lambda v: v.min(1), persist, score)
        state = (least >= entry) & (energy >= -0.5) & (order >= 0) & (phase >= -0.5)
        return {"close": close, "open": r["open"], "energy": energy, "temperature": temperature, "order_term": order, "phase_term": phase, "switch_term": switch, "score": score, "score_min": least, "state": state}

    names = ("open", "close", "ret", "amount_sum", "turnover_sum", "mf_sum")
    return by_symbol(bars, {c: c for c in names}, kernel, "close double, open double, energy double, temperature double, order_term double, phase_term double, switch_term double, score double, score_min double, state boolean")


FEATURES = (
    "close", "amount", "turnover_rate", "ma_20", "ma_60", "breakout_10", "breakout_20", "volume_impulse", "flow_impulse", "mf_z", "execution_cost", "ar1_state", "ar1_adjusted", "skew", "var_lift",
    "pe_20", "pe_60", "gap", "pct", "pi", "eig_abs", "distortion", "recovery", "accel", "energy", "order_alignment",
)


SETUP = ("entropy_quality", "bifurcation_quality", "trigger_quality", "setup_score")
CONDITIONS = ("compressed", "instable", "in_phase", "triggered", "of_quality", "setup", "abandon_seed")


def qualities(f: dict) -> dict:
    """``setup.setup_frame`` of its features: four scores, five conditions, the setup and whether the cost forbids it."""
    scaled = lambda x, lo, hi: clip((x - lo) / (hi - lo), 0, 1)
    entropy = clip(0.50 * (1 - or0(f["pct"], 1.0)) + 0.30 * scaled(f["gap"], 0, 0.10) + 0.20 * scaled(0.95 - f["pe_20"], 0, 0.40), 0, 1)
    bifurcation = clip(
        0.06 * scaled(f["ar1_state"], 0.82, 0.97) + 0.18 * scaled(f["ar1_adjusted"], 0.80, 0.97) + 0.30 * scaled(f["eig_abs"], 0.68, 0.99) + 0.24 * scaled(f["pi"], 0.01, 0.25)
        + 0.12 * scaled(0.22 - f["recovery"], 0, 0.22) + 0.10 * scaled(f["var_lift"], -0.05, 0.20), 0, 1,
    )
    trigger = clip(
        0.30 * scaled(f["breakout_10"], 0, 0.04) + 0.20 * scaled(f["breakout_20"], 0, 0.06) + 0.18 * scaled(f["volume_impulse"], 0, 0.30) + 0.14 * scaled(f["flow_impulse"], -0.10, 0.80)
        + 0.10 * clip(0.5 + 0.5 * f["energy"], 0, 1) + 0.08 * scaled(f["accel"], -0.01, 0.02), 0, 1,
    )
    score, cost = clip(0.32 * entropy + 0.48 * bifurcation + 0.20 * trigger, 0, 1), f["execution_cost"]
    got = {
        "entropy_quality": entropy, "bifurcation_quality": bifurcation, "trigger_quality": trigger, "setup_score": score,
        "compressed": (f["pct"] <= 0.40) & (f["gap"] >= 0.015), "instable": ((f["eig_abs"] >= 0.66) & (f["pi"] >= 0.008)) | (bifurcation >= 0.45),
        "in_phase": (f["ar1_adjusted"] >= 0.60) | ((f["distortion"] <= 0.12) & (f["ar1_state"] >= 0.55)),
        "triggered": (f["breakout_10"] >= -0.02) & (f["close"] >= f["ma_20"] * 0.985) & (f["ma_20"] >= f["ma_60"] * 0.98) & (f["mf_z"] >= -0.80),
        "of_quality": (score >= 0.44) & (entropy >= 0.62) & (bifurcation >= 0.20) & (1 - cost >= 0.35), "abandon_seed": (cost >= 0.82) & (score < 0.65),
    }
    return got | {"setup": np.logical_and.reduce([got[c] for c in CONDITIONS[:5]])}


def setup_features(bars: DataFrame, scored: bool = False) -> DataFrame:
    """``setup.setup_features`` with its default windows; ``scored``: with the columns of ``setup.setup_frame``."""

    def kernel(r: Rows) -> dict:
        close, amount, turnover, flow = (r[c] for c in ("close", "amount", "turnover_rate", "net_mf"))
        lc = np.log(np.where(close > 0, close, np.nan))
        lr = lc - r.lag(lc)
        ma_20, ma_60, am_20 = r.mean(close, 20, 10), r.mean(close, 60, 30), r.mean(amount, 20, 10)
        lc_mean, lc_var = r.moments(lc, 20, 10)
        breakout_10, breakout_20 = over(close, r.most(r["high"], 10, 5, end=1)) - 1, over(close, r.most(r["high"], 20, 10, end=1)) - 1
        turn_mean, turn_var = r.moments(turnover, 20, 10)
        volume_impulse = over(r.mean(amount, 5, 3), am_20) - 1
        flow_impulse = over(r.mean(flow, 5, 3), r.mean(np.abs(flow), 20, 10))
        flow_mean, flow_var = r.moments(flow, 60, 20)
        mf_z = over(flow - flow_mean, np.sqrt(flow_var))
        detrended = over(lc - lc_mean, np.sqrt(lc_var))
        cost = clip(0.45 * or0(r.sd(lr, 20, 10)) / 0.04 + 0.30 * or0(np.sqrt(turn_var)) - 0.15 * np.log(1 + np.fmax(am_20, 0)) / 14 - 0.10 * or0(turn_mean) / 6, 0, 1)

        def less(x, phase, n, least):
            before = np.full(len(x), np.nan)
            for k in range(int(phase.max()) + 1):
                own = phase == k
                if own.any():
                    before[own] = r.of(own).mean(x[own], n, least, end=1)
            return x - or0(before)

        adjusted = less(less(less(detrended, r["ph1"], 12, 3), r["ph2"], 10, 3), r["ph3"], 18, 4)
        code = pattern(r, detrended)
        pe_20, pe_60 = pattern_entropy(r, code, 20), pattern_entropy(r, code, 60)

        def slope(x):
            def one(v, p):
                both = ~(np.isnan(v) | np.isnan(p))
                (mx, _), (mp, var) = _moments(np.where(both, v, np.nan)), _moments(np.where(both, p, np.nan))
                m = both.sum(1)
                cov = np.where(both, (v - mx[:, None]) * (p - mp[:, None]), 0).sum(1) / np.maximum(m, 1)
                ok = (m >= 9) & (var > 1e-18)
                return np.where(ok, cov / np.where(ok, var, 1), np.nan)

            return r.each(one, 19, x, r.lag(x))

        def skewness(v):
            m = (~np.isnan(v)).sum(1)
            mean, var = _moments(v)
            ok = (m >= 10) & (np.sqrt(var) > 1e-9)
            third = np.nansum((v - mean[:, None]) ** 3, axis=1) / np.maximum(m, 1)
            return np.where(ok, third / np.where(ok, var, 1) ** 1.5 * np.sqrt(m * (m - 1.0)) / np.maximum(m - 2.0, 1), np.nan)

        def reversals(v):
            _, var = _moments(v)
            sd = np.sqrt(var)
            return np.where(sd <= 1e-12, 0.0, np.where(np.isnan(v).any(1), np.nan, irreversibility(v, sd)))

        def modulus(v):
            mean, var = _moments(v)
            full = ~np.isnan(v).any(1) & (np.sqrt(var) > 1e-12)
            return np.where(full, eigenvalues(np.where(full[:, None], v - mean[:, None], np.nan))[1], np.nan)

        def at_most(v):
            m = (~np.isnan(v)).sum(1)
            return np.where((m >= 40) & ~np.isnan(v[:, -1]), (v <= v[:, -1:] + 1e-9).sum(1) / np.maximum(m, 1), np.nan)

        pct = np.where(r.at >= 119, r.each(at_most, 120, pe_20), np.nan)
        ar1_state, ar1_adjusted = slope(detrended), slope(adjusted)
        entropy_slope = (pe_20 - r.lag(pe_20, 5)) / 5
        got = {
            "close": close, "amount": amount, "turnover_rate": turnover, "ma_20": ma_20, "ma_60": ma_60, "breakout_10": breakout_10, "breakout_20": breakout_20, "volume_impulse": volume_impulse, "flow_impulse": flow_impulse,
            "mf_z": mf_z, "execution_cost": cost, "ar1_state": ar1_state, "ar1_adjusted": ar1_adjusted, "skew": r.each(skewness, 20, detrended),
            "var_lift": over(r.moments(detrended, 10, 5)[1], r.moments(detrended, 20, 10)[1]) - 1, "pe_20": pe_20, "pe_60": pe_60, "gap": pe_60 - pe_20, "pct": pct, "pi": r.each(reversals, 20, lr), "eig_abs": r.each(modulus, 20, adjusted),
            "distortion": np.abs(ar1_state - ar1_adjusted), "recovery": 1 - ar1_adjusted, "accel": entropy_slope - r.lag(entropy_slope), "energy": clip(0.55 * or0(volume_impulse) + 0.45 * or0(flow_impulse), -1, 1),
            "order_alignment": clip(0.35 * or0(div(close - ma_20, ma_20)) + 0.35 * or0(div(ma_20 - ma_60, ma_60)) + 0.30 * or0(breakout_10), -1, 1),
        }
        return got | qualities(got) if scored else got

    columns = {"close": "close", "high": "high", **{c: f"coalesce({c}, 0)" for c in ("amount", "turnover_rate", "net_mf")}, "ph1": "weekday(trade_date)", "ph2": "CASE WHEN day(trade_date) <= 7 THEN 0 WHEN day(trade_date) >= 23 THEN 2 ELSE 1 END", "ph3": "(month(trade_date) - 1) % 3"}
    return by_symbol(bars.where("close IS NOT NULL"), columns, kernel, ", ".join([f"{c} double" for c in FEATURES + SETUP * scored] + [f"{c} boolean" for c in CONDITIONS * scored]))


def _structure(r: Rows, n: int = 20, long: int = 60) -> dict:
    """Log return, pattern entropies, irreversibility and eigenvalues of a symbol's rows, those of ``windows`` by name; ``full``: those of ``windows.structure``."""
    close = np.where(r["close"] > 0, r["close"], np.nan)
    lr = np.log(close) - np.log(r.lag(close))
    code = pattern(r, lr)
    known = ~np.isnan(lr)
    own, x = r.of(known), lr[known]

    def one(v):
        m = (~np.isnan(v)).sum(1)
        mean, var = _moments(v)
        sd = np.sqrt(var)
        spread = sd > 1e-12
        real, size = eigenvalues(np.where(((m >= 12) & spread)[:, None], v - mean[:, None], np.nan))
        return np.where(m >= 10, irreversibility(v, sd), np.nan), real, size, np.where(spread, 1.0, np.nan)

    got = {}
    for name, part in zip(("pi", "eig_real", "eig_abs", "spread"), own.each(one, n, x) if len(x) else [x] * 4):
        got[name] = np.full(len(lr), np.nan)
        got[name][known] = part
    full = (r.count(lr, n) == n) & (got["spread"] == 1)
    return got | {"lr": lr, "pe": pattern_entropy(r, code, n), "pe_long": pattern_entropy(r, code, long), "full": full}


def detector_frame(bars: DataFrame) -> DataFrame:
    """``detectors.detector_frame`` of daily bars with flows in tiers, all in one pass."""
    tiers = [f"{side}_{t}" for side in ("buy", "sell") for t in ("sm", "md", "lg", "elg")]

    def kernel(r: Rows) -> dict:
        s = _structure(r)
        q = r.of(s["full"] & ~np.isnan(s["pe"]))
        pe, pi, eig = (s[c][s["full"] & ~np.isnan(s["pe"])] for c in ("pe", "pi", "eig_abs"))
        parts = [pe, 1 - pe + 1e-9, np.fmin(pi, 1.0), clip(eig, 0, 1)]
        total = sum(parts)
        amp = [np.sqrt(p / total) for p in parts]
        rho = {(i, j): q.mean(amp[i] * amp[j], 20, 5) for i, j in SYMMETRIC} if len(pe) else dict.fromkeys(SYMMETRIC, pe)
        purity = sum(rho[i, i] ** 2 for i in range(4)) + 2 * sum(rho[k] ** 2 for k in SYMMETRIC if k[0] != k[1])
        l1 = 2 * sum(rho[k] for k in SYMMETRIC if k[0] != k[1]) / 3
        there = ~np.isnan(l1)
        fall = np.full(len(l1), np.nan)
        fall[there] = l1[there] - q.of(there).lag(l1[there], 5)
        purity_norm, decay = np.full(len(s["lr"]), np.nan), np.full(len(s["lr"]), np.nan)
        at = np.flatnonzero(s["full"] & ~np.isnan(s["pe"]))
        purity_norm[at], decay[at] = (purity - 0.25) / 0.75, fall
        f = {c: r[c] for c in tiers}
        big = f["buy_lg"] + f["buy_elg"] - f["sell_lg"] - f["sell_elg"]
        buys, sells = (sum(f[f"{side}_{t}"] for t in ("sm", "md", "lg", "elg")) for side in ("buy", "sell"))
        up = big > 0
        row = np.arange(len(up))
        streak = np.where(up, np.minimum(row - np.maximum.accumulate(np.where(up, -1, row)), r.at + 1), 0)
        sums = r.each(lambda v: np.where((~np.isnan(v)).sum(1) >= 3, np.nansum(v, axis=1), np.nan), 10, big)
        step = s["pe"] - r.lag(s["pe"])
        got = {
            "vol_impulse": div(r.mean(r["vol"], 5, 3), r.mean(r["vol"], 20, 7)), "pe": s["pe"], "pi": s["pi"], "eig": s["eig_real"], "purity_norm": purity_norm, "decay": decay, "big_10": sums, "big_ratio": div(big, buys + sells),
            "imbalance": div(buys - sells, buys + sells), "momentum": r.mean(big, 5, 3) - r.mean(big, 20, 7), "streak": streak, "accel": step - r.lag(step),
        }
        return {c: x if c == "vol_impulse" else np.where(r["nameless"] == 1, np.nan, x) for c, x in got.items()}

    names = ("vol_impulse", "pe", "pi", "eig", "purity_norm", "decay", "big_10", "big_ratio", "imbalance", "momentum", "streak", "accel")
    rows = by_symbol(bars, {c: c for c in ("close", "vol", *tiers)} | NAMELESS, kernel, ", ".join(f"{c} double" for c in names))
    return rows.selectExpr("symbol", "trade_date", *(f"CAST({c} AS BIGINT) AS {c}" if c == "streak" else c for c in names))


def daily_summary(bars: DataFrame, low: float = 0.40, pe_high: float = 0.85, past: int = 120, least: int = 70) -> DataFrame:
    """``dual.daily_summary`` of daily bars, all in one pass."""

    def kernel(r: Rows) -> dict:
        s = _structure(r)
        named = np.where(r["nameless"] == 1, np.nan, 0.0)
        pe, pe_long, pi, eig, lr = (s[c] + named for c in ("pe", "pe_long", "pi", "eig_real", "lr"))
        known = ~np.isnan(pe)
        pct = np.full(len(pe), np.nan)

        def below(v):
            m = (~np.isnan(v)).sum(1)
            return np.where(m >= max(8, past // 3), (v < v[:, -1:]).sum(1) / np.maximum(m, 1), np.nan)

        if known.any():
            pct[known] = r.of(known).each(below, past, pe[known])
        is_low = pct < low
        compressed = is_low & (pe < pe_high)
        row = np.arange(len(pe))
        run = np.minimum(row - np.maximum.accumulate(np.where(is_low, -1, row)), r.at + 1)
        lift = div(r.moments(lr, 10)[1], r.moments(lr, 20)[1]) - 1
        before = {c: r.lag(x, 5) for c, x in (("pe", pe), ("pi", pi), ("pct", pct), ("eig", eig))}
        return {
            "pe": pe, "pe_long": pe_long, "gap": or0(pe_long - pe), "pct": or0(pct, 0.5), "pi": or0(pi), "eig": or0(eig), "lift": or0(lift), "compressed": compressed, "days": np.where(compressed, run, 0), "pe_move": or0(pe - before["pe"]),
            "pi_move": or0(pi - before["pi"]), "pct_5": or0(before["pct"], 0.5), "eig_5": or0(before["eig"]), "pi_5": or0(before["pi"]), "row_no": r.at + 1,
        }

    names = ("pe", "pe_long", "gap", "pct", "pi", "eig", "lift", "compressed", "days", "pe_move", "pi_move", "pct_5", "eig_5", "pi_5")
    rows = by_symbol(bars, {"close": "close"} | NAMELESS, kernel, ", ".join(f"{c} {'boolean' if c == 'compressed' else 'double'}" for c in (*names, "row_no")))
    return rows.where(f"row_no >= {least}").selectExpr("symbol", "trade_date", *(f"CAST({c} AS INT) AS {c}" if c == "days" else c for c in names))


def _in_order(r: Rows, x: np.ndarray, n: int):
    """Sum and number of the window's values; they are added oldest first, as a frame adds them, so that equal values give equal means."""
    there = ~np.isnan(x)
    x = np.where(there, x, 0.0)
    total, m = np.zeros(len(x)), np.zeros(len(x), np.int64)
    for k in range(min(n, len(x)) - 1, -1, -1):
        inside = r.at[k:] >= k
        total[k:] += np.where(inside, x[: len(x) - k], 0.0)
        m[k:] += inside & there[: len(x) - k]
    return total, m


RECOVERY = ("close", "amount", "turnover_rate", "r1", "ret_3", "r5", "ret_10", "ret_20", "dd_20", "to_ma20", "flow_5", "amount_ratio", "rebound", "atr", "damage", "repair", "entry_window", "flow_support", "stability", "overheat")
RECOVERY_FLAGS = ("repair_flag", "early_flag", "overheat_flag", "candidate")


def recovery(bars: DataFrame) -> DataFrame:
    """``scores.recovery`` of the returns of daily bars, all in one pass."""

    def kernel(r: Rows) -> dict:
        close, high, low, amount, turnover = (r[c] for c in ("close", "high", "low", "amount", "turnover_rate"))
        scaled = lambda x, lo, hi: clip((x - lo) / (hi - lo), 0, 1)

        def mean(x, n, least=None):
            total, m = _in_order(r, x, n)
            return np.where(m >= (n if least is None else least), total / np.maximum(m, 1), np.nan)

        def triangular(x, lo, mid, hi):
            return np.where(np.isnan(x) | (x <= lo) | (x >= hi), 0.0, np.where(x <= mid, (x - lo) / (mid - lo), (hi - x) / (hi - mid)))

        def deviation(v):
            m = (~np.isnan(v)).sum(1)
            return np.where(m >= 6, np.sqrt(_moments(v)[1] * m / np.maximum(m - 1, 1)), np.nan)

        ret = {k: over(close, r.lag(close, k)) - 1 for k in (1, 3, 5, 10, 20)}
        before = r.lag(close)
        ma_5 = mean(close, 5)
        amount_ratio, turnover_ratio, flow_5 = div(amount, mean(amount, 20, 10)), div(turnover, mean(turnover, 20, 10)), mean(div(r["net_mf"], amount), 5, 3)
        dd_20, dd_60 = div(close, r.most(high, 20, 10)) - 1, div(close, r.most(high, 60, 30)) - 1
        rebound, to_ma20 = div(close, r.each(lambda v: np.where((~np.isnan(v)).sum(1) >= 5, np.fmin.reduce(v, 1), np.nan), 10, low)) - 1, div(close, mean(close, 20)) - 1
        atr = div(mean(np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before))), 14, 7), close)
        vol_10 = r.each(deviation, 10, ret[1]) * math.sqrt(10.0)
        neg_7, m = _in_order(r, (ret[1] < 0).astype(float), 7)
        neg_7 = np.where(m >= 4, neg_7, np.nan)
        above_5, above_10, slope = close >= ma_5, close >= mean(close, 10), over(ma_5, r.lag(ma_5, 3)) - 1
        damage = 0.35 * scaled(-ret[10], 0.01, 0.10) + 0.25 * scaled(-dd_20, 0.04, 0.18) + 0.25 * scaled(-dd_60, 0.08, 0.30) + 0.15 * scaled(neg_7, 3.0, 7.0)
        repair = 0.35 * scaled(ret[3], -0.01, 0.08) + 0.20 * scaled(amount_ratio, 0.80, 1.80) + 0.20 * scaled(flow_5, -0.02, 0.06) + 0.15 * above_5 + 0.10 * scaled(slope, -0.01, 0.03)
        entry = 0.65 * triangular(rebound, 0.02, 0.07, 0.16) + 0.35 * triangular(to_ma20, -0.08, -0.01, 0.08)
        support = 0.50 * scaled(flow_5, -0.01, 0.05) + 0.30 * scaled(amount_ratio, 0.90, 1.80) + 0.20 * scaled(turnover_ratio, 0.85, 1.50)
        stability = 0.45 * scaled(to_ma20, -0.08, 0.04) + 0.25 * (1 - scaled(vol_10, 0.02, 0.09)) + 0.15 * (1 - scaled(atr, 0.01, 0.06)) + 0.15 * above_10
        overheat = 0.55 * scaled(rebound, 0.12, 0.25) + 0.45 * scaled(ret[5], 0.06, 0.16)
        return {
            "close": close, "amount": amount, "turnover_rate": turnover, "r1": ret[1], "ret_3": ret[3], "r5": ret[5], "ret_10": ret[10], "ret_20": ret[20], "dd_20": dd_20, "to_ma20": to_ma20, "flow_5": flow_5, "amount_ratio": amount_ratio,
            "rebound": rebound, "atr": atr, "damage": damage, "repair": repair, "entry_window": entry, "flow_support": support, "stability": stability, "overheat": overheat,
            "repair_flag": above_5 & (ret[3] >= 0.01) & (amount_ratio >= 0.90), "early_flag": above_5 & (rebound >= 0.03) & (rebound <= 0.15) & (ret[3] >= 0.01) & (flow_5 >= -0.01), "overheat_flag": overheat >= 0.60,
            "candidate": (damage >= 0.32) & (repair >= 0.45) & (entry >= 0.40) & (support >= 0.35) & (overheat < 0.60),
        }

    names = ("close", "high", "low", "amount", "turnover_rate", "net_mf")
    return by_symbol(bars, {c: c for c in names}, kernel, ", ".join([f"{c} double" for c in RECOVERY] + [f"{c} boolean" for c in RECOVERY_FLAGS]))


def embedding_spectrum(bars: DataFrame, n: int = 60, delay: int = 5) -> DataFrame:
    """``windows.embedding_spectrum`` of the bars' log returns; missing where a return and its delays have no correlation, as one stands still."""
    far = n + 2 * delay

    def spectrum(v):
        out = np.full(len(v), np.nan)
        full = ~np.isnan(v).any(1)
        parts = []
        for k in (2 * delay, delay, 0):
            x = v[full, k : k + n]
            x = x - x[:, :1]  # equal values are 0 to the last bit
            x -= x.mean(1)[:, None]
            parts.append((x, np.einsum("ij,ij->i", x, x)))
        with np.errstate(all="ignore"):
            x, y, z = (np.einsum("ij,ij->i", a, b) / np.sqrt(aa * bb) for (a, aa), (b, bb) in ((parts[0], parts[1]), (parts[1], parts[2]), (parts[0], parts[2])))
            p = np.sqrt((x * x + y * y + z * z) / 3)
            phi = np.arccos(clip(x * y * z / p**3, -1, 1)) / 3
            total = 0.0
            for k in (0.0, 2.0943951023931953, 4.1887902047863905):
                e = 1 + 2 * p * np.cos(phi + k)
                total = total + np.where(e <= 1e-12, 0, e / 3 * np.log(np.where(e <= 1e-12, 1, e) / 3))
        out[full] = np.where(p <= 1e-9, 1.0, -total / math.log(3))
        return out

    def kernel(r: Rows) -> dict:
        lc = np.log(np.where(r["close"] > 0, r["close"], np.nan))
        lr = lc - r.lag(lc)
        there = ~np.isnan(lr)
        own = r.of(there)
        got, whole = np.full(len(lr), np.nan), np.zeros(len(lr), bool)
        if there.any():
            got[there], whole[there] = own.each(spectrum, far, lr[there]), own.at >= far - 1
        return {"spectrum": got, "whole": whole}

    return by_symbol(bars, {"close": "close"}, kernel, "spectrum double, whole boolean").where("whole").drop("whole")


def panel(bars: DataFrame, reaches: tuple[int, ...] = (), together: bool = False) -> DataFrame:
    """``factors.panel`` of ``windows.derived_factors`` without weights: its four factors and forward returns of each bar that has the longest.

    ``known_N`` for each of ``reaches``: the date of the panel's row N rows on;
    ``together`` as in ``by_symbol``.
    """

    def kernel(r: Rows) -> dict:
        close = r["close"]
        mom = {n: over(close, r.lag(close, n)) - 1 for n in (5, 20)}
        mean, var = r.moments(mom[5], 20, 7)
        fwd = {n: over(r.lead(close, n), close) - 1 for n in (5, 10, 20)}
        kept = ~np.isnan(fwd[20]) & ~np.isnan(r["day"])
        known = {n: np.full(len(close), np.nan) for n in reaches}
        for n, days in known.items():
            days[kept] = (own := r.of(kept)).lead(own["day"], n)
        return {"mom_5": mom[5], "mom_20": mom[20], "vs_20": over(close, r.mean(close, 20, 7)) - 1, "reversal": -div(mom[5] - mean, np.sqrt(var))} | {f"fwd_{n}": x for n, x in fwd.items()} | {f"known_{n}": x for n, x in known.items()}

    names = ("mom_5", "mom_20", "vs_20", "reversal", "fwd_5", "fwd_10", "fwd_20", *(f"known_{n}" for n in reaches))
    rows = by_symbol(bars, {"close": "close", "day": "unix_date(trade_date)"}, kernel, ", ".join(f"{c} double" for c in names), together)
    return rows.where("symbol IS NOT NULL AND trade_date IS NOT NULL AND fwd_20 IS NOT NULL").withColumns({f"known_{n}": F.expr(f"date_from_unix_date(CAST(known_{n} AS INT))") for n in reaches})
