"""Rolling-window features over bars (``symbol, trade_date, ...``).

Every operator's windows share one partitioning and order, so that one exchange
and one sort serve them all.
"""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, bit, clip, div, lag, operator, rolling, shannon, so_far, w


@operator
def returns(d, bars):
    """Simple, five-bar and log returns."""
    return f"""
    SELECT *, close / nullif({lag('close')}, 0) - 1 AS r1, close / nullif({lag('close', 5)}, 0) - 1 AS r5, ln(close) - ln({lag('close')}) AS lr,
      CAST(row_number() OVER ({BY}) AS BIGINT) AS bar_no FROM {bars}"""


@operator
def moving_averages(d, bars, windows=(5, 10, 20, 60, 120)):
    cols = ", ".join(f"{rolling('avg', 'close', n, max(3, n // 3))} AS ma_{n}" for n in windows)
    return f"SELECT symbol, trade_date, close, {cols} FROM {bars}"


@operator
def range_position(d, bars, n=20):
    """Break-out over the previous high, place in the range, new-high flag."""
    prev = rolling("max", "high", n, 5, end=1)
    return f"""
    SELECT symbol, trade_date, close / nullif(prev_high, 0) - 1 AS breakout, {div('close - lo', 'hi - lo')} AS range_pos, coalesce(close >= prev_high, false) AS new_high
    FROM (SELECT symbol, trade_date, close, {prev} AS prev_high, {rolling('max', 'high', n, 5)} AS hi, {rolling('min', 'low', n, 5)} AS lo FROM {bars}) x"""


@operator
def volatility(d, rets, short=10, long=40):
    """Sample and population deviations, ratio, compression."""
    return f"""
    SELECT symbol, trade_date, vs, vl, vp, {div('vs', 'vl')} AS vol_ratio, 1 - {div('vs', 'vl')} AS compression FROM (
      SELECT symbol, trade_date, {rolling('stddev_samp', 'r1', short, 5)} AS vs, {rolling('stddev_samp', 'r1', long, 13)} AS vl,
        {rolling('stddev_pop', 'r1', short, 5)} AS vp FROM {rets}) x"""


@operator
def zscore(d, bars, n=20):
    """Population z-scores; no spread is missing."""
    def z(x):
        return f"{div(f'{x} - ({rolling("avg", x, n, n // 3)})', rolling('stddev_pop', x, n, n // 3))} AS {x}_z"
    return f"SELECT symbol, trade_date, {z('vol')}, {z('amount')}, {z('net_mf')}, {z('turnover_rate')} FROM {bars}"


def share_last(d, a: str, inclusive: bool = True) -> str:
    """Share of an array's values that are at most (or below) its last."""
    last = d.at(a, d.size(a))
    return f"{d.size(d.filter(a, f'x {'<=' if inclusive else '<'} {last}'))} / CAST(nullif({d.size(a)}, 0) AS DOUBLE)"


@operator
def bollinger(d, bars, n=20, past=60):
    """Band width and its percentile in the past."""
    return f"""
    SELECT symbol, trade_date, width, CASE WHEN {d.size('a')} >= {past // 2} THEN {share_last(d, 'a')} END AS width_pct FROM (
      SELECT symbol, trade_date, width, {d.collect('width')} {w(past)} AS a FROM (
        SELECT symbol, trade_date, 2 * {rolling('stddev_samp', 'close', n)} / nullif({rolling('avg', 'close', n)}, 0) AS width FROM {bars}) x
      WHERE width IS NOT NULL) y"""


@operator
def detrended(d, bars, n=20):
    return f"""
    SELECT symbol, trade_date, {div(f'lp - ({rolling("avg", "lp", n, 8)})', rolling('stddev_pop', 'lp', n, 8))} AS detrended
    FROM (SELECT symbol, trade_date, ln(close) AS lp FROM {bars} WHERE close > 0) x"""


def pattern(x: str, by: str = BY) -> str:
    """Code of the ordinal pattern of three values: 0, 1, 3, 4, 6 or 7; missing where one is."""
    a, b = lag(x, 2, by), lag(x, 1, by)
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {x} IS NOT NULL THEN 4 * ({bit(f'{a} > {b}')}) + 2 * ({bit(f'{a} > {x}')}) + {bit(f'{b} > {x}')} END"


@operator
def permutation_entropy(d, rows, x="lr", n=20, normalise=True, drop_last=False, least=6, by=BY):
    """Shannon entropy of the ordinal patterns of three in a window.

    ``normalise`` divides by ln 6; ``drop_last`` leaves the newest pattern out;
    below ``least`` values it is missing.
    """
    frame = w(n - 2 - drop_last, by, 1 if drop_last else 0)
    counts = ", ".join(f"sum({bit(f'code = {k}')}) {frame} AS c{k}" for k in (0, 1, 3, 4, 6, 7))
    value = shannon([f"c{k}" for k in (0, 1, 3, 4, 6, 7)], "nullif(total, 0)", 6.0 if normalise else None)
    return f"""
    SELECT symbol, trade_date, CASE WHEN total >= {max(least, n) - 2 - drop_last} THEN {value} END AS pe FROM (
      SELECT symbol, trade_date, {counts}, count(code) {frame} AS total FROM (SELECT symbol, trade_date, {pattern(x, by)} AS code FROM {rows}) p) q"""


def _states(d, a: str, threshold: str) -> str:
    return d.map(a, f"CASE WHEN x > {threshold} THEN 2 WHEN x < -({threshold}) THEN 0 ELSE 1 END")


def pair_counts(d, pairs: str, states: int) -> str:
    """Columns ``total`` and, of each pair of different states, ``k<code>``; ``pairs`` holds i * states + j."""
    codes = [i * states + j for i in range(states) for j in range(states) if i != j]
    if states > 3:  # generated code for so many pairs would be too long to be compiled
        return f"{d.size(pairs)} AS total, " + ", ".join(f"{d.size(d.filter(pairs, f'x = {k}'))} AS k{k}" for k in codes)
    return f"{d.size(pairs)} AS total, " + ", ".join(f"{d.count_of(pairs, k)} AS k{k}" for k in codes)


def irreversibility_of(states: int) -> str:
    """KL of transitions and their reverses, from the columns of ``pair_counts``.  Pairs seen one way only add nothing."""
    terms = []
    for i in range(states):
        for j in range(i + 1, states):
            a, b = f"k{i * states + j}", f"k{j * states + i}"
            terms.append(f"CASE WHEN {a} > 0 AND {b} > 0 THEN ({a} - {b}) * ln({a} / CAST({b} AS DOUBLE)) ELSE 0 END")
    return f"CASE WHEN total > 1 THEN greatest(0, ({' + '.join(terms)}) / total) END"


def _transitions(d, s: str, states: int) -> str:
    return d.map(d.pick(f"sequence(1, size({s}) - 1)", f"range(1, len({s}))"), f"{d.at(s, 'i')} * {states} + {d.at(s, 'i + 1')}", "i")


@operator
def irreversibility(d, rets, n=20, least=10):
    """Three states by half the window's own deviation; array functions, as thresholds are the window's."""
    return f"""
    SELECT symbol, trade_date, CASE WHEN m >= {least} THEN {irreversibility_of(3)} END AS pi FROM (
      SELECT symbol, trade_date, m, {pair_counts(d, 'pairs', 3)} FROM (
        SELECT symbol, trade_date, m, {_transitions(d, 's', 3)} AS pairs FROM (
          SELECT symbol, trade_date, m, {_states(d, 'a', '0.5 * sd')} AS s FROM (
            SELECT symbol, trade_date, {d.collect('lr')} {w(n)} AS a, stddev_pop(lr) {w(n)} AS sd, count(lr) {w(n)} AS m FROM {rets} WHERE lr IS NOT NULL) x
          WHERE m >= 2) y) z) v"""


@operator
def joint_irreversibility(d, rets, n=20):
    """Nine joint states of return and flow."""
    rs, fs = _states(d, "a", "0.5 * sa"), _states(d, "b", "0.5 * sb")
    joint = d.map(d.pick("sequence(1, size(rs))", "range(1, len(rs) + 1)"), f"{d.at('rs', 'i')} * 3 + {d.at('fs', 'i')}", "i")
    return f"""
    SELECT symbol, trade_date, {irreversibility_of(9)} AS pi9 FROM (
      SELECT symbol, trade_date, {pair_counts(d, 'pairs', 9)} FROM (
       SELECT symbol, trade_date, {_transitions(d, 's', 9)} AS pairs FROM (
        SELECT symbol, trade_date, {joint} AS s FROM (
          SELECT symbol, trade_date, {rs} AS rs, {fs} AS fs FROM (
            SELECT symbol, trade_date, {d.collect('lr')} {w(n)} AS a, {d.collect('flow')} {w(n)} AS b, stddev_pop(lr) {w(n)} AS sa, stddev_pop(flow) {w(n)} AS sb,
              count(lr) {w(n)} AS m FROM (SELECT symbol, trade_date, lr, coalesce(net_mf, close - open) AS flow FROM {rets} WHERE lr IS NOT NULL) f) x
          WHERE m = {n}) y) z) v) u"""


EIG_REAL = "CASE WHEN disc >= 0 THEN (p1 + sign(p1) * sqrt(greatest(disc, 0))) / 2 ELSE p1 / 2 END"
EIG_ABS = "CASE WHEN disc >= 0 THEN abs(p1 + sign(p1) * sqrt(greatest(disc, 0))) / 2 ELSE sqrt(greatest(-p2, 0)) END"
YULE_WALKER = "(a1 * r - a1 * a2) / (r * r - a1 * a1) AS p1, (r * a2 - a1 * a1) / (r * r - a1 * a1) AS p2"


def autocovariances(d, c: str = "c") -> str:
    """Columns ``r, a1, a2`` of an array of centred values, the first with a small ridge."""
    def cov(k):
        return f"{d.total(d.map(d.pick(f'sequence(1, size({c}) - {k})', f'range(1, len({c}) - {k} + 1)'), f'{d.at(c, "i")} * {d.at(c, f"i + {k}")}', 'i'))} / ({d.size(c)} - {k})"
    return f"{cov(0)} + 1e-8 AS r, {cov(1)} AS a1, {cov(2)} AS a2"


@operator
def dominant_eigenvalue(d, rets, n=20):
    """Largest root of the AR(2) fit by Yule-Walker: real part and modulus in closed form."""
    return f"""
    SELECT symbol, trade_date, {EIG_REAL} AS eig_real, {EIG_ABS} AS eig_abs FROM (
      SELECT symbol, trade_date, p1, p2, p1 * p1 + 4 * p2 AS disc FROM (
        SELECT symbol, trade_date, {YULE_WALKER} FROM (
          SELECT symbol, trade_date, {autocovariances(d)} FROM (
            SELECT symbol, trade_date, {d.map('a', 'x - mu')} AS c FROM (
              SELECT symbol, trade_date, {d.collect('lr')} {w(n)} AS a, avg(lr) {w(n)} AS mu, stddev_pop(lr) {w(n)} AS sd, count(lr) {w(n)} AS m FROM {rets} WHERE lr IS NOT NULL) x
            WHERE m >= 12 AND sd > 1e-12) y) z) v) u"""


def histogram_bins(d, a: str, lo: str, hi: str, bins: int = 10) -> str:
    """Places in equal bins between the least and largest value, the last one closed; values less than 5e-10 of a bin below an edge are on it; missing for a constant window."""
    b = d.map(a, f"least(CAST(floor((x - {lo}) / ({hi} - {lo}) * {bins} + 5e-10) AS INT), {bins - 1})")
    return f"CASE WHEN {hi} > {lo} THEN {b} END"


def histogram_entropy(d, b: str, bins: int = 10) -> str:
    """Entropy of an array of places: counts first, each made once."""
    counts = d.map(d.range("0", f"{bins - 1}"), d.count_of(b, "k"), "k")
    share = f"k / CAST({d.size(b)} AS DOUBLE)"
    return f"-({d.total(d.map(counts, f'CASE WHEN k > 0 THEN ({share}) * ln({share}) ELSE CAST(0 AS DOUBLE) END', 'k'))})"


@operator
def turnover_entropy(d, bars, x="turnover_rate", n=20, bins=10):
    """Normalised histogram entropy of a window; 0 for a constant one."""
    return f"""
    SELECT symbol, trade_date, CASE WHEN hi > lo THEN ({histogram_entropy(d, 'b', bins)}) / ln({float(bins)}) ELSE 0e0 END AS te FROM (
      SELECT symbol, trade_date, lo, hi, {histogram_bins(d, 'a', 'lo', 'hi', bins)} AS b FROM (
        SELECT symbol, trade_date, {d.collect(x)} {w(n)} AS a, min({x}) {w(n)} AS lo, max({x}) {w(n)} AS hi, count({x}) {w(n)} AS m FROM {bars} WHERE {x} IS NOT NULL) v
      WHERE m = {n}) u"""


def windows_of(d, x: str, short: int, long: int) -> str:
    """Columns ``a, lo, hi`` of a short and a long window of a value."""
    return ", ".join(f"{d.collect(x)} {w(n)} AS a_{t}, min({x}) {w(n)} AS lo_{t}, max({x}) {w(n)} AS hi_{t}" for t, n in (("s", short), ("l", long)))


def entropy_of(d, t: str) -> str:
    return f"CASE WHEN {d.size(f'a_{t}')} < 5 THEN 999.0 WHEN hi_{t} > lo_{t} THEN {histogram_entropy(d, f'b_{t}')} ELSE 0e0 END AS e{t}"


@operator
def relative_entropy(d, rets, short=10, long=40):
    """Histogram entropy of a short and a long window, and their relative difference; 999 below five values; rows whose long window is full."""
    return f"""
    SELECT symbol, trade_date, es, el, (el - es) / nullif(abs(el), 0) AS entropy_rel FROM (
      SELECT symbol, trade_date, {entropy_of(d, 's')}, {entropy_of(d, 'l')} FROM (
        SELECT *, {histogram_bins(d, 'a_s', 'lo_s', 'hi_s')} AS b_s, {histogram_bins(d, 'a_l', 'lo_l', 'hi_l')} AS b_l FROM (
          SELECT symbol, trade_date, {windows_of(d, 'r1', short, long)}, count(*) {w(max(short, long))} AS m FROM {rets} WHERE r1 IS NOT NULL) v WHERE m = {max(short, long)}) u) t"""


def slope_of_logs(values: dict[int, str]) -> str:
    """Least-squares slope of ln value on ln key, over those that are positive; missing below two."""
    import math

    n = " + ".join(f"({bit(f'{v} > 0')})" for v in values.values())
    sx = " + ".join(f"CASE WHEN {v} > 0 THEN {math.log(k)} ELSE 0 END" for k, v in values.items())
    sy = " + ".join(f"CASE WHEN {v} > 0 THEN ln({v}) ELSE 0 END" for v in values.values())
    sxx = " + ".join(f"CASE WHEN {v} > 0 THEN {math.log(k) ** 2} ELSE 0 END" for k, v in values.items())
    sxy = " + ".join(f"CASE WHEN {v} > 0 THEN {math.log(k)} * ln({v}) ELSE 0 END" for k, v in values.items())
    return f"CASE WHEN {n} >= 2 THEN (({n}) * ({sxy}) - ({sx}) * ({sy})) / (({n}) * ({sxx}) - ({sx}) * ({sx})) END"


def _lags(n: int) -> list[int]:
    return [k for k in (2, 4, 8, 16) if k < n]


def moves(n: int) -> str:
    return ", ".join(f"power(close - {lag('close', k)}, 2) AS m{k}" for k in _lags(n))


def displacements(n: int, t: str = "") -> str:
    return ", ".join(f"avg(m{k}) {w(n - k)} AS v{t}{k}" for k in _lags(n))


def hurst_of(n: int, t: str = "", m: str = "m") -> str:
    return f"CASE WHEN {m} = {n} THEN coalesce({slope_of_logs({k: f'v{t}{k}' for k in _lags(n)})} / 2, 0.5) END"


@operator
def hurst(d, bars, n=40):
    """Half the slope of ln mean square displacement on ln lag; 0.5 where it can't be had."""
    return f"""
    SELECT symbol, trade_date, {hurst_of(n)} AS hurst FROM (
      SELECT symbol, trade_date, m, {displacements(n)} FROM (SELECT symbol, trade_date, count(*) {w(n)} AS m, {moves(n)} FROM {bars}) x) y"""


def ar1(x: str, prev: str, n: int) -> str:
    """Regression slope of a value on the one before it."""
    both = f"CASE WHEN {prev} IS NOT NULL AND {x} IS NOT NULL THEN"
    return f"CASE WHEN count({both} {x} END) {w(n)} >= {max(5, n // 2)} AND var_pop({both} {prev} END) {w(n)} > 1e-18 THEN regr_slope({x}, {prev}) {w(n)} END"


@operator
def recovery_rate(d, rets, n=19):
    return f"SELECT symbol, trade_date, a AS ar1, 1 - a AS recovery FROM (SELECT symbol, trade_date, {ar1('lr', 'prev', n)} AS a FROM (SELECT symbol, trade_date, lr, {lag('lr')} AS prev FROM {rets}) x) y"


@operator
def percentile_of_last(d, rets, n=60, inclusive=True):
    return f"""
    SELECT symbol, trade_date, CASE WHEN {d.size('a')} = {n} THEN {share_last(d, 'a', inclusive)} END AS pct FROM (
      SELECT symbol, trade_date, {d.collect('r5')} {w(n)} AS a FROM {rets} WHERE r5 IS NOT NULL) x"""


@operator
def phase_adjusted(d, rets, past=8):
    """Returns less the mean of their last values on the same weekday, third of the month and month of the quarter, one after another.

    Also returns less their whole-sample weekday mean, joined by date, and the
    distortion of the AR(1) slope by the adjustment.
    """
    def by(p):
        return f"PARTITION BY symbol, {p} ORDER BY trade_date"
    def less(x, p):
        frame = w(past, by(p), 1)
        return f"{x} - coalesce(CASE WHEN count({x}) {frame} >= 3 THEN avg({x}) {frame} END, 0)"
    third = "CASE WHEN day(trade_date) <= 10 THEN 0 WHEN day(trade_date) <= 20 THEN 1 ELSE 2 END"
    return f"""
    SELECT symbol, trade_date, adjusted, plain, abs(a - b) AS distortion FROM (
      SELECT symbol, trade_date, adjusted, plain, {ar1('lr', 'lr_prev', 19)} AS a, {ar1('adjusted', 'adj_prev', 19)} AS b FROM (
        SELECT *, {lag('lr')} AS lr_prev, {lag('adjusted')} AS adj_prev FROM (
          SELECT *, {less('x2', 'p3')} AS adjusted FROM (
            SELECT *, {less('x1', 'p2')} AS x2 FROM (
              SELECT *, {less('lr', 'p1')} AS x1, lr - avg(lr) OVER (PARTITION BY symbol, p1) AS plain FROM (
                SELECT symbol, trade_date, lr, {d.weekday('trade_date')} AS p1, {third} AS p2, month(trade_date) % 3 AS p3 FROM {rets} WHERE lr IS NOT NULL) a) b) c) e) f) g"""


@operator
def variance_lift(d, rets):
    return f"SELECT symbol, trade_date, {div(rolling('var_pop', 'lr', 10), rolling('var_pop', 'lr', 20))} - 1 AS var_lift FROM {rets}"


@operator
def adjusted_skew(d, rets, n=20):
    """Skewness with the small-sample correction."""
    m = f"count(lr) {w(n)}"
    value = d.pick(f"skewness(lr) {w(n)} * sqrt({m} * ({m} - 1.0)) / ({m} - 2.0)", f"skewness(lr) {w(n)}")
    return f"SELECT symbol, trade_date, CASE WHEN {m} >= {n} AND var_pop(lr) {w(n)} > 1e-18 THEN {value} END AS skew FROM {rets}"


@operator
def entropy_motion(d, short, long):
    """Gap of long and short entropy, its slope, acceleration and velocity."""
    return f"""
    SELECT symbol, trade_date, gap, gap - {lag('gap', 5)} AS gap_5, (pe - {lag('pe', 5)}) / 5 AS slope, slope1 - {lag('slope1')} AS accel, pe - {lag('pe')} AS velocity FROM (
      SELECT s.symbol, s.trade_date, s.pe, l.pe - s.pe AS gap, s.pe - lag(s.pe) OVER (PARTITION BY s.symbol ORDER BY s.trade_date) AS slope1
      FROM {short} s JOIN {long} l ON s.symbol = l.symbol AND s.trade_date = l.trade_date) x"""


@operator
def structure(d, rets, n=20):
    """Pattern entropy, irreversibility and eigenvalue modulus of each full window that isn't constant, in one pass over the rows.

    The same values as of ``permutation_entropy``, ``irreversibility`` and
    ``dominant_eigenvalue`` joined, where all three are there.
    """
    codes = (0, 1, 3, 4, 6, 7)
    counts = ", ".join(f"sum({bit(f'code = {k}')}) {w(n - 2)} AS c{k}" for k in codes)
    kept = "symbol, trade_date, n_codes, " + ", ".join(f"c{k}" for k in codes)
    return f"""
    SELECT symbol, trade_date, {shannon([f'c{k}' for k in codes], 'n_codes', 6.0)} AS pe, {irreversibility_of(3)} AS pi, {EIG_ABS} AS eig_abs FROM (
      SELECT *, p1 * p1 + 4 * p2 AS disc FROM (
        SELECT *, {YULE_WALKER} FROM (
          SELECT *, {pair_counts(d, 'pairs', 3)}, {autocovariances(d)} FROM (
            SELECT {kept}, c, {_transitions(d, 's', 3)} AS pairs FROM (
              SELECT {kept}, {d.map('a', 'x - mu')} AS c, {_states(d, 'a', '0.5 * sd')} AS s FROM (
                SELECT symbol, trade_date, {counts}, count(code) {w(n - 2)} AS n_codes, {d.collect('lr')} {w(n)} AS a, avg(lr) {w(n)} AS mu, stddev_pop(lr) {w(n)} AS sd, count(lr) {w(n)} AS m FROM (
                  SELECT symbol, trade_date, lr, {pattern('lr')} AS code FROM {rets}) p) q
              WHERE n_codes = {n - 2} AND m = {n} AND sd > 1e-12) y) z) v) u) t"""


@operator
def coherence(d, structures, n=20):
    """Density matrix of four amplitudes: off-diagonal sum, purity, normalised purity, decay, and its ten entries."""
    amp = ("a0", "a1", "a2", "a3")
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    least = max(5, n // 4)
    ok = f"count(a0) {w(n)} >= {least}"
    entries = ", ".join(f"CASE WHEN {ok} THEN avg({amp[i]} * {amp[j]}) {w(n)} END AS r{i}{j}" for i, j in pairs)
    trace = "(r00 + r11 + r22 + r33)"
    off = " + ".join(f"r{i}{j}" for i, j in pairs if i != j)
    purity = "r00 * r00 + r11 * r11 + r22 * r22 + r33 * r33 + 2 * (" + " + ".join(f"r{i}{j} * r{i}{j}" for i, j in pairs if i != j) + ")"
    return f"""
    SELECT *, (purity - 0.25) / 0.75 AS purity_norm, l1 - {lag('l1', 5)} AS decay FROM (
      SELECT *, 2 * ({off}) / 3 AS l1, {purity} AS purity, {trace} AS trace FROM (
        SELECT symbol, trade_date, {entries} FROM (
          SELECT symbol, trade_date, sqrt(q0 / s) AS a0, sqrt(q1 / s) AS a1, sqrt(q2 / s) AS a2, sqrt(q3 / s) AS a3 FROM (
            SELECT *, q0 + q1 + q2 + q3 AS s FROM (
              SELECT symbol, trade_date, pe AS q0, 1 - pe + 1e-9 AS q1, least(pi, 1.0) AS q2, {clip('eig_abs', 0.0, 1.0)} AS q3 FROM {structures}) a) b) c) f WHERE r00 IS NOT NULL) g"""


@operator
def volume_ratios(d, bars):
    """Short over long means of volume, shrinkage, amount ratio."""
    return f"""
    SELECT symbol, trade_date, {div(rolling('avg', 'vol', 5, 3), rolling('avg', 'vol', 20, 7))} AS vol_impulse, 1 - {div(rolling('avg', 'vol', 5, 3), rolling('avg', 'vol', 60, 20))} AS shrink,
      {div('amount', rolling('avg', 'amount', 20, 7))} AS amount_ratio FROM {bars}"""


@operator
def flow_impulse(d, bars):
    """Rolling flow, flow over its deviation, mean flow over mean absolute flow."""
    return f"""
    SELECT symbol, trade_date, {rolling('sum', 'net_mf', 5, 3)} AS mf_5, {rolling('sum', 'net_mf', 20, 7)} AS mf_20, {div('net_mf', rolling('stddev_pop', 'net_mf', 20, 7))} AS mf_impulse,
      {div(rolling('avg', 'net_mf', 5, 3), rolling('avg', 'abs(net_mf)', 20, 7))} AS flow_impulse FROM {bars}"""


@operator
def tiered_flow(d, flow):
    """Net of large tiers, its share, sums, small orders' share, imbalance, momentum, and the run of days above 0."""
    return f"""
    SELECT symbol, trade_date, big_net, {div('big_net', 'gross')} AS big_ratio, {rolling('sum', 'big_net', 10, 3)} AS big_10, {div('small', 'gross')} AS small_share, {div('buys - sells', 'buys + sells')} AS imbalance,
      {rolling('avg', 'big_net', 5, 3)} - {rolling('avg', 'big_net', 20, 7)} AS momentum,
      CASE WHEN pos = 1 THEN CAST(sum(pos) OVER (PARTITION BY symbol, island ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) ELSE 0 END AS streak FROM (
      SELECT *, sum(changed) {so_far()} AS island FROM (
        SELECT *, CASE WHEN pos = coalesce({lag('pos')}, -1) THEN 0 ELSE 1 END AS changed FROM (
          SELECT *, CASE WHEN big_net > 0 THEN 1 ELSE 0 END AS pos FROM (
            SELECT symbol, trade_date, buy_lg + buy_elg - sell_lg - sell_elg AS big_net, buy_sm + sell_sm AS small, buy_sm + buy_md + buy_lg + buy_elg AS buys,
              sell_sm + sell_md + sell_lg + sell_elg AS sells, buy_sm + buy_md + buy_lg + buy_elg + sell_sm + sell_md + sell_lg + sell_elg AS gross FROM {flow}) a) b) c) e"""


@operator
def weekly_extra(d, weekly):
    """Percentile of a price level in 52 weeks, four-week flow, turnover shrinkage."""
    return f"""
    SELECT symbol, bar_end, CASE WHEN {d.size('a')} >= 12 THEN {share_last(d, 'a')} END AS level_pct, mf_4, shrink FROM (
      SELECT symbol, bar_end, {d.collect('close')} {w(52)} AS a, {rolling('sum', 'mf_sum', 4, 1)} AS mf_4, {div(rolling('avg', 'turnover_sum', 4, 2), rolling('avg', 'turnover_sum', 12, 4))} AS shrink
      FROM {weekly}) x"""


@operator
def true_range(d, bars, n=14):
    return f"""
    SELECT symbol, trade_date, tr, {div(rolling('avg', 'tr', n, 5), 'close')} AS atr_ratio FROM (
      SELECT symbol, trade_date, close, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM {bars}) x"""


@operator
def drawdown(d, bars, n=20):
    """Fall from the window's high, rise from its low, days that fell."""
    return f"""
    SELECT symbol, trade_date, close / nullif({rolling('max', 'high', n, 5)}, 0) - 1 AS drawdown, close / nullif({rolling('min', 'low', n, 5)}, 0) - 1 AS rebound,
      {rolling('sum', 'down', 10, 1)} AS down_days FROM (SELECT *, CASE WHEN close < {lag('close')} THEN 1e0 ELSE 0e0 END AS down FROM {bars}) x"""


@operator
def efficiency(d, rets):
    """Net move over path of five bars, share of days up."""
    return f"""
    SELECT symbol, trade_date, {div(f'abs(close - {lag("close", 5)})', rolling('sum', 'step', 5))} AS efficiency, {rolling('avg', 'up', 10, 5)} AS up_ratio
    FROM (SELECT *, abs(close - {lag('close')}) AS step, CASE WHEN r1 > 0 THEN 1e0 WHEN r1 IS NOT NULL THEN 0e0 END AS up FROM {rets}) x"""


@operator
def loop_score(d, rets, n=20):
    """Delay embedding in two dimensions: roundness of the covariance and density of turns."""
    root = "sqrt(greatest((vx - vy) * (vx - vy) + 4 * c * c, 0))"
    return f"""
    SELECT symbol, trade_date, 0.7 * sqrt({clip(div(f'vx + vy - {root}', f'vx + vy + {root}'), 0.0, 1.0)}) + 0.3 * turns AS loop FROM (
      SELECT symbol, trade_date, {rolling('var_samp', 'lr', n)} AS vx, {rolling('var_samp', 'y', n)} AS vy, CASE WHEN count(y) {w(n)} = {n} THEN covar_samp(lr, y) {w(n)} END AS c, {rolling('avg', 'turn', n)} AS turns FROM (
        SELECT symbol, trade_date, lr, {lag('lr')} AS y, CASE WHEN {lag('lr')} IS NULL THEN NULL WHEN lr * {lag('lr')} < 0 THEN 1e0 ELSE 0e0 END AS turn FROM {rets} WHERE lr IS NOT NULL) a) b"""


@operator
def embedding_spectrum(d, rets, n=60, delay=5):
    """Entropy of the eigenvalues of a 3 x 3 correlation of delayed returns, by the trigonometric roots."""
    def corr(a, b):
        return f"corr({a}, {b}) {w(n)}"
    p = "sqrt(greatest((x * x + y * y + z * z) / 3.0, 0))"
    phi = f"acos({clip('(x * y * z) / power(p, 3)', -1.0, 1.0)}) / 3.0"
    eig = [f"(1 + 2 * p * cos(phi + {k}))" for k in (0.0, 2.0943951023931953, 4.1887902047863905)]
    ent = " + ".join(f"CASE WHEN {e} > 1e-12 THEN ({e} / 3) * ln({e} / 3) ELSE 0 END" for e in eig)
    return f"""
    SELECT symbol, trade_date, CASE WHEN p > 1e-9 THEN -({ent}) / ln(3.0) ELSE 1.0 END AS spectrum FROM (
      SELECT *, CASE WHEN p > 1e-9 THEN {phi} END AS phi FROM (
        SELECT *, {p} AS p FROM (
          SELECT symbol, trade_date, {corr('lr', 'b')} AS x, {corr('b', 'c')} AS y, {corr('lr', 'c')} AS z, count(c) {w(n)} AS m FROM (
            SELECT symbol, trade_date, lr, {lag('lr', delay)} AS b, {lag('lr', 2 * delay)} AS c FROM {rets} WHERE lr IS NOT NULL) a) b WHERE m = {n}) e) f"""


@operator
def persistence(d, scored, n=3):
    """Least score of the last n bars, whether all were positive, how many were."""
    return f"""
    SELECT symbol, trade_date, CASE WHEN count(r5) {w(n)} = {n} THEN min(r5) {w(n)} END AS least, coalesce(min({bit('r5 > 0')}) {w(n)} = 1 AND count(*) {w(n)} = {n}, false) AS all_up,
      CAST(sum({bit('r5 > 0')}) {w(n)} AS BIGINT) AS n_up, max({bit('r5 > 0.5')}) {w(10)} = 1 AS recent FROM {scored}"""


@operator
def peak_fade(d, rets):
    """Fall from the highest of five, change over three."""
    return f"SELECT symbol, trade_date, max(close) {w(5)} - close AS fade, close - {lag('close', 3)} AS change_3 FROM {rets}"


@operator
def since_entry(d, rets, entry="DATE '1999-01-04'"):
    """Close against the highest since the entry date."""
    return f"SELECT symbol, trade_date, close / nullif(max(close) {so_far()}, 0) AS peak_ratio FROM {rets} WHERE trade_date >= {entry}"


@operator
def low_run(d, pct, below=0.4):
    """Length of the current run of rows whose percentile is below a level."""
    return f"""
    SELECT symbol, trade_date, CASE WHEN low = 1 THEN CAST(sum(low) OVER (PARTITION BY symbol, island ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) ELSE 0 END AS run FROM (
      SELECT symbol, trade_date, low, sum(1 - low) {so_far()} AS island FROM (SELECT symbol, trade_date, {bit(f'pct < {below}')} AS low FROM {pct}) a) b"""


@operator
def derived_factors(d, rets):
    """Momentum over 5, 20 and 60 bars, price against averages, their synergy, reversal z-score."""
    m = {n: f"close / nullif({lag('close', n)}, 0) - 1" for n in (5, 20, 60)}
    return f"""
    SELECT symbol, trade_date, mom_5, mom_20, mom_60, vs_20, vs_60, mom_20 * vs_20 AS synergy, -{div(f'mom_5 - ({rolling("avg", "mom_5", 20, 7)})', rolling('stddev_pop', 'mom_5', 20, 7))} AS reversal FROM (
      SELECT symbol, trade_date, {m[5]} AS mom_5, {m[20]} AS mom_20, {m[60]} AS mom_60, close / nullif({rolling('avg', 'close', 20, 7)}, 0) - 1 AS vs_20,
        close / nullif({rolling('avg', 'close', 60, 20)}, 0) - 1 AS vs_60 FROM {rets}) x"""


@operator
def alignment(d, ma):
    """How many averages stand in rising, and in falling, order; acceleration of the shortest."""
    up = " + ".join(f"({bit(f'ma_{a} > ma_{b}')})" for a, b in ((5, 10), (10, 20), (20, 60)))
    down = " + ".join(f"({bit(f'ma_{a} < ma_{b}')})" for a, b in ((5, 10), (10, 20), (20, 60)))
    return f"SELECT symbol, trade_date, CAST({up} AS INT) AS bull, CAST({down} AS INT) AS bear, (ma_5 - {lag('ma_5', 5)}) - ({lag('ma_5', 5)} - {lag('ma_5', 10)}) AS accel FROM {ma}"


@operator
def order_flow(d, bars):
    """Net flow, else the body over the range."""
    return f"SELECT symbol, trade_date, coalesce(nullif(net_mf, 0), {div('close - open', 'high - low')}, 0.0) AS flow FROM {bars}"


@operator
def ordinal_entropy(d, rows, x="lr", n=30, order=4):
    """Entropy of ordinal patterns of any order, over ln of the number of patterns; codes are made of pairwise comparisons."""
    import math

    lagged = [lag(x, k) if k else x for k in range(order - 1, -1, -1)]
    pairs = [(i, j) for i in range(order) for j in range(i + 1, order)]
    code = " + ".join(f"{2**k} * ({bit(f'{lagged[i]} > {lagged[j]}')})" for k, (i, j) in enumerate(pairs))
    share = d.pick("size(filter(a, y -> y = x))", "len(list_filter(a, lambda y: y = x))") + f" / CAST({d.size('a')} AS DOUBLE)"
    distinct = d.pick("array_distinct(a)", "list_distinct(a)")
    return f"""
    SELECT symbol, trade_date, -({d.total(d.map('p', 'x * ln(x)'))}) / ln({float(math.factorial(order))}) AS pe FROM (
      SELECT symbol, trade_date, {d.map(distinct, share)} AS p FROM (
        SELECT symbol, trade_date, {d.collect('code')} {w(n - order + 1)} AS a, count(code) {w(n - order + 1)} AS m FROM (
          SELECT symbol, trade_date, CASE WHEN {lagged[0]} IS NOT NULL THEN {code} END AS code FROM {rows} WHERE {x} IS NOT NULL) c WHERE code IS NOT NULL) b WHERE m = {n - order + 1}) e"""


@operator
def structure_score(d, rets, n=20):
    """Four components of the last bars: trend over noise, volume trend, balance of tails, calm."""
    return f"""
    SELECT symbol, trade_date, 0.3 * least(abs({div('m', 'sd')}), 1) + 0.3 * ({clip(div('v5 - v20', 'v20'), -1.0, 1.0)}) + 0.2 * (1 - least(abs(hi + lo) / nullif(hi - lo, 0), 1)) + 0.2 * least(1 / (1 + sd), 1) AS structure FROM (
      SELECT symbol, trade_date, {rolling('avg', 'lr', n)} AS m, {rolling('stddev_pop', 'lr', n)} AS sd, {rolling('avg', 'vol', 5)} AS v5, {rolling('avg', 'vol', n)} AS v20, {rolling('max', 'lr', n)} AS hi, {rolling('min', 'lr', n)} AS lo FROM {rets}) x"""


@operator
def filled_sequences(d, factors, n=20):
    """Factors carried forward over gaps, the factor's mean before the first value; sums over the last rows."""
    carry = d.pick("last(reversal, true)", "last_value(reversal IGNORE NULLS)") + f" {so_far()}"
    return f"""
    SELECT symbol, trade_date, filled, CASE WHEN count(*) {w(n)} = {n} THEN avg(filled) {w(n)} END AS mean_filled FROM (
      SELECT symbol, trade_date, coalesce({carry}, avg(reversal) OVER (PARTITION BY symbol), 0e0) AS filled FROM {factors}) x"""


@operator
def entropy_pair(d, pe, pi):
    """Permutation entropy and irreversibility side by side."""
    return f"SELECT p.symbol, p.trade_date, p.pe, i.pi FROM {pe} p JOIN {pi} i ON p.symbol = i.symbol AND p.trade_date = i.trade_date"
