"""Dual entropy: daily summary, bifurcation score, buy and sell scores of daily and intraday entropy, held trends; signals at a date.

Weights, bounds and thresholds are fixed values of the method; those that depend
on the market's units or on the length of a session are parameters.
"""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, bit, clip, flag, lag, operator, rolling, shannon, so_far, w
from tapeloom.operators.windows import pattern, share_last

CODES = (0, 1, 3, 4, 6, 7)
SESSION = "PARTITION BY symbol, trade_date ORDER BY minute"
HALF = "PARTITION BY symbol, trade_date, afternoon ORDER BY minute"


def _ramp(x: str, start: float, width: float, missing: float = 0.0) -> str:
    """0 up to ``start``, 1 from ``start + width`` on; falling for a negative width."""
    return f"coalesce({clip(f'(({x}) - ({start})) / ({width})', 0.0, 1.0)}, {missing})"


@operator
def daily_summary(d, rets, pe, pe_long, pi, eig, lift, low=0.40, pe_high=0.85, past=120, least=70):
    """Entropies, their gap, place among the last ones, run of compressed days, and moves over five days; from the 70th bar on.

    The place is the share of the window's entropies below the newest, from a
    third of the window on.  Missing places count as 0.5, other missing features
    as 0, but for the two entropies, which stay missing.
    """
    on = lambda t: f"ON r.symbol = {t}.symbol AND r.trade_date = {t}.trade_date"
    return f"""
    SELECT symbol, trade_date, pe, pe_long, coalesce(pe_long - pe, 0) AS gap, coalesce(pct, 0.5) AS pct, coalesce(pi, 0) AS pi, coalesce(eig, 0) AS eig, coalesce(lift, 0) AS lift, compressed,
      CAST(CASE WHEN compressed THEN run ELSE 0 END AS INT) AS days, coalesce(pe - pe_5, 0) AS pe_move, coalesce(pi - pi_5, 0) AS pi_move, coalesce(pct_5, 0.5) AS pct_5, coalesce(eig_5, 0) AS eig_5, coalesce(pi_5, 0) AS pi_5 FROM (
      SELECT *, {flag(f'pct < {low} AND pe < {pe_high}')} AS compressed, row_no - max(CASE WHEN {flag(f'pct < {low}')} THEN 0 ELSE row_no END) {so_far()} AS run,
        {', '.join(f'{lag(c, 5)} AS {c}_5' for c in ('pe', 'pi', 'pct', 'eig'))} FROM (
        SELECT *, row_number() OVER ({BY}) AS row_no FROM (
          SELECT r.symbol, r.trade_date, p.pe, l.pe AS pe_long, i.pi, e.eig_real AS eig, v.var_lift AS lift, CASE WHEN {d.size('p.a')} >= {max(8, past // 3)} THEN {share_last(d, 'p.a', False)} END AS pct
          FROM {rets} r LEFT JOIN (SELECT symbol, trade_date, pe, {d.collect('pe')} {w(past)} AS a FROM {pe} WHERE pe IS NOT NULL) p {on('p')}
          LEFT JOIN {pe_long} l {on('l')} LEFT JOIN {pi} i {on('i')} LEFT JOIN {eig} e {on('e')} LEFT JOIN {lift} v {on('v')}) a) b) c WHERE row_no >= {least}"""


@operator
def bifurcation(d, summary, rets, eig_gate=0.55, accel_gate=-0.05, liquidity_gate=3e6, momentum_floor=-0.08, buy=0.45, watch=0.30):
    """The gates on eigenvalue, acceleration, liquidity and momentum, the four part scores, their sum and the signal."""
    velocity = "(abs(s.eig) - abs(s.eig_5)) / 5"
    return f"""
    SELECT symbol, trade_date, passes, eig_part, gap_part, direction_part, momentum_part, total, CASE WHEN NOT passes THEN 'skip' WHEN total >= {buy} THEN 'buy' WHEN total >= {watch} THEN 'watch' ELSE 'skip' END AS signal FROM (
      SELECT *, 0.40 * eig_part + 0.25 * gap_part + 0.20 * direction_part + 0.15 * momentum_part AS total FROM (
        SELECT s.symbol, s.trade_date, {flag(f'abs(s.eig) >= {eig_gate} AND m.accel <= {accel_gate} AND m.liquidity >= {liquidity_gate} AND m.mom >= {momentum_floor}')} AS passes,
          least(1e0, {_ramp('abs(s.eig)', eig_gate, round(1 - eig_gate, 9))} + {clip(f'{velocity} / 0.03', 0.0, 0.3)}) AS eig_part,
          0.6 * {_ramp('s.gap', 0, 0.12)} + 0.4 * {_ramp('s.pct', 0.40, -0.40)} AS gap_part,
          0.6 * {_ramp('s.pi', 0, 0.05)} + 0.4 * {_ramp('s.pi - s.pi_5', 0, 0.03)} AS direction_part,
          CASE WHEN m.mom > 0 AND m.accel < 0 THEN 0.5 * least(1e0, m.mom / 0.30) + 0.5 * least(1e0, abs(m.accel) / 0.20) WHEN m.mom > 0 THEN least(5e-1, m.mom / 0.30) ELSE 0e0 END AS momentum_part
        FROM {summary} s JOIN (
          SELECT symbol, trade_date, {rolling('sum', 'lr', 20)} AS mom, sum(lr) {w(5)} - sum(lr) {w(5, BY, 5)} AS accel, close * avg(vol) {w(20)} AS liquidity FROM {rets}) m
        ON s.symbol = m.symbol AND s.trade_date = m.trade_date) a) b"""


@operator
def entropy_curve(d, minutes, n=60, least=30, half=15, points=5):
    """M4, M6: a session's pattern entropy, afternoon's less morning's, and slope and deviation of its rolling curve.

    Sessions of fewer than ``least`` bars are left out; halves of fewer than
    ``half`` have no shift; curves of fewer than ``points`` points are flat.
    """
    def entropy(where: str) -> str:
        counts = [f"sum(CASE WHEN {where} = {k} THEN 1 ELSE 0 END)" for k in CODES]
        return shannon(counts, f"nullif(count({where}), 0)", 6.0)
    half_codes = [f"CASE WHEN {cond} THEN half_code END" for cond in ("NOT afternoon", "afternoon")]
    rolled = shannon([f"sum({bit(f'code = {k}')}) {w(n - 2, SESSION)}" for k in CODES], f"nullif(count(code) {w(n - 2, SESSION)}, 0)", 6.0)
    return f"""
    SELECT symbol, trade_date, pe, CASE WHEN n_am >= {half} AND n_pm >= {half} THEN pm - am END AS shift, CASE WHEN n_points >= {points} THEN slope ELSE 0e0 END AS trend, CASE WHEN n_points >= {points} THEN deviation ELSE 0e0 END AS spread FROM (
      SELECT symbol, trade_date, {entropy('code')} AS pe, {entropy(half_codes[0])} AS am, {entropy(half_codes[1])} AS pm, count(CASE WHEN NOT afternoon THEN 1 END) AS n_am, count(CASE WHEN afternoon THEN 1 END) AS n_pm,
        count(e) AS n_points, regr_slope(e, CAST(bar_no AS DOUBLE)) AS slope, stddev_pop(e) AS deviation FROM (
        SELECT *, CASE WHEN count(code) {w(n - 2, SESSION)} = {n - 2} THEN {rolled} END AS e FROM (
          SELECT *, {pattern('lr', SESSION)} AS code, {pattern('half_lr', HALF)} AS half_code FROM (
            SELECT symbol, trade_date, minute, afternoon, row_number() OVER ({SESSION}) AS bar_no, ln(close) - ln({lag('close', 1, SESSION)}) AS lr, ln(close) - ln({lag('close', 1, HALF)}) AS half_lr
            FROM (SELECT symbol, trade_date, minute, close, hour(minute) >= 12 AS afternoon FROM {minutes} WHERE close > 0) a) b) c) e
      GROUP BY symbol, trade_date HAVING count(*) >= {least}) f"""


@operator
def intraday_frame(d, shares, whole, curve, summary, past=10):
    """A session's features, their change against the sessions before, and the last daily summary not after it.

    As-of by a running maximum of the summaries' dates over both tables' rows,
    then an equi-join; sessions without a daily summary are left out.
    """
    before = lambda x: f"coalesce(avg({x}) {w(past, BY, 1)} - {x}, 0)"
    on = lambda a, b: f"ON {a}.symbol = {b}.symbol AND {a}.trade_date = {b}.trade_date"
    daily = ", ".join(f"y.{c} AS d_{c}" for c in ("pe", "pct", "pct_5", "gap", "days", "eig", "lift", "pe_move", "pi_move"))
    return f"""
    SELECT x.symbol, x.trade_date, x.entropy, x.hhi, x.active_ratio, x.range_ratio, x.pi, x.pe, x.shift, x.trend, x.entropy_drop, x.pi_drop, x.hhi_drop, {daily} FROM (
      SELECT *, {before('entropy')} AS entropy_drop, {before('pi')} AS pi_drop, {before('hhi')} AS hhi_drop FROM (
        SELECT s.symbol, s.trade_date, s.entropy, s.hhi, s.active_ratio, s.range_ratio, h.pi, c.pe, c.shift, coalesce(c.trend, 0) AS trend
        FROM {shares} s LEFT JOIN {whole} h {on('s', 'h')} LEFT JOIN {curve} c {on('s', 'c')}) a) x
    JOIN (
      SELECT symbol, trade_date, last_daily FROM (
        SELECT symbol, trade_date, session, max(daily_date) OVER ({BY}) AS last_daily FROM (
          SELECT symbol, trade_date, 1 AS session, CAST(NULL AS DATE) AS daily_date FROM {shares} UNION ALL SELECT symbol, trade_date, 0 AS session, trade_date AS daily_date FROM {summary}) u) v
      WHERE session = 1 AND last_daily IS NOT NULL) k {on('x', 'k')}
    JOIN {summary} y ON y.symbol = k.symbol AND y.trade_date = k.last_daily"""


@operator
def buy_signal(d, frame, pct_most=0.40, pe_most=0.85, active_least=0.70, range_most=0.06, buy=0.55, watch=0.40):
    """Compression, concentration, direction and volume pattern, their sum, the gates and the signal; a missing value passes its gate."""
    gates = f"NOT ({flag(f'd_pct > {pct_most}')} OR {flag(f'd_pe > {pe_most}')} OR {flag(f'active_ratio < {active_least}')} OR {flag(f'range_ratio > {range_most}')})"
    return f"""
    SELECT symbol, trade_date, passes, compression, concentration, direction, volume_pattern, total, CASE WHEN NOT passes THEN 'skip' WHEN total >= {buy} THEN 'buy' WHEN total >= {watch} THEN 'watch' ELSE 'skip' END AS signal FROM (
      SELECT *, 0.30 * compression + 0.30 * concentration + 0.20 * direction + 0.20 * volume_pattern AS total FROM (
        SELECT symbol, trade_date, {gates} AS passes,
          0.35 * greatest(0e0, 1 - d_pct / 0.5) + 0.25 * {_ramp('d_pe', 0.95, -0.25)} + 0.20 * {_ramp('d_gap', 0, 0.05)} + 0.20 * least(1e0, d_days / 10e0) AS compression,
          0.30 * {_ramp('entropy', 0.95, -0.15)} + 0.35 * {_ramp('entropy_drop', 0, 0.08)} + 0.35 * {_ramp('hhi', 0.004, 0.030)} AS concentration,
          0.40 * {_ramp('pi', 0, 0.05)} + 0.30 * least(1e0, abs(d_eig) / 0.8) + 0.30 * {_ramp('-shift / 0.05 + 0.5', 0, 1, 0.5)} AS direction,
          0.25 * {_ramp('active_ratio', 0.5, 0.4)} + 0.35 * {_ramp('range_ratio', 0.06, -0.04, 0.5)} + 0.40 * {_ramp('d_lift * 2 + 0.3', 0, 1, 0.3)} AS volume_pattern
        FROM {frame}) a) b"""


@operator
def sell_signal(d, frame, active_least=0.60, sell=0.50, warning=0.35):
    """Diffusion, stealth, exhaustion and volume anomaly, their sum, the leading one (the first of equals) and the signal; quiet sessions hold."""
    parts = ("diffusion", "stealth", "exhaustion", "anomaly")
    most = f"greatest({', '.join(parts)})"
    kind = " ".join(f"WHEN {p} = {most} THEN '{p}'" for p in parts)
    return f"""
    SELECT symbol, trade_date, diffusion, stealth, exhaustion, anomaly, total, CASE {kind} END AS kind,
      CASE WHEN {flag(f'active_ratio < {active_least}')} THEN 'hold' WHEN total >= {sell} THEN 'sell' WHEN total >= {warning} THEN 'warning' ELSE 'hold' END AS signal FROM (
      SELECT *, 0.30 * diffusion + 0.35 * stealth + 0.20 * exhaustion + 0.15 * anomaly AS total FROM (
        SELECT symbol, trade_date, active_ratio,
          0.40 * {_ramp('d_pe_move', 0, 0.05)} + 0.35 * (0.6 * {_ramp('d_pct', 0.50, 0.30)} + 0.4 * {_ramp('d_pct - d_pct_5', 0, 0.20)}) + 0.25 * {_ramp('d_gap', 0.02, -0.04)} AS diffusion,
          0.30 * {_ramp('-entropy_drop', 0, 0.05)} + 0.25 * {_ramp('shift', 0, 0.05)} + 0.25 * {_ramp('pi_drop', 0, 0.02)} + 0.20 * {_ramp('hhi_drop', 0, 0.01)} AS stealth,
          0.30 * {_ramp('d_pe', 0.85, 0.10)} + 0.25 * {_ramp('pe', 0.90, 0.08)} + 0.25 * {_ramp('-d_pi_move', 0, 0.03)} + 0.20 * greatest(0e0, 1 - abs(d_eig) / 0.5) AS exhaustion,
          0.40 * {_ramp('range_ratio', 0.02, 0.03)} + 0.35 * {_ramp('hhi_drop', 0, 0.008)} + 0.25 * {_ramp('trend', 0, 0.001)} AS anomaly
        FROM {frame}) a) b"""


@operator
def trend_hold(d, held, summary, sell=0.50, boost=0.25, eig_least=0.35, pi_least=0.015, pct_most=0.92, profit=0.20):
    """Whether a held position's trend is alive, and the score that selling it takes."""
    alive = f"s.pct <= {pct_most} AND (abs(s.eig) > {eig_least} OR s.pi > {pi_least} OR h.pnl > {profit})"
    return f"""
    SELECT h.symbol, h.entry_date, h.trade_date, {flag(alive)} AS alive, {sell}e0 + CASE WHEN {alive} THEN {boost}e0 ELSE 0e0 END AS sell_from
    FROM {held} h JOIN {summary} s ON h.symbol = s.symbol AND h.trade_date = s.trade_date"""


@operator
def signals_at(d, scored, on="DATE '1999-06-30'", exact=True):
    """Each symbol's resonance row at a date; if not ``exact``, its last one up to it.  Missing states and counts are false and 0."""
    cols = f"s.symbol, s.trade_date, {flag('s.resonance_state')} AS resonance_state, coalesce(s.support_count, 0) AS support_count, s.score_min, s.resonance_score"
    if exact:
        return f"SELECT {cols} FROM {scored} s WHERE s.trade_date = {on}"
    return f"SELECT {cols} FROM {scored} s JOIN (SELECT symbol, max(trade_date) AS latest FROM {scored} WHERE trade_date <= {on} GROUP BY symbol) m ON s.symbol = m.symbol AND s.trade_date = m.latest"
