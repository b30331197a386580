"""Accumulation, break-out and collapse detectors over a joined feature frame, and the market trend of seven scores.

Thresholds and weights are parameters; the defaults are fixed values of the
method.  A comparison with a missing value doesn't hold.
"""

from __future__ import annotations

from tapeloom.functions.sqlkit import bit, clip, lag, operator, rolling, shown, so_far, w

DAY = "ORDER BY trade_date"


def _held(conds: list[str]) -> str:
    return " + ".join(f"({bit(c)})" for c in conds)


@operator
def detector_frame(d, volumes, pe, pi, eig, coh, flow, motion):
    """One row a symbol and day with all features that the detectors read; missing ones stay missing."""
    on = lambda t: f"ON v.symbol = {t}.symbol AND v.trade_date = {t}.trade_date"
    return f"""
    SELECT v.symbol, v.trade_date, v.vol_impulse, p.pe, i.pi, e.eig_real AS eig, c.purity_norm, c.decay, f.big_10, f.big_ratio, f.imbalance, f.momentum, f.streak, m.accel
    FROM {volumes} v LEFT JOIN {pe} p {on('p')} LEFT JOIN {pi} i {on('i')} LEFT JOIN {eig} e {on('e')} LEFT JOIN {coh} c {on('c')} LEFT JOIN {flow} f {on('f')} LEFT JOIN {motion} m {on('m')}"""


@operator
def detect_accumulation(d, frame, pe_low=0.65, pi_high=0.05, imbalance_least=0.3, days=5):
    """All but one of four conditions on each of the last days, and a quality in 0..1."""
    conds = [f"pe < {pe_low}", f"pi > {pi_high}", "big_10 > 0", f"imbalance > {imbalance_least}"]
    ratio = rolling("avg", "big_ratio", 5, 1)
    return f"""
    SELECT *, coalesce(sum({bit(f'met >= {len(conds) - 1}')}) {w(days)} >= {days}, false) AS accumulating FROM (
      SELECT *, CAST({_held(conds)} AS INT) AS met,
        {clip(f'''0.25 * coalesce(1 - ({clip('pe', 0.3, 1.0)}), 0) + 0.20 * coalesce(({clip('pi', 0.0, 0.5)}) / 0.5, 0) + 0.10 * coalesce((({clip(ratio, -0.1, 0.1)}) / 0.1 + 1) / 2, 0.5)
          + 0.15 * coalesce({clip('purity_norm', 0.0, 1.0)}, 0) + 0.15 * coalesce(({clip('streak', 0, 10)}) / 10e0, 0) + 0.15 * coalesce({clip(f"({clip('imbalance', -1.0, 2.0)}) / 2 + 0.5", 0.0, 1.0)}, 0.5)''', 0.0, 1.0)} AS quality
      FROM {frame}) x"""


@operator
def detect_breakout(d, found, eig_high=0.85, impulse_high=1.8, pe_most=0.75, recent=10):
    """All but one of five conditions, recent accumulation among them, and a quality in 0..1."""
    conds = ["lately = 1", f"eig > {eig_high}", f"vol_impulse > {impulse_high}", f"pe < {pe_most}", "momentum > 0"]
    norm = f"CASE WHEN sd > 0 THEN {clip('momentum / sd', -2.0, 2.0)} END"
    return f"""
    SELECT *, {_held(conds)} >= {len(conds) - 1} AS breakout,
      {clip(f'''0.20 * coalesce((({clip('eig', 0.5, 1.0)}) - 0.5) / 0.5, 0) + 0.20 * coalesce((({clip('vol_impulse', 1.0, 5.0)}) - 1) / 4, 0) + 0.10 * coalesce(1 - ({clip('pe', 0.3, 1.0)}), 0)
        + 0.10 * coalesce(({clip('pi', 0.0, 0.5)}) / 0.5, 0) + 0.15 * ({clip('-coalesce(decay, 0)', 0.0, 0.05)}) / 0.05 + 0.15 * coalesce((({norm}) + 2) / 4, 0.5) + 0.10 * coalesce((({clip('big_ratio', -0.3, 0.3)}) + 0.3) / 0.6, 0.5)''', 0.0, 1.0)} AS breakout_quality FROM (
      SELECT *, max({bit('accumulating')}) {w(recent)} AS lately, {rolling('stddev_samp', 'coalesce(momentum, 0)', 20, 5)} AS sd FROM {found}) x"""


@operator
def detect_collapse(d, found, pe_high=0.90, pi_low=0.01, accel_high=0.05, exhausted=0.3, purity_low=0.3, least=3, most_days=20):
    """At least three of five signals, volume against its peak since the last break-out among them, or held for too long; and the phase."""
    signs = [f"pe > {pe_high}", f"pi < {pi_low}", f"accel > {accel_high}", f"entry_no IS NOT NULL AND peak > 0 AND vol_impulse / peak < {exhausted}", f"purity_norm < {purity_low}"]
    since = "PARTITION BY symbol, entry_no ORDER BY trade_date"
    return f"""
    SELECT symbol, trade_date, met, accumulating, quality, breakout, breakout_quality, CAST(signs AS INT) AS signs, collapse,
      CASE WHEN collapse THEN 'collapse' WHEN breakout THEN 'breakout' WHEN accumulating THEN 'accumulation' ELSE 'idle' END AS phase FROM (
      SELECT *, signs >= {least} OR coalesce(bar_no - entry_no > {most_days}, false) AS collapse FROM (
        SELECT *, {_held(signs)} AS signs FROM (
          SELECT *, max(vol_impulse) OVER ({since} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM (
            SELECT *, max(CASE WHEN breakout AND NOT before THEN bar_no END) {so_far()} AS entry_no FROM (
              SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS bar_no, coalesce({lag('breakout')}, false) AS before FROM {found}) a) b) c) e) f"""


@operator
def trend_inputs(d, rets, master, pe, flow):
    """Each symbol and day as the market's scores see it; entropy in natural units."""
    by = "PARTITION BY r.symbol ORDER BY r.trade_date"
    own = lambda agg, x, n, least: rolling(agg, x, n, least, by=by)
    return f"""
    SELECT r.symbol, r.trade_date, m.industry, r.r1, r.net_mf, f.big_net, p.pe * ln(6e0) AS entropy, r.close > {own('avg', 'r.close', 20, 20)} AS above_20, r.close > {own('avg', 'r.close', 60, 60)} AS above_60,
      r.close >= max(r.high) {w(60, by)} AS new_high, {own('stddev_samp', 'r.r1', 5, 5)} AS sd, r.r5 / 5 AS drift, sign(r.r1) AS today, sign(lag(r.r5) OVER ({by})) AS before
    FROM {rets} r LEFT JOIN {master} m ON r.symbol = m.symbol LEFT JOIN {pe} p ON r.symbol = p.symbol AND r.trade_date = p.trade_date LEFT JOIN {flow} f ON r.symbol = f.symbol AND r.trade_date = f.trade_date"""


@operator
def trend_micro(d, inputs, panic=-0.05, ordered=1.0):
    """Shares, medians and sums by date; spread of the industries' means, two levels of aggregation."""
    share = lambda c: f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"
    return f"""
    SELECT a.trade_date, n, advance, above_20, above_60, new_high, inflow, big_sum, sd_median, panic, entropy_median, ordered, coalesce(aligned, 0.5) AS aligned, coalesce(spread, 0) AS spread FROM (
      SELECT trade_date, count(*) AS n, {share('r1 > 0')} AS advance, {share('above_20')} AS above_20, {share('above_60')} AS above_60, {share('new_high')} AS new_high, {share('net_mf > 0')} AS inflow, sum(big_net) AS big_sum,
        coalesce({d.median('sd')}, 0) AS sd_median, {share(f'r1 < {panic}')} AS panic, coalesce({d.median('entropy')}, 0) AS entropy_median, coalesce(avg(CASE WHEN entropy < {ordered} THEN 1e0 WHEN entropy IS NOT NULL THEN 0e0 END), 0) AS ordered,
        avg(CASE WHEN today = before THEN 1e0 WHEN today IS NOT NULL AND before IS NOT NULL THEN 0e0 END) AS aligned
      FROM {inputs} WHERE r1 IS NOT NULL GROUP BY trade_date) a LEFT JOIN (
      SELECT trade_date, stddev_pop(mean_r) AS spread FROM (SELECT trade_date, industry, avg(r1) AS mean_r FROM {inputs} WHERE r1 IS NOT NULL GROUP BY trade_date, industry) s GROUP BY trade_date HAVING count(*) >= 2) b ON a.trade_date = b.trade_date"""


@operator
def market_trend(d, micro, emas, limits, daily, thrust=0.615, up=0.2, strong_up=0.5, down=-0.2, strong_down=-0.5, panic_least=0.03):
    """Seven scores in -1..1, their weighted sum and the trend.

    ``daily`` has the margin balance and overnight rate carried to each date; the
    day's change of the balance is the net buying.
    """
    part = lambda x, mid, half: clip(f"(({x}) - ({mid})) / {half}", -1.0, 1.0)
    # fixed values: middle and half width of each score's range, and weights
    breadth = f"0.30 * ({part('advance', 0.5, 0.2)}) + 0.25 * ({part('above_20', 0.5, 0.2)}) + 0.15 * ({part('above_60', 0.5, 0.2)}) + 0.15 * ({clip('new_high / 0.1', 0.0, 1.0)}) + 0.15 * ({clip('limit_diff / 50e0', -1.0, 1.0)})"
    money = f"0.6 * ({part('inflow', 0.5, 0.2)}) + 0.4 * ({clip('coalesce(big_sum, 0) / 5e5', -1.0, 1.0)})"
    volatility = f"0.5 * ({clip('1 - (sd_median - 0.01) / 0.03 * 2', -1.0, 1.0)}) + 0.5 * ({clip('-panic / 0.05', -1.0, 0.0)})"
    order = f"0.5 * ({part('ordered', 0.45, 0.25)}) + 0.5 * ({clip('1 - (entropy_median - 0.8) / 0.8 * 2', -1.0, 1.0)})"
    momentum = f"0.6 * ({part('aligned', 0.55, 0.15)}) + 0.4 * ({clip('1 - (spread - 0.02) / 0.06 * 2', -1.0, 1.0)})"
    leverage = f"0.35 * ({clip('coalesce(change, 0) / 0.02', -1.0, 1.0)}) + 0.35 * ({clip('CASE WHEN ma_20 > 0 THEN (ma_5 / ma_20 - 1) / 0.02 ELSE 0e0 END', -1.0, 1.0)}) + 0.30 * ({clip('coalesce(net_buy, 0) / 50', -1.0, 1.0)})"
    liquidity = f"0.30 * ({clip('1 - (coalesce(rate, 0) - 1.0) / 2.0 * 2', -1.0, 1.0)}) + 0.30 * ({clip('CASE WHEN rate_20 > 0 THEN -(rate / rate_20 - 1) / 0.2 ELSE 0e0 END', -1.0, 1.0)}) + 0.40 * ({clip('-coalesce(rate_change, 0) / 0.3', -1.0, 1.0)})"
    at = f"OVER ({DAY})"
    return f"""
    SELECT *, CASE WHEN composite >= {strong_up} AND is_thrust THEN 'STRONG_UP' WHEN composite >= {up} THEN 'UP' WHEN composite <= {strong_down} AND panic > {panic_least} THEN 'STRONG_DOWN' WHEN composite <= {down} THEN 'DOWN' ELSE 'NEUTRAL' END AS trend FROM (
      SELECT trade_date, panic, is_thrust, breadth, money, volatility, entropy_score, momentum, leverage, liquidity,
        {clip('0.25 * breadth + 0.20 * money + 0.10 * volatility + 0.15 * entropy_score + 0.10 * momentum + 0.10 * leverage + 0.10 * liquidity', -1.0, 1.0)} AS composite FROM (
        SELECT trade_date, panic, is_thrust, {clip(f'least({breadth} + CASE WHEN is_thrust THEN 0.15 ELSE 0 END, 1.0)', -1.0, 1.0)} AS breadth, {money} AS money, {volatility} AS volatility, {order} AS entropy_score, {momentum} AS momentum, {leverage} AS leverage, {liquidity} AS liquidity FROM (
          SELECT m.*, coalesce(e.ema > {thrust}, false) AS is_thrust, coalesce(l.n_up - l.n_down, 0) AS limit_diff, x.change, x.ma_5, x.ma_20, x.net_buy, x.rate, x.rate_20, x.rate_change FROM {micro} m
          LEFT JOIN {emas} e ON m.trade_date = e.trade_date LEFT JOIN {limits} l ON m.trade_date = l.trade_date LEFT JOIN (
            SELECT trade_date, rzye / nullif(lag(rzye) {at}, 0) - 1 AS change, {rolling('avg', 'rzye', 5, 1, DAY)} AS ma_5, {rolling('avg', 'rzye', 20, 1, DAY)} AS ma_20, rzye - lag(rzye) {at} AS net_buy,
              on_rate AS rate, {rolling('avg', 'on_rate', 20, 1, DAY)} AS rate_20, on_rate - lag(on_rate) {at} AS rate_change FROM {daily}) x ON m.trade_date = x.trade_date) a) b) c"""


@operator
def regime_by_date(d, index_bars, months):
    """Each index date with the last finished month's regime; dates before the first are given the first one.  One row a date: one task."""
    first = d.pick("first(own, true) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "first_value(own IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    last = d.pick("last(own, true) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "last_value(own IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return f"""
    SELECT trade_date, close, coalesce({last}, {first}) AS regime FROM (
      SELECT i.trade_date, i.close, CASE WHEN i.trade_date = e.last_date THEN m.lasting END AS own FROM {index_bars} i
      LEFT JOIN (SELECT last_day(trade_date) AS month_end, max(trade_date) AS last_date FROM {index_bars} GROUP BY last_day(trade_date)) e ON i.trade_date = e.last_date
      LEFT JOIN {months} m ON e.month_end = m.month_end) x"""


@operator
def snapshot_with_week(d, daily, weekly, least=1):
    """Each symbol's last daily row with its last week's row up to it, the week's columns prefixed."""
    return f"""
    SELECT s.symbol, s.trade_date, s.close, s.r1, max(k.bar_end) AS w_bar_end, max_by(k.close, k.bar_end) AS w_close, max_by(k.ret, k.bar_end) AS w_ret, max_by(k.amount_sum, k.bar_end) AS w_amount_sum FROM (
      SELECT symbol, max(trade_date) AS trade_date, max_by(close, trade_date) AS close, max_by(r1, trade_date) AS r1 FROM {daily} GROUP BY symbol HAVING count(*) >= {least}) s
    LEFT JOIN {weekly} k ON s.symbol = k.symbol AND k.bar_end <= s.trade_date GROUP BY s.symbol, s.trade_date, s.close, s.r1"""


@operator
def filled_top(d, scored, total=10):
    """K3: best rows of a state by date, filled up with the best of the others where they are too few: two ranks, no loop."""
    own = d.pick(shown("score", 9), "score")  # scores that are equal but for their last bits are ties, as the order of adding trades differs with the tasks
    return f"""
    SELECT symbol, trade_date, score, CAST(place AS INT) AS place, fallback FROM (
      SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY fallback, {own} DESC, symbol) AS place FROM (
        SELECT symbol, trade_date, coalesce(resonance_score, -999.0) AS score, NOT coalesce(resonance_state, false) AS fallback FROM {scored}) x) y WHERE place <= {total}"""
