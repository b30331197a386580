"""Ordered recurrences over one row a date, coupling and noise of the market, its phase and gate, the month regime.

Recurrences are closed forms over windows, exact for any length.  Tables of one
row a date or month are ordered in one task, which dates bound.  Thresholds are
parameters; the defaults are fixed values of the method.
"""

from __future__ import annotations

import math

from tapeloom.functions.sqlkit import BY, bit, clip, div, lag, operator, rolling, w
from tapeloom.operators.windows import displacements, entropy_of, histogram_bins, hurst_of, moves

DAY = "ORDER BY trade_date"


@operator
def ema(d, breadths, x="advance", alpha=2 / 11):
    """Exponential average that begins with the first value; the thrust of a day uses the average before it.

    In blocks of dates the weighted sums are one window each.  A block takes over
    the end of the one before; what came earlier has a weight below 1e-16.
    """
    q = 1 - alpha
    block = max(2, math.ceil(37 / -math.log(q)))
    return f"""
    SELECT trade_date, {x}, ema, {x} - lag(ema) OVER ({DAY}) AS thrust FROM (
      SELECT a.trade_date, a.{x}, a.own + power({q!r}e0, a.j + 1) * coalesce(b.own, 0e0) AS ema FROM (
        SELECT *, {alpha!r}e0 * power({q!r}e0, j) * sum(v * power({q!r}e0, -j)) OVER (PARTITION BY block {DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM (
          SELECT trade_date, {x}, CASE WHEN i = 0 THEN {x} / {alpha!r}e0 ELSE {x} END AS v, i % {block} AS j, CAST(floor(i / {block}e0) AS BIGINT) AS block FROM (
            SELECT trade_date, {x}, row_number() OVER ({DAY}) - 1 AS i FROM {breadths} WHERE {x} IS NOT NULL) r) s) a
      LEFT JOIN (
        SELECT block + 1 AS block, max_by(own, j) AS own FROM (
          SELECT *, {alpha!r}e0 * power({q!r}e0, j) * sum(v * power({q!r}e0, -j)) OVER (PARTITION BY block {DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM (
            SELECT trade_date, CASE WHEN i = 0 THEN {x} / {alpha!r}e0 ELSE {x} END AS v, i % {block} AS j, CAST(floor(i / {block}e0) AS BIGINT) AS block FROM (
              SELECT trade_date, {x}, row_number() OVER ({DAY}) - 1 AS i FROM {breadths} WHERE {x} IS NOT NULL) r) s) t GROUP BY block) b ON a.block = b.block) y"""


def held_label(d, x: str, order: str, rows: str, persist: int) -> str:
    """SQL over ``rows``: ``lasting``, the label ``x`` that last stood for ``persist`` rows on end; the first one before that."""
    so_far = f"OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last = d.pick(f"last(settled, true) {so_far}", f"last_value(settled IGNORE NULLS) {so_far}")
    return f"""
    SELECT *, coalesce({last}, first_value({x}) {so_far}) AS lasting FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY {order}) >= {persist} THEN {x} END AS settled FROM (
        SELECT *, sum(CASE WHEN {x} = before THEN 0 ELSE 1 END) {so_far} AS run FROM (
          SELECT *, lag({x}) OVER (ORDER BY {order}) AS before FROM {rows}) h1) h2) h3"""


@operator
def month_rows(d, bars):
    """Months of an index made of all symbols: last mean close, return, sum of net flow."""
    return f"""
    SELECT symbol, month_end AS trade_date, close, close / nullif(lag(close) OVER (ORDER BY month_end), 0) - 1 AS ret, mf_sum FROM (
      SELECT 0 AS symbol, last_day(trade_date) AS month_end, max_by(close, trade_date) AS close, sum(net_mf) AS mf_sum FROM (
        SELECT trade_date, avg(close) AS close, sum(net_mf) AS net_mf FROM {bars} GROUP BY trade_date) x GROUP BY last_day(trade_date)) y"""


@operator
def month_regime(d, months, short=12, long=36, persist=2):
    """BULL, RISK or BASE of each month by average, Hurst slope, flow and entropy; ``lasting`` changes once a label has stood ``persist`` months."""
    kept = lambda n, t: d.pick(f"collect_list(ret) {w(n)}", f"list(ret) FILTER (WHERE ret IS NOT NULL) {w(n)}") + f" AS a_{t}, min(ret) {w(n)} AS lo_{t}, max(ret) {w(n)} AS hi_{t}, count(*) {w(n)} AS n_{t}"
    z = div(f"mf_sum - ({rolling('avg', 'mf_sum', 12, 4)})", rolling("stddev_pop", "mf_sum", 12, 4))
    rows = f"""(
      SELECT trade_date AS month_end, close, close_over_ma, hurst, mf_z, entropy_rel,
        CASE WHEN close_over_ma >= 1.02 AND hurst >= 0.55 AND coalesce(mf_z, 0) >= -0.25 THEN 'BULL'
          WHEN close_over_ma IS NOT NULL AND (close_over_ma <= 0.98 OR mf_z <= -0.75) AND entropy_rel > 0 THEN 'RISK' ELSE 'BASE' END AS raw FROM (
        SELECT *, CASE WHEN n_s = {short} AND n_l = {long} THEN (es - el) / nullif(el, 0) END AS entropy_rel FROM (
          SELECT trade_date, close, close / nullif(ma, 0) AS close_over_ma, {clip(hurst_of(short, 's', 'n_s'), 0.0, 1.0)} AS hurst, mf_z, n_s, n_l, {entropy_of(d, 's')}, {entropy_of(d, 'l')} FROM (
            SELECT *, {histogram_bins(d, 'a_s', 'lo_s', 'hi_s')} AS b_s, {histogram_bins(d, 'a_l', 'lo_l', 'hi_l')} AS b_l FROM (
              SELECT trade_date, close, {rolling('avg', 'close', short, max(3, short // 3))} AS ma, {z} AS mf_z, {kept(short, 's')}, {kept(long, 'l')}, {displacements(short, 's')} FROM (
                SELECT *, {moves(short)} FROM {months}) m1) m2) m3) m4) m5)"""
    return f"SELECT month_end, close, close_over_ma, hurst, mf_z, entropy_rel, raw, lasting FROM ({held_label(d, 'raw', 'month_end', rows, persist)}) z"


@operator
def pair_correlations(d, days, master, n=20, least=5):
    """Correlation of each pair of industries' mean returns over the last n dates; industries of at least so many symbols.

    One row a pair and date on which both have a return; a window of sums each,
    no join of windows.  ``days`` has ``industry, trade_date, day_no, ret``.
    """
    own = f"(SELECT x.* FROM {days} x JOIN (SELECT industry FROM {master} GROUP BY industry HAVING count(DISTINCT symbol) >= {least}) k ON x.industry = k.industry)"
    last = f"OVER (PARTITION BY a_industry, b_industry ORDER BY day_no RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT a_industry, b_industry, trade_date, day_no, CASE WHEN va > 1e-18 AND vb > 1e-18 THEN least(greatest(c / sqrt(va * vb), -1e0), 1e0) END AS pair_corr FROM (
      SELECT a_industry, b_industry, trade_date, day_no, covar_pop(x, y) {last} AS c, var_pop(x) {last} AS va, var_pop(y) {last} AS vb FROM (
        SELECT a.industry AS a_industry, b.industry AS b_industry, a.trade_date, a.day_no, a.ret AS x, b.ret AS y FROM {own} a JOIN {own} b ON a.trade_date = b.trade_date AND a.industry < b.industry) p) q"""


@operator
def coupling(d, pairs, days, n=20, bins=10):
    """Entropy of the histogram of the pairs' correlations between their least and greatest, by date; 0.5 without pairs or on the first dates."""
    return f"""
    SELECT c.trade_date, c.day_no, CASE WHEN c.day_no >= {n} THEN coalesce(e.entropy, 0.5e0) ELSE 0.5e0 END AS coupling FROM (SELECT DISTINCT trade_date, day_no FROM {days}) c LEFT JOIN (
      SELECT trade_date, -sum(k / CAST(total AS DOUBLE) * ln(k / CAST(total AS DOUBLE))) / ln({float(bins)}) AS entropy FROM (
        SELECT trade_date, bin, count(*) AS k, min(total) AS total FROM (
          SELECT trade_date, total, CASE WHEN hi > lo THEN least(CAST(floor((pair_corr - lo) / (hi - lo) * {bins} + 5e-10) AS INT), {bins - 1}) ELSE 0 END AS bin FROM (
            SELECT trade_date, pair_corr, min(pair_corr) OVER (PARTITION BY trade_date) AS lo, max(pair_corr) OVER (PARTITION BY trade_date) AS hi, count(*) OVER (PARTITION BY trade_date) AS total FROM {pairs} WHERE pair_corr IS NOT NULL) h) b GROUP BY trade_date, bin) g GROUP BY trade_date) e ON c.trade_date = e.trade_date"""


@operator
def noise_cost(d, rets, n=20, frame=60):
    """Mean over the day's symbols of four costs over their last ``frame`` rows: clustering, volume change, jumps, extremes.

    A symbol counts from its n-th row on; 0.5 on dates without one.
    """
    back = w(frame)
    over = d.pick("size(filter(moved, y -> y > 2 * vol_mean))", "len(list_filter(moved, lambda y: y > 2 * vol_mean))")
    kept = d.pick(f"collect_list(abs(r1)) {back}", f"list(abs(r1)) FILTER (WHERE r1 IS NOT NULL) {back}")
    return f"""
    SELECT t.trade_date, coalesce({clip('0.30 * clustering + 0.25 * imbalance + 0.25 * jumps + 0.20 * extremes', 0.0, 1.0)}, 0.5e0) AS noise, clustering, imbalance, jumps, extremes FROM (SELECT DISTINCT trade_date FROM {rets}) t LEFT JOIN (
      SELECT trade_date, {clip('(avg(coalesce(ac, 0e0)) + 1) / 2', 0.0, 1.0)} AS clustering, least(1e0, 10 * avg(vc)) AS imbalance, avg(jump) AS jumps, avg(extreme) AS extremes FROM (
        SELECT trade_date, ac, vc, jump, {over} / CAST(m AS DOUBLE) AS extreme FROM (
          SELECT trade_date, bar_no, CASE WHEN count(both_v) {back} > 10 AND var_pop(both_v) {back} > 1e-18 AND var_pop(before_v) {back} > 1e-18 THEN corr(both_v, before_v) {back} END AS ac,
            avg(abs(vc)) {back} AS vc, avg(jump) {back} AS jump, avg(vol_n) {back} AS vol_mean, {kept} AS moved, count(*) {back} AS m FROM (
            SELECT *, CASE WHEN before IS NOT NULL THEN vol_n END AS both_v, CASE WHEN vol_n IS NOT NULL THEN before END AS before_v FROM (
              SELECT *, {lag('vol_n')} AS before FROM (
                SELECT symbol, trade_date, bar_no, r1, vol / nullif({lag('vol')}, 0) - 1 AS vc, {rolling('stddev_samp', 'r1', n)} AS vol_n, CASE WHEN abs(lr) > 3 * ({rolling('stddev_samp', 'lr', n)}) THEN 1e0 ELSE 0e0 END AS jump FROM {rets}) x) y) z) u WHERE bar_no >= {n}) v GROUP BY trade_date) s ON t.trade_date = s.trade_date"""


@operator
def market_phase(d, couplings, noises, coupling_low=0.4, coupling_high=0.6, coupling_critical=0.8, noise_low=0.3, noise_high=0.6, noise_critical=0.8, months=(1, 4, 7, 10), from_day=15):
    """Levels of coupling (less in reporting and holiday windows) and noise, the phase that they make, and the gate's score."""
    month, day = "month(c.trade_date)", "day(c.trade_date)"
    less = f"""CASE WHEN {month} IN ({', '.join(map(str, months))}) AND {day} >= {from_day} THEN 0.10e0 ELSE 0e0 END
      + CASE WHEN ({month} = 1 AND {day} >= 20) OR ({month} = 2 AND {day} <= 15) OR ({month} = 10 AND {day} <= 10) THEN 0.05e0 ELSE 0e0 END"""
    level = lambda x, low, high, critical: f"CASE WHEN {x} < {low} THEN 'low' WHEN {x} < {high} THEN 'medium' WHEN {x} < {critical} THEN 'high' ELSE 'critical' END"
    base = "CASE state WHEN 'compression' THEN 1e0 WHEN 'transition' THEN 0.7e0 WHEN 'expansion' THEN 0.3e0 WHEN 'neutral' THEN 0.5e0 ELSE 0e0 END"
    return f"""
    SELECT *, {clip(f'{base} + (1 - coupling) * 0.1 + (1 - noise) * 0.1', 0.0, 1.0)} AS gate FROM (
      SELECT *, CASE WHEN noise_level = 'critical' THEN 'abandon' WHEN coupling_level = 'critical' THEN 'distorted' WHEN coupling_level = 'high' AND noise_level = 'high' THEN 'expansion'
        WHEN coupling_level = 'low' AND noise_level = 'low' THEN 'compression' WHEN coupling_level = 'medium' AND noise_level = 'low' THEN 'transition' ELSE 'neutral' END AS state FROM (
        SELECT trade_date, coupling, noise, {level('adjusted', coupling_low, coupling_high, coupling_critical)} AS coupling_level, {level('noise', noise_low, noise_high, noise_critical)} AS noise_level FROM (
          SELECT c.trade_date, c.coupling, n.noise, greatest(0e0, c.coupling - ({less})) AS adjusted FROM {couplings} c JOIN {noises} n ON c.trade_date = n.trade_date) a) b) e"""
