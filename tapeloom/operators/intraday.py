"""Tick and minute features."""

from __future__ import annotations

from tapeloom.functions.sqlkit import bit, div, operator, shannon, w
from tapeloom.operators.windows import _transitions, irreversibility_of, pair_counts, pattern

TICK = "PARTITION BY symbol ORDER BY ts"
DAY = "PARTITION BY symbol, trade_date ORDER BY minute"


@operator
def tick_returns(d, ticks):
    return f"SELECT *, ln(price) - ln(lag(price) OVER ({TICK})) AS lr, side * volume AS flow, {d.seconds('ts', f'lag(ts) OVER ({TICK})')} AS waited FROM {ticks}"


@operator
def minute_returns(d, minutes):
    """Log returns within each day, as ``whole_day`` reads them."""
    return f"SELECT symbol, trade_date, minute AS ts, ln(close) - ln(lag(close) OVER ({DAY})) AS lr FROM {minutes} WHERE close > 0"


@operator
def tick_state(d, rets, n=20):
    """Entropy of return patterns over ticks, and the state it means."""
    counts = ", ".join(f"sum({bit(f'code = {k}')}) {w(n - 2, TICK)} AS c{k}" for k in (0, 1, 3, 4, 6, 7))
    return f"""
    SELECT event_id, symbol, pe, CASE WHEN coalesce(pe, 0.5) < 0.85 THEN 'ordered' WHEN coalesce(pe, 0.5) < 0.95 THEN 'weak_chaos' ELSE 'strong_chaos' END AS state FROM (
      SELECT event_id, symbol, CASE WHEN total = {n - 2} THEN {shannon([f'c{k}' for k in (0, 1, 3, 4, 6, 7)], 'nullif(total, 0)', 6.0)} END AS pe FROM (
        SELECT event_id, symbol, {counts}, count(code) {w(n - 2, TICK)} AS total FROM (SELECT event_id, symbol, ts, {pattern('lr', TICK)} AS code FROM {rets}) a) b) c"""


@operator
def waiting_entropy(d, rets, n=25, bins=5):
    """Entropy of log-binned waiting times, floored at a tenth of a second."""
    b = d.map("a", f"least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INT), {bins - 1})")
    counts = [d.size(d.filter("b", f"x = {k}")) for k in range(bins)]
    return f"""
    SELECT event_id, symbol, CASE WHEN hi > lo THEN ({shannon(counts, d.size('b'))}) / ln({float(bins)}) ELSE 0e0 END AS we FROM (SELECT event_id, symbol, lo, hi, CASE WHEN hi > lo THEN {b} END AS b FROM (
      SELECT event_id, symbol, {d.collect('lw')} {w(n, TICK)} AS a, min(lw) {w(n, TICK)} AS lo, max(lw) {w(n, TICK)} AS hi, count(lw) {w(n, TICK)} AS m FROM (SELECT event_id, symbol, ts, ln(greatest(waited, 0.1)) AS lw FROM {rets} WHERE waited IS NOT NULL) x) y WHERE m = {n}) z"""


@operator
def volume_share(d, minutes):
    """Entropy and concentration of a day's volume over its bars; share of active bars; range over the last price."""
    p = "sum(CASE WHEN volume > 0 THEN volume * ln(volume) ELSE 0 END)"
    return f"""
    SELECT symbol, trade_date, CASE WHEN n_active > 1 THEN (ln(total) - plogp / total) / ln(CAST(n_active AS DOUBLE)) END AS entropy, squares / nullif(total * total, 0) AS hhi, n_active / CAST(n AS DOUBLE) AS active_ratio, {div('hi - lo', 'last_price')} AS range_ratio FROM (
      SELECT symbol, trade_date, sum(volume) AS total, {p} AS plogp, sum(volume * volume) AS squares, count(CASE WHEN volume > 0 THEN 1 END) AS n_active, count(*) AS n, max(high) AS hi, min(low) AS lo, max_by(close, minute) AS last_price FROM {minutes} GROUP BY symbol, trade_date) x"""


@operator
def whole_day(d, rets, least=6):
    """Pattern entropy and irreversibility of all of a day's ticks, mornings against afternoons, and the day's label."""
    arr = d.pick("transform(array_sort(collect_list(CASE WHEN lr IS NOT NULL THEN struct(ts, lr) END)), x -> x.lr)", "list(lr ORDER BY ts) FILTER (WHERE lr IS NOT NULL)")
    codes = d.map(d.pick("sequence(1, size(a) - 2)", "range(1, len(a) - 1)"), f"4 * (CASE WHEN {d.at('a', 'i')} > {d.at('a', 'i + 1')} THEN 1 ELSE 0 END) + 2 * (CASE WHEN {d.at('a', 'i')} > {d.at('a', 'i + 2')} THEN 1 ELSE 0 END) + (CASE WHEN {d.at('a', 'i + 1')} > {d.at('a', 'i + 2')} THEN 1 ELSE 0 END)", "i")
    counts = [d.size(d.filter("codes", f"x = {k}")) for k in (0, 1, 3, 4, 6, 7)]
    states = d.map("a", "CASE WHEN x > 0.5 * sd THEN 2 WHEN x < -0.5 * sd THEN 0 ELSE 1 END")
    return f"""
    SELECT symbol, trade_date, n_ticks, pe, {irreversibility_of(3)} AS pi, am_sd - pm_sd AS shift, CASE WHEN pe < 0.7 THEN 'trend' WHEN pe < 0.9 THEN 'structured' ELSE 'noise' END AS label FROM (
      SELECT *, {pair_counts(d, 'pairs', 3)} FROM (
       SELECT *, {shannon(counts, d.size('codes'), 6.0)} AS pe, {_transitions(d, 's', 3)} AS pairs FROM (
        SELECT *, {codes} AS codes, {states} AS s FROM (
          SELECT symbol, trade_date, count(lr) AS n_ticks, {arr} AS a, stddev_pop(lr) AS sd, stddev_pop(CASE WHEN hour(ts) < 12 THEN lr END) AS am_sd, stddev_pop(CASE WHEN hour(ts) >= 12 THEN lr END) AS pm_sd FROM {rets} GROUP BY symbol, trade_date HAVING count(lr) >= {least}) x) y) z) v"""


@operator
def day_deltas(d, shares, past=10):
    """Today against the days before: entropy, concentration; mean of the last five."""
    by = "PARTITION BY symbol ORDER BY trade_date"
    return f"""
    SELECT symbol, trade_date, avg(entropy) {w(past, by, 1)} - entropy AS entropy_drop, entropy - avg(entropy) {w(past, by, 1)} AS entropy_rise, avg(hhi) {w(past, by, 1)} - hhi AS hhi_drop, avg(entropy) {w(5, by)} AS entropy_5 FROM {shares}"""


@operator
def multi_scale(d, ticks, scales=(60, 240, 720)):
    """Volume sums at several scales and their spread, one row for each symbol and scale."""
    return " UNION ALL ".join(
        f"SELECT symbol, {s} AS scale, count(*) AS n_bars, stddev_pop(v) / nullif(avg(v), 0) AS spread, ln(sum(v)) - sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END) / sum(v) AS entropy FROM (SELECT symbol, {d.bucket('ts', s)} AS t, sum(volume) + 1 AS v FROM {ticks} GROUP BY symbol, {d.bucket('ts', s)}) x GROUP BY symbol"
        for s in scales
    )


@operator
def fusion(d, shares, deltas, whole):
    """Buy score of compression, concentration, direction and order; sell score of diffusion; dominant type."""
    return f"""
    SELECT symbol, trade_date, buy_score, sell_score, CASE WHEN sell_score >= 0.6 THEN 'sell' WHEN sell_score >= 0.45 THEN 'warning' WHEN buy_score >= 0.5 THEN 'buy' ELSE 'hold' END AS decision FROM (
      SELECT s.symbol, s.trade_date, 0.4 * (1 - coalesce(s.entropy, 1)) + 0.3 * least(coalesce(s.hhi, 0) * 2, 1) + 0.3 * (1 - coalesce(w.pe, 1)) AS buy_score, 0.5 * coalesce(s.entropy, 0) + 0.3 * greatest(coalesce(t.entropy_rise, 0), 0) + 0.2 * coalesce(w.pe, 0) AS sell_score
      FROM {shares} s LEFT JOIN {deltas} t ON s.symbol = t.symbol AND s.trade_date = t.trade_date LEFT JOIN {whole} w ON s.symbol = w.symbol AND s.trade_date = w.trade_date) x"""
