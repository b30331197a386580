"""What became of selections: trades, first-hit exits, cohorts' net value, metrics, diagnostics."""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, ahead, bit, clip, div, lead, operator, w

DAY = "ORDER BY trade_date"


@operator
def fixed_horizon(d, rets, hold=10, signal="r5 > 1"):
    """Of rows with a signal: entry at the next open, exit at the close of the last held bar, highest and lowest on the way; cut at the last bar.

    ``signal`` is a condition on the rows' columns; ``true`` takes every row.
    """
    frame = ahead(hold)
    return f"""
    SELECT symbol, trade_date, exit_price / nullif(entry, 0) - 1 AS ret, hi / nullif(entry, 0) - 1 AS runup, lo / nullif(entry, 0) - 1 AS drawdown, held, held = {hold} AS full_hold FROM (
      SELECT symbol, trade_date, coalesce({signal}, false) AS signal, {lead('open')} AS entry, max(close) {frame} AS hi, min(close) {frame} AS lo, {d.pick('last', 'last_value')}(close) {frame} AS exit_price, count(close) {frame} AS held FROM {rets}) x WHERE signal AND entry IS NOT NULL"""


@operator
def first_hit(d, picks, bars, stop=-0.3, take=0.5, trail=0.4):
    """Exit at the first bar that meets a rule, in the rules' order; else at the end of the holding time."""
    return f"""
    SELECT symbol, entry_date, min(trade_date) AS exit_date, min_by(reason, trade_date) AS reason, min_by(close, trade_date) / min(entry_price) - 1 AS ret FROM (
      SELECT *, CASE WHEN close / entry_price - 1 <= {stop} THEN 'stop' WHEN close / entry_price - 1 >= {take} THEN 'take' WHEN close / nullif(peak, 0) - 1 <= -{trail} THEN 'trail' WHEN trade_date = exit_date THEN 'timeout' END AS reason FROM (
        SELECT p.symbol, p.entry_date, p.entry_price, p.exit_date, b.trade_date, b.close, max(b.close) OVER (PARTITION BY p.symbol, p.entry_date ORDER BY b.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak
        FROM {picks} p JOIN {bars} b ON b.symbol = p.symbol AND b.trade_date BETWEEN p.entry_date AND p.exit_date) x) y WHERE reason IS NOT NULL GROUP BY symbol, entry_date"""


@operator
def marked(d, picks, bars):
    """Each live trade's return of each day: to the close from entry on its first day, else from the close before; with its staged scale."""
    return f"""
    SELECT symbol, entry_date, trade_date, close / nullif(CASE WHEN n = 1 THEN entry_price ELSE prev END, 0) - 1 AS day_ret, CASE WHEN n = 1 THEN 0.35e0 WHEN n = 2 THEN 0.65e0 ELSE 1e0 END AS scale FROM (
      SELECT p.symbol, p.entry_date, p.entry_price, b.trade_date, b.close, row_number() OVER (PARTITION BY p.symbol, p.entry_date ORDER BY b.trade_date) AS n, lag(b.close) OVER (PARTITION BY p.symbol, p.entry_date ORDER BY b.trade_date) AS prev
      FROM {picks} p JOIN {bars} b ON b.symbol = p.symbol AND b.trade_date BETWEEN p.entry_date AND p.exit_date) x"""


@operator
def cohort_nav(d, marks):
    """Scale-weighted mean return by date and its cumulative product (capped at +-20 % a day)."""
    return f"""
    SELECT trade_date, n_live, ret, exp(sum(ln(1 + ret)) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM (
      SELECT trade_date, count(*) AS n_live, {clip('sum(day_ret * scale) / nullif(sum(scale), 0)', -0.2, 0.2)} AS ret FROM {marks} GROUP BY trade_date) x"""


@operator
def nav_metrics(d, nav):
    return f"""
    SELECT count(*) AS n_days, max_by(nav, trade_date) - 1 AS total_return, min(dd) AS max_drawdown, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0) AS sharpe, (power(max_by(nav, trade_date), 252.0 / count(*)) - 1) / nullif(abs(min(dd)), 0) AS calmar FROM (
      SELECT *, nav / max(nav) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM {nav}) x"""


@operator
def trade_metrics(d, exits):
    """Win rate, mean, median, profit factor, best, worst, by reason and in all; the verdict of four checks."""
    return f"""
    SELECT *, CASE WHEN ({bit('win_rate >= 0.5')}) + ({bit('mean_ret > 0')}) + ({bit('median_ret > 0')}) + ({bit('profit_factor > 1')}) >= 2 THEN 'effective' ELSE 'weak' END AS verdict FROM (
      SELECT coalesce(reason, 'ALL') AS reason, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(ret) AS mean_ret, {d.median('ret')} AS median_ret,
        sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0) AS profit_factor, max(ret) AS best, min(ret) AS worst FROM {exits} GROUP BY GROUPING SETS ((reason), ())) x"""


@operator
def period_performance(d, nav):
    """Years, and intervals back from the end, by a range join of a small table of periods."""
    interval = lambda m: d.pick(f"add_months(last, -{m})", f"CAST(last - INTERVAL '{m} months' AS DATE)")
    periods = " UNION ALL ".join(f"SELECT '{n}' AS period, {interval(m)} AS first, last FROM e" for n, m in (("3y", 36), ("2y", 24), ("1y", 12), ("6m", 6), ("3m", 3)))
    return f"""
    WITH e AS (SELECT max(trade_date) AS last FROM {nav}), p AS ({periods} UNION ALL SELECT DISTINCT CAST(CAST(year(trade_date) AS INT) AS {d.pick('STRING', 'VARCHAR')}), make_date(CAST(year(trade_date) AS INT), 1, 1), make_date(CAST(year(trade_date) AS INT), 12, 31) FROM {nav})
    SELECT p.period, count(*) AS n_days, exp(sum(ln(1 + n.ret))) - 1 AS ret, avg(CASE WHEN n.ret > 0 THEN 1e0 ELSE 0e0 END) AS up_share FROM p JOIN {nav} n ON n.trade_date BETWEEN p.first AND p.last GROUP BY p.period"""


@operator
def blockers(d, recovered):
    """Which conditions keep rows from being candidates: flags as rows, counted; how many fail one only."""
    cs = {"damage": "damage < 0.32", "repair": "repair < 0.45", "entry": "entry_window < 0.40", "flow": "flow_support < 0.35", "overheat": "overheat >= 0.60"}
    arr = d.pick("array(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cs.items()) + ")", "[" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cs.items()) + "]")
    return f"""
    SELECT blocker, count(*) AS n, count(CASE WHEN n_failed = 1 THEN 1 END) AS n_only FROM (SELECT n_failed, {d.explode('failed')} AS blocker FROM (
      SELECT failed, {d.size('failed')} AS n_failed FROM (SELECT {d.filter(arr, 'x IS NOT NULL')} AS failed FROM {recovered} WHERE damage IS NOT NULL) a) b) c GROUP BY blocker"""


@operator
def top_gainers(d, bars, picks, first="DATE '1999-01-01'", last="DATE '1999-12-31'", n=20):
    """The largest gains of an interval and whether a pick caught them, with the reason of a miss."""
    return f"""
    SELECT g.symbol, g.gain, CAST(coalesce(p.n, 0) AS BIGINT) AS n_picks, CASE WHEN p.n IS NOT NULL THEN 'caught' WHEN g.n_bars < 60 THEN 'short history' ELSE 'no signal' END AS outcome FROM (
      SELECT symbol, max_by(close, trade_date) / min_by(close, trade_date) - 1 AS gain, count(*) AS n_bars FROM {bars} WHERE trade_date BETWEEN {first} AND {last} GROUP BY symbol ORDER BY gain DESC, symbol LIMIT {n}) g
    LEFT JOIN (SELECT symbol, count(*) AS n FROM {picks} WHERE entry_date BETWEEN {first} AND {last} GROUP BY symbol) p ON g.symbol = p.symbol"""


@operator
def contribution(d, exits):
    edges = ((-10, -0.2), (-0.2, 0), (0, 0.2), (0.2, 1), (1, 1e9))
    return " UNION ALL ".join(f"SELECT '{lo} to {hi}' AS bucket, count(*) AS n, coalesce(sum(ret), 0) AS total FROM {exits} WHERE ret >= {lo} AND ret < {hi}" for lo, hi in edges)


@operator
def coverage_gap(d, factors, gainers):
    """Normalised gap of mean factor values between caught and missed symbols: factors as rows."""
    names = ("mom_5", "mom_20", "vs_20", "reversal")
    stack = d.pick(
        f"SELECT symbol, stack({len(names)}, {', '.join(f"'{x}', {x}" for x in names)}) AS (factor, value) FROM {factors}",
        " UNION ALL ".join(f"SELECT symbol, '{x}' AS factor, {x} AS value FROM {factors}" for x in names),
    )
    return f"""
    SELECT factor, (avg(CASE WHEN g.outcome = 'caught' THEN value END) - avg(CASE WHEN g.outcome <> 'caught' THEN value END)) / nullif(stddev_pop(value), 0) AS gap, count(*) AS n FROM ({stack}) f LEFT JOIN {gainers} g ON f.symbol = g.symbol WHERE value IS NOT NULL GROUP BY factor"""


@operator
def hit_rates(d, labels):
    return f"""
    SELECT CAST(year(trade_date) AS INT) AS yr, count(gain_short) AS n_short, avg(CASE WHEN gain_short >= 1 THEN 1e0 WHEN gain_short IS NOT NULL THEN 0e0 END) AS hit_short, count(gain_long) AS n_long, avg(CASE WHEN gain_long >= 2 THEN 1e0 WHEN gain_long IS NOT NULL THEN 0e0 END) AS hit_long
    FROM {labels} GROUP BY CAST(year(trade_date) AS INT)"""


@operator
def exit_quality(d, exits, rets, ahead=10):
    """What followed exits: forward return by reason, premature share, correlation with the trade's own return; intervention flags."""
    return f"""
    SELECT reason, n, later, premature, own_corr, later > 0.1 OR premature > 0.6 AS intervene FROM (
      SELECT e.reason, count(*) AS n, avg(f.later) AS later, avg(CASE WHEN f.later > 0.05 THEN 1e0 ELSE 0e0 END) AS premature, corr(e.ret, f.later) AS own_corr FROM {exits} e JOIN (
        SELECT symbol, trade_date, {lead('close', ahead)} / nullif(close, 0) - 1 AS later FROM {rets}) f ON e.symbol = f.symbol AND e.exit_date = f.trade_date WHERE f.later IS NOT NULL GROUP BY e.reason) x"""


@operator
def rolling_summary(d, trades):
    quarter = "CAST(year(entry_date) * 10 + floor((month(entry_date) - 1) / 3) + 1 AS INT)"
    return f"SELECT {quarter} AS quarter, count(*) AS n, avg(ret) AS mean_ret, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM {trades} GROUP BY {quarter}"


@operator
def cohort_replay(d, rets, calendar, every=20, top=3, hold=20):
    """Non-overlapping cohorts: every so many dates the best few, entry at the next close, a stop inside the window, equal weights."""
    return f"""
    SELECT trade_date, n, cohort_ret, exp(sum(ln(1 + cohort_ret)) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM (
      SELECT trade_date, count(*) AS n, {clip('avg(CASE WHEN worst <= -0.5 THEN -0.5 ELSE ret END)', -0.9, 3.0)} AS cohort_ret FROM (
        SELECT r.*, row_number() OVER (PARTITION BY r.trade_date ORDER BY r.r5 DESC, r.symbol) AS place FROM (
          SELECT symbol, trade_date, r5, {lead('close', hold)} / nullif({lead('close')}, 0) - 1 AS ret, min(close) {ahead_frame(hold)} / nullif({lead('close')}, 0) - 1 AS worst FROM {rets}) r
        JOIN {calendar} c ON r.trade_date = c.trade_date WHERE c.cal_no % {every} = 0 AND r.ret IS NOT NULL AND r.r5 IS NOT NULL) x WHERE place <= {top} GROUP BY trade_date) y"""


def ahead_frame(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


@operator
def fees(d, picks, lot=1000):
    """Commission with a floor, stamp duty on selling, slippage: net return of a round trip."""
    return f"""
    SELECT symbol, entry_date, ret, (sold - sell_fee - bought - buy_fee) / nullif(bought, 0) AS net_ret FROM (
      SELECT *, greatest(bought * 0.00025, 5.0) + bought * 0.001 AS buy_fee, greatest(sold * 0.00025, 5.0) + sold * 0.0005 + sold * 0.001 AS sell_fee FROM (
        SELECT symbol, entry_date, ret, entry_price * {lot} AS bought, exit_price * {lot} AS sold FROM {picks}) a) b"""


# ranking, limits and sets


@operator
def capped_top(d, scored, master, total=10, each=2):
    """Best rows of each date, at most so many of an industry: rank within industry, then within date."""
    return f"""
    SELECT symbol, trade_date, industry, score, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS INT) AS place FROM (
        SELECT s.symbol, s.trade_date, m.industry, coalesce(s.score_min, -999.0) AS score, row_number() OVER (PARTITION BY s.trade_date, m.industry ORDER BY coalesce(s.score_min, -999.0) DESC, s.symbol) AS own
        FROM {scored} s JOIN {master} m ON s.symbol = m.symbol) x WHERE own <= {each}) y WHERE place <= {total}"""


@operator
def nth_dates(d, calendar, every=5):
    return f"SELECT trade_date, cal_no FROM {calendar} WHERE cal_no % {every} = 0"


@operator
def last_of_week(d, calendar):
    return f"SELECT {d.week_end('trade_date')} AS week_end, max(trade_date) AS trade_date FROM {calendar} GROUP BY {d.week_end('trade_date')}"


@operator
def extremes(d, exits, n=15):
    """The n best and n worst trades."""
    cols = "symbol, entry_date, ret"
    return f"(SELECT {cols}, 'best' AS side FROM {exits} ORDER BY ret DESC, symbol, entry_date LIMIT {n}) UNION ALL (SELECT {cols}, 'worst' AS side FROM {exits} ORDER BY ret, symbol, entry_date LIMIT {n})"


@operator
def missed(d, gainers, picks):
    """Set difference, and intersection, of gainers and picks."""
    return f"SELECT symbol, 'missed' AS what FROM (SELECT symbol FROM {gainers} EXCEPT SELECT symbol FROM {picks}) a UNION ALL SELECT symbol, 'both' AS what FROM (SELECT symbol FROM {gainers} INTERSECT SELECT symbol FROM {picks}) b"


@operator
def last_kept(d, picks):
    """Of rows with one symbol the last."""
    return f"SELECT symbol, trade_date, ret FROM (SELECT symbol, trade_date, ret, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC, entry_date DESC) AS n FROM {picks}) x WHERE n = 1"
