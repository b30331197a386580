"""Joins in time: as-of by equi-join and a last-value window, by calendar offset, by interval; predicates over rows."""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, bit, clip, flag, lead, operator, scaled, triangular, w


def carried(x: str, by: str = BY) -> str:
    """Last value that isn't missing, up to the row."""
    return f"last_value({x} IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _carried(d, x: str, by: str = BY) -> str:
    return d.pick(f"last({x}, true) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", carried(x, by))


@operator
def asof_context(d, daily, weekly, monthly):
    """Each day with the latest week and month whose last bar isn't after it: no look ahead, no range join."""
    return f"""
    SELECT symbol, trade_date, {_carried(d, 'wc')} AS week_close, {_carried(d, 'wr')} AS week_ret, {_carried(d, 'mc')} AS month_close, {_carried(d, 'mr')} AS month_ret FROM (
      SELECT b.symbol, b.trade_date, k.close AS wc, k.ret AS wr, m.close AS mc, m.ret AS mr FROM {daily} b
      LEFT JOIN {weekly} k ON b.symbol = k.symbol AND b.trade_date = k.bar_end LEFT JOIN {monthly} m ON b.symbol = m.symbol AND b.trade_date = m.bar_end) x"""


@operator
def asof_macro(d, calendar, margin, rate):
    """Each trading date with the last macro rows; first ones carried back.  One row a date: one task."""
    by = "ORDER BY trade_date"
    back = d.pick("first(rzye, true) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "first_value(rzye IGNORE NULLS) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    return f"""
    SELECT trade_date, coalesce({_carried(d, 'rzye', by)}, {back}) AS rzye, {_carried(d, 'on_rate', by)} AS on_rate FROM (
      SELECT c.trade_date, m.rzye, r.on_rate FROM {calendar} c LEFT JOIN {margin} m ON c.trade_date = m.trade_date LEFT JOIN {rate} r ON c.trade_date = r.trade_date) x"""


@operator
def latest_rows(d, bars, on="DATE '1999-06-30'", least=60):
    """Each symbol's latest row up to a date, if it has enough of them."""
    return f"""
    SELECT symbol, max(trade_date) AS trade_date, max_by(close, trade_date) AS close, max_by(r1, trade_date) AS r1, count(*) AS n_rows
    FROM {bars} WHERE trade_date <= {on} GROUP BY symbol HAVING count(*) >= {least}"""


@operator
def offset_labels(d, bars, calendar, short=40, long=120):
    """Closes at the calendar dates so many days ahead; labels of large gains."""
    return f"""
    SELECT b.symbol, b.trade_date, s.close / nullif(b.close, 0) - 1 AS gain_short, l.close / nullif(b.close, 0) - 1 AS gain_long,
      CASE WHEN s.close IS NULL THEN NULL WHEN s.close / nullif(b.close, 0) - 1 >= 1.0 THEN 1 ELSE 0 END AS big_short,
      CASE WHEN l.close IS NULL THEN NULL WHEN l.close / nullif(b.close, 0) - 1 >= 2.0 THEN 1 ELSE 0 END AS big_long
    FROM {bars} b JOIN {calendar} c ON b.trade_date = c.trade_date
    LEFT JOIN {calendar} cs ON cs.cal_no = c.cal_no + {short} LEFT JOIN {calendar} cl ON cl.cal_no = c.cal_no + {long}
    LEFT JOIN {bars} s ON s.symbol = b.symbol AND s.trade_date = cs.trade_date LEFT JOIN {bars} l ON l.symbol = b.symbol AND l.trade_date = cl.trade_date"""


@operator
def interval_stats(d, picks, bars):
    """Extremes and mean of a symbol's bars between a pick's two dates."""
    return f"""
    SELECT p.symbol, p.entry_date, p.exit_date, max(b.high) AS hi, min(b.low) AS lo, avg(b.close) AS mean_close, count(*) AS n_bars
    FROM {picks} p JOIN {bars} b ON b.symbol = p.symbol AND b.trade_date BETWEEN p.entry_date AND p.exit_date GROUP BY p.symbol, p.entry_date, p.exit_date"""


@operator
def first_exit(d, picks, bars, stop=-0.3):
    """First bar after entry that falls so far below the entry price."""
    return f"""
    SELECT p.symbol, p.entry_date, min(b.trade_date) AS hit_date, min_by(b.close, b.trade_date) AS hit_close
    FROM {picks} p JOIN {bars} b ON b.symbol = p.symbol AND b.trade_date > p.entry_date AND b.trade_date <= p.exit_date
    WHERE b.close / p.entry_price - 1 <= {stop} GROUP BY p.symbol, p.entry_date"""


@operator
def limit_hits(d, bars, limits):
    return f"""
    SELECT b.trade_date, count(CASE WHEN b.close >= l.up_limit THEN 1 END) AS n_up, count(CASE WHEN b.close <= l.down_limit THEN 1 END) AS n_down, count(*) AS n
    FROM {bars} b LEFT JOIN {limits} l ON b.symbol = l.symbol AND b.trade_date = l.trade_date GROUP BY b.trade_date"""


@operator
def in_hot_industries(d, rows, master, hot):
    """Rows of symbols whose industry is among the chosen ones (semi join)."""
    return f"SELECT r.symbol, r.trade_date, m.industry FROM {rows} r JOIN {master} m ON r.symbol = m.symbol WHERE EXISTS (SELECT 1 FROM {hot} h WHERE h.industry = m.industry)"


@operator
def not_recent(d, rows, earlier, days=30):
    """Rows without an earlier pick of the symbol in the days before (anti join with a date window)."""
    gap = d.days("r.trade_date", "e.trade_date")
    return f"""
    SELECT r.symbol, r.trade_date, r.close FROM {rows} r WHERE NOT EXISTS (
      SELECT 1 FROM {earlier} e WHERE e.symbol = r.symbol AND {gap} > 0 AND {gap} <= {days})"""


@operator
def merged_picks(d, model, leaders, most=50):
    """Model picks, then leaders that aren't among them, up to a number."""
    return f"""
    SELECT symbol, trade_date, origin FROM (
      SELECT *, row_number() OVER (ORDER BY origin DESC, symbol, trade_date) AS n FROM (
        SELECT symbol, trade_date, 'model' AS origin FROM {model} UNION ALL
        SELECT l.symbol, l.trade_date, 'leader' AS origin FROM {leaders} l WHERE NOT EXISTS (SELECT 1 FROM {model} m WHERE m.symbol = l.symbol AND m.trade_date = l.trade_date)) u) v
    WHERE n <= {most}"""


@operator
def merged_picks_by_date(d, model, leaders, most=50):
    """Of each date the model picks, then leaders that aren't among them, up to a number."""
    return f"""
    SELECT symbol, trade_date, origin FROM (
      SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY origin DESC, symbol) AS n FROM (
        SELECT symbol, trade_date, 'model' AS origin FROM {model} UNION ALL
        SELECT l.symbol, l.trade_date, 'leader' AS origin FROM {leaders} l WHERE NOT EXISTS (SELECT 1 FROM {model} m WHERE m.symbol = l.symbol AND m.trade_date = l.trade_date)) u) v
    WHERE n <= {most}"""


@operator
def lead_lag(d, industry_days):
    """Correlation of each industry's return with every other's of the day before; pairs of industries, which are few."""
    return f"""
    SELECT a.industry, b.industry AS leader, corr(a.ret, b.ret) AS lead_corr, count(*) AS n FROM {industry_days} a
    JOIN {industry_days} b ON a.day_no = b.day_no + 1 AND a.industry <> b.industry GROUP BY a.industry, b.industry HAVING count(*) >= 20"""


@operator
def stop_list(d, trades, losses=2):
    """Industries with so many losing trades, and the trades outside them."""
    return f"""
    SELECT t.symbol, t.trade_date, t.industry FROM {trades} t LEFT JOIN (
      SELECT industry FROM {trades} WHERE ret < -0.5 GROUP BY industry HAVING count(*) >= {losses}) s ON t.industry = s.industry WHERE s.industry IS NULL"""


@operator
def blindness(d, missed, caught):
    """Missed and caught counts by industry (full outer)."""
    return f"""
    SELECT coalesce(m.industry, c.industry) AS industry, coalesce(m.n, 0) AS n_missed, coalesce(c.n, 0) AS n_caught FROM
      (SELECT industry, count(*) AS n FROM {missed} GROUP BY industry) m FULL OUTER JOIN (SELECT industry, count(*) AS n FROM {caught} GROUP BY industry) c ON m.industry = c.industry"""


@operator
def candidate_filter(d, rows, master, amount=100000.0):
    """Tradable, liquid, not marked for special treatment; gates with their reason."""
    return f"""
    SELECT r.symbol, r.trade_date, {flag(f"NOT (upper(m.display_name) LIKE 'ST%' OR upper(m.display_name) LIKE '*ST%') AND r.amount >= {amount} AND r.turnover_rate > 0.5")} AS passes,
      CASE WHEN r.amount < {amount} THEN 'amount' WHEN r.turnover_rate <= 0.5 THEN 'turnover' WHEN upper(m.display_name) LIKE 'ST%' THEN 'marked' ELSE 'ok' END AS reason
    FROM {rows} r LEFT JOIN {master} m ON r.symbol = m.symbol"""


@operator
def universe(d, bars, least=150000.0):
    """Symbols by mean amount of 20 bars, and a volatility screen: percentile of deviation in its past."""
    return f"""
    SELECT symbol, trade_date, mean_amount >= {least} AS liquid, sd FROM (
      SELECT symbol, trade_date, avg(amount) {w(20)} AS mean_amount, stddev_samp(close) {w(20)} AS sd, count(*) {w(20)} AS m FROM {bars}) x WHERE m = 20"""


@operator
def scalar_scores(d, bars):
    """The scalar helpers on one column: clip, tent, trinary by half a deviation of the day's set."""
    return f"""
    SELECT symbol, trade_date, {clip('net_mf / 100000', -1.0, 1.0)} AS clipped, {scaled('vol', 10.0, 60.0)} AS scaled, {triangular('vol', 5.0, 25.0, 80.0)} AS tent,
      CASE WHEN net_mf > 0.5 * sd THEN 1 WHEN net_mf < -0.5 * sd THEN -1 ELSE 0 END AS trinary FROM (
      SELECT *, stddev_pop(net_mf) OVER (PARTITION BY trade_date) AS sd FROM {bars}) x"""


@operator
def resolved_symbols(d, master, bars):
    """Look-up by code, exact name and part of a name; of equal matches the one with bars."""
    asked = "SELECT '12' AS asked UNION ALL SELECT 'Supplier#000000007' UNION ALL SELECT '#00000001' UNION ALL SELECT 'nothing'"
    return f"""
    SELECT asked, symbol, how FROM (
      SELECT asked, symbol, how, row_number() OVER (PARTITION BY asked ORDER BY how, has_bars DESC, symbol) AS n FROM (
        SELECT q.asked, m.symbol, CASE WHEN CAST(m.symbol AS {d.pick('STRING', 'VARCHAR')}) = q.asked THEN 1 WHEN m.name = q.asked THEN 2 WHEN m.name LIKE '%' || q.asked || '%' THEN 3 END AS how,
          CASE WHEN b.symbol IS NULL THEN 0 ELSE 1 END AS has_bars
        FROM ({asked}) q CROSS JOIN {master} m LEFT JOIN (SELECT DISTINCT symbol FROM {bars}) b ON b.symbol = m.symbol) x WHERE how IS NOT NULL) y WHERE n = 1"""


@operator
def picks(d, rets, hold=10, signal="r5 > 2"):
    """Trades of a signal: entry at the next bar's open, exit at the close of the last held bar."""
    return f"""
    SELECT symbol, trade_date, entry_date, entry_price, exit_date, exit_price, exit_price / nullif(entry_price, 0) - 1 AS ret FROM (
      SELECT *, {lead('trade_date')} AS entry_date, {lead('open')} AS entry_price, {lead('trade_date', hold)} AS exit_date, {lead('close', hold)} AS exit_price FROM {rets}) x
    WHERE {signal} AND exit_date IS NOT NULL"""


@operator
def trades_by_industry(d, trades, master):
    return f"SELECT t.symbol, t.trade_date, t.ret, m.industry FROM {trades} t JOIN {master} m ON t.symbol = m.symbol"
