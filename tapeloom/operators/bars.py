"""Bars of longer periods."""

from __future__ import annotations

from tapeloom.functions.sqlkit import operator


@operator
def with_returns(d, bars):
    """Daily bars in the common shape of all periods: ``bar_end``, sums, means, return to the last bar."""
    return f"""
    SELECT symbol, trade_date, trade_date AS bar_start, trade_date AS bar_end, open, high, low, close, vol, amount AS amount_sum,
      turnover_rate AS turnover_sum, turnover_rate AS turnover_mean, net_mf AS mf_sum,
      close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret
    FROM {bars}"""


@operator
def period_bars(d, bars, period="week"):
    """Weeks end on Friday, months on their last day; ``bar_end`` is the last date that traded."""
    key = d.week_end("trade_date") if period == "week" else "last_day(trade_date)"
    return f"""
    SELECT symbol, period_end, trade_date, bar_start, bar_end, open, high, low, close, vol, amount_sum, turnover_sum, turnover_mean, mf_sum,
      close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret
    FROM (
      SELECT symbol, {key} AS period_end, max(trade_date) AS trade_date, min(trade_date) AS bar_start, max(trade_date) AS bar_end,
        min_by(open, trade_date) AS open, max(high) AS high, min(low) AS low, max_by(close, trade_date) AS close, sum(vol) AS vol,
        sum(amount) AS amount_sum, sum(turnover_rate) AS turnover_sum, avg(turnover_rate) AS turnover_mean, sum(net_mf) AS mf_sum
      FROM {bars} GROUP BY symbol, {key}) p"""


@operator
def count_bars(d, bars, rows=5):
    """Bars of a fixed number of rows; an incomplete last one is left out; change and percentage made anew."""
    return f"""
    SELECT *, close - pre_close AS change, (close - pre_close) / nullif(pre_close, 0) * 100 AS pct_chg FROM (
      SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY block) AS pre_close FROM (
        SELECT symbol, block, max(trade_date) AS trade_date, min_by(open, trade_date) AS open, max(high) AS high, min(low) AS low,
          max_by(close, trade_date) AS close, sum(vol) AS vol, sum(amount) AS amount
        FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1) / {rows}) AS BIGINT) AS block FROM {bars}) n
        GROUP BY symbol, block HAVING count(*) = {rows}) g) c"""


@operator
def year_returns(d, bars):
    """Last close of a year against the last close before it."""
    return f"""
    SELECT symbol, yr, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY yr), 0) - 1 AS year_return FROM (
      SELECT symbol, CAST(year(trade_date) AS INT) AS yr, max_by(close, trade_date) AS close FROM {bars} GROUP BY symbol, CAST(year(trade_date) AS INT)) y"""


@operator
def minute_bars(d, ticks, minutes=60):
    """Tumbling bars of ticks."""
    return f"""
    SELECT symbol, {d.bucket('ts', minutes)} AS minute, CAST(min(ts) AS DATE) AS trade_date, min_by(price, ts) AS open, max(price) AS high,
      min(price) AS low, max_by(price, ts) AS close, sum(volume) AS volume, sum(price * volume) AS amount, count(*) AS n_ticks
    FROM {ticks} GROUP BY symbol, {d.bucket('ts', minutes)}"""


@operator
def minutes_to_days(d, minutes):
    return f"""
    SELECT symbol, trade_date, min_by(open, minute) AS open, max(high) AS high, min(low) AS low, max_by(close, minute) AS close,
      sum(volume) AS volume, sum(amount) AS amount FROM {minutes} GROUP BY symbol, trade_date"""
