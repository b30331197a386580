"""Cross sections by date: breadth, sectors, regimes, ranks."""

from __future__ import annotations

from tapeloom.functions.sqlkit import bit, clip, div, operator, rolling, scaled, shown, w

DAY = "ORDER BY trade_date"


@operator
def stock_inputs(d, rets, master):
    """Per symbol and day what breadth needs."""
    return f"""
    SELECT r.symbol, r.trade_date, m.industry, r.r1, r.net_mf, r.amount, r.close > {rolling('avg', 'r.close', 20, 7, by='PARTITION BY r.symbol ORDER BY r.trade_date')} AS above_20,
      r.close >= max(r.high) {w(60, 'PARTITION BY r.symbol ORDER BY r.trade_date')} AS new_high, {rolling('stddev_samp', 'r.r1', 20, 7, by='PARTITION BY r.symbol ORDER BY r.trade_date')} AS sd, r.r5
    FROM {rets} r LEFT JOIN {master} m ON r.symbol = m.symbol"""


@operator
def breadth(d, inputs):
    return f"""
    SELECT trade_date, count(*) AS n, avg(CASE WHEN r1 > 0 THEN 1e0 ELSE 0e0 END) AS advance, avg(CASE WHEN above_20 THEN 1e0 ELSE 0e0 END) AS above_ma, avg(CASE WHEN new_high THEN 1e0 ELSE 0e0 END) AS new_high,
      avg(CASE WHEN net_mf > 0 THEN 1e0 ELSE 0e0 END) AS inflow, avg(CASE WHEN r1 < -0.5 THEN 1e0 ELSE 0e0 END) AS panic, {d.median('sd')} AS sd_median, {d.median('r1')} AS r_median
    FROM {inputs} WHERE r1 IS NOT NULL GROUP BY trade_date"""


@operator
def sector_flow(d, inputs, least=1):
    return f"""
    SELECT trade_date, industry, n, net, mean_r, momentum, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY net DESC, industry) AS INT) AS place FROM (
      SELECT trade_date, industry, count(*) AS n, sum(net_mf) AS net, avg(r1) AS mean_r, avg(r5) AS momentum FROM {inputs} GROUP BY trade_date, industry HAVING count(*) >= {least}) x"""


@operator
def dispersion(d, sectors):
    """Deviation of sectors' momenta; entropy of the sectors' absolute flows; share and squares."""
    p = "(abs(net) / nullif(total, 0))"
    return f"""
    SELECT trade_date, stddev_pop(momentum) AS dispersion, CASE WHEN count(*) > 1 THEN -sum(CASE WHEN abs(net) > 0 THEN {p} * ln({p}) ELSE 0 END) / ln(CAST(count(*) AS DOUBLE)) END AS flow_entropy, sum({p} * {p}) AS hhi FROM (
      SELECT *, sum(abs(net)) OVER (PARTITION BY trade_date) AS total FROM {sectors}) x GROUP BY trade_date"""


@operator
def macro(d, daily):
    """Changes and averages of macro series over the calendar."""
    lagged = lambda x, k=1: f"lag({x}, {k}) OVER ({DAY})"
    return f"""
    SELECT trade_date, rzye, rzye / nullif({lagged('rzye')}, 0) - 1 AS change, {rolling('avg', 'rzye', 5, 1, DAY)} AS ma_5, {rolling('avg', 'rzye', 20, 1, DAY)} AS ma_20, on_rate - {lagged('on_rate', 5)} AS rate_diff FROM {daily}"""


@operator
def trend(d, breadths, emas, spread, macros):
    """Seven dimension scores, their composite and the label."""
    return f"""
    SELECT trade_date, composite, CASE WHEN composite >= 0.65 THEN 'STRONG_UP' WHEN composite >= 0.55 THEN 'UP' WHEN composite >= 0.45 THEN 'NEUTRAL' WHEN composite >= 0.35 THEN 'DOWN' ELSE 'STRONG_DOWN' END AS trend FROM (
      SELECT b.trade_date, 0.25 * ({scaled('b.advance', 0.2, 0.8)}) + 0.20 * ({scaled('b.inflow', 0.2, 0.8)}) + 0.15 * (1 - ({scaled('b.sd_median', 0.0, 20.0)})) + 0.10 * ({scaled('coalesce(s.flow_entropy, 0.5)', 0.0, 1.0)})
        + 0.10 * ({scaled('b.above_ma', 0.2, 0.8)}) + 0.10 * ({scaled('coalesce(e.thrust, 0)', -0.3, 0.3)}) + 0.10 * ({scaled('coalesce(m.change, 0)', -1.0, 1.0)}) AS composite
      FROM {breadths} b LEFT JOIN {emas} e ON b.trade_date = e.trade_date LEFT JOIN {spread} s ON b.trade_date = s.trade_date LEFT JOIN {macros} m ON b.trade_date = m.trade_date) x"""


@operator
def trend_returns(d, trends, index_bars, ahead=5):
    """Mean index change of the day and of the days ahead by trend."""
    return f"""
    SELECT trend, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share, avg(same_day) AS same_day, avg(later) AS later FROM (
      SELECT t.trade_date, t.trend, i.same_day, i.later FROM {trends} t JOIN (
        SELECT trade_date, close / nullif(lag(close) OVER ({DAY}), 0) - 1 AS same_day, lead(close, {ahead}) OVER ({DAY}) / nullif(close, 0) - 1 AS later FROM {index_bars}) i ON t.trade_date = i.trade_date) x GROUP BY trend"""


@operator
def industry_days(d, inputs):
    """Mean return by industry and trading day, numbered."""
    return f"""
    SELECT i.industry, i.trade_date, c.day_no, i.ret FROM (SELECT industry, trade_date, avg(r1) AS ret FROM {inputs} WHERE r1 IS NOT NULL GROUP BY industry, trade_date) i
    JOIN (SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS day_no FROM (SELECT DISTINCT trade_date FROM {inputs}) x) c ON i.trade_date = c.trade_date"""


@operator
def industry_factors(d, inputs):
    """Industry medians joined back to members: momentum, breadth, relative strength."""
    return f"""
    SELECT i.symbol, i.trade_date, g.med AS industry_momentum, g.breadth AS industry_breadth, i.r5 - g.med AS relative FROM {inputs} i JOIN (
      SELECT trade_date, industry, {d.median('r5')} AS med, avg(CASE WHEN r1 > 0 THEN 1e0 ELSE 0e0 END) AS breadth FROM {inputs} WHERE r5 IS NOT NULL GROUP BY trade_date, industry) g ON i.trade_date = g.trade_date AND i.industry = g.industry WHERE i.r5 IS NOT NULL"""


@operator
def hot_industries(d, sectors, top=3):
    return f"SELECT industry, count(*) AS n_days FROM {sectors} WHERE place <= {top} GROUP BY industry HAVING count(*) >= 20"


@operator
def leaders(d, factors, top=5):
    """Leader score and the first few of each day."""
    return f"""
    SELECT symbol, trade_date, score, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS INT) AS place FROM (
        SELECT symbol, trade_date, 0.5 * ({scaled('relative', -1.0, 2.0)}) + 0.3 * ({scaled('industry_momentum', -0.5, 1.0)}) + 0.2 * industry_breadth AS score FROM {factors}) x) y WHERE place <= {top}"""


@operator
def index_regime(d, index_bars):
    """Five states by ordered rules over averages, momentum and drawdown of the index."""
    return f"""
    SELECT trade_date, CASE WHEN ma_5 > ma_20 AND ma_20 > ma_60 AND mom > 0.05 THEN 'bull' WHEN ma_5 < ma_20 AND ma_20 < ma_60 AND mom < -0.05 THEN 'bear' WHEN dd < -0.3 THEN 'crash' WHEN ma_5 > ma_20 THEN 'recovery' ELSE 'consolidation' END AS regime, ma_20, dd FROM (
      SELECT trade_date, {rolling('avg', 'close', 5, 1, DAY)} AS ma_5, {rolling('avg', 'close', 20, 1, DAY)} AS ma_20, {rolling('avg', 'close', 60, 1, DAY)} AS ma_60, close / nullif(lag(close, 20) OVER ({DAY}), 0) - 1 AS mom,
        close / nullif(max(close) {w(60, DAY)}, 0) - 1 AS dd FROM {index_bars}) x"""


@operator
def summary(d, scored, master):
    """Counts of the scan, and the same trades by state, industry, both and in all."""
    return f"""
    SELECT coalesce(m.industry, 'ALL') AS industry, coalesce(CAST(s.resonance_state AS {d.pick('STRING', 'VARCHAR')}), 'ALL') AS state, count(*) AS n, count(DISTINCT s.symbol) AS n_symbols, avg(s.resonance_score) AS mean_score
    FROM {scored} s JOIN {master} m ON s.symbol = m.symbol GROUP BY GROUPING SETS ((m.industry), (s.resonance_state), (m.industry, s.resonance_state), ())"""


@operator
def standardized(d, factors):
    """Cross-sectional z-scores, winsorised at three deviations."""
    def z(x):
        return f"{clip(div(f'{x} - avg({x}) OVER (PARTITION BY trade_date)', f'stddev_pop({x}) OVER (PARTITION BY trade_date)'), -3.0, 3.0)} AS {x}_z"
    return f"SELECT symbol, trade_date, {z('mom_5')}, {z('mom_20')}, {z('vs_20')}, {z('reversal')} FROM {factors}"
