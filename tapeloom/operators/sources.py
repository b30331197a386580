"""Tables of the market data model, made from trades, ticks and master tables."""

from __future__ import annotations

from tapeloom.functions.sqlkit import operator

ORDER = "(l_orderkey, l_linenumber, l_partkey, l_extendedprice)"


@operator
def daily_bars(d, trades):
    """Trades to one bar per symbol and day.  Side and size of a trade give signed flow in four tiers."""
    key = d.pick(f"struct{ORDER}", f"row{ORDER}")
    side = "CASE l_returnflag WHEN 'A' THEN 1e0 WHEN 'R' THEN -1e0 ELSE 0e0 END"
    tiers = ((0, 12.5), (12.5, 25), (25, 37.5), (37.5, 1e9))
    flows = ", ".join(
        f"sum(CASE WHEN l_quantity > {lo} AND l_quantity <= {hi} AND l_returnflag = '{f}' THEN l_extendedprice ELSE 0 END) AS {n}_{t}"
        for t, (lo, hi) in zip(("sm", "md", "lg", "elg"), tiers)
        for f, n in (("A", "buy"), ("R", "sell"))
    )
    return f"""
    SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
      min_by(l_extendedprice / l_quantity, {key}) AS open, max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low, max_by(l_extendedprice / l_quantity, {key}) AS close,
      sum(l_quantity) AS vol, sum(l_extendedprice) AS amount, sum({side} * l_extendedprice) AS net_mf,
      sum(l_tax * l_quantity) AS turnover_rate, {flows}
    FROM {trades} WHERE l_quantity > 0 AND l_shipdate IS NOT NULL GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""


@operator
def master(d, supplier, nation, region):
    """Security master: name, industry, area; missing text is empty, a missing industry UNKNOWN."""
    return f"""
    SELECT s_suppkey AS symbol, coalesce(s_name, '') AS name, coalesce(n_name, 'UNKNOWN') AS industry, coalesce(r_name, '') AS area,
      CASE WHEN s_suppkey % 7 = 0 THEN 'ST' || s_name ELSE s_name END AS display_name, s_acctbal * 1000 AS float_share
    FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey"""


@operator
def board_bars(d, bars, start="DATE '1998-01-01'", warmup=70, least=60):
    """Main board symbols from a start date, with bars before it to warm windows up, if they have enough rows."""
    return f"""
    SELECT * FROM (
      SELECT *, count(*) OVER (PARTITION BY symbol) AS n_rows FROM (
        SELECT symbol, trade_date, close, sum(CASE WHEN trade_date < {start} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS n_before,
          CAST(row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS BIGINT) AS bar_no
        FROM {bars} WHERE symbol % 10 < 8) a
      WHERE bar_no > n_before - {warmup}) b
    WHERE n_rows >= {least}"""


@operator
def index_bars(d, bars):
    """Market index: mean of all symbols' bars by day."""
    return f"""
    SELECT trade_date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(vol) AS vol, sum(amount) AS amount,
      count(*) AS members FROM {bars} GROUP BY trade_date"""


@operator
def limit_prices(d, bars, band=0.5):
    """Price limits: the previous close and a band around it."""
    return f"""
    SELECT symbol, trade_date, prev * {1 + band} AS up_limit, prev * {1 - band} AS down_limit FROM (
      SELECT symbol, trade_date, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS prev FROM {bars}) x WHERE prev IS NOT NULL"""


@operator
def margin(d, orders):
    """Balances summed over priorities by date."""
    return f"""
    SELECT CAST(o_orderdate AS DATE) AS trade_date, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS rzye,
      sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS rzmre, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS rqye,
      sum(o_totalprice) AS rzrqye FROM {orders} WHERE o_orderdate IS NOT NULL GROUP BY CAST(o_orderdate AS DATE)"""


@operator
def interbank(d, orders):
    """A rate by date, from text where it is one."""
    return f"""
    SELECT CAST(o_orderdate AS DATE) AS trade_date, avg(try_cast(substring(o_orderpriority, 1, 1) AS DOUBLE)) AS on_rate,
      avg(o_totalprice) / 100000 AS w1_rate FROM {orders} GROUP BY CAST(o_orderdate AS DATE)"""


@operator
def money_flow(d, bars):
    return f"SELECT symbol, trade_date, buy_sm, sell_sm, buy_md, sell_md, buy_lg, sell_lg, buy_elg, sell_elg FROM {bars}"


@operator
def weekly_or_resampled(d, precomputed, weekly, least=12):
    """A precomputed weekly table for the symbols that have enough rows there, resampled bars for the others."""
    return f"""
    WITH enough AS (SELECT symbol FROM {precomputed} GROUP BY symbol HAVING count(*) >= {least})
    SELECT symbol, bar_end, close, 'table' AS origin FROM {precomputed} WHERE symbol IN (SELECT symbol FROM enough)
    UNION ALL SELECT symbol, bar_end, close, 'resampled' AS origin FROM {weekly} WHERE symbol NOT IN (SELECT symbol FROM enough)"""


@operator
def lookback_trim(d, bars, end="DATE '2000-06-30'", years=2):
    """Rows from the first of January ``years`` before the end date's year, up to it."""
    return f"SELECT symbol, trade_date, close FROM {bars} WHERE trade_date >= make_date(CAST(year({end}) AS INT) - {years}, 1, 1) AND trade_date <= {end}"


@operator
def scan_date(d, bars, asked="DATE '1999-12-31'"):
    """Latest date, and the latest that isn't after the one asked for."""
    return f"SELECT max(trade_date) AS latest, max(CASE WHEN trade_date <= {asked} THEN trade_date END) AS resolved FROM {bars}"


@operator
def calendar(d, bars):
    """Distinct trading dates, numbered.  One row a date, so one task numbers them."""
    return f"SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS cal_no FROM (SELECT DISTINCT trade_date FROM {bars}) c"


@operator
def daily_full(d, bars, master, flow):
    """Bars with master and flow columns by left joins."""
    return f"""
    SELECT b.symbol, b.trade_date, b.close, b.vol, m.industry, b.vol / nullif(m.float_share, 0) AS share_turnover, f.buy_elg - f.sell_elg AS net_elg
    FROM {bars} b LEFT JOIN {master} m ON b.symbol = m.symbol LEFT JOIN {flow} f ON b.symbol = f.symbol AND b.trade_date = f.trade_date"""


@operator
def newer_rows(d, incoming, stored):
    """Rows newer than each symbol's last stored date; all rows of symbols not stored yet."""
    return f"""
    SELECT i.symbol, i.trade_date, i.close FROM {incoming} i
    LEFT JOIN (SELECT symbol, max(trade_date) AS last_date FROM {stored} GROUP BY symbol) s ON i.symbol = s.symbol
    WHERE s.last_date IS NULL OR i.trade_date > s.last_date"""


@operator
def refresh_window(d, bars, stored, lookback=130, full_above=50):
    """Rows that an incremental refresh of features reads: new ones and the lookback, or all where too many are new."""
    return f"""
    SELECT symbol, trade_date, mode FROM (
      SELECT symbol, trade_date, bar_no, n_new, n_all, CASE WHEN n_new > {full_above} THEN 'full' WHEN n_new = 0 THEN 'none' ELSE 'tail' END AS mode FROM (
        SELECT b.symbol, b.trade_date, row_number() OVER (PARTITION BY b.symbol ORDER BY b.trade_date) AS bar_no,
          sum(CASE WHEN s.last_date IS NULL OR b.trade_date > s.last_date THEN 1 ELSE 0 END) OVER (PARTITION BY b.symbol) AS n_new,
          count(*) OVER (PARTITION BY b.symbol) AS n_all
        FROM {bars} b LEFT JOIN (SELECT symbol, max(trade_date) AS last_date FROM {stored} GROUP BY symbol) s ON b.symbol = s.symbol) x) y
    WHERE mode = 'full' OR (mode = 'tail' AND bar_no > n_all - n_new - {lookback})"""


@operator
def ticks(d, events):
    """Tick stream: symbol, time, price, volume and side."""
    vol = d.pick("CAST(get_json_object(props, '$.k') AS DOUBLE)", "CAST(json_extract_string(props, '$.k') AS DOUBLE)")
    return f"""
    SELECT event_id, user_id AS symbol, ts, CAST(ts AS DATE) AS trade_date, value AS price, coalesce({vol}, 0) AS volume,
      CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS side
    FROM {events} WHERE value > 0 AND ts IS NOT NULL"""


@operator
def adjusted_minutes(d, minutes, factors):
    """Prices times the day's factor, average price, turnover from float shares where known."""
    return f"""
    SELECT m.symbol, m.minute, m.close * coalesce(f.factor, 1.0) AS close_adj, m.amount / nullif(m.volume, 0) AS avg_price,
      m.volume * 10000 / nullif(f.float_share, 0) AS turnover
    FROM {minutes} m LEFT JOIN {factors} f ON m.symbol = f.symbol AND m.trade_date = f.trade_date"""


@operator
def day_factors(d, ticks):
    """Adjustment factor and float shares of the days that have them."""
    return f"""
    SELECT symbol, trade_date, max(price) / min(price) AS factor, CASE WHEN symbol % 3 = 0 THEN NULL ELSE sum(volume) * 1000 END AS float_share
    FROM {ticks} GROUP BY symbol, trade_date HAVING count(*) > 1"""


@operator
def missing_days(d, minutes, cutoff_hour=12):
    """Symbol-days of the calendar without complete minutes (none at or after the cut-off hour): the work list."""
    return f"""
    WITH days AS (SELECT DISTINCT trade_date FROM {minutes}), symbols AS (SELECT DISTINCT symbol FROM {minutes}),
    complete AS (SELECT symbol, trade_date FROM {minutes} GROUP BY symbol, trade_date HAVING max(hour(minute)) >= {cutoff_hour})
    SELECT s.symbol, c.trade_date FROM symbols s CROSS JOIN days c LEFT JOIN complete k ON s.symbol = k.symbol AND c.trade_date = k.trade_date
    WHERE k.symbol IS NULL"""


@operator
def posts(d, documents, most=2000):
    """Posts: markup removed, cut to a length, and the rule filter on length and keywords."""
    clean = d.pick("regexp_replace(text, '<[^>]+>', ' ')", "regexp_replace(text, '<[^>]+>', ' ', 'g')")
    keyword = d.pick("lower(text) RLIKE 'license|token|password|market'", "regexp_matches(lower(text), 'license|token|password|market')")
    return f"""
    SELECT doc_id, source, CAST(length(body) AS BIGINT) AS n_body, length(body) >= 300 AND keyword AS passes, keyword FROM (
      SELECT doc_id, source, substring({clean}, 1, {most}) AS body, {keyword} AS keyword FROM {documents} WHERE text IS NOT NULL) p"""


@operator
def wide_dates(d, texts):
    """Dates in several spellings as dates; what is none is missing."""
    parsed = d.pick(
        "coalesce(try_to_date(s, 'yyyy-MM-dd'), try_to_date(s, 'yyyy/MM/dd'), try_to_date(s, 'yyyyMMdd'))",
        "CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%Y%m%d')) AS DATE)",
    )
    spelled = "CASE o_orderkey % 4 WHEN 0 THEN iso WHEN 1 THEN replace(iso, '-', '/') WHEN 2 THEN replace(iso, '-', '') ELSE 'n/a' END"
    iso = d.pick("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')")
    return f"SELECT o_orderkey, {parsed} AS parsed FROM (SELECT o_orderkey, {spelled} AS s FROM (SELECT o_orderkey, {iso} AS iso FROM {texts}) a) b"


@operator
def precomputed_weekly(d, weekly):
    """The part of the weekly bars that a vendor's table holds."""
    return f"SELECT symbol, bar_end, close FROM {weekly} WHERE symbol % 3 <> 0"
