"""Factor research: forward returns, information coefficients, quantiles, profiles, events, samples."""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, clip, div, lead, operator, w

FACTORS = ("mom_5", "mom_20", "vs_20", "reversal")


@operator
def panel(d, factors, rets, horizons=(5, 10, 20)):
    """Factor rows with forward returns; the last rows of a symbol, which lack the longest, are left out; time-decay weights."""
    fw = ", ".join(f"{lead('close', h)} / nullif(close, 0) - 1 AS fwd_{h}" for h in horizons)
    if not d.spark:
        return f"""
    SELECT f.*, {', '.join(f'r.fwd_{h}' for h in horizons)}, exp(-0.001 * (max(r.month_no) OVER () - r.month_no)) AS weight FROM {factors} f JOIN (
      SELECT symbol, trade_date, {fw}, year(trade_date) * 12 + month(trade_date) AS month_no FROM {rets}) r ON f.symbol = r.symbol AND f.trade_date = r.trade_date WHERE r.fwd_{max(horizons)} IS NOT NULL"""
    # the newest month of the rows kept is an aggregate, joined as one row: a window over all rows would take them through one task
    longest = max(horizons)
    month = "year(trade_date) * 12 + month(trade_date)"
    newest = f"""
      SELECT max({month}) AS month_no FROM (SELECT symbol, trade_date, {lead('close', longest)} / nullif(close, 0) - 1 AS fwd FROM {rets}) x
      LEFT SEMI JOIN {factors} k ON x.symbol = k.symbol AND x.trade_date = k.trade_date WHERE fwd IS NOT NULL"""
    return f"""
    SELECT /*+ BROADCAST(z) */ f.*, {', '.join(f'r.fwd_{h}' for h in horizons)}, exp(-0.001 * (z.month_no - r.month_no)) AS weight FROM {factors} f JOIN (
      SELECT symbol, trade_date, {fw}, {month} AS month_no FROM {rets}) r ON f.symbol = r.symbol AND f.trade_date = r.trade_date CROSS JOIN ({newest}) z WHERE r.fwd_{longest} IS NOT NULL"""


def long_form(d, panel: str, names=FACTORS) -> str:
    keep = "symbol, trade_date, fwd_5, fwd_10, fwd_20, weight"
    if d.spark:
        return f"SELECT {keep}, stack({len(names)}, {', '.join(f"'{x}', {x}" for x in names)}) AS (factor, value) FROM {panel}"
    return " UNION ALL ".join(f"SELECT {keep}, '{x}' AS factor, {x} AS value FROM {panel}" for x in names)


@operator
def factor_rows(d, panel):
    return f"SELECT * FROM ({long_form(d, panel)}) x WHERE value IS NOT NULL"


def average_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0)"


@operator
def rank_ic(d, rows, least=30):
    """Weighted correlation of average ranks for each symbol and factor."""
    m = lambda x: f"sum(weight * {x}) / sum(weight)"
    return f"""
    SELECT symbol, factor, n, (xy - x * y) / nullif(sqrt(greatest(xx - x * x, 0)) * sqrt(greatest(yy - y * y, 0)), 0) AS ic FROM (
      SELECT symbol, factor, count(*) AS n, {m('rx')} AS x, {m('ry')} AS y, {m('rx * ry')} AS xy, {m('rx * rx')} AS xx, {m('ry * ry')} AS yy FROM (
        SELECT symbol, factor, weight, {average_rank('value', 'symbol, factor')} AS rx, {average_rank('fwd_5', 'symbol, factor')} AS ry FROM {rows}) a GROUP BY symbol, factor HAVING count(*) >= {least}) b"""


@operator
def recent_ic(d, rows, last=60):
    """Correlation of ranks over each symbol's last rows, and the plain one."""
    return f"""
    SELECT symbol, factor, corr(rx, ry) AS spearman, corr(value, fwd_5) AS pearson, count(*) AS n FROM (
      SELECT symbol, factor, value, fwd_5, {average_rank('value', 'symbol, factor')} AS rx, {average_rank('fwd_5', 'symbol, factor')} AS ry FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol, factor ORDER BY trade_date DESC) AS back FROM {rows}) a WHERE back <= {last}) b GROUP BY symbol, factor"""


@operator
def date_ic(d, rows, least=10):
    """Cross-sectional rank correlation by month and factor; its mean over deviation by factor."""
    month = "year(trade_date) * 100 + month(trade_date)"
    return f"""
    SELECT factor, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, count(*) AS n_months FROM (
      SELECT factor, mon, corr(rx, ry) AS ic FROM (SELECT factor, mon, {average_rank('value', 'factor, mon')} AS rx, {average_rank('fwd_5', 'factor, mon')} AS ry FROM (SELECT *, {month} AS mon FROM {rows}) a) b GROUP BY factor, mon HAVING count(*) >= {least}) c GROUP BY factor"""


def _percentiles(rows: str, q: int) -> str:
    """Spark text of ``factor, edges``: exact percentiles, for which no task holds a factor's values.

    Values are counted; the counts by bins of 1/1024 octave tell in which bins the
    ranks lie that are asked for, and only the values of these bins are ordered.
    """
    size = "least(floor(log2(abs(value)) * 1024), 2000000) + 2000000"  # positive for all doubles
    bins = f"CASE WHEN isnan(value) THEN 5000000 WHEN value = 0 THEN 0 WHEN value > 0 THEN CAST({size} AS BIGINT) ELSE -CAST({size} AS BIGINT) END"
    shares = ", ".join(f"{k / q}D" for k in range(q + 1))
    return f"""
    WITH counted AS (SELECT *, {bins} AS bin FROM (SELECT factor, value, count(*) AS m FROM {rows} GROUP BY factor, value) x),
    summed AS (SELECT factor, bin, m, sum(m) OVER (PARTITION BY factor ORDER BY bin) - m AS first, sum(m) OVER (PARTITION BY factor) AS n FROM (SELECT factor, bin, sum(m) AS m FROM counted GROUP BY factor, bin) x),
    places AS (SELECT factor, place, explode(array_distinct(array(floor(place), ceil(place)))) AS nth FROM (SELECT factor, share * (n - 1) AS place FROM (SELECT factor, n, explode(array({shares})) AS share FROM (SELECT DISTINCT factor, n FROM summed) x) y) z),
    asked AS (SELECT /*+ BROADCAST(a) */ a.factor, a.place, a.nth, s.bin, s.first FROM summed s JOIN places a ON s.factor = a.factor AND a.nth >= s.first AND a.nth < s.first + s.m),
    near AS (SELECT *, sum(m) OVER (PARTITION BY factor, bin ORDER BY value) AS upto FROM (SELECT /*+ BROADCAST(k) */ c.* FROM counted c LEFT SEMI JOIN asked k ON c.factor = k.factor AND c.bin = k.bin) x),
    found AS (SELECT /*+ BROADCAST(a) */ a.factor, a.place, a.nth, min(c.value) AS value FROM near c JOIN asked a ON c.factor = a.factor AND c.bin = a.bin AND a.first + c.upto > a.nth GROUP BY a.factor, a.place, a.nth),
    pairs AS (SELECT factor, place, min_by(value, nth) AS low, max_by(value, nth) AS high FROM found GROUP BY factor, place)
    SELECT factor, array_distinct(transform(array_sort(collect_list(struct(place, CASE WHEN low = high THEN low ELSE (ceil(place) - place) * low + (place - floor(place)) * high END AS edge))), e -> e.edge)) AS edges FROM pairs GROUP BY factor"""


@operator
def quantile_returns(d, rows, q=5):
    """Mean forward return by quantile of the factor; edges that coincide are one, as values equal to an edge belong below it."""
    edges = "list_distinct([" + ", ".join(f"quantile_cont(value, {k / q})" for k in range(q + 1)) + "])"
    by_factor = d.pick(_percentiles(rows, q), f"SELECT factor, {edges} AS edges FROM {rows} GROUP BY factor")
    lowest = d.pick("array_min(edges)", "list_min(edges)")
    place = d.size(d.filter("edges", f"r.value > x AND x > {lowest}"))
    return f"""
    SELECT factor, bucket, count(*) AS n, avg(fwd_5) AS mean_fwd FROM (SELECT {d.pick('/*+ BROADCAST(e) */ ', '')}r.factor, {place} AS bucket, r.fwd_5 FROM {rows} r JOIN ({by_factor}) e ON r.factor = e.factor) x GROUP BY factor, bucket"""


@operator
def factor_summary(d, ics):
    """By factor: how many symbols are positive or negative, median, consensus, and the weight where it is large enough."""
    return f"""
    SELECT factor, n, n_pos, n_neg, median_ic, greatest(n_pos, n_neg) / CAST(n AS DOUBLE) AS consensus, CASE WHEN abs(median_ic) >= 0.005 AND n >= 50 THEN median_ic ELSE 0e0 END AS weight FROM (
      SELECT factor, count(*) AS n, count(CASE WHEN ic > 0.02 THEN 1 END) AS n_pos, count(CASE WHEN ic < -0.02 THEN 1 END) AS n_neg, {d.median('ic')} AS median_ic FROM {ics} WHERE ic IS NOT NULL GROUP BY factor) x"""


@operator
def ic_score(d, rows, weights):
    """Score of each row: mean of weight times winsorised z over usable factors; the largest contributions as text."""
    return f"""
    SELECT symbol, trade_date, avg(part) AS score, count(*) AS n_factors, max_by(factor, abs(part)) AS main_factor FROM (
      SELECT {d.pick('/*+ BROADCAST(w, s) */ ', '')}r.symbol, r.trade_date, r.factor, w.weight * ({clip(div('r.value - s.mu', 's.sd'), -3.0, 3.0)}) AS part FROM {rows} r JOIN {weights} w ON r.factor = w.factor JOIN (
        SELECT factor, avg(value) AS mu, stddev_pop(value) AS sd FROM {rows} GROUP BY factor) s ON r.factor = s.factor WHERE w.weight <> 0) x WHERE part IS NOT NULL GROUP BY symbol, trade_date"""


@operator
def horizon_residual(d, panel):
    """What a longer horizon holds beyond a shorter: residual without intercept, slope by month."""
    return f"""
    SELECT symbol, trade_date, fwd_10 - beta * fwd_5 AS residual FROM (SELECT symbol, trade_date, fwd_5, fwd_10, sum(fwd_5 * fwd_10) OVER (PARTITION BY mon) / nullif(sum(fwd_5 * fwd_5) OVER (PARTITION BY mon), 0) AS beta FROM (
      SELECT *, year(trade_date) * 100 + month(trade_date) AS mon FROM {panel}) a) b"""


@operator
def event_study(d, rets, before=5, after=10):
    """Average path around events: bars joined by their number."""
    return f"""
    SELECT CAST(b.bar_no - e.bar_no AS INT) AS rel, count(*) AS n, avg(b.close / nullif(e.close, 0) - 1) AS path FROM (SELECT symbol, bar_no, close FROM {rets} WHERE r5 > 3) e
    JOIN {rets} b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no - {before} AND e.bar_no + {after} GROUP BY b.bar_no - e.bar_no"""


@operator
def stay_labels(d, rets, n=10):
    """Labels over the bars ahead: stays up, collapses, bars until the first fall."""
    frame = f"OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    return f"""
    SELECT symbol, trade_date, lo / nullif(close, 0) - 1 > -0.3 AS stays, lo / nullif(close, 0) - 1 < -0.6 AS collapses, fall_bar - bar_no AS bars_to_fall FROM (
      SELECT symbol, trade_date, close, bar_no, min(close) {frame} AS lo, min(CASE WHEN r1 < -0.5 THEN bar_no END) {frame} AS fall_bar, count(*) {frame} AS m FROM {rets}) x WHERE m = {n}"""


@operator
def holding_features(d, marks, picks):
    """Days held, gain, highest gain so far, fall from it, of each live trade and day."""
    by = "PARTITION BY symbol, entry_date ORDER BY trade_date"
    return f"""
    SELECT symbol, entry_date, trade_date, days_held, pnl, max_pnl, pnl - max_pnl AS from_peak FROM (SELECT *, max(pnl) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_pnl FROM (
      SELECT m.symbol, m.entry_date, m.trade_date, CAST(row_number() OVER (PARTITION BY m.symbol, m.entry_date ORDER BY m.trade_date) AS INT) AS days_held, exp(sum(ln(greatest(1 + m.day_ret, 1e-9))) OVER (PARTITION BY m.symbol, m.entry_date ORDER BY m.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS pnl FROM {marks} m) a) b"""


@operator
def sequences(d, factors, n=20):
    """Sequence samples: the last n rows of two factors as arrays; windows with gaps are left out; split by year."""
    return f"""
    SELECT symbol, trade_date, {d.size('a')} AS steps, {d.total('a')} AS sum_a, {d.total('b')} AS sum_b, CASE WHEN year(trade_date) < 2000 THEN 'train' ELSE 'eval' END AS split FROM (
      SELECT symbol, trade_date, {d.collect('mom_5')} {w(n)} AS a, {d.collect('vs_20')} {w(n)} AS b, count(mom_5) {w(n)} AS m, count(vs_20) {w(n)} AS k FROM {factors} WHERE mom_5 IS NOT NULL) x WHERE m = {n} AND k = {n}"""


@operator
def neutralized(d, panel_, bars):
    """A factor less its regression on log size by month."""
    return f"""
    SELECT symbol, trade_date, mom_5 - (regr_intercept(mom_5, size) OVER (PARTITION BY mon) + regr_slope(mom_5, size) OVER (PARTITION BY mon) * size) AS neutral FROM (
      SELECT p.symbol, p.trade_date, p.mom_5, ln(1 + b.amount) AS size, year(p.trade_date) * 100 + month(p.trade_date) AS mon FROM {panel_} p JOIN {bars} b ON p.symbol = b.symbol AND p.trade_date = b.trade_date WHERE p.mom_5 IS NOT NULL) x"""


@operator
def adjusted_weights(d, ics, rate=0.3):
    """Weights moved towards the share of their correlations, clipped and made to sum to 1."""
    return f"""
    SELECT factor, weight / sum(weight) OVER () AS weight FROM (SELECT factor, {clip(f'0.25 * (1 - {rate}) + {rate} * (0.25 + avg(ic))', 0.01, 0.6)} AS weight FROM {ics} WHERE ic IS NOT NULL GROUP BY factor) x"""


#: One of each pair of mirrored or nearly equal columns, by the names of this package's frames.
REDUNDANT = (
    "sell_elg", "sell_lg", "sell_md", "sell_sm", "buy_elg", "buy_lg", "buy_md",
    "big_ratio", "purity_norm", "spectrum_entropy", "slope",
)


@operator
def pruned(d, rows, names=(), redundant=REDUNDANT):
    """the columns named but for redundant ones; the scan reads no others."""
    return f"SELECT {', '.join(c for c in names if c not in redundant)} FROM {rows}"
