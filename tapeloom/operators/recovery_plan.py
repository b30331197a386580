"""Decline recovery above the single symbol: market row and timing, sector choice, plan with a local override, picks.

Weights, bounds and thresholds are fixed values of the method; limits that a
user sets are parameters.  Missing values count as 0 in scores and as not met in
conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.sqlkit import clip, flag, operator, scaled, shown, w
from tapeloom.sources import workdir

DAY = "ORDER BY trade_date"


#: Means of equal numbers may differ in their last bits; thresholds on them give way by this.
NEAR = 1e-12


def _unit(x: str, lo: float, hi: float) -> str:
    return f"coalesce({scaled(x, lo, hi)}, 0)"


def _sum(*terms: tuple[float, str]) -> str:
    return clip(" + ".join(f"{a} * {x}" for a, x in terms), 0.0, 1.0)


@operator
def recovery_rows(d, recovered, master, min_amount=600000.0, min_turnover=1.0, exclude_marked=True):
    """Recovery features with industry and whether a row may be traded: amount, turnover, no ST mark in the name."""
    marked = "coalesce(upper(m.name) LIKE '%ST%', false)" if exclude_marked else "false"
    return f"""
    SELECT r.*, coalesce(m.industry, 'UNKNOWN') AS industry, coalesce(r.amount, 0) >= {min_amount} AND coalesce(r.turnover_rate, 0) >= {min_turnover} AND NOT {marked} AS tradable
    FROM {recovered} r LEFT JOIN {master} m ON r.symbol = m.symbol"""


def _share(c: str) -> str:
    return f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"


#: Means and shares of a date's symbols.
MEANS = {
    "eq_1": "avg(r1)", "eq_3": "avg(ret_3)", "eq_5": "avg(r5)", "eq_10": "avg(ret_10)", "eq_20": "avg(ret_20)", "below_share": _share("to_ma20 < 0"), "down_share": _share("damage >= 0.32 OR ret_10 <= -0.06"),
    "deep_share": _share("dd_20 <= -0.12"), "repair_share": _share("repair_flag"), "early_share": _share("early_flag"), "flow_share": _share("flow_5 > 0"), "amount_share": _share("amount_ratio >= 1.05"), "hot_share": _share("overheat_flag"),
}


def _scored(means: str) -> str:
    washout = _sum((0.30, _unit("-eq_10", 0.01, 0.08)), (0.25, _unit("below_share", 0.30, 0.85)), (0.25, _unit("deep_share", 0.08, 0.55)), (0.20, _unit("down_share", 0.20, 0.75)))
    repair = _sum((0.25, _unit("eq_3", -0.005, 0.03)), (0.25, _unit("repair_share", 0.20, 0.60)), (0.20, _unit("early_share", 0.03, 0.25)), (0.15, _unit("flow_share", 0.40, 0.70)), (0.15, _unit("amount_share", 0.20, 0.55)))
    overheat = _sum((0.60, _unit("hot_share", 0.10, 0.35)), (0.40, _unit("eq_5", 0.02, 0.08)))
    return f"""
    SELECT *, {washout} AS washout, {repair} AS repair, {overheat} AS overheat FROM ({means}) y"""


@operator
def market_row(d, rows):
    """Mean returns and nine shares of each date's tradable symbols (of all where none is), and three scores of them."""
    m = [f"{x} AS {c}" for c, x in MEANS.items()]
    return _scored(f"""
      SELECT trade_date, count(*) AS n, {', '.join(m[:7])},
        {', '.join(m[7:])}
      FROM (SELECT *, max(CASE WHEN tradable THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date) AS any_tradable FROM {rows}) x WHERE tradable OR any_tradable = 0 GROUP BY trade_date""")


@operator
def market_sums(d, rows):
    """``market_row`` without a window over all rows: sums of the tradable and of all symbols, of which a date takes one."""
    either = lambda x: f"CASE WHEN max(tradable) THEN {x} FILTER (WHERE tradable) ELSE {x} END"
    return _scored(f"SELECT trade_date, {either('count(*)')} AS n, {', '.join(f'{either(x)} AS {c}' for c, x in MEANS.items())} FROM {rows} GROUP BY trade_date")


@operator
def market_timing(d, market, days=6):
    """State of each date from the highest washout of the last sessions and today's repair and overheating."""
    return f"""
    SELECT *, timing IN ('buy_window', 'repair_watch') AS can_buy FROM (
      SELECT *, CASE WHEN washout_peak < 0.50 THEN 'no_setup' WHEN overheat >= 0.58 THEN 'rebound_crowded' WHEN repair >= 0.44 AND early_share >= 0.03 AND buy_score >= 0.50 THEN 'buy_window'
        WHEN repair >= 0.30 AND coalesce(eq_1, -1e0) >= -0.01 AND buy_score >= 0.38 THEN 'repair_watch' ELSE 'selloff' END AS timing FROM (
        SELECT *, {clip('0.55 * washout_peak + 0.45 * repair - 0.35 * overheat', 0.0, 1.0)} AS buy_score FROM (SELECT *, max(washout) {w(days, DAY)} AS washout_peak FROM {market}) a) b) c"""


@operator
def sector_rank(d, rows, market, members=4, top=6):
    """Score, state, place and choice of each date's industries with enough tradable symbols."""
    score = _sum((0.20, "coalesce(damage, 0)"), (0.28, "coalesce(repair, 0)"), (0.17, "entry_share"), (0.15, "coalesce(flow, 0)"), (0.10, _unit("relative", -0.02, 0.05)), (0.10, "(1 - coalesce(overheat, 0))"))
    # means that are equal but for their last bits are ties here, as the order of adding differs with the tasks
    own = lambda x: d.pick(shown(x, 9), x)
    return f"""
    SELECT *, place <= {top} AND sector_score >= 0.48 - {NEAR} AND repair >= 0.45 - {NEAR} AS chosen FROM (
      SELECT *, CASE WHEN sector_score >= 0.62 - {NEAR} AND repair >= 0.50 - {NEAR} THEN 'leading_repair' WHEN sector_score >= 0.48 - {NEAR} THEN 'watch' ELSE 'lagging' END AS state,
        CAST(row_number() OVER (PARTITION BY trade_date ORDER BY {own('sector_score')} DESC, {own('relative')} DESC NULLS LAST, {own('repair')} DESC NULLS LAST, n DESC, industry) AS INT) AS place FROM (
        SELECT *, {score} AS sector_score FROM (
          SELECT g.*, g.ret_5 - coalesce(k.eq_5, 0) AS relative FROM (
            SELECT trade_date, industry, count(*) AS n, avg(damage) AS damage, avg(repair) AS repair, avg(CASE WHEN candidate THEN 1e0 ELSE 0e0 END) AS entry_share, avg(flow_support) AS flow, avg(overheat) AS overheat, avg(ret_3) AS ret_3, avg(r5) AS ret_5
            FROM {rows} WHERE tradable GROUP BY trade_date, industry HAVING count(*) >= {members}) g LEFT JOIN {market} k ON g.trade_date = k.trade_date) a) b) c"""


@operator
def entry_plan(d, rows, sectors, timing, top=6, rebound_least=0.03, rebound_most=0.15, min_amount=600000.0, min_turnover=1.0):
    """Strategy score against the sector, thresholds that a strong repair relaxes, market access or a local override, and the plan.

    An industry without a place has score 0 and place 999.
    """
    relaxed = max(1, min(3, top))
    score = _sum(
        (0.18, "coalesce(damage, 0)"), (0.24, "coalesce(repair, 0)"), (0.16, "coalesce(entry_window, 0)"), (0.14, "coalesce(flow_support, 0)"), (0.08, "coalesce(stability, 0)"), (0.12, "sector_score"),
        (0.08, _unit("coalesce(r5, 0) - sector_ret_5", -0.04, 0.08)), (-0.10, "coalesce(overheat, 0)"),
    )
    return f"""
    SELECT *, CASE WHEN NOT strategy_state THEN 'skip' WHEN access = 'local_repair_override' OR timing = 'repair_watch' THEN 'probe' WHEN timing = 'buy_window' AND buy_score >= 0.68 AND strategy_score >= 0.76 AND cost_state = 'normal' THEN 'full' WHEN timing = 'buy_window' THEN 'staged' ELSE 'skip' END AS mode,
      CASE WHEN NOT strategy_state THEN 0e0 WHEN access = 'local_repair_override' THEN CASE WHEN cost_state = 'normal' THEN 0.25e0 ELSE 0.15e0 END WHEN timing = 'repair_watch' THEN CASE WHEN cost_state = 'normal' THEN 0.35e0 ELSE 0.25e0 END
        WHEN timing = 'buy_window' AND buy_score >= 0.68 AND strategy_score >= 0.76 AND cost_state = 'normal' THEN 1e0 WHEN timing = 'buy_window' THEN CASE WHEN cost_state = 'normal' THEN 0.65e0 ELSE 0.50e0 END ELSE 0e0 END AS scale,
      CASE WHEN NOT strategy_state THEN 0 WHEN access = 'local_repair_override' OR timing = 'repair_watch' THEN 1 WHEN timing = 'buy_window' AND NOT (buy_score >= 0.68 AND strategy_score >= 0.76 AND cost_state = 'normal') THEN 2 ELSE 1 END AS entry_days,
      CASE WHEN NOT strategy_state THEN 'abandon' WHEN access = 'local_repair_override' OR timing = 'repair_watch' THEN 'reduce' ELSE 'trail' END AS exit_mode FROM (
      SELECT *, candidate_ok AND access <> 'blocked' AND strategy_score >= CASE WHEN timing IN ('buy_window', 'repair_watch') THEN 0.46 ELSE 0.50 END AS strategy_state FROM (
        SELECT *, CASE WHEN can_buy THEN 'broad_market' WHEN candidate_ok AND timing IN ('no_setup', 'selloff') AND buy_score >= 0.34 AND sector_place <= {relaxed} AND sector_score >= sector_least AND strong AND coalesce(overheat, 0) <= 0.20
            AND coalesce(rebound, 0) <= {min(rebound_most, 0.13)} AND strategy_score >= 0.52 THEN 'local_repair_override' ELSE 'blocked' END AS access FROM (
          SELECT *, {score} AS strategy_score, {flag(f'tradable AND damage >= damage_least AND repair >= 0.48 AND entry_window >= 0.40 AND flow_support >= 0.35 AND rebound >= {rebound_least} AND rebound <= {rebound_most} AND sector_score >= sector_least AND sector_place <= {top}')} AS candidate_ok FROM (
            SELECT *, CASE WHEN strong THEN 0.24 ELSE 0.32 END AS damage_least, CASE WHEN strong AND sector_relative >= -0.01 THEN 0.40 ELSE 0.48 END AS sector_least FROM (
              SELECT *, {flag(f'sector_place <= {relaxed} AND repair >= 0.60 AND entry_window >= 0.55 AND flow_support >= 0.45 AND stability >= 0.38 AND sector_repair >= 0.55')} AS strong,
                CASE WHEN coalesce(amount, 0) < {min_amount} OR coalesce(turnover_rate, 0) < {min_turnover} THEN 'blocked' WHEN coalesce(amount_ratio, 0) < 0.90 OR coalesce(atr, 0) > 0.08 OR coalesce(overheat, 0) > 0.45 THEN 'cautious' ELSE 'normal' END AS cost_state FROM (
                SELECT r.symbol, r.trade_date, r.industry, r.tradable, r.amount, r.turnover_rate, r.amount_ratio, r.atr, r.rebound, r.r5, r.damage, r.repair, r.entry_window, r.flow_support, r.stability, r.overheat,
                  coalesce(s.place, 999) AS sector_place, coalesce(s.sector_score, 0) AS sector_score, coalesce(s.repair, 0) AS sector_repair, coalesce(s.relative, 0) AS sector_relative, coalesce(s.ret_5, 0) AS sector_ret_5, coalesce(s.state, 'unranked') AS sector_state,
                  coalesce(t.timing, 'no_setup') AS timing, coalesce(t.buy_score, 0) AS buy_score, coalesce(t.can_buy, false) AS can_buy
                FROM {rows} r LEFT JOIN {sectors} s ON r.trade_date = s.trade_date AND r.industry = s.industry LEFT JOIN {timing} t ON r.trade_date = t.trade_date) p) q) u) v) x) y"""


def kept_rows(recovered: DataFrame, master: DataFrame, **params) -> DataFrame:
    """``recovery_rows``, written once: market, sectors and plans go over them. The master (a row a symbol) is broadcast."""
    rows = recovery_rows(recovered, F.broadcast(master.select("symbol", "name", "industry")), **params)
    return workdir.written(rows, "recovery")[0]


def kept_market(rows: DataFrame) -> DataFrame:
    """``market_row``, written once: a row a date, for timing and sectors."""
    return workdir.written(market_sums(rows), "market")[0]


def planned(rows: DataFrame, sectors: DataFrame, timing: DataFrame, **params) -> DataFrame:
    """``entry_plan`` that leaves its rows where they are: sectors (a row an industry and date) and timing are broadcast."""
    return entry_plan(rows, F.broadcast(sectors), F.broadcast(timing), **params)


@operator
def portfolio(d, plans, total=10, each=2):
    """The plans of each date that are entered, best sectors first, capped by industry and in all."""
    order = "sector_score DESC, strategy_score DESC, repair DESC NULLS LAST, flow_support DESC NULLS LAST, amount DESC NULLS LAST, symbol"
    return f"""
    SELECT symbol, trade_date, industry, strategy_score, sector_score, mode, scale, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY {order}) AS INT) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY trade_date, industry ORDER BY {order}) AS own FROM {plans} WHERE strategy_state AND mode <> 'skip') x WHERE own <= {each}) y WHERE place <= {total}"""
