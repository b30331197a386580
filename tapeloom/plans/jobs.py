"""User-level jobs over a user's own bars: one lazy plan each, made of the engine's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import cross as A
from tapeloom.operators import detectors as D
from tapeloom.operators import joins as J
from tapeloom.operators import outcomes as O
from tapeloom.operators import recovery_plan as V
from tapeloom.operators import regimes as Z
from tapeloom.operators import scores as P
from tapeloom.operators import setup as X
from tapeloom.operators import sources as S
from tapeloom.operators import windows as W


def resonance_scan(bars: DataFrame, master: DataFrame, hold: int = 10, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Three time frames' scores, their joint state, capped picks by date, outcomes and cohort net value."""
    rets = W.returns(bars)
    scored = {"day": P.physics(B.with_returns(bars))}
    for period in ("week", "month"):
        scored[period] = P.physics(B.period_bars(bars, period=period), short=6, long=12)
    resonance = P.resonance(scored["day"], scored["week"], scored["month"])
    trades = J.picks(rets, hold=hold)
    marks = O.marked(trades, bars)
    return {"market": resonance, "selected": O.capped_top(scored["day"], master, total=total, each=each), "trades": trades, "nav": O.cohort_nav(marks), "summary": A.summary(resonance, master)}


def setup_scan(bars: DataFrame, master: DataFrame, min_amount: float = 500000.0, min_turnover: float = 1.0, hold: int = 10, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Bifurcation setups of every date: cross section and plans, latent states, what passes the gates, capped picks with outcomes and cohort net value."""
    rets = W.returns(bars)
    features = X.setup_features(bars)
    setups = X.setup_frame(features)
    crossed = X.cross_section(setups, X.lead_lag_entropy(X.industry_logs(rets, master)))
    candidates = X.setup_candidates(crossed, master, min_amount=min_amount, min_turnover=min_turnover)
    passing = candidates.where("passes").select("symbol", "trade_date", F.col("context").alias("score_min"))
    selected = O.capped_top(passing, master, total=total, each=each)
    marked = rets.join(selected.select("symbol", "trade_date", F.lit(True).alias("picked")), ["symbol", "trade_date"], "left")
    trades = J.picks(marked, hold=hold, signal="picked")
    return {
        "setups": setups, "cross_section": crossed, "candidates": candidates, "states": X.latent_states(X.latent_scores(features)), "actions": P.stock_state(setups, W.irreversibility(rets)),
        "selected": selected, "trades": trades, "nav": O.cohort_nav(O.marked(trades, bars)),
    }


def recovery_scan(
    bars: DataFrame, master: DataFrame, min_amount: float = 600000.0, min_turnover: float = 1.0, members: int = 4, top: int = 6,
    rebound: tuple[float, float] = (0.03, 0.15), hold: int = 8, total: int = 10, each: int = 2,
) -> dict[str, DataFrame]:
    """Decline and recovery of every date: market timing, sectors, plans, capped picks with outcomes and cohort net value, what blocks candidates."""
    rets = W.returns(bars)
    recovered = P.recovery(rets)
    rows = V.recovery_rows(recovered, master, min_amount=min_amount, min_turnover=min_turnover)
    market = V.market_row(rows)
    timing, sectors = V.market_timing(market), V.sector_rank(rows, market, members=members, top=top)
    plans = V.entry_plan(rows, sectors, timing, top=top, rebound_least=rebound[0], rebound_most=rebound[1], min_amount=min_amount, min_turnover=min_turnover)
    selected = V.portfolio(plans, total=total, each=each)
    marked = rets.join(selected.select("symbol", "trade_date", F.lit(True).alias("picked")), ["symbol", "trade_date"], "left")
    trades = J.picks(marked, hold=hold, signal="picked")
    return {"market": timing, "sectors": sectors, "plans": plans, "selected": selected, "trades": trades, "nav": O.cohort_nav(O.marked(trades, bars)), "blockers": O.blockers(recovered)}


def trend_scan(bars: DataFrame, master: DataFrame, margin: DataFrame, rate: DataFrame, limits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Seven scores and the trend by date from breadth, flow, limits and macro, with what the index did; sectors' flow beside them.

    ``limits`` gives ``symbol, trade_date, up_limit, down_limit``; without it they
    are a band around the close before.
    """
    rets = W.returns(bars)
    inputs = A.stock_inputs(rets, master)
    micro = D.trend_micro(D.trend_inputs(rets, master, W.permutation_entropy(rets), W.tiered_flow(S.money_flow(bars))))
    hits = J.limit_hits(bars, S.limit_prices(bars) if limits is None else limits)
    trend = D.market_trend(micro, Z.ema(A.breadth(inputs)), hits, J.asof_macro(S.calendar(bars), margin, rate))
    return {"breadth": micro, "sectors": A.sector_flow(inputs), "trend": trend, "returns": A.trend_returns(trend, S.index_bars(bars))}


def hold_scan(bars: DataFrame, start: str) -> dict[str, DataFrame]:
    """Hold and exit path of all symbols from a date on, and its states."""
    paths = P.hold_path(P.expansion(W.returns(bars)), start=f"DATE '{start}'")
    return {"paths": paths, "states": P.path_transitions(paths)}
