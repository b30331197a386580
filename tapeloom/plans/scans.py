"""Further user-level jobs over a user's own bars: scans with picks, outcomes and net value, factor research, training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import adaptive as Y
from tapeloom.operators import cross as A
from tapeloom.operators import detectors as D
from tapeloom.operators import dual as E
from tapeloom.operators import factors as R
from tapeloom.operators import intraday as M
from tapeloom.operators import joins as J
from tapeloom.operators import outcomes as O
from tapeloom.operators import outcome_models as Q
from tapeloom.operators import samples as T
from tapeloom.operators import scores as P
from tapeloom.operators import setup as X
from tapeloom.operators import sources as S
from tapeloom.operators import windows as W


def _followed(rets: DataFrame, selected: DataFrame, hold: int) -> DataFrame:
    """What became of the selected rows: entry at the next open, exit after ``hold`` bars."""
    marked = rets.join(selected.select("symbol", "trade_date", F.lit(True).alias("picked")), ["symbol", "trade_date"], "left")
    return O.fixed_horizon(marked, hold=hold, signal="picked")


def _scan(rets: DataFrame, master: DataFrame, scored: DataFrame, score: str, where: str, hold: int, total: int, each: int) -> dict[str, DataFrame]:
    """Rows that meet a condition, the best of each date under caps by industry, and their outcomes."""
    candidates = scored.where(where).select("symbol", "trade_date", F.col(score).alias("score_min"))
    selected = O.capped_top(candidates, master, total=total, each=each)
    trades = _followed(rets, selected, hold)
    summary = trades.groupBy("trade_date").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))
    return {"market": scored, "candidates": candidates, "selected": selected, "trades": trades, "summary": summary}


def accumulation_scan(bars: DataFrame, master: DataFrame, hold: int = 20, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Accumulation, break-out and collapse of every symbol, break-outs ranked by quality, outcomes."""
    found = D.detect_collapse(D.detect_breakout(D.detect_accumulation(detector_inputs(bars))))
    return _scan(W.returns(bars), master, found, "breakout_quality", "breakout AND NOT collapse", hold, total, each)


def detector_inputs(bars: DataFrame) -> DataFrame:
    """The features that detectors and adaptive states read, one row a symbol and day."""
    rets = W.returns(bars)
    pe, pi, eig = W.permutation_entropy(rets), W.irreversibility(rets), W.dominant_eigenvalue(rets)
    return D.detector_frame(W.volume_ratios(bars), pe, pi, eig, W.coherence(W.structure(rets)), W.tiered_flow(S.money_flow(bars)), W.entropy_motion(pe, W.permutation_entropy(rets, n=60)))


def adaptive_replay(bars: DataFrame, model: DataFrame | None = None, start: str | None = None, end: str | None = None, every: int = 5, hold_scans: int = 3, hold: int = 10, least: float = 0.0) -> dict[str, DataFrame]:
    """Adaptive states at every n-th date between two dates, their counts, the signals and what became of the break-outs.

    ``model`` gives ``symbol, trade_date, up_prob``; without it the probability
    is one half.  Signals are all states but idle of at least a confidence.
    """
    days = S.calendar(bars)
    if start or end:
        days = days.where(F.col("trade_date").between(start or "0001-01-01", end or "9999-12-31")).withColumn("cal_no", F.expr("row_number() OVER (ORDER BY trade_date)"))
    if model is None:
        model = bars.select("symbol", "trade_date", F.lit(0.5).alias("up_prob"))
    states = Y.adaptive_states(Y.adaptive_scores(detector_inputs(bars), Y.scan_dates(days, every=every), model), hold_scans=hold_scans)
    signals = states.where((F.col("state") != "idle") & (F.col("confidence") >= least))
    return {"states": states, "summary": Y.scan_summary(states), "signals": signals, "trades": Y.adaptive_outcomes(states, bars, hold=hold)}


def four_layer_scan(bars: DataFrame, master: DataFrame, hold: int = 10, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Market phase, setups, each symbol's state and action, entries ranked by signal, outcomes."""
    rets = W.returns(bars)
    pi = W.irreversibility(rets)
    setups = X.setup_frame(X.setup_features(bars))
    states = P.stock_state(setups, pi)
    return {"phase": X.cross_section(setups, X.lead_lag_entropy(X.industry_logs(rets, master))), **_scan(rets, master, states, "signal", "signal > 0", hold, total, each)}


def volume_breakout_scan(bars: DataFrame, master: DataFrame, least: float = 0.5, hold: int = 10, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Volume break-outs of at least a score, ranked, with outcomes."""
    rets = W.returns(bars)
    return _scan(rets, master, P.volume_breakout(rets), "score", f"score >= {least}", hold, total, each)


def factor_scan(bars: DataFrame, master: DataFrame, hold: int = 10, total: int = 10, each: int = 2) -> dict[str, DataFrame]:
    """Factors, their rank correlations with later returns and weights, weighted scores, picks, outcomes.

    The weights are those of the whole history given: for a walk forward, give
    bars up to the cutoff.
    """
    rets = W.returns(bars)
    rows = R.factor_rows(R.panel(W.derived_factors(rets), rets))
    summary = R.factor_summary(R.rank_ic(rows))
    scored = R.ic_score(rows, summary)
    return {"factors": summary, "recent": R.recent_ic(rows), "monthly": R.date_ic(rows), **_scan(rets, master, scored, "score", "score > 0", hold, total, each)}


def training_samples(bars: DataFrame, cutoff: str | None = None, n: int = 60, horizon: int = 40) -> dict[str, DataFrame]:
    """Windows of all factors as arrays (``samples.write_samples`` writes them in bounded files), labels of later gains and of staying in a trend.

    With a cutoff the samples carry the highest gain of the next ``horizon`` bars
    and their split, none of whose training labels reaches past it.
    """
    rets = W.returns(bars)
    windows = T.sequence_samples(W.derived_factors(rets), S.calendar(bars), n=n)
    if cutoff:
        windows = T.labelled(windows, Q.forward_gains(bars, horizon), F.lit(cutoff).cast("date"))
    return {"sequences": windows, "gains": J.offset_labels(bars, S.calendar(bars)), "stay": R.stay_labels(rets)}


def dual_entropy_scan(bars: DataFrame, minutes: DataFrame) -> dict[str, DataFrame]:
    """Daily entropy summary, bifurcation of every symbol and day, and buy and sell scores of every session of the minute bars."""
    rets = W.returns(bars)
    daily = E.daily_summary(rets, W.permutation_entropy(rets), W.permutation_entropy(rets, n=60), W.irreversibility(rets), W.dominant_eigenvalue(rets), W.variance_lift(rets))
    steps = M.minute_returns(minutes)
    sessions = E.intraday_frame(M.volume_share(minutes), M.whole_day(steps, least=30), E.entropy_curve(minutes), daily)
    return {"daily": daily, "bifurcation": E.bifurcation(daily, rets), "sessions": sessions, "buy": E.buy_signal(sessions), "sell": E.sell_signal(sessions)}
