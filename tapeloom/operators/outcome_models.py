"""Models of trade outcomes, and the replay of missed gainers through a fitted one.

A label is known when its trade is closed: a model for a cutoff learns only from
trades closed by then, and its threshold comes from a later part of these, with
the same rule between the two.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.models import FACTORS, features, sweep


@dataclass
class OutcomeModel:
    model: Any
    factors: tuple[str, ...]
    threshold: float
    n: int
    positives: int
    mean: dict[str, float]
    sd: dict[str, float]


def outcome_rows(trades: DataFrame, factors: DataFrame, good: float = 0.0, kind: str = "buy") -> DataFrame:
    """Trades with the factors at their signal (``buy``) or exit (``exit``) and a label: was it good to buy, or to sell.

    ``trades`` has ``symbol, trade_date, exit_date, ret``, for ``exit`` also
    ``later``, the return after the exit.  A buy is good at a return above
    ``good``, an exit at a later one below ``-good``.  ``known_at`` is when the
    label is known: for exits the caller's ``known_at``.
    """
    if kind == "buy":
        rows = trades.select("symbol", "trade_date", (F.col("ret") > good).cast("double").alias("label"), F.col("exit_date").alias("known_at"))
    else:
        rows = trades.select("symbol", F.col("exit_date").alias("trade_date"), (F.col("later") < -good).cast("double").alias("label"), "known_at")
    return rows.where("label IS NOT NULL AND known_at IS NOT NULL").join(factors, ["symbol", "trade_date"])


def _fitted(rows: DataFrame, factors, rounds: int, cap: float):
    n, positives = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not positives or positives == n:
        return None
    ratio = min(cap, (n - positives) / positives)
    weighted = rows.withColumn("class_weight", F.when(F.col("label") == 1, ratio).otherwise(1.0))
    return GBTClassifier(labelCol="label", weightCol="class_weight", maxIter=rounds, maxDepth=4, seed=7).fit(weighted)


def _probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def fit_outcomes(rows: DataFrame, cutoff, factors=FACTORS, rounds: int = 20, cap: float = 10.0, share: float = 0.8) -> OutcomeModel | None:
    """A classifier of outcomes known by ``cutoff``, with the threshold of best F1 on the newest part of them; None without both labels.

    The rare class weighs more, up to ``cap``.
    """
    known = features(rows.where(F.col("known_at") <= F.lit(cutoff)), factors)
    day = F.unix_date(F.to_date("trade_date"))
    split = known.select(F.percentile(day, share)).first()[0]
    if split is None:
        return None
    model = _fitted(known, factors, rounds, cap)
    if model is None:
        return None
    inner = _fitted(known.where(F.unix_date(F.to_date("known_at")) <= split), factors, rounds, cap)
    threshold = 0.5
    if inner is not None:
        best = sweep(_probability(inner, known.where(day > split)).select("label", "p")).where("f1 IS NOT NULL").orderBy(F.desc("f1"), "threshold").first()
        threshold = best["threshold"] if best else threshold
    made = known.agg(F.count("*").alias("n"), F.sum("label").alias("positives"), *[f(c).alias(f"{k}_{c}") for c in factors for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    return OutcomeModel(model, tuple(factors), threshold, made["n"], int(made["positives"]), {c: made[f"mean_{c}"] for c in factors}, {c: made[f"sd_{c}"] for c in factors})


def forward_gains(bars: DataFrame, horizon: int) -> DataFrame:
    """``symbol, trade_date, gain, known_at``: the highest close of the next ``horizon`` bars over a bar's own."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    ahead = w.rowsBetween(1, horizon)
    return bars.select("symbol", "trade_date", (F.max("close").over(ahead) / F.col("close") - 1).alias("gain"), F.lead("trade_date", horizon).over(w).alias("known_at"))


def was_positive(bars: DataFrame, scan_date, horizon: int = 120, window: int = 240, gain: float = 2.0) -> DataFrame:
    """``symbol, positive``: had the symbol a bar, ``horizon`` to ``window`` bars before the scan, whose gain reached the target within ``horizon`` bars?"""
    past = bars.where(F.col("trade_date") <= F.lit(scan_date))
    back = past.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))))
    gains = forward_gains(past, horizon).join(back.select("symbol", "trade_date", "back"), ["symbol", "trade_date"])
    hit = (F.col("back") > horizon) & (F.col("back") <= window) & (F.col("gain") >= gain)
    return gains.groupBy("symbol").agg(F.max(hit).alias("positive"))


def missed_gainers(bars: DataFrame, picked: DataFrame, scan_date, horizon: int = 120, gain: float = 2.0) -> DataFrame:
    """``symbol, gain``: symbols that rose by ``gain`` within ``horizon`` bars of the scan and weren't picked (``symbol, trade_date``) then."""
    at = forward_gains(bars, horizon).where((F.col("trade_date") == F.lit(scan_date)) & (F.col("gain") >= gain))
    return at.select("symbol", "gain").join(picked.where(F.col("trade_date") == F.lit(scan_date)).select("symbol"), "symbol", "left_anti")


def replay_missed(model: OutcomeModel, missed: DataFrame, factors: DataFrame, bars: DataFrame, scan_date, horizon: int = 120, window: int = 240, gain: float = 2.0, part: float = 0.3) -> DataFrame:
    """Missed gainers scored by the model from their factors at the scan date, with a diagnosis of all of them.

    ``threshold_issue`` if more than ``part`` of them reach half the threshold,
    else ``label_gap`` if more than ``part`` were once positives of the training
    window, else ``factor_blind``.  A missing factor is its training mean.
    ``main_factor`` has the largest contribution: importance times distance from
    the training mean in deviations.
    """
    rows = factors.where(F.col("trade_date") == F.lit(scan_date)).join(missed, "symbol").fillna(model.mean)
    scored = _probability(model.model, features(rows, model.factors))
    weight = [float(x) for x in model.model.featureImportances.toArray()]
    parts = [F.struct(F.abs(F.lit(w) * (F.col(c) - model.mean[c]) / (model.sd[c] or 1.0)).alias("size"), F.lit(c).alias("factor")) for w, c in zip(weight, model.factors)]
    scored = scored.select("symbol", "gain", "p", F.array_max(F.array(*parts))["factor"].alias("main_factor"))
    scored = scored.join(was_positive(bars, scan_date, horizon, window, gain), "symbol", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    marked = scored.withColumn("above_half", F.col("p") > model.threshold / 2)
    all_ = Window.partitionBy(F.lit(0))  # the missed of one date
    n, above, positive = F.count("*").over(all_), F.count_if("above_half").over(all_), F.count_if("positive").over(all_)
    diagnosis = F.when(above > part * n, "threshold_issue").when(positive > part * n, "label_gap").otherwise("factor_blind")
    return marked.withColumn("diagnosis", diagnosis).withColumn("threshold", F.lit(model.threshold))
