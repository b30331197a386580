"""Supervised models on the factor panel with Spark ML, and what goes with them: walk-forward cutoffs, threshold sweep, health."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTORS = ("mom_5", "mom_20", "vs_20", "reversal")


def features(panel: DataFrame, factors=FACTORS) -> DataFrame:
    """Rows with all factors, in one vector column."""
    return VectorAssembler(inputCols=list(factors), outputCol="features").transform(panel.dropna(subset=list(factors)))


def _month(c: str):
    return F.year(c) * 12 + F.month(c)


def _reach(target: str) -> int:
    return int(target.rsplit("_", 1)[1])


def _ahead(n: int):
    return F.lead("trade_date", n).over(Window.partitionBy("symbol").orderBy("trade_date"))


def _known(panel: DataFrame, target: str) -> DataFrame:
    """``panel`` with ``known_at``, the bar that a target ``fwd_N`` reaches to: its column ``known_N``, if it has one."""
    own = f"known_{_reach(target)}"
    return panel.withColumn("known_at", F.col(own) if own in panel.columns else _ahead(_reach(target)))


def fit_return(panel: DataFrame, target: str = "fwd_10", rounds: int = 10, factors=FACTORS):
    """Boosted trees for a forward return, rows weighted by age, the newest sixth of months for early stopping.

    Rows whose target reaches into these months are left out of the rest.
    """
    months = _month("trade_date")
    last = panel.agg(F.max(months), F.min(months)).first()
    cut = last[0] - max(1, (last[0] - last[1]) // 6)
    rows = features(_known(panel, target), factors).withColumn("validation", months > cut).where(F.col("validation") | (_month("known_at") <= cut)).drop("known_at")
    return GBTRegressor(labelCol=target, weightCol="weight", validationIndicatorCol="validation", maxIter=rounds, maxDepth=4, seed=7).fit(rows)


def fit_gain(panel: DataFrame, target: str = "fwd_20", above: float = 0.5, rounds: int = 8, cap: float = 10.0, factors=FACTORS):
    """Boosted trees for a large gain; the rare class weighs more, up to a cap.  Returns the model and its AUC on the newest fifth.

    Rows whose target reaches into the newest fifth aren't learnt from.
    """
    rows = features(_known(panel, target), factors).withColumn("label", (F.col(target) >= above).cast("double"))
    cut = rows.select(F.percentile(_month("trade_date"), 0.8)).first()[0]
    train, test = rows.where(_month("known_at") <= cut), rows.where(_month("trade_date") > cut)
    share = train.agg(F.avg("label")).first()[0] or 0.0
    ratio = min(cap, (1 - share) / share) if share else 1.0
    train = train.withColumn("class_weight", F.when(F.col("label") == 1, ratio).otherwise(1.0) * F.col("weight"))
    model = GBTClassifier(labelCol="label", weightCol="class_weight", maxIter=rounds, maxDepth=4, seed=7).fit(train)
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(model.transform(test)) if test.take(1) else None
    return model, auc


def sweep(scored: DataFrame, steps: int = 49) -> DataFrame:
    """Precision, recall and F1 at each threshold, in one aggregation."""
    marks = scored.select("label", "p", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")).withColumn("threshold", F.col("k") / (steps + 1.0))
    hit = F.col("p") >= F.col("threshold")
    out = marks.groupBy("threshold").agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit).alias("picked"), F.count_if(F.col("label") == 1).alias("positives"))
    return out.withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("picked") + F.col("positives")))


def predict_top(model, panel: DataFrame, top: int = 5, factors=FACTORS) -> DataFrame:
    """Best-scored rows of each date."""
    scored = model.transform(features(panel, factors)).select("symbol", "trade_date", F.col("prediction").alias("score"))
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def walk_forward(panel: DataFrame, cutoffs: list[str], target: str = "fwd_10", rounds: int = 5, reach: int = 10) -> DataFrame:
    """For each cutoff: learn from rows whose target is known by then (``reach`` bars on), predict the dates up to the next.  One model a cutoff.

    Columns ``known_N``, the dates N rows on, are made here where the panel lacks
    them; with them its rows are shuffled for no cutoff.
    """
    out, n = None, _reach(target)
    dates = [f"known_{k}" for k in {reach, n, reach + n}]
    panel = panel.withColumns({c: _ahead(_reach(c)) for c in dates if c not in panel.columns})
    for at, end in zip(cutoffs, [*cutoffs[1:], "9999-12-31"]):
        # of the rows kept the last n of a symbol have no row n on
        own = F.when(F.col(f"known_{reach + n}") <= at, F.col(f"known_{n}"))
        model = fit_return(panel.where(F.col(f"known_{reach}") <= at).withColumn("own", own).drop(*dates).withColumnRenamed("own", f"known_{n}"), target, rounds)
        part = predict_top(model, panel.drop(*dates).where((F.col("trade_date") > at) & (F.col("trade_date") <= end))).withColumn("cutoff", F.lit(at).cast("date"))
        out = part if out is None else out.unionByName(part)
    return out


def health(metrics: DataFrame, least_auc: float = 0.55, least_rows: int = 500) -> DataFrame:
    """Issues and status of models by their metrics (``auc, n``)."""
    issues = F.filter(F.array(F.when(F.col("auc") < least_auc, "auc"), F.when(F.col("n") < least_rows, "rows")), lambda x: x.isNotNull())
    return metrics.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") == 0, "ok").otherwise("check"))
