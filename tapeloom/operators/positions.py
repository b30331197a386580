"""Tracked positions in batch: marks by each later price, and a ledger of those that are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUCCESS, LOSS, FAIL = 0.30, -0.10, 0.10


def positions(picks: DataFrame, prices: DataFrame, days: int = 30, now=None) -> DataFrame:
    """``symbol, entry_ts, ts, kind, gain, max_gain, drawdown, bars_held, result``.

    ``picks`` has ``symbol, ts, price`` (the entry), ``prices`` ``symbol, ts,
    price``.  A ``mark`` for each price after the entry up to ``days`` later; a
    ``closed`` row for each position that ends before ``now`` (by default: all).
    Rows of one entry time and symbol are one position, the dearest.
    """
    span = F.expr(f"INTERVAL {days} DAYS")
    entries = picks.where("price > 0").groupBy("symbol", F.col("ts").alias("entry_ts")).agg(F.max("price").alias("entry"))
    p = prices.select("symbol", "ts", "price")
    in_reach = (F.col("ts") > F.col("entry_ts")) & (F.col("ts") <= F.col("entry_ts") + span)
    held = entries.join(p, "symbol").where(in_reach)
    w = Window.partitionBy("symbol", "entry_ts").orderBy("ts", "price").rowsBetween(Window.unboundedPreceding, 0)
    top = held.withColumn("top", F.greatest("entry", F.max("price").over(w)))
    marks = top.select(
        "symbol", "entry_ts", "ts", F.lit("mark").alias("kind"), (F.col("price") / F.col("entry") - 1).alias("gain"), (F.col("top") / F.col("entry") - 1).alias("max_gain"),
        F.least(F.lit(0.0), F.min(F.col("price") / F.col("top") - 1).over(w)).alias("drawdown"), F.count("*").over(w).alias("bars_held"), F.lit(None).cast("string").alias("result"),
    )
    last = marks.groupBy("symbol", "entry_ts").agg(F.max_by("gain", "bars_held").alias("gain"), F.max("max_gain").alias("max_gain"), F.min("drawdown").alias("drawdown"), F.max("bars_held").alias("bars_held"))
    over = entries.join(last, ["symbol", "entry_ts"], "left").fillna(0, ["gain", "max_gain", "drawdown", "bars_held"])
    if now is not None:
        over = over.where(F.col("entry_ts") + span < F.lit(now).cast("timestamp"))
    result = F.when(F.col("max_gain") >= SUCCESS, "success").when(F.col("gain") < LOSS, "loss").when(F.col("max_gain") < FAIL, "fail").otherwise("neutral")
    closed = over.select("symbol", "entry_ts", (F.col("entry_ts") + span).alias("ts"), F.lit("closed").alias("kind"), "gain", "max_gain", "drawdown", "bars_held", result.alias("result"))
    return marks.unionByName(closed)
