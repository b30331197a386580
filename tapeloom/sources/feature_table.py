"""A stored feature table that is refreshed from each symbol's newest rows.

Layout below ``path``: ``rows/month=YYYYMM`` (features by month) and ``marks``
(each symbol's last stored date).  A refresh takes the rows after a symbol's
mark with ``lookback`` rows before them, computes features over these alone,
keeps the new ones, and rewrites the months that they fall into; other months
aren't touched.  A symbol without a mark, or with more than ``most_new`` new
rows, is computed whole.

The new months are written aside first and then put in place by dynamic
partition overwrite, marks last: a refresh that breaks off is simply run again.
One refresh at a time may run on a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.sources import workdir

MONTH = "year(trade_date) * 100 + month(trade_date)"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(f"{path}/rows").drop("month")


def marks(spark: SparkSession, path: str) -> DataFrame | None:
    """``symbol, last_date`` of the stored symbols; None before the first refresh."""
    found = workdir.names(spark, f"{path}/marks")
    return spark.read.parquet(f"{path}/marks/{found[-1]}") if found else None


def stale_rows(bars: DataFrame, last: DataFrame | None, lookback: int, most_new: int) -> DataFrame:
    """The bars that a refresh reads, with ``fresh``: is the row's feature to be stored?"""
    if last is None:
        return bars.withColumn("fresh", F.lit(True))
    marked = bars.join(last.select(F.col("symbol"), "last_date"), "symbol", "left")
    new = F.col("last_date").isNull() | (F.col("trade_date") > F.col("last_date"))
    by = Window.partitionBy("symbol")
    counted = marked.withColumns({"new": new, "n_new": F.count_if(new).over(by), "place": F.row_number().over(by.orderBy(F.desc("trade_date")))})
    whole = F.col("last_date").isNull() | (F.col("n_new") > most_new)
    # from the newest row back: the new ones come first, then as many as the windows need
    needed = (F.col("n_new") > 0) & (whole | (F.col("place") <= F.col("n_new") + lookback))
    return counted.where(needed).withColumn("fresh", whole | F.col("new")).drop("last_date", "new", "n_new", "place")


def refresh(bars: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], lookback: int = 130, most_new: int = 50) -> list[int]:
    """Bring the table at ``path`` up to the bars; returns the months that were rewritten.

    ``compute`` makes features (``symbol, trade_date`` and others, one row a bar)
    from bars; no feature may look further back than ``lookback`` rows.
    """
    spark = bars.sparkSession
    last = marks(spark, path)
    read, read_at = workdir.written(stale_rows(bars, last, lookback, most_new), "stale")
    kept = read.where("fresh").select("symbol", "trade_date")
    new = compute(read.drop("fresh")).join(kept, ["symbol", "trade_date"], "left_semi").withColumn("month", F.expr(MONTH))
    months = sorted(r["month"] for r in kept.select(F.expr(MONTH).alias("month")).distinct().collect())
    if not months:
        workdir.remove(spark, read_at)
        return []
    if workdir.exists(spark, f"{path}/rows"):
        old = spark.read.parquet(f"{path}/rows").where(F.col("month").isin(months)).join(kept, ["symbol", "trade_date"], "left_anti")
        new = old.unionByName(new, allowMissingColumns=True)
    merged, merged_at = workdir.written(new, "merged")
    merged.repartition("month").sortWithinPartitions("month", "symbol", "trade_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/rows")
    reached = kept.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))
    if last is not None:
        reached = last.unionByName(reached).groupBy("symbol").agg(F.max("last_date").alias("last_date"))
    before = workdir.names(spark, f"{path}/marks")
    number = int(before[-1]) + 1 if before else 1
    reached.write.parquet(f"{path}/marks/{number:09d}")
    for name in before:
        workdir.remove(spark, f"{path}/marks/{name}")
    for at in (read_at, merged_at):
        workdir.remove(spark, at)
    return months
