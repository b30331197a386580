"""Append behind each key's high-water mark, once for each batch; and what is still missing of a series of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.sources import workdir


class MarkedAppend:
    """A ``foreachBatch`` sink: rows later than what their key has, each batch once.

    Below ``path``: ``rows/batch=N`` (what batch N added), ``marks/N`` (each key's
    last time after it) and ``done/N``, written in this order.  A batch that is
    done is skipped when it comes again; one that broke off is written anew over
    its own rows.  A batch reads the marks only, one row a key, never the stored
    rows.  Readers see the batches that are done (``read``).

    Of rows with one key and time the first by ``order`` (all columns) stays.
    """

    def __init__(self, path: str, keys: list[str], time_col: str = "ts"):
        self.path, self.keys, self.time_col = path.rstrip("/"), keys, time_col

    def _done(self, spark: SparkSession) -> list[int]:
        return [int(n) for n in workdir.names(spark, f"{self.path}/done") if n.isdigit()]

    def marks(self, spark: SparkSession, done: list[int] | None = None) -> DataFrame | None:
        done = self._done(spark) if done is None else done
        return spark.read.parquet(f"{self.path}/marks/{max(done)}") if done else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._done(spark)
        if batch_id in done or (done and batch_id < max(done)):
            return
        last = self.marks(spark, done)
        place = F.row_number().over(Window.partitionBy(*self.keys, self.time_col).orderBy(*[c for c in batch.columns if c not in (*self.keys, self.time_col)]))
        new = batch.where(F.col(self.time_col).isNotNull()).withColumn("__place", place).where("__place = 1").drop("__place")
        if last is not None:
            new = new.join(last, self.keys, "left").where(F.col("last_time").isNull() | (F.col(self.time_col) > F.col("last_time"))).drop("last_time")
        at = f"{self.path}/rows/batch={batch_id}"
        new.write.mode("overwrite").parquet(at)
        reached = spark.read.schema(new.schema).parquet(at).groupBy(*self.keys).agg(F.max(self.time_col).alias("last_time"))
        if last is not None:
            reached = last.unionByName(reached).groupBy(*self.keys).agg(F.max("last_time").alias("last_time"))
        reached.write.mode("overwrite").parquet(f"{self.path}/marks/{batch_id}")
        workdir.put_mark(spark, f"{self.path}/done/{batch_id}")
        for n in done:  # marks of earlier batches; the newest before this one stays for readers
            if n != max(done):
                workdir.remove(spark, f"{self.path}/marks/{n}")

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of the batches that are done."""
        done = self._done(spark)
        return spark.read.parquet(f"{self.path}/rows").where(F.col("batch").isin(done)).drop("batch")


def missing_stream(expected: DataFrame, closed: DataFrame, late: str = "1 day", keys: tuple[str, ...] = ("symbol",), time_col: str = "minute") -> DataFrame:
    """Expected intervals that no closed one has matched when the watermark passes them: an outer join of two streams.

    Both sides have ``keys`` and ``time_col``; state is dropped with the watermark.
    """
    a = expected.withWatermark(time_col, late).select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col(time_col).alias("e_time"))
    b = closed.withWatermark(time_col, late).select(*keys, time_col).withColumn("there", F.lit(True))
    same = F.col("e_time") == F.col(time_col)
    for k in keys:
        same = same & (F.col(f"e_{k}") == F.col(k))
    out = a.join(b, same, "left_outer").where("there IS NULL")
    return out.select(*[F.col(f"e_{k}").alias(k) for k in keys], F.col("e_time").alias(time_col))


def still_missing(reported: DataFrame, closed: DataFrame, keys: tuple[str, ...] = ("symbol",), time_col: str = "minute") -> DataFrame:
    """Of the intervals reported missing those that no late file has brought since."""
    on = [*keys, time_col]
    return reported.select(on).distinct().join(closed.select(on), on, "left_anti")
