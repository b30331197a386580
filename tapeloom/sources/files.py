"""Readers and writers of bar, minute, master and result files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.sources.workdir import remove

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "vol", "amount", "turnover_rate", "net_mf_amount")]
)


def to_date(c):
    """Dates spelled with dashes, slashes or neither; anything else is missing."""
    c = c.cast("string")
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyy/MM/dd"), F.try_to_date(c, "yyyyMMdd"))


def number(c):
    """A finite number or missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _by_header(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """All CSV files below a path as strings, each read with its own header, plus ``_file``; names in lower case.

    A header is a line with a cell ``key``; files without one are left out.  One
    pass over the lines finds each file's header; there is one read for each
    distinct header, whatever the number of files.
    """
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.regexp_replace(c, '[\\ufeff"\\s]', "")))
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), cells.alias("cells"))
    found = lines.where(F.array_contains("cells", key)).groupBy("file").agg(F.first("cells").alias("cells")).groupBy("cells").agg(F.collect_list("file").alias("files"))
    out = None
    for r in sorted(found.collect(), key=lambda r: r["cells"]):
        columns = [c if c and r["cells"].index(c) == k else f"_{k}" for k, c in enumerate(r["cells"])]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        part = spark.read.schema(schema).csv([unquote(f) for f in sorted(r["files"])], header=True)
        part = part.select(*[c for c in columns if not c.startswith("_")], F.col("_metadata.file_path").alias("_file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Daily bars of all symbols, or of some, from CSV files with headers.

    Files may differ in their columns and in the order of these; what a file
    lacks is missing.  A file without a symbol column gives its name.  Rows
    without a readable date are left out, as are files without a date column.
    """
    rows = _by_header(spark, path, "trade_date")
    if rows is None:
        rows = spark.createDataFrame([], "trade_date string, _file string")
    cols = []
    for f in BAR_SCHEMA:
        source = F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string")
        if f.name == "symbol":
            cols.append(F.coalesce(source, F.url_decode(F.regexp_extract("_file", r"([^/]+)\.csv$", 1))).alias("symbol"))
        elif f.name == "trade_date":
            cols.append(to_date(source).alias("trade_date"))
        else:
            cols.append(number(source).alias(f.name))
    out = rows.select(*cols).where(F.col("trade_date").isNotNull())
    return out.where(F.col("symbol").isin(symbols)) if symbols else out


def read_minutes(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Minute bars below symbol folders; ``names`` maps headers to ours.  Files may differ in columns and their order."""
    names = {k.lower(): v for k, v in (names or {}).items()}
    key = next((k for k, v in names.items() if v == "time"), "time")
    rows = _by_header(spark, path, key)
    if rows is None:
        rows = spark.createDataFrame([], "time string, _file string")
    rows = rows.withColumnsRenamed(names)
    nums = [c for c in rows.columns if c not in ("time", "_file")]
    symbol = F.url_decode(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1))
    return rows.select(symbol.alias("symbol"), F.try_to_timestamp(F.col("time")).alias("ts"), *[number(F.col(c)).alias(c) for c in nums]).where("ts IS NOT NULL")


def with_warmup(bars: DataFrame, start: str, n: int) -> DataFrame:
    """Rows from a date on and each symbol's last ``n`` before it, so that windows are full at the date."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    before = bars.where(F.col("trade_date") < start).withColumn("__back", back).where(F.col("__back") <= n).drop("__back")
    return before.unionByName(bars.where(F.col("trade_date") >= start))


def write_results(tables: dict[str, DataFrame], path: str, by: str = "scan_date") -> None:
    """Result tables below a folder, those with a scan date by that.

    A run replaces the dates that it has and leaves others; one that was broken
    off is replaced by the next.  To clear a date without results use
    ``clear_results``.
    """
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if by in df.columns:
            w = w.option("partitionOverwriteMode", "dynamic").partitionBy(by)
        w.parquet(f"{path}/{name}")


def clear_results(spark: SparkSession, names: list[str], path: str, date: str, by: str = "scan_date") -> None:
    """Drop one scan date of result tables."""
    for name in names:
        remove(spark, f"{path}/{name}/{by}={date}")
