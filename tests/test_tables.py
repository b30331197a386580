"""Refreshed feature tables equal a full recompute; appends are done once; missing intervals shrink."""

import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import windows as W
from tapeloom.plans import graph, market  # noqa: F401  the nodes
from tapeloom.sources import feature_table, workdir
from tapeloom.streaming.marked_append import MarkedAppend, missing_stream, still_missing

SF = "/root/testdata/sf0.001"


def features(bars):
    rets = W.returns(bars)
    on = ["symbol", "trade_date"]
    pe = W.permutation_entropy(rets).select(*on, "pe")
    return pe.join(W.irreversibility(rets).select(*on, "pi"), on).join(W.hurst(bars).select(*on, "hurst"), on).join(W.coherence(W.structure(rets)).select(*on, "l1", "purity"), on)


@pytest.fixture(scope="module")
def bars(spark):
    table, _ = workdir.written(graph.frame(spark, SF, "b1_daily_bars").where("symbol < 4"), "bars")
    return table


def test_refresh_equals_recompute(spark, bars, tmp_path):
    path = str(tmp_path / "features")
    days = [r[0] for r in bars.select("trade_date").distinct().orderBy("trade_date").collect()]
    first = bars.where((F.col("trade_date") <= days[-25]) & (F.col("symbol") < 3))
    feature_table.refresh(first, path, features)
    months = lambda: {n: sorted(workdir.names(spark, f"{path}/rows/{n}")) for n in workdir.names(spark, f"{path}/rows") if n.startswith("month")}
    before = months()
    second = bars.where((F.col("trade_date") <= days[-10]) & (F.col("symbol") < 3))
    touched = feature_table.refresh(second, path, features)
    after = months()
    assert {n for n in after if before.get(n) != after[n]} == {f"month={m}" for m in touched} and len(touched) < 0.1 * len(after)
    feature_table.refresh(bars, path, features)  # new days and a new symbol
    assert feature_table.refresh(bars, path, features) == []
    got, want = feature_table.stored(spark, path).toPandas(), features(bars).toPandas()
    key = ["symbol", "trade_date"]
    got, want = (df.sort_values(key).reset_index(drop=True) for df in (got[want.columns], want))
    assert len(got) == len(want) and (got[key] == want[key]).all().all()
    for c in ("pe", "pi", "hurst", "l1", "purity"):
        assert got[c].isna().equals(want[c].isna()) and (got[c] - want[c]).abs().max() < 1e-9


def test_many_new_rows_are_computed_whole(spark, bars, tmp_path):
    last = bars.groupBy("symbol").agg(F.min("trade_date").alias("last_date"))
    read = feature_table.stale_rows(bars, last, 5, 50)
    assert read.where("NOT fresh").count() == 0 and read.count() == bars.count()
    late = bars.groupBy("symbol").agg(F.max("trade_date").alias("last_date"))
    assert feature_table.stale_rows(bars, late, 5, 50).count() == 0


ROW = "symbol string, ts timestamp, price double"


def at(day):
    return datetime.datetime(2024, 1, day)


def test_append_once(spark, tmp_path):
    sink = MarkedAppend(str(tmp_path / "t"), ["symbol"])
    frame = lambda *rows: spark.createDataFrame([(s, at(d), float(p)) for s, d, p in rows], ROW)
    read = lambda: sorted((r["symbol"], r["ts"].day, r["price"]) for r in sink.read(spark).collect())
    sink(frame(("a", 1, 1), ("a", 2, 2), ("b", 5, 3), ("a", 2, 9)), 0)
    first = read()
    assert first == [("a", 1, 1), ("a", 2, 2), ("b", 5, 3)]
    sink(frame(("a", 1, 1), ("a", 2, 2), ("b", 5, 3)), 0)  # replayed
    sink(frame(("a", 2, 7), ("a", 3, 4), ("b", 4, 8)), 1)  # behind the marks, but for one
    assert read() == first[:2] + [("a", 3, 4)] + first[2:]
    # a batch that broke off before it was done is neither read nor lost
    frame(("b", 9, 9)).write.parquet(f"{sink.path}/rows/batch=2")
    assert len(read()) == 4
    sink(frame(("b", 6, 6), ("c", 1, 1)), 2)
    assert read() == [("a", 1, 1), ("a", 2, 2), ("a", 3, 4), ("b", 5, 3), ("b", 6, 6), ("c", 1, 1)]
    assert {r["symbol"]: r["last_time"].day for r in sink.marks(spark).collect()} == {"a": 3, "b": 6, "c": 1}
    assert len(workdir.names(spark, f"{sink.path}/marks")) == 2  # not one for each batch


def test_append_in_a_stream(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    sink = MarkedAppend(str(tmp_path / "t"), ["symbol"])
    spark.createDataFrame([], ROW).write.parquet(source)
    for days in ((1, 2, 2), (2, 3), (1,)):
        spark.createDataFrame([("a", at(d), 1.0) for d in days], ROW).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["ts"].day for r in sink.read(spark).collect()) == [1, 2, 3]


def test_missing_list_shrinks(spark, tmp_path):
    schema = "symbol string, minute timestamp"
    paths = {n: str(tmp_path / n) for n in ("expected", "closed", "out", "check")}
    put = lambda name, rows: spark.createDataFrame([(s, at(d)) for s, d in rows], schema).coalesce(1).write.mode("append").parquet(paths[name])

    def go():
        e, c = (spark.readStream.schema(schema).parquet(paths[n]) for n in ("expected", "closed"))
        missing_stream(e, c).writeStream.format("parquet").option("path", paths["out"]).option("checkpointLocation", paths["check"]).trigger(availableNow=True).start().awaitTermination()
        closed = spark.read.schema(schema).parquet(paths["closed"])
        return sorted((r["symbol"], r["minute"].day) for r in still_missing(spark.read.schema(schema).parquet(paths["out"]), closed).collect())

    put("expected", [(s, d) for s in "ab" for d in range(1, 8)])
    put("closed", [("a", d) for d in (1, 2, 4, 5, 6, 7)] + [("b", d) for d in (1, 2, 3, 7)])
    go()
    put("expected", [("z", 20)])
    put("closed", [("z", 20)])
    assert go() == [("a", 3), ("b", 4), ("b", 5), ("b", 6)]
    put("closed", [("b", 4), ("b", 5)])  # late files
    assert go() == [("a", 3), ("b", 6)]
