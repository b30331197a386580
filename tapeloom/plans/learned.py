"""Queries that fit models, keep tables or run streams; ``SQL_OF`` names the query whose twin some share."""

from __future__ import annotations

import functools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.sqlkit import shown
from tapeloom.operators import kernels, models, outcome_models, rolling, samples
from tapeloom.operators import windows as W
from tapeloom.plans import graph
from tapeloom.sources import feature_table as refreshed
from tapeloom.sources import workdir
from tapeloom.sources.workdir import fresh_path
from tapeloom.streaming import keyed
from tapeloom.streaming import market as stream
from tapeloom.streaming.marked_append import MarkedAppend, missing_stream, still_missing


def _bars(spark, sf_dir):
    """Daily bars of trades that are shuffled once, by symbol: what goes over a symbol's rows needs no shuffle of its own."""
    trades = graph.frame(spark, sf_dir, "lineitem").where("l_quantity > 0 AND l_shipdate IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    return graph.frame(spark, sf_dir, "b1_daily_bars", {"lineitem": trades.repartition("l_suppkey")})


def _panel(spark, sf_dir, target="fwd_10", *reaches):
    """The panel with what models of a target read, written once: a fit goes over it many times."""
    rows = rolling.panel(_bars(spark, sf_dir), reaches, together=True)
    rows, _ = workdir.written(rows.select("symbol", "trade_date", *models.FACTORS, target, *(f"known_{n}" for n in reaches)), "panel")
    month = F.year("trade_date") * 12 + F.month("trade_date")
    newest = rows.agg(F.max(month)).first()[0]
    return rows.withColumn("weight", F.exp(F.lit(-0.001) * (F.lit(newest) - month)))


def boosted_return(spark, sf_dir):
    panel = _panel(spark, sf_dir, "fwd_10", 10)
    return models.predict_top(models.fit_return(panel, rounds=5), panel)


def gain_classifier(spark, sf_dir):
    panel = _panel(spark, sf_dir, "fwd_20", 20)
    model, auc = models.fit_gain(panel, rounds=5)
    scored = model.transform(models.features(panel))
    scored = scored.select((F.col("fwd_20") >= 0.5).cast("int").alias("label"), vector_to_array("probability")[1].alias("p"))
    return models.sweep(scored).withColumn("auc", F.lit(auc))


def walk_forward(spark, sf_dir):
    return models.walk_forward(_panel(spark, sf_dir, "fwd_10", 10, 20), ["1998-12-31", "1999-12-31"], rounds=3)


def _through(spark, sf_dir, make):
    """Run a stream over the tick table to its end and read what it wrote."""
    path = fresh_path(spark, "stream")
    graph.frame(spark, sf_dir, "s3_ticks").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    q = make(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_bars(spark, sf_dir):
    return _through(spark, sf_dir, stream.tumbling_bars)


def stream_sliding(spark, sf_dir):
    return _through(spark, sf_dir, stream.sliding_volume)


def stream_append_once(spark, sf_dir):
    return _through(spark, sf_dir, lambda r: stream.append_once(r, ["event_id"]))


def stream_sessions(spark, sf_dir):
    return _through(spark, sf_dir, stream.sessions)


def stream_latch(spark, sf_dir):
    label = F.when(F.col("side") > 0, "up").when(F.col("side") < 0, "down").otherwise("flat")
    return _through(spark, sf_dir, lambda r: stream.latch(r.select("symbol", "ts", label.alias("label"), (F.col("price") > 150).alias("exit_signal"))))


def stream_track(spark, sf_dir):
    return _through(spark, sf_dir, lambda r: stream.track(r.select("symbol", "ts", F.col("price").alias("close"))))


def _keyed(spark, tables, make):
    """Run a keyed stream over tables (``ts`` is a timestamp) and read what it wrote; a last row without a symbol, long after all others, lets the watermark pass these."""
    path = fresh_path(spark, "stream")
    stored = []
    for k, df in enumerate(tables):
        df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/in{k}")
        stored.append(spark.read.parquet(f"{path}/in{k}"))
    ends = [df.agg(F.max("ts").alias("ts")) for df in stored]
    end = functools.reduce(DataFrame.union, ends).agg(F.expr("max(ts) + INTERVAL 400 DAYS").alias("end"))
    streams = []
    for k, df in enumerate(stored):
        rest = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c != "ts" else F.col("end").alias("ts") for c in df.columns]
        end.select(*rest).write.mode("append").parquet(f"{path}/in{k}")
        streams.append(spark.readStream.schema(df.schema).parquet(f"{path}/in{k}"))
    with keyed.keyed_state(spark):
        q = make(*streams).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    last = end.first()[0]
    out = spark.read.parquet(f"{path}/out")
    return out if last is None else out.where((F.col("ts") < F.lit(last)) | F.col("symbol").isNotNull())


def stream_adaptive(spark, sf_dir):
    scored = graph.frame(spark, sf_dir, "adaptive_scores").withColumnRenamed("trade_date", "ts")
    rows = scored.select("symbol", "ts", F.col("scan_no").cast("long").alias("scan_no"), *[F.col(c).cast("double").alias(c) for c in ("accum_score", "breakout_score", "collapse_score", "up_prob")])
    out = _keyed(spark, [rows], keyed.adaptive_stream)
    return out.select("symbol", F.to_date("ts").alias("trade_date"), "scan_no", "state", "held")


def stream_positions(spark, sf_dir):
    """Positions of all picks, marked by the daily closes: marks and ledger; bars are written once."""
    bars, _ = workdir.written(graph.frame(spark, sf_dir, "b1_daily_bars").select("symbol", "trade_date", "open", "close"), "bars")
    made = {"b1_daily_bars": bars}
    picks = graph.frame(spark, sf_dir, "j12_o1_picks", made).select("symbol", F.col("entry_date").alias("ts"), F.col("entry_price").cast("double").alias("price")).where("ts IS NOT NULL")
    prices = bars.select("symbol", F.col("trade_date").alias("ts"), F.col("close").cast("double").alias("price"))
    return _keyed(spark, [picks, prices], keyed.position_stream)


def feature_table(spark, sf_dir):
    """A feature table built up to ten dates before the last and refreshed from the tails of all bars; a full recompute gives the same rows."""
    path = fresh_path(spark, "features")
    bars, _ = workdir.written(graph.frame(spark, sf_dir, "b1_daily_bars"), "bars")
    cut = bars.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(10).agg(F.min("trade_date")).first()[0]

    def features(rows):
        rets = W.returns(rows)
        return W.permutation_entropy(rets).select("symbol", "trade_date", "pe").join(W.irreversibility(rets).select("symbol", "trade_date", "pi"), ["symbol", "trade_date"])

    refreshed.refresh(bars.where(F.col("trade_date") < cut), path, features)
    refreshed.refresh(bars, path, features)
    return refreshed.stored(spark, path).select("symbol", "trade_date", *[F.expr(shown(c, 6)).alias(c) for c in ("pe", "pi")])


def marked_append(spark, sf_dir):
    """Ticks through the append sink in four batches in the order of time, the third one twice; every tick is there once."""
    path = fresh_path(spark, "append")
    ticks = graph.frame(spark, sf_dir, "s3_ticks").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", "volume")
    ticks, _ = workdir.written(ticks, "ticks")
    cuts = [None, *ticks.select(F.percentile(F.unix_timestamp("ts"), [0.25, 0.5, 0.75])).first()[0], None]
    at = F.unix_timestamp("ts")
    for a, z in (*zip(cuts, cuts[1:]), cuts[2:4]):
        part = ticks.where(F.lit(True) if a is None else at > a).where(F.lit(True) if z is None else at <= z)
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    sink = MarkedAppend(f"{path}/out", ["symbol"])
    rows = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return sink.read(spark)


def missing_minutes(spark, sf_dir):
    """Symbol-days without complete minutes, found by a stream join of expected and closed days."""
    path = fresh_path(spark, "missing")
    bars, _ = workdir.written(graph.frame(spark, sf_dir, "r2_minute_bars").select("symbol", "minute", F.to_date("minute").cast("timestamp").alias("day")), "minutes")
    closed = bars.groupBy("symbol", F.col("day").alias("minute")).agg(F.max(F.hour("minute")).alias("hour")).where("hour >= 12").drop("hour")
    days = bars.agg(F.array_sort(F.collect_set("day")).alias("days"))  # one row: the calendar
    expected = bars.select("symbol").distinct().join(F.broadcast(days), F.lit(True)).select("symbol", F.explode("days").alias("minute"))
    last = bars.agg(F.expr("max(day) + INTERVAL 30 DAYS").alias("minute")).select(F.lit(-1).cast(dict(bars.dtypes)["symbol"]).alias("symbol"), "minute")
    expected.union(last).write.parquet(f"{path}/expected")
    closed.union(last).write.parquet(f"{path}/closed")
    e, c = (spark.readStream.schema(closed.schema).parquet(f"{path}/{n}") for n in ("expected", "closed"))
    missing_stream(e, c).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return still_missing(spark.read.schema(closed.schema).parquet(f"{path}/out"), closed).select("symbol", F.to_date("minute").alias("trade_date"))


def _outcomes(spark, sf_dir):
    """Trades, factors, bars and the scan date; bars and trades are written once, as the fit and the replay go over them many times."""
    bars, _ = workdir.written(graph.frame(spark, sf_dir, "b1_daily_bars").select("symbol", "trade_date", "open", "high", "low", "close", "vol", "amount", "net_mf", "turnover_rate"), "bars")
    made = {"b1_daily_bars": bars}
    factors = graph.frame(spark, sf_dir, "w40_derived_factors", made).select("symbol", "trade_date", *models.FACTORS)
    trades, _ = workdir.written(graph.frame(spark, sf_dir, "j12_o1_picks", made), "trades")
    day = bars.agg(F.percentile(F.unix_date(F.to_date("trade_date")), 0.7).alias("d")).select(F.date_from_unix_date(F.col("d").cast("int"))).first()[0]
    scan = bars.where(F.col("trade_date") <= F.lit(day)).agg(F.max("trade_date")).first()[0]
    return trades, factors, bars, scan


def buy_outcome_model(spark, sf_dir):
    """Probability that a pick after the cutoff is a good one, by a model of the picks closed by then."""
    trades, factors, _, scan = _outcomes(spark, sf_dir)
    rows, _ = workdir.written(outcome_models.outcome_rows(trades, factors), "outcomes")
    model = outcome_models.fit_outcomes(rows, scan)
    later = outcome_models.features(rows.where(F.col("trade_date") > F.lit(scan)), model.factors)
    scored = outcome_models._probability(model.model, later)
    return scored.select("symbol", "trade_date", "label", "p", (F.col("p") >= model.threshold).alias("chosen"))


def missed_replay(spark, sf_dir):
    """Gainers after the scan date that weren't picked, through the model of outcomes known by then."""
    trades, factors, bars, scan = _outcomes(spark, sf_dir)
    rows, _ = workdir.written(outcome_models.outcome_rows(trades, factors), "outcomes")
    model = outcome_models.fit_outcomes(rows, scan)
    missed = outcome_models.missed_gainers(bars, trades, scan, horizon=40, gain=1.0)
    return outcome_models.replay_missed(model, missed, factors, bars, scan, horizon=40, window=120, gain=1.0)


def sequence_samples(spark, sf_dir):
    """Windows of 60 rows of all factors; a symbol's own dates are its calendar, as the given symbols trade on few dates in common."""
    factors = graph.frame(spark, sf_dir, "w40_derived_factors", {"b1_daily_bars": _bars(spark, sf_dir)})
    own = factors.withColumn("cal_no", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")))
    return samples.sequence_samples(own.where("symbol IS NOT NULL AND trade_date IS NOT NULL"), None, n=60)


def von_neumann(spark, sf_dir):
    return kernels.von_neumann(graph.frame(spark, sf_dir, "w23_coherence"))


def rolling_rank_ic(spark, sf_dir):
    return kernels.panel_rank_ic(rolling.panel(graph.frame(spark, sf_dir, "b1_daily_bars")), models.FACTORS)


QUERIES = {
    "w24_von_neumann": von_neumann,
    "r4_rolling_rank_ic": rolling_rank_ic,
    "r22_r25_boosted_return": boosted_return,
    "r23_gain_classifier": gain_classifier,
    "r26_walk_forward": walk_forward,
    "r19_samples": sequence_samples,
    "r24_buy_outcomes": buy_outcome_model,
    "o19_missed_replay": missed_replay,
    "stream_r1_append_once": stream_append_once,
    "stream_r2_bars": stream_bars,
    "stream_r3_sliding": stream_sliding,
    "stream_r4_sessions": stream_sessions,
    "stream_r5_latch": stream_latch,
    "stream_r6_r7_track": stream_track,
    "stream_r6_r7_positions": stream_positions,
    "stream_p14_adaptive": stream_adaptive,
    "s23_feature_table": feature_table,
    "stream_r1_marked_append": marked_append,
    "stream_r8_missing_days": missing_minutes,
}

#: Streams and kept tables whose rows are those of a plain query: its name, and the columns in common.
SQL_OF = {
    "s23_feature_table": ("w8_w10_features", "symbol, trade_date, pe, pi"),
    "stream_p14_adaptive": ("p14_adaptive_state", "symbol, trade_date, scan_no, state, held"),
    "stream_r8_missing_days": ("s19_missing_days", "symbol, trade_date"),
}
