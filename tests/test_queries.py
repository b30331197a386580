"""Every query with a DuckDB twin gives the twin's rows on the smallest tables; properties of the others."""

import math

import duckdb
import pandas as pd
import pytest

from tapeloom import catalog
from tapeloom.operators import joins
from tapeloom.plans import graph

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(catalog.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in graph.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return v
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        return float(v) if not isinstance(v, str) else v

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_caps_hold(spark):
    top = graph.run(spark, SF, "k1_k2_capped_top").toPandas()
    assert top.groupby("trade_date").size().max() <= 10
    assert top.groupby(["trade_date", "industry"]).size().max() <= 2


@pytest.mark.parametrize("name", ["stream_r1_append_once", "stream_r2_bars", "stream_r5_latch"])
def test_streams_follow_batch(spark, name):
    got = catalog.queries()[name](spark, SF)
    ticks = graph.frame(spark, SF, "s3_ticks")
    if name == "stream_r2_bars":  # the last intervals stay open until the watermark passes them
        batch = graph.frame(spark, SF, "r2_minute_bars")
        keys = got.select("symbol", got["minute"].cast("timestamp_ntz").alias("minute"), "n_ticks")
        assert keys.exceptAll(batch.select("symbol", "minute", "n_ticks")).count() == 0
        assert batch.count() - got.count() < 0.05 * batch.count()
    else:
        assert got.count() == ticks.count()


def test_appended_ticks_are_whole(spark):
    got = catalog.queries()["stream_r1_marked_append"](spark, SF)
    ticks = graph.frame(spark, SF, "s3_ticks")
    assert got.count() == ticks.select("symbol", "ts").distinct().count() and got.select("event_id").exceptAll(ticks.select("event_id")).count() == 0


def test_positions_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from tapeloom.operators.positions import positions

    got = catalog.queries()["stream_r6_r7_positions"](spark, SF)
    picks = graph.frame(spark, SF, "j12_o1_picks").select("symbol", F.col("entry_date").cast("timestamp").alias("ts"), F.col("entry_price").alias("price")).where("ts IS NOT NULL")
    prices = graph.frame(spark, SF, "b1_daily_bars").select("symbol", F.col("trade_date").cast("timestamp").alias("ts"), F.col("close").alias("price"))
    key = ["symbol", "entry_ts", "kind", "ts"]
    want = positions(picks, prices).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got.toPandas()[want.columns].sort_values(key).reset_index(drop=True), want, check_dtype=False)


def test_merged_picks_are_capped_by_date(spark):
    days = range(1, 9)
    model = spark.sql("SELECT concat('m', id) AS symbol, make_date(2001, 1, d) AS trade_date FROM range(9) CROSS JOIN (SELECT explode(sequence(1, 8)) AS d)")
    leaders = spark.sql("SELECT concat('l', id) AS symbol, make_date(2001, 1, d) AS trade_date FROM range(60) CROSS JOIN (SELECT explode(sequence(1, 8)) AS d)")
    got = joins.merged_picks_by_date(model, leaders).toPandas()
    assert got.groupby(["trade_date", "origin"]).size().tolist() == [41, 9] * len(days)


def test_latent_states_cover_all_years_and_change_by_margin_only(spark):
    frames = {}
    scores = graph.frame(spark, SF, "p6_latent_scores", frames).dropna().toPandas().sort_values(["symbol", "trade_date"])
    got = {(r["symbol"], r["trade_date"]): (r["state"], r["structure"]) for r in graph.frame(spark, SF, "p6_latent_states", frames).collect()}
    assert len(got) == len(scores) and min(d.year for _, d in got) < 2000
    for symbol, own in scores.groupby("symbol"):
        state, switches = None, []
        for r in own.itertuples():
            s = (r.s0, r.s1, r.s2, r.s3)
            new = s.index(max(s))
            if state is not None and new != state and max(s) - s[state] < 0.05:
                new = state
            switches.append(int(state is not None and new != state))
            state = new
            want = max(0, max(s) - 0.25 * sum(switches[-5:]) / len(switches[-5:]))
            assert got[symbol, r.trade_date][0] == state and abs(got[symbol, r.trade_date][1] - want) < 1e-12
