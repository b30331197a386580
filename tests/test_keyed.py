"""Keyed streams equal their batch forms, cut into batches and out of order, over a restart; state ends."""

import datetime
import random

import pandas as pd
import pytest

from tapeloom.operators import adaptive
from tapeloom.operators.positions import positions
from tapeloom.streaming import keyed

DAY = datetime.datetime(2020, 1, 1)


def on(day):
    return DAY + datetime.timedelta(days=day)


def run(spark, tmp_path, make, schema, batches, name):
    """Feed batches one by one to a stream that is stopped and started anew after each; its rows and the keys left in its state."""
    source, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    spark.createDataFrame([], schema).write.parquet(source)
    left = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        with keyed.keyed_state(spark):
            q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return spark.read.parquet(out), left


def by_definition(rows, hold_scans=3):
    """The states of one symbol's scans, as a loop with a memory."""
    hold, out = None, []
    for scan, accum, broke, collapse, p in rows:
        if p < 0.3 and collapse > 0.5:
            collapse = min(1.0, collapse * 1.3)
        elif p < 0.4:
            accum, broke = accum * 0.7, broke * 0.7
        elif p > 0.6:
            accum, broke = min(1.0, accum * 1.1), min(1.0, broke * 1.1)
        if collapse >= 1:
            hold, state = None, "collapse"
        elif broke > 0.5 and broke >= accum:
            hold, state = scan, "breakout"
        elif hold is not None:
            if scan - hold >= hold_scans:
                hold, state = None, "idle"
            else:
                state = "hold"
        else:
            state = "accumulation" if accum > 0.5 else "idle"
        out.append(state)
    return out


@pytest.fixture(scope="module")
def scans():
    r = random.Random(5)
    rows = []
    for s in range(40):
        for scan in range(1, 41):
            if r.random() < 0.75:  # a symbol may be missing from a scan
                rows.append((s, on(scan * 5), scan, r.choice([0.0, 0.5, 0.75, 1.0]), r.choice([0.0, 0.0, 0.0, 0.25, 0.75, 1.0]), r.choice([0.0, 0.0, 0.25, 0.75, 0.75, 1.0]), r.choice([0.1, 0.35, 0.5, 0.7])))
    return rows


SCAN = "symbol int, ts timestamp, scan_no long, accum_score double, breakout_score double, collapse_score double, up_prob double"


def test_adaptive_states_by_definition(spark, scans):
    scored = spark.createDataFrame(scans, SCAN).withColumnRenamed("ts", "trade_date").selectExpr("*", "0.5e0 AS aq", "0.25e0 AS bq")
    got = adaptive.adaptive_states(scored).toPandas().sort_values(["symbol", "scan_no"])
    frame = pd.DataFrame(scans, columns=[c.split()[0] for c in SCAN.split(", ")]).sort_values(["symbol", "scan_no"])
    want = [x for _, own in frame.groupby("symbol") for x in by_definition(own.iloc[:, 2:].itertuples(index=False))]
    assert got.state.tolist() == want and set(want) == {"idle", "hold", "breakout", "accumulation", "collapse"}
    assert got.confidence.where(got.state != "breakout", 0.35).round(9).isin([0.2, 0.35]).all()


def test_adaptive_stream_equals_batch(spark, scans, tmp_path):
    r = random.Random(2)
    order = sorted(scans, key=lambda x: x[2] + r.random() * 3)  # out of order, within the watermark
    batches = [order[k : k + 500] for k in range(0, len(order), 500)] + [[(-1, on(1000), 1000, 0.0, 0.0, 0.0, 0.5)], [(-1, on(1100), 1100, 0.0, 0.0, 0.0, 0.5)]]
    got, left = run(spark, tmp_path, lambda s: keyed.adaptive_stream(s, late="40 days"), SCAN, batches, "adaptive")
    batch = adaptive.adaptive_states(spark.createDataFrame(scans, SCAN).withColumnRenamed("ts", "trade_date").selectExpr("*", "0e0 AS aq", "0e0 AS bq"))
    rows = lambda df: sorted((r["symbol"], r["scan_no"], r["state"], r["held"]) for r in df.where("symbol >= 0").select("symbol", "scan_no", "state", "held").collect())
    assert rows(got) == rows(batch)
    assert left <= 60  # holds and waiting rows only


PRICE = "symbol int, ts timestamp, kind string, price double"


def test_positions_equal_batch_over_restarts(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for s in range(12):
        price = 10.0
        for day in range(0, 120, 1):
            price *= 1 + r.gauss(0, 0.05)
            rows.append((s, on(day), "price", price))
            if r.random() < 0.08:
                rows.append((s, on(day) + datetime.timedelta(hours=1), "pick", price))
    order = sorted(rows, key=lambda x: x[1] + datetime.timedelta(days=r.random() * 4))
    ends = [[(-1, on(400), "price", 1.0)], [(-1, on(500), "price", 1.0)]]
    batches = [order[k : k + 800] for k in range(0, len(order), 800)] + ends

    def make(stream):
        return keyed.position_stream(stream.where("kind = 'pick'"), stream.where("kind = 'price'"), late="6 days")

    got, left = run(spark, tmp_path, make, PRICE, batches, "positions")
    all_rows = spark.createDataFrame(rows, PRICE)
    want = positions(all_rows.where("kind = 'pick'"), all_rows.where("kind = 'price'")).toPandas()
    key = ["symbol", "entry_ts", "kind", "ts"]
    got = got.toPandas()[want.columns].sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert set(want.result.dropna()) >= {"success", "fail"} and (want.kind == "closed").sum() == sum(x[2] == "pick" for x in rows)
    assert left <= 3  # all positions are over


def test_keys_beside_a_missing_one_are_kept(spark, scans, tmp_path):
    rows = [x for x in scans if x[0] < 6] + [(None, *x[1:]) for x in scans if x[0] == 7] + [(None, on(1000), None, None, None, None, None)]
    got, _ = run(spark, tmp_path, lambda s: keyed.adaptive_stream(s.coalesce(1), late="1 day"), SCAN, [rows], "missing")
    batch = adaptive.adaptive_states(spark.createDataFrame(rows[:-1], SCAN).withColumnRenamed("ts", "trade_date").selectExpr("*", "0e0 AS aq", "0e0 AS bq"))
    plain = lambda df: sorted(map(repr, df.select("symbol", "scan_no", "state", "held").collect()))
    assert plain(got) == plain(batch) and got.where("symbol IS NULL").count() > 0


def test_positions_with_a_missing_price_in_local_time(spark, tmp_path):
    """Over a change of the clock, with times of microseconds, prices at a position's very end and one that is missing."""
    r = random.Random(3)
    start = datetime.datetime(2020, 2, 20)
    at = lambda day, us=0: start + datetime.timedelta(days=day, microseconds=us)
    rows = [(1, at(day, us), "price", None if day == 7 else 10 * (1 + r.random())) for day in range(50) for us in (0, 3, 4)]
    rows += [(1, at(day, 3), "pick", 11.0) for day in (0, 5, 9)] + [(2, at(4), "pick", None), (2, at(5), "pick", 9.0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        make = lambda s: keyed.position_stream(s.where("kind = 'pick'"), s.where("kind = 'price'"), late="60 days")
        ends = [[(-1, at(400 + k), "price", 1.0)] for k in (0, 100)]
        got, _ = run(spark, tmp_path, make, PRICE, [rows[::2], rows[1::2], *ends], "local")
        df = spark.createDataFrame(rows, PRICE)
        want = positions(df.where("kind = 'pick'"), df.where("kind = 'price'"))
        plain = lambda x: sorted(map(repr, x.select(want.columns).collect()))
        assert plain(got.where("symbol > 0")) == plain(want) and want.where("kind = 'closed'").count() == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_state_comes_with_the_rows(spark):
    """No call to the store for each key: its state is a column of the batch."""
    rows = spark.readStream.schema(PRICE).parquet("/root/testdata/sf0.001/nation.parquet")
    scans = spark.readStream.schema(SCAN).parquet("/root/testdata/sf0.001/nation.parquet")
    for stream in (keyed.position_stream(rows, rows), keyed.adaptive_stream(scans)):
        plan = stream._jdf.queryExecution().logical().toString()
        assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan, plan
