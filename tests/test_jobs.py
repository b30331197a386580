"""User-level jobs run from bars to results."""

import pandas as pd
import pytest


from tapeloom.plans import graph, jobs, market  # noqa: F401  the nodes

SF = "/root/testdata/sf0.001"


def test_jobs(spark):
    made = {}
    get = lambda n: graph.frame(spark, SF, n, made)
    bars, master = get("b1_daily_bars"), get("s8_security_master")
    found = jobs.trend_scan(bars, master, get("s6_margin"), get("s7_interbank_rate")) | jobs.hold_scan(bars, "1999-03-01")
    assert found["trend"].count() == bars.select("trade_date").distinct().where("trade_date > '1995-01-05'").count() or found["trend"].count() > 1000
    assert {r["path_state"] for r in found["states"].collect()} <= {"exit", "rapid", "hold", "observe"}
    scan = jobs.resonance_scan(bars, master)
    assert scan["nav"].where("nav <= 0").count() == 0 and scan["trades"].count() > 0
    top = scan["selected"].groupBy("trade_date").count().agg({"count": "max"}).first()[0]
    assert top <= 10
    assert jobs.recovery_scan(bars, master)["blockers"].count() == 5
    setups = jobs.setup_scan(bars, master, min_amount=1e4, min_turnover=0.1)
    assert setups["actions"].count() > 0 and setups["cross_section"].where("regime IS NULL OR context IS NULL").count() == 0 and setups["selected"].count() >= 0


@pytest.mark.parametrize("name", ["accumulation_scan", "four_layer_scan", "volume_breakout_scan", "factor_scan"])
def test_scans_pick_under_caps_and_follow(spark, name):
    from tapeloom.plans import graph, scans

    sf = "/root/testdata/sf0.001"
    bars, master = graph.frame(spark, sf, "b1_daily_bars"), graph.frame(spark, sf, "s8_security_master")
    got = getattr(scans, name)(bars, master, total=3, each=1)
    selected = got["selected"].toPandas()
    assert selected.groupby("trade_date").size().max() <= 3 if len(selected) else True
    assert not selected.duplicated(["trade_date", "industry"]).any()
    candidates = {(r["symbol"], r["trade_date"]) for r in got["candidates"].collect()}
    picked = set(zip(selected.symbol, selected.trade_date))
    assert picked <= candidates and bool(picked) == bool(candidates)
    trades = {(r["symbol"], r["trade_date"]) for r in got["trades"].collect()}
    assert trades <= picked and got["summary"].agg({"n": "sum"}).first()[0] in (len(trades), None)


def test_training_samples(spark, tmp_path):
    import numpy as np

    from tapeloom.operators import samples, windows
    from tapeloom.plans import scans

    days = [d.date() for d in pd.bdate_range("2001-01-01", periods=200)]
    r = np.random.default_rng(0)
    rows = [(s, d, *[float(v) for v in (10 + s + k / 50 + r.normal(0, 0.1),) * 4], 1e3, 1e4, 1.0, float(r.normal())) for s in range(3) for k, d in enumerate(days) if not (s == 2 and k == 150)]
    bars = spark.createDataFrame(rows, "symbol int, trade_date date, open double, high double, low double, close double, vol double, amount double, turnover_rate double, net_mf double")
    got = scans.training_samples(bars, cutoff="2001-08-01", n=10, horizon=5)
    assert got["stay"].count() > 0 and got["gains"].columns
    factors = windows.derived_factors(windows.returns(bars)).toPandas().sort_values(["symbol", "trade_date"])
    want = {}
    place = {d: k for k, d in enumerate(days)}
    for s, own in factors.groupby("symbol"):
        x, at = own[list(samples.COLUMNS)].to_numpy(float), [place[d] for d in own.trade_date]
        for k in range(9, len(own)):
            if at[k] - at[k - 9] == 9 and np.isfinite(x[k - 9 : k + 1]).all():
                want[s, own.trade_date.iloc[k]] = x[k - 9 : k + 1]
    plain = samples.sequence_samples(windows.derived_factors(windows.returns(bars)), spark.createDataFrame([(d, k) for d, k in place.items()], "trade_date date, cal_no int"), n=10)
    have = {(r["symbol"], r["trade_date"]): np.array(r["x"]) for r in plain.collect()}
    assert have.keys() == want.keys() and len(want) > 100 and all(np.array_equal(have[k], want[k]) for k in want)
    cut = pd.Timestamp("2001-08-01").date()
    for r in got["sequences"].collect():
        assert (r["known_at"] <= cut) if r["split"] == "train" else r["trade_date"] > cut
    samples.write_samples(got["sequences"], str(tmp_path / "s"), rows=50)
    import pyarrow.parquet as pq

    sizes = [pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "s").rglob("*.parquet")]
    assert max(sizes) <= 50 and sum(sizes) == got["sequences"].count()
