"""Detectors and market trend against pandas written from the definitions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import detectors as D
from tapeloom.operators import models

DAY = dt.date(2024, 1, 1)
COLUMNS = ["vol_impulse", "pe", "pi", "eig", "purity_norm", "decay", "big_10", "big_ratio", "imbalance", "momentum", "accel"]


@pytest.fixture(scope="module")
def features():
    r = np.random.default_rng(4)
    frames = []
    for symbol in "abc":
        n = 120
        calm = np.repeat(r.random(n // 12) < 0.5, 12)
        f = pd.DataFrame({c: r.normal(0, 1, n) for c in COLUMNS})
        f["pe"], f["pi"] = np.where(calm, r.uniform(0.3, 0.7, n), r.uniform(0.6, 1.0, n)), np.where(calm, r.uniform(0.04, 0.4, n), r.uniform(0, 0.05, n))
        f["eig"], f["vol_impulse"], f["purity_norm"] = r.uniform(0.6, 1.1, n), r.uniform(0.1, 4, n), r.uniform(0, 1, n)
        f["imbalance"], f["decay"], f["accel"], f["big_ratio"] = r.uniform(0, 2, n), r.normal(0, 0.03, n), r.normal(0, 0.08, n), r.normal(0, 0.2, n)
        f["big_10"] = np.where(calm, 1.0, -1.0)
        f["streak"] = r.integers(0, 14, n)
        for c in COLUMNS:
            f.loc[r.random(n) < 0.04, c] = np.nan
        f.insert(0, "symbol", symbol)
        f.insert(1, "trade_date", [DAY + dt.timedelta(days=i) for i in range(n)])
        frames.append(f)
    return frames


def expected(f):
    n = lambda c, low, high: f[c].clip(low, high)
    met = (f.pe < 0.65).astype(int) + (f.pi > 0.05) + (f.big_10 > 0) + (f.imbalance > 0.3)
    accumulating = (met >= 3).rolling(5, min_periods=5).sum() >= 5
    quality = (1 - n("pe", 0.3, 1)).fillna(0) * 0.25 + (n("pi", 0, 0.5) / 0.5).fillna(0) * 0.2 + n("purity_norm", 0, 1).fillna(0) * 0.15 + n("streak", 0, 10) / 10 * 0.15
    ratio = f.big_ratio.rolling(5, min_periods=1).mean().clip(-0.1, 0.1) / 0.1
    quality += ((ratio + 1) / 2).fillna(0.5) * 0.1 + (n("imbalance", -1, 2) / 2 + 0.5).clip(0, 1).fillna(0.5) * 0.15
    lately = accumulating.astype(int).rolling(10, min_periods=1).max() > 0
    breakout = lately.astype(int) + (f.eig > 0.85) + (f.vol_impulse > 1.8) + (f.pe < 0.75) + (f.momentum > 0) >= 4
    flow = f.momentum.fillna(0)
    sd = flow.rolling(20, min_periods=5).std().replace(0, np.nan)
    second = ((n("eig", 0.5, 1) - 0.5) / 0.5).fillna(0) * 0.2 + ((n("vol_impulse", 1, 5) - 1) / 4).fillna(0) * 0.2 + (1 - n("pe", 0.3, 1)).fillna(0) * 0.1 + (n("pi", 0, 0.5) / 0.5).fillna(0) * 0.1
    second += (-f.decay.fillna(0)).clip(0, 0.05) / 0.05 * 0.15 + (((f.momentum / sd).clip(-2, 2) + 2) / 4).fillna(0.5) * 0.15 + ((n("big_ratio", -0.3, 0.3) + 0.3) / 0.6).fillna(0.5) * 0.1
    signs, held, entry, peak = [], [], None, np.nan
    for i in range(len(f)):
        if breakout[i] and not (i and breakout[i - 1]):
            entry, peak = i, np.nan
        peak = np.nanmax([peak, f.vol_impulse[i]]) if not (np.isnan(peak) and np.isnan(f.vol_impulse[i])) else np.nan
        tired = entry is not None and f.vol_impulse[i] / peak < 0.3
        signs.append(int(f.pe[i] > 0.9) + int(f.pi[i] < 0.01) + int(f.accel[i] > 0.05) + int(tired) + int(f.purity_norm[i] < 0.3))
        held.append(entry is not None and i - entry > 20)
    collapse = (np.array(signs) >= 3) | np.array(held)
    return pd.DataFrame({"accumulating": accumulating, "quality": quality.clip(0, 1), "breakout": breakout, "breakout_quality": second.clip(0, 1), "signs": signs, "collapse": collapse})


def test_detectors_equal_the_definitions(spark, features):
    rows = pd.concat(features)
    schema = "symbol string, trade_date date, " + ", ".join(f"{c} double" for c in [*COLUMNS, "streak"])
    frame = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in rows[["symbol", "trade_date", *COLUMNS, "streak"]].astype({"streak": float}).itertuples(index=False)], schema)
    got = D.detect_collapse(D.detect_breakout(D.detect_accumulation(frame))).toPandas().sort_values(["symbol", "trade_date"])
    seen = set()
    for symbol, f in zip("abc", features):
        own, want = got[got.symbol == symbol].reset_index(drop=True), expected(f)
        for c in want.columns:
            assert np.allclose(own[c].astype(float), want[c].astype(float), atol=1e-9), c
        seen |= set(own.phase)
    assert seen == {"collapse", "breakout", "accumulation", "idle"}


def test_trend_labels(spark):
    base = dict(n=100, advance=0.5, above_20=0.5, above_60=0.5, new_high=0.05, inflow=0.5, big_sum=0.0, sd_median=0.025, panic=0.0, entropy_median=1.2, ordered=0.45, aligned=0.55, spread=0.05)
    good = dict(base, advance=0.75, above_20=0.75, above_60=0.75, new_high=0.2, inflow=0.75, big_sum=6e5, sd_median=0.01, entropy_median=0.7, ordered=0.8, aligned=0.75, spread=0.01)
    bad = dict(base, advance=0.2, above_20=0.2, above_60=0.2, new_high=0.0, inflow=0.2, big_sum=-6e5, sd_median=0.05, panic=0.08, entropy_median=1.7, ordered=0.1, aligned=0.3, spread=0.09)
    rows = [dict(r, trade_date=DAY + dt.timedelta(days=i)) for i, r in enumerate([base, good, good, bad, dict(bad, panic=0.02)])]
    micro = spark.createDataFrame(pd.DataFrame(rows)).withColumn("trade_date", __import__("pyspark.sql.functions", fromlist=["x"]).col("trade_date").cast("date"))
    dates = [r["trade_date"] for r in rows]
    emas = spark.createDataFrame([(t, 0.7 if i == 1 else 0.5) for i, t in enumerate(dates)], "trade_date date, ema double")
    limits = spark.createDataFrame([(t, 10, 10) for t in dates], "trade_date date, n_up long, n_down long")
    daily = spark.createDataFrame([(t, 1000.0, 2.0) for t in dates], "trade_date date, rzye double, on_rate double")
    got = D.market_trend(micro, emas, limits, daily).orderBy("trade_date").toPandas()
    assert got.trend.tolist() == ["NEUTRAL", "STRONG_UP", "UP", "STRONG_DOWN", "DOWN"]
    # breadth 0.15 * 0.5; volatility 0.5 * 0; all others 0 in the middle of their ranges
    assert abs(got.composite[0] - 0.25 * 0.075) < 1e-9
    assert abs(got.breadth[1] - 1.0) < 1e-9 and abs(got.money[3] + 1.0) < 1e-9


def test_walk_forward_learns_only_from_known_targets(spark, monkeypatch):
    rows = [("a", DAY + dt.timedelta(days=i), float(i)) for i in range(40)]
    panel = spark.createDataFrame(rows, "symbol string, trade_date date, fwd_10 double")
    seen = []
    monkeypatch.setattr(models, "fit_return", lambda p, target, rounds: seen.append(p.agg({"trade_date": "max"}).first()[0]))
    monkeypatch.setattr(models, "predict_top", lambda model, p: p.select("symbol", "trade_date"))
    out = models.walk_forward(panel, ["2024-01-20", "2024-01-30"])
    assert seen == [dt.date(2024, 1, 10), dt.date(2024, 1, 20)] and out.count() == 20


def test_filled_top_and_regime(spark):
    t = [DAY + dt.timedelta(days=i) for i in range(70)]
    scored = spark.createDataFrame([("a", t[0], 0.1, True), ("b", t[0], 0.9, False), ("c", t[0], None, None), ("d", t[0], 0.5, True), ("e", t[1], 0.2, None)], "symbol string, trade_date date, resonance_score double, resonance_state boolean")
    got = {(r["trade_date"], r["place"]): (r["symbol"], r["fallback"]) for r in D.filled_top(scored, total=3).collect()}
    assert got == {(t[0], 1): ("d", False), (t[0], 2): ("a", False), (t[0], 3): ("b", True), (t[1], 1): ("e", True)}
    index = spark.createDataFrame([(x, 1.0) for x in t], "trade_date date, close double")
    months = spark.createDataFrame([(dt.date(2024, 1, 31), 1.0, "BULL"), (dt.date(2024, 2, 29), 1.0, "RISK")], "month_end date, close double, lasting string")
    by = {r["trade_date"]: r["regime"] for r in D.regime_by_date(index, months).collect()}
    assert by[t[0]] == by[dt.date(2024, 2, 15)] == "BULL" and by[dt.date(2024, 3, 1)] == "RISK"


def test_scores_equal_but_for_their_last_bits_are_ties(spark):
    rows = [(3, 0.3, True), (1, 0.1 + 0.2, True), (2, 0.3 - 5e-17, True), (4, 0.4, True), (5, 0.9, False), (6, 0.9 - 2e-16, False), (7, None, None)]
    scored = spark.createDataFrame([(s, DAY, x, r) for s, x, r in rows], "symbol long, trade_date date, resonance_score double, resonance_state boolean")
    got = D.filled_top(scored, total=6).orderBy("place").collect()
    assert [(r["symbol"], r["fallback"]) for r in got] == [(4, False), (1, False), (2, False), (3, False), (5, True), (6, True)]


def test_walk_forward_learns_the_same_rows_from_dates_made_with_the_panel(spark, monkeypatch):
    rows = [(s, DAY + dt.timedelta(days=i * k), float(i)) for s, k, n in (("a", 1, 60), ("b", 2, 33), ("c", 1, 15)) for i in range(n)]
    panel = spark.createDataFrame(rows, "symbol string, trade_date date, fwd_10 double")
    seen = []

    def fit(p, target, rounds):
        assert "Window" not in p._jdf.queryExecution().optimizedPlan().toString() or "known_10" not in given.columns
        known = models._known(p, target).select("symbol", "trade_date", "fwd_10", "known_at")
        seen.append(sorted(map(str, known.collect())))

    monkeypatch.setattr(models, "fit_return", fit)
    monkeypatch.setattr(models, "predict_top", lambda model, p: p.select("symbol", "trade_date"))
    cuts = ["2024-01-20", "2024-02-15"]
    given = panel
    plain = models.walk_forward(given, cuts)
    want, seen = seen, []
    ahead = "lead(trade_date, {0}) OVER (PARTITION BY symbol ORDER BY trade_date) AS known_{0}"
    given = panel.selectExpr("*", *(ahead.format(n) for n in (10, 20))).localCheckpoint()
    assert models.walk_forward(given, cuts).exceptAll(plain).count() == 0 and seen == want and len(want[1]) > 40
    for at, part in zip(cuts, want):  # as two leads, one of the rows that the other has left
        first = panel.selectExpr("*", "lead(trade_date, 10) OVER (PARTITION BY symbol ORDER BY trade_date) AS k").where(f"k <= '{at}'").drop("k")
        assert part == sorted(map(str, first.selectExpr("*", "lead(trade_date, 10) OVER (PARTITION BY symbol ORDER BY trade_date) AS known_at").collect()))
