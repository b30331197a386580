"""Outcome labels, gains, missed symbols and the diagnosis by hand; nothing is learnt from after the cutoff."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import models, outcome_models

D = [d.date() for d in pd.bdate_range("2001-01-01", periods=400)]


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(1)
    rows = []
    for s in range(30):
        close = 10.0
        for k, day in enumerate(D):
            close *= 1 + (0.02 if s < 6 and 250 <= k < 290 else 0.015 if s in (0, 1, 2) and 120 <= k < 170 else 0.0) + r.normal(0, 0.005)
            rows.append((s, day, float(close)))
    return spark.createDataFrame(rows, "symbol int, trade_date date, close double"), pd.DataFrame(rows, columns=["symbol", "trade_date", "close"])


@pytest.fixture(scope="module")
def trades(spark):
    r = np.random.default_rng(3)
    rows, factors = [], []
    for s in range(30):
        for k in range(0, 380, 7):
            x = r.normal(0, 1, 4)
            rows.append((s, D[k], D[min(k + 10, 399)], float(0.05 * x[0] + r.normal(0, 0.02))))
            factors.append((s, D[k], *map(float, x)))
        factors.append((s, D[251], *map(float, r.normal(0, 1, 4))))
    names = "symbol int, trade_date date, " + ", ".join(f"{c} double" for c in models.FACTORS)
    return spark.createDataFrame(rows, "symbol int, trade_date date, exit_date date, ret double"), spark.createDataFrame(factors, names).dropDuplicates(["symbol", "trade_date"])


def trees(model):
    return model.toDebugString.split("\n", 1)[1]  # without the name of the model


def test_gains_and_missed(spark, bars):
    df, pdf = bars
    wide = pdf.pivot(index="trade_date", columns="symbol", values="close")
    at = D[251]
    gain = wide.iloc[252:292].max() / wide.loc[at] - 1
    picked = spark.createDataFrame([(0, at), (1, D[250])], "symbol int, trade_date date")
    got = {r["symbol"]: r["gain"] for r in outcome_models.missed_gainers(df, picked, at, horizon=40, gain=0.5).collect()}
    want = {s: g for s, g in gain.items() if g >= 0.5 and s != 0}
    assert got.keys() == want.keys() and len(want) == 5 and all(abs(got[s] - want[s]) < 1e-12 for s in want)
    past = wide.loc[:at]
    n = len(past)
    hits = {s: any(past[s].iloc[k + 1 : k + 41].max() / past[s].iloc[k] - 1 >= 0.5 for k in range(n - 160, n - 40)) for s in wide}
    positive = {r["symbol"]: r["positive"] for r in outcome_models.was_positive(df, at, horizon=40, window=160, gain=0.5).collect()}
    assert positive == hits and sum(hits.values()) == 3


def test_labels_are_known_by_the_cutoff(trades):
    t, f = trades
    rows = outcome_models.outcome_rows(t, f)
    pdf = t.toPandas()
    assert rows.count() == len(pdf) and rows.agg(F.sum("label")).first()[0] == (pdf.ret > 0).sum()
    model = outcome_models.fit_outcomes(rows, D[251], rounds=3)
    known = pdf[pdf.exit_date <= D[251]]
    assert (model.n, model.positives) == (len(known), (known.ret > 0).sum()) and 0 < model.threshold < 1
    # later outcomes change nothing
    other = rows.withColumn("label", F.when(F.col("known_at") > F.lit(D[251]), 1 - F.col("label")).otherwise(F.col("label")))
    again = outcome_models.fit_outcomes(other, D[251], rounds=3)
    assert again.threshold == model.threshold and trees(again.model) == trees(model.model)
    later = outcome_models._probability(model.model, outcome_models.features(rows.where(F.col("trade_date") > F.lit(D[251])), model.factors)).select("label", "p").toPandas()
    assert later.p[later.label == 1].mean() > later.p[later.label == 0].mean() + 0.3
    assert outcome_models.fit_outcomes(rows, datetime.date(1990, 1, 1)) is None


def test_exits(spark, trades):
    t, f = trades
    exits = t.limit(200).selectExpr("symbol", "trade_date", "trade_date AS exit_date", "ret", "ret AS later", "exit_date AS known_at")
    rows = outcome_models.outcome_rows(exits, f, good=0.01, kind="exit").collect()
    ret = {(r["symbol"], r["trade_date"]): r["ret"] for r in exits.collect()}
    assert rows and all(r["label"] == float(ret[r["symbol"], r["trade_date"]] < -0.01) for r in rows)


@pytest.mark.parametrize("threshold,gain,want", [(0.0001, 0.5, "threshold_issue"), (1.9, 0.5, "label_gap"), (1.9, 30.0, "factor_blind")])
def test_diagnosis(bars, trades, threshold, gain, want):
    (df, _), (t, f) = bars, trades
    model = outcome_models.fit_outcomes(outcome_models.outcome_rows(t, f), D[251], rounds=3)
    model.threshold = threshold
    missed = outcome_models.missed_gainers(df, t, D[251], horizon=40, gain=0.5)
    got = outcome_models.replay_missed(model, missed, f, df, D[251], horizon=40, window=160, gain=gain).collect()
    assert {r["symbol"] for r in got} == set(range(6)) and {r["diagnosis"] for r in got} == {want}
    assert all(r["main_factor"] in model.factors and r["above_half"] == (r["p"] > threshold / 2) for r in got)


def test_gain_model_learns_nothing_that_reaches_into_its_test_part(spark):
    r = np.random.default_rng(4)
    rows = [(s, d, *map(float, r.normal(0, 1, 4)), float(r.normal(0.2, 1)), 1.0) for s in range(8) for d in D]
    panel = spark.createDataFrame(rows, "symbol int, trade_date date, " + ", ".join(f"{c} double" for c in models.FACTORS) + ", fwd_20 double, weight double")
    model, _ = models.fit_gain(panel, rounds=2)
    month = [d.year * 12 + d.month for d in D]
    cut = np.percentile(month, 80)
    touched = {d for k, d in enumerate(D) if k + 20 >= len(D) or month[k + 20] > cut}
    changed = panel.withColumn("fwd_20", F.when(F.col("trade_date").isin(list(touched)), -F.col("fwd_20")).otherwise(F.col("fwd_20")))
    assert trees(models.fit_gain(changed, rounds=2)[0]) == trees(model)


def test_models_read_stored_tables(spark):
    """A fit goes over its rows many times: they aren't made anew from the trades each time."""
    from tapeloom import catalog  # noqa: F401  registers the queries
    from tapeloom.plans import learned

    sf = "/root/testdata/sf0.001"
    trades, _, bars, _ = learned._outcomes(spark, sf)
    for df, label in ((learned._panel(spark, sf), "panel-"), (trades, "trades-"), (bars, "bars-")):
        assert df.inputFiles() and all(label in f for f in df.inputFiles())
