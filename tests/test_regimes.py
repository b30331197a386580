"""Ordered recurrences, coupling, noise, phase and month regime against NumPy and pandas from the definitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import cross, regimes, windows


def days(n, first="2001-01-01"):
    return pd.bdate_range(first, periods=n).date


@pytest.mark.parametrize("alpha", [2 / 11, 0.5, 0.02])
def test_ema_is_the_recursion(spark, alpha):
    r = np.random.default_rng(4)
    x = r.random(3000)
    got = regimes.ema(spark.createDataFrame(list(zip(days(3000), x.tolist())), "trade_date date, advance double"), alpha=alpha).toPandas().sort_values("trade_date")
    want = [x[0]]
    for v in x[1:]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    assert np.abs(got.ema.to_numpy() - want).max() < 1e-12
    assert np.abs(got.thrust.to_numpy()[1:] - (x[1:] - np.array(want)[:-1])).max() < 1e-12


def smoothed(raw, persist):
    out, pending, n = [raw[0]], None, 0
    for r in raw[1:]:
        if r == out[-1]:
            pending, n = None, 0
        else:
            n = n + 1 if pending == r else 1
            pending = r
        if n >= persist and pending is not None:
            out.append(r)
            pending, n = None, 0
        else:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("persist", [1, 2, 3])
def test_held_label_is_the_fold(spark, persist):
    r = np.random.default_rng(persist)
    raw = [str(x) for x in r.choice(["A", "B", "C"], 400, p=[0.6, 0.25, 0.15])]
    df = spark.createDataFrame(list(enumerate(raw)), "k int, label string")
    from tapeloom.functions.sqlkit import SPARK

    got = spark.sql(regimes.held_label(SPARK, "label", "k", "{rows}", persist), rows=df).orderBy("k").toPandas()
    assert got.lasting.tolist() == smoothed(raw, persist)


@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(7)
    rows, n = [], 90
    common = r.normal(0, 0.01, n)
    for s in range(24):
        close, vol = 20.0, 1000.0
        for k, day in enumerate(days(n, "2001-01-02")):
            close *= 1 + common[k] * (s % 4) / 2 + r.normal(0, 0.02)
            vol = max(10.0, vol * (1 + r.normal(0, 0.2)))
            if r.random() < 0.97:
                rows.append((s, day, float(close), float(vol)))
    bars = spark.createDataFrame(rows, "symbol int, trade_date date, close double, vol double")
    master = spark.createDataFrame([(s, f"i{s % 6}") for s in range(24)] + [(99, "lone")], "symbol int, industry string")
    return bars, master, pd.DataFrame(rows, columns=["symbol", "trade_date", "close", "vol"])


def entropy_of(values, bins=10):
    p = np.histogram(values, bins=bins)[0]
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def test_coupling_by_date(spark, market):
    bars, master, pdf = market
    rets = windows.returns(bars)
    inputs = rets.join(master, "symbol")
    industry_days = cross.industry_days(inputs)
    got = regimes.coupling(regimes.pair_correlations(industry_days, master, n=20, least=3), industry_days, n=20).toPandas().sort_values("trade_date")
    pdf = pdf.assign(r=pdf.sort_values("trade_date").groupby("symbol").close.pct_change(fill_method=None), industry=[f"i{s % 6}" for s in pdf.symbol])
    wide = pdf.dropna().pivot_table(index="trade_date", columns="industry", values="r", aggfunc="mean").sort_index()
    assert len(got) == len(wide)
    for k, c in enumerate(got.coupling):
        if k < 18:  # the first date has no return
            assert c == 0.5
        else:
            corr = np.corrcoef(wide.iloc[max(0, k - 19) : k + 1].to_numpy().T)
            assert math.isclose(c, entropy_of(corr[np.triu_indices(6, 1)]) / math.log(10), abs_tol=1e-9)


def test_noise_cost(spark, market):
    bars, _, pdf = market
    frame, n = 60, 20
    got = regimes.noise_cost(windows.returns(bars), n=n, frame=frame).toPandas().set_index("trade_date").sort_index()
    parts = {}
    for _, own in pdf.sort_values("trade_date").groupby("symbol"):
        own = own.reset_index(drop=True)
        r, lr = own.close.pct_change(fill_method=None), np.log(own.close).diff()
        vol, vc = r.rolling(n).std(), own.vol.pct_change(fill_method=None).abs()
        jump = lr.abs() > 3 * lr.rolling(n).std()
        for k in range(n - 1, len(own)):
            s = slice(max(0, k - frame + 1), k + 1)
            pair = pd.concat([vol, vol.shift()], axis=1)[s].dropna()
            ac = pair.corr().iloc[0, 1] if len(pair) > 10 else 0.0
            extreme = (r[s].abs() > 2 * vol[s].mean()).mean()
            parts.setdefault(own.trade_date[k], []).append((ac, vc[s].mean(), jump[s].mean(), extreme))
    assert set(parts) <= set(got.index)
    for day, own in parts.items():
        ac, vc, jump, extreme = np.mean(own, axis=0)
        want = 0.30 * min(1, max(0, (ac + 1) / 2)) + 0.25 * min(1, 10 * vc) + 0.25 * jump + 0.20 * extreme
        assert math.isclose(got.noise[day], min(1, max(0, want)), abs_tol=1e-9), day


def test_phase_and_gate(spark):
    cases = [("2001-05-20", 0.3, 0.2), ("2001-05-20", 0.5, 0.2), ("2001-05-20", 0.7, 0.7), ("2001-05-20", 0.9, 0.2), ("2001-05-20", 0.9, 0.9), ("2001-05-20", 0.5, 0.5), ("2001-04-20", 0.85, 0.2), ("2001-01-25", 0.54, 0.2), ("2001-10-05", 0.42, 0.2), ("2001-02-10", 0.44, 0.1)]
    rows = [(d, i, c, n) for i, (d, c, n) in enumerate(cases)]
    got = {}
    for d, i, c, n in rows:  # one date at a time
        a = spark.createDataFrame([(d, c)], "trade_date string, coupling double").withColumn("trade_date", F.to_date("trade_date"))
        b = spark.createDataFrame([(d, n)], "trade_date string, noise double").withColumn("trade_date", F.to_date("trade_date"))
        r = regimes.market_phase(a, b).first()
        got[i] = (r["state"], round(r["gate"], 6))
    base = {"compression": 1.0, "transition": 0.7, "expansion": 0.3, "distorted": 0.0, "neutral": 0.5, "abandon": 0.0}
    want = ["compression", "transition", "expansion", "distorted", "abandon", "neutral", "neutral", "compression", "compression", "compression"]
    assert [got[i][0] for i in range(len(cases))] == want
    assert [got[i][1] for i in range(len(cases))] == [round(min(1, base[s] + (1 - c) * 0.1 + (1 - n) * 0.1), 6) for s, (_, c, n) in zip(want, cases)]


def test_month_regime(spark):
    r = np.random.default_rng(11)
    rows, close = [], 100.0
    for k, day in enumerate(days(21 * 90, "1995-01-02")):
        close *= 1 + 0.002 * math.sin(k / 150) + r.normal(0, 0.008)
        rows.append((0, day, float(close), float(r.normal(0, 5))))
    bars = spark.createDataFrame(rows, "symbol int, trade_date date, close double, net_mf double")
    got = regimes.month_regime(regimes.month_rows(bars)).toPandas().sort_values("month_end").reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["s", "day", "close", "mf"]).assign(day=lambda x: pd.to_datetime(x.day)).set_index("day")
    m = pd.DataFrame({"close": pdf.close.resample("ME").last(), "mf": pdf.mf.resample("ME").sum()})
    m["ret"] = m.close.pct_change()

    def hurst(x):
        lags = [k for k in (2, 4, 8, 16) if k < len(x)]
        return np.polyfit(np.log(lags), np.log([np.mean((x[k:] - x[:-k]) ** 2) for k in lags]), 1)[0] / 2

    raw = []
    for k in range(len(m)):
        c = m.close.iloc[k] / m.close.iloc[max(0, k - 11) : k + 1].mean() if k >= 3 else None
        h = min(1, max(0, hurst(m.close.iloc[k - 11 : k + 1].to_numpy()))) if k >= 11 else None
        mf = m.mf.iloc[max(0, k - 11) : k + 1]
        z = (mf.iloc[-1] - mf.mean()) / mf.std(ddof=0) if k >= 3 else 0.0
        es, el = ((entropy_of(m.ret.iloc[k - n + 1 : k + 1].dropna()) if k >= n - 1 else None) for n in (12, 36))
        e = (es - el) / el if es is not None and el else 0.0
        raw.append("BULL" if c and h is not None and c >= 1.02 and h >= 0.55 and z >= -0.25 else "RISK" if c and (c <= 0.98 or z <= -0.75) and e > 0 else "BASE")
    assert got.raw.tolist() == raw and set(raw) >= {"BULL", "BASE"}
    assert got.lasting.tolist() == smoothed(raw, 2)
