"""Dual-entropy scores against plain Python written from the definitions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import dual as E
from tapeloom.operators import factors as R
from tapeloom.plans import scans

DAY = dt.date(2024, 1, 1)


def unit(x):
    return min(1.0, max(0.0, x))


def ramp(x, start, width, missing=0.0):
    return missing if x is None or math.isnan(x) else unit((x - start) / width)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def frame(spark, pdf):
    schema = ", ".join(f"{c} {'string' if c == 'symbol' else 'date' if c.endswith('date') else 'timestamp' if c == 'minute' else 'boolean' if pdf[c].dtype == bool else 'double'}" for c in pdf.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    return spark.createDataFrame([[plain(v) for v in r] for r in pdf.astype(object).values.tolist()], schema)


def result(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def daily(spark):
    r = np.random.default_rng(5)
    parts = []
    for symbol in "ab":
        n = 260
        f = pd.DataFrame({"symbol": symbol, "trade_date": days(n)})
        f["lr"] = r.normal(0, 0.03, n)
        f["close"], f["vol"] = 10 * np.exp(f.lr.cumsum()), r.uniform(1e5, 1e6, n)
        f["pe"] = np.clip(0.8 + 0.1 * np.sin(np.arange(n) / 15) + r.normal(0, 0.03, n), 0, 1)
        f.loc[:20, "pe"] = np.nan
        f["pe_long"], f["pi"], f["eig_real"], f["var_lift"] = r.uniform(0.7, 1, n), r.uniform(0, 0.1, n), r.uniform(-1, 1, n), r.normal(0, 0.3, n)
        f.loc[r.random(n) < 0.05, "pi"] = np.nan
        f.loc[:60, "pe_long"] = np.nan
        parts.append(f)
    return parts


@pytest.fixture(scope="module")
def summary(spark, daily):
    whole = pd.concat(daily)
    one = lambda *cols, **names: frame(spark, whole[["symbol", "trade_date", *cols]].rename(columns=names))
    rets = one("lr", "close", "vol")
    return rets, E.daily_summary(rets, one("pe"), one("pe_long", pe_long="pe"), one("pi"), one("eig_real"), one("var_lift"))


def expected_summary(f):
    out, pct = {}, []
    for t in range(len(f)):
        own = [x for x in f.pe[max(0, t - 119) : t + 1] if not math.isnan(x)]
        pct.append(sum(x < own[-1] for x in own) / len(own) if len(own) >= 40 else math.nan)
    zero = lambda x: 0.0 if math.isnan(x) else x
    for t in range(69, len(f)):
        compressed = pct[t] < 0.40 and f.pe[t] < 0.85
        run = 0
        while compressed and run <= t and pct[t - run] < 0.40:
            run += 1
        out[f.trade_date[t]] = {
            "gap": zero(f.pe_long[t] - f.pe[t]), "pct": 0.5 if math.isnan(pct[t]) else pct[t], "pi": zero(f.pi[t]), "eig": f.eig_real[t], "compressed": compressed, "days": run,
            "pe_move": zero(f.pe[t] - f.pe[t - 5]), "pi_move": zero(f.pi[t] - f.pi[t - 5]), "pct_5": 0.5 if math.isnan(pct[t - 5]) else pct[t - 5], "eig_5": f.eig_real[t - 5], "pi_5": zero(f.pi[t - 5]),
        }
    return out


def test_daily_summary(daily, summary):
    got = result(summary[1], "symbol", "trade_date")
    assert len(got) == 2 * (260 - 69) and sum(r["days"] > 1 for r in got.values()) > 20
    for f in daily:
        for day, want in expected_summary(f).items():
            for name, value in want.items():
                assert got[f.symbol[0], day][name] == pytest.approx(value, abs=1e-9), (day, name)


def test_bifurcation(daily, summary):
    got = result(E.bifurcation(summary[1], summary[0]), "symbol", "trade_date")
    seen = set()
    for f in daily:
        for t, (day, s) in enumerate(expected_summary(f).items(), 69):
            mom, accel = f.lr[t - 19 : t + 1].sum(), f.lr[t - 4 : t + 1].sum() - f.lr[t - 9 : t - 4].sum()
            liquidity = f.close[t] * f.vol[t - 19 : t + 1].mean()
            velocity = (abs(s["eig"]) - abs(s["eig_5"])) / 5
            eig = min(1, ramp(abs(s["eig"]), 0.55, 0.45) + (min(0.3, velocity / 0.03) if velocity > 0 else 0))
            gap = 0.6 * ramp(s["gap"], 0, 0.12) + 0.4 * (ramp(0.4 - s["pct"], 0, 0.4) if s["pct"] < 0.4 else 0)
            direction = 0.6 * ramp(s["pi"], 0, 0.05) + 0.4 * ramp(s["pi"] - s["pi_5"], 0, 0.03)
            if mom > 0 and accel < 0:
                momentum = 0.5 * min(1, mom / 0.3) + 0.5 * min(1, -accel / 0.2)
            else:
                momentum = min(0.5, mom / 0.3) if mom > 0 else 0
            total = 0.4 * eig + 0.25 * gap + 0.2 * direction + 0.15 * momentum
            passes = abs(s["eig"]) >= 0.55 and accel <= -0.05 and liquidity >= 3e6 and mom >= -0.08
            r = got[f.symbol[0], day]
            assert (r["passes"], r["total"]) == (passes, pytest.approx(total, abs=1e-9))
            assert r["signal"] == ("skip" if not passes or total < 0.30 else "buy" if total >= 0.45 else "watch")
            seen.add(r["signal"])
    assert seen == {"buy", "watch", "skip"}


def ordinal_entropy(x):
    seen = {}
    for i in range(len(x) - 2):
        key = tuple(np.argsort(x[i : i + 3], kind="mergesort"))
        seen[key] = seen.get(key, 0) + 1
    p = np.array(list(seen.values())) / sum(seen.values())
    return -(p * np.log(p)).sum() / math.log(6)


def test_entropy_curve(spark):
    r = np.random.default_rng(6)
    at = [dt.datetime(2024, 1, 2, 9, 31) + dt.timedelta(minutes=i) for i in range(120)] + [dt.datetime(2024, 1, 2, 13, 1) + dt.timedelta(minutes=i) for i in range(120)]
    close = 10 * np.exp(r.normal(0, 0.001, 240).cumsum())
    bars = pd.DataFrame({"symbol": "a", "trade_date": at[0].date(), "minute": at, "close": close})
    short = bars.head(29).assign(symbol="b")
    got = result(E.entropy_curve(frame(spark, pd.concat([bars, short]))), "symbol")
    assert list(got) == [("a",)]
    lr = np.diff(np.log(close))
    curve = [ordinal_entropy(lr[i : i + 60]) for i in range(len(lr) - 59)]
    want = {"pe": ordinal_entropy(lr), "shift": ordinal_entropy(np.diff(np.log(close[120:]))) - ordinal_entropy(np.diff(np.log(close[:120]))), "trend": np.polyfit(range(len(curve)), curve, 1)[0], "spread": np.std(curve)}
    for name, value in want.items():
        assert got["a",][name] == pytest.approx(value, abs=1e-9), name


SESSION = ["entropy", "hhi", "active_ratio", "range_ratio", "pi", "pe", "shift", "trend", "entropy_drop", "pi_drop", "hhi_drop", "d_pe", "d_pct", "d_pct_5", "d_gap", "d_days", "d_eig", "d_lift", "d_pe_move", "d_pi_move"]


@pytest.fixture(scope="module")
def sessions():
    r = np.random.default_rng(7)
    n = 400
    low = [0.7, 0, 0.5, 0, 0, 0.8, -0.1, -0.002, -0.1, -0.03, -0.02, 0.6, 0, 0, -0.05, 0, -1, -0.5, -0.1, -0.1]
    high = [1, 0.05, 1, 0.08, 0.1, 1, 0.1, 0.002, 0.1, 0.03, 0.02, 1, 1, 1, 0.1, 14, 1, 0.5, 0.1, 0.1]
    f = pd.DataFrame(r.uniform(low, high, (n, len(SESSION))), columns=SESSION)
    good = r.random(n) < 0.4
    f.loc[good, "d_pct"] *= 0.3
    f.loc[good, "d_pe"] = 0.7
    for c in ("entropy", "hhi", "active_ratio", "range_ratio", "pi", "pe", "shift", "d_pe"):
        f.loc[r.random(n) < 0.04, c] = np.nan
    f.insert(0, "symbol", [f"s{i}" for i in range(n)])
    f.insert(1, "trade_date", DAY)
    return f


def test_buy_signal(spark, sessions):
    got = result(E.buy_signal(frame(spark, sessions)), "symbol")
    seen = set()
    for x in sessions.itertuples():
        s1 = 0.35 * max(0, 1 - x.d_pct / 0.5) + 0.25 * ramp(0.95 - x.d_pe, 0, 0.25) + 0.2 * ramp(x.d_gap, 0, 0.05) + 0.2 * min(1, x.d_days / 10)
        s2 = 0.3 * ramp(0.95 - x.entropy, 0, 0.15) + 0.35 * ramp(x.entropy_drop, 0, 0.08) + 0.35 * ramp(x.hhi, 0.004, 0.03)
        s3 = 0.4 * ramp(x.pi, 0, 0.05) + 0.3 * min(1, abs(x.d_eig) / 0.8) + 0.3 * ramp(-x.shift / 0.05 + 0.5, 0, 1, 0.5)
        s4 = 0.25 * ramp(x.active_ratio, 0.5, 0.4) + 0.35 * ramp(0.06 - x.range_ratio, 0, 0.04, 0.5) + 0.4 * unit(x.d_lift * 2 + 0.3)
        total = 0.3 * s1 + 0.3 * s2 + 0.2 * s3 + 0.2 * s4
        passes = not (x.d_pct > 0.4 or x.d_pe > 0.85 or x.active_ratio < 0.7 or x.range_ratio > 0.06)
        r = got[x.symbol,]
        assert (r["passes"], r["total"]) == (passes, pytest.approx(total, abs=1e-9))
        assert r["signal"] == ("skip" if not passes or total < 0.4 else "buy" if total >= 0.55 else "watch")
        seen.add(r["signal"])
    assert seen == {"buy", "watch", "skip"}


def test_sell_signal(spark, sessions):
    got = result(E.sell_signal(frame(spark, sessions)), "symbol")
    seen = set()
    for x in sessions.itertuples():
        parts = {
            "diffusion": 0.4 * ramp(x.d_pe_move, 0, 0.05) + 0.35 * (0.6 * ramp(x.d_pct, 0.5, 0.3) + 0.4 * ramp(x.d_pct - x.d_pct_5, 0, 0.2)) + 0.25 * ramp(0.02 - x.d_gap, 0, 0.04),
            "stealth": 0.3 * ramp(-x.entropy_drop, 0, 0.05) + 0.25 * ramp(x.shift, 0, 0.05) + 0.25 * ramp(x.pi_drop, 0, 0.02) + 0.2 * ramp(x.hhi_drop, 0, 0.01),
            "exhaustion": 0.3 * ramp(x.d_pe, 0.85, 0.1) + 0.25 * ramp(x.pe, 0.9, 0.08) + 0.25 * ramp(-x.d_pi_move, 0, 0.03) + 0.2 * max(0, 1 - abs(x.d_eig) / 0.5),
            "anomaly": 0.4 * ramp(x.range_ratio, 0.02, 0.03) + 0.35 * ramp(x.hhi_drop, 0, 0.008) + 0.25 * ramp(x.trend, 0, 0.001),
        }
        total = 0.3 * parts["diffusion"] + 0.35 * parts["stealth"] + 0.2 * parts["exhaustion"] + 0.15 * parts["anomaly"]
        r = got[x.symbol,]
        assert r["total"] == pytest.approx(total, abs=1e-9) and parts[r["kind"]] == pytest.approx(max(parts.values()), abs=1e-9)
        assert r["signal"] == ("hold" if x.active_ratio < 0.6 or total < 0.35 else "sell" if total >= 0.5 else "warning")
        seen.add(r["signal"])
    assert seen == {"sell", "warning", "hold"}


def test_intraday_frame_takes_the_last_daily_summary(spark, summary):
    at = [DAY + dt.timedelta(days=i) for i in (10, 100, 100 + 260)]
    shares = frame(spark, pd.DataFrame({"symbol": "a", "trade_date": at, "entropy": [0.9, 0.8, 0.6], "hhi": 0.01, "active_ratio": 1.0, "range_ratio": 0.02}))
    whole = frame(spark, pd.DataFrame({"symbol": "a", "trade_date": at[2:], "pi": 0.1}))
    curve = frame(spark, pd.DataFrame({"symbol": "a", "trade_date": at[2:], "pe": 0.9, "shift": 0.1, "trend": 0.0}))
    got = result(E.intraday_frame(shares, whole, curve, summary[1]), "trade_date")
    daily = result(summary[1].where("symbol = 'a'"), "trade_date")
    assert sorted(got) == [(at[1],), (at[2],)]  # no daily summary before the first one
    assert got[at[1],]["d_pct"] == daily[at[1],]["pct"] and got[at[2],]["d_pct"] == daily[max(daily)]["pct"]
    assert got[at[2],]["entropy_drop"] == pytest.approx(0.85 - 0.6) and got[at[1],]["entropy_drop"] == pytest.approx(0.1)


def test_trend_hold_and_signals_at(spark):
    s = frame(spark, pd.DataFrame({"symbol": list("abcd"), "trade_date": DAY, "pct": [0.95, 0.5, 0.5, 0.5], "eig": [0.9, -0.4, 0.1, 0.1], "pi": [0.1, 0.0, 0.0, 0.0]}))
    held = frame(spark, pd.DataFrame({"symbol": list("abcd"), "entry_date": DAY, "trade_date": DAY, "pnl": [0.5, 0.0, 0.3, 0.1]}))
    got = result(E.trend_hold(held, s), "symbol")
    assert [got[c,]["alive"] for c in "abcd"] == [False, True, True, False]
    assert [got[c,]["sell_from"] for c in "abcd"] == [0.5, 0.75, 0.75, 0.5]
    scored = frame(spark, pd.DataFrame({"symbol": list("aab"), "trade_date": [*days(2), DAY], "resonance_state": [True, False, True], "support_count": [1.0, 2.0, np.nan], "score_min": 0.1, "resonance_score": 0.2}))
    assert set(result(E.signals_at(scored, on="DATE '2024-01-02'"), "symbol")) == {("a",)}
    last = result(E.signals_at(scored, on="DATE '2024-01-02'", exact=False), "symbol")
    assert (last["a",]["support_count"], last["b",]["support_count"], last["b",]["resonance_state"]) == (2, 0, True)


def test_dual_entropy_scan(spark, daily):
    r = np.random.default_rng(8)
    bars = pd.concat(daily)[["symbol", "trade_date", "close", "vol"]]
    for c in ("open", "high", "low"):
        bars[c] = bars["close"]
    bars["amount"] = bars["close"] * bars["vol"]
    at = [dt.datetime(2024, 9, 10, 9, 31) + dt.timedelta(minutes=i) for i in range(240)]
    close = 10 * np.exp(r.normal(0, 0.001, 240).cumsum())
    minutes = pd.DataFrame({"symbol": "a", "trade_date": at[0].date(), "minute": at, "open": close, "high": close, "low": close, "close": close, "volume": r.uniform(1, 5, 240)})
    out = scans.dual_entropy_scan(frame(spark, bars), frame(spark, minutes))
    assert [x["symbol"] for x in out["buy"].collect()] == ["a"] and out["sell"].count() == 1
    assert out["bifurcation"].count() == 2 * (260 - 69)


def test_pruned(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "symbol string, buy_sm double, sell_sm double, purity_norm double")
    assert R.pruned(df, names=df.columns).columns == ["symbol", "buy_sm"]
    assert R.pruned(df, names=df.columns, redundant=("buy_sm",)).columns == ["symbol", "sell_sm", "purity_norm"]
