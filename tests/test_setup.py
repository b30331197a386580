"""Bifurcation setups: features of a symbol, qualities, market and plan against NumPy and pandas from the definitions."""

import math

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import setup

N = 420
DAYS = pd.bdate_range("2001-01-02", periods=N)


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in range(3):
        close = 20.0
        for k, day in enumerate(DAYS):
            close *= 1 + 0.002 * math.sin(k / 20 + s) + r.normal(0, 0.01)
            rows.append((s, day.date(), float(close * 1.01), float(close), float(r.uniform(4e5, 9e5)), float(r.uniform(0.5, 3)), float(r.normal(0, 1e5))))
    pdf = pd.DataFrame(rows, columns=["symbol", "trade_date", "high", "close", "amount", "turnover_rate", "net_mf"])
    return spark.createDataFrame(rows, "symbol int, trade_date date, high double, close double, amount double, turnover_rate double, net_mf double"), pdf


def entropy(x):
    x = np.asarray(x)
    counts = {}
    for k in range(len(x) - 2):
        p = tuple(np.argsort(x[k : k + 3], kind="mergesort"))
        counts[p] = counts.get(p, 0) + 1
    q = np.array(list(counts.values())) / sum(counts.values())
    return float(-(q * np.log(q)).sum() / math.log(6))


def slope(x):
    a, b = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
    return float(a @ b / (a @ a))


def modulus(x):
    c = x - x.mean()
    r, a1, a2 = (float(c[: len(c) - k] @ c[k:]) / (len(c) - k) for k in range(3))
    p = np.linalg.solve(np.array([[r + 1e-8, a1], [a1, r + 1e-8]]), np.array([a1, a2]))
    return float(np.abs(np.linalg.eigvals(np.array([[p[0], p[1]], [1, 0]]))).max())


def one_way(x):
    t = 0.5 * np.std(x)
    s = np.where(x > t, 2, np.where(x < -t, 0, 1))
    n = np.zeros((3, 3))
    np.add.at(n, (s[:-1], s[1:]), 1)
    n /= n.sum()
    m = (n > 0) & (n.T > 0)
    return max(0.0, float((n[m] * np.log(n[m] / n.T[m])).sum()))


def by_hand(own):
    own = own.reset_index(drop=True)
    lc = np.log(own.close)
    day = pd.to_datetime(own.trade_date)
    state = (lc - lc.rolling(20, min_periods=10).mean()) / lc.rolling(20, min_periods=10).std(ddof=0)
    adj = state
    for phase, past, least in ((day.dt.weekday, 12, 3), (pd.Series(np.where(day.dt.day <= 7, 0, np.where(day.dt.day >= 23, 2, 1))), 10, 3), ((day.dt.month - 1) % 3, 18, 4)):
        base = adj.groupby(phase).transform(lambda x, past=past, least=least: x.shift(1).rolling(past, min_periods=least).mean())
        adj = adj - base.fillna(0)
    roll = lambda x, n, f: pd.Series([f(x.to_numpy()[k - n + 1 : k + 1]) if k >= n - 1 and np.isfinite(x.to_numpy()[k - n + 1 : k + 1]).all() else np.nan for k in range(len(x))])
    out = pd.DataFrame({"pe_20": roll(state, 20, entropy), "pe_60": roll(state, 60, entropy), "ar1_state": roll(state, 20, slope), "ar1_adjusted": roll(adj, 20, slope), "eig_abs": roll(adj, 20, modulus), "pi": roll(lc.diff(), 20, one_way)})
    out["gap"] = out.pe_60 - out.pe_20
    out["pct"] = [np.mean((v := out.pe_20.iloc[k - 119 : k + 1].dropna()) <= v.iloc[-1] + 1e-9) if k >= 119 else np.nan for k in range(len(own))]
    out["distortion"] = (out.ar1_state - out.ar1_adjusted).abs()
    out["var_lift"] = state.rolling(10, min_periods=5).var(ddof=0) / state.rolling(20, min_periods=10).var(ddof=0) - 1
    out["skew"] = state.rolling(20, min_periods=10).skew()
    out["accel"] = (out.pe_20.diff(5) / 5).diff()
    high = own.high.shift(1)
    out["breakout_10"], out["breakout_20"] = (own.close / high.rolling(n, min_periods=n // 2).max() - 1 for n in (10, 20))
    am = own.amount.rolling(20, min_periods=10).mean()
    out["volume_impulse"] = own.amount.rolling(5, min_periods=3).mean() / am - 1
    out["flow_impulse"] = own.net_mf.rolling(5, min_periods=3).mean() / own.net_mf.abs().rolling(20, min_periods=10).mean()
    out["mf_z"] = (own.net_mf - own.net_mf.rolling(60, min_periods=20).mean()) / own.net_mf.rolling(60, min_periods=20).std(ddof=0)
    out["energy"] = (0.55 * out.volume_impulse.fillna(0) + 0.45 * out.flow_impulse.fillna(0)).clip(-1, 1)
    ma_20, ma_60 = own.close.rolling(20, min_periods=10).mean(), own.close.rolling(60, min_periods=30).mean()
    out["order_alignment"] = (0.35 * (own.close / ma_20 - 1).fillna(0) + 0.35 * (ma_20 / ma_60 - 1).fillna(0) + 0.30 * out.breakout_10.fillna(0)).clip(-1, 1)
    turn = own.turnover_rate.rolling(20, min_periods=10)
    out["execution_cost"] = (0.45 * lc.diff().rolling(20, min_periods=10).std(ddof=0).fillna(0) / 0.04 + 0.30 * turn.std(ddof=0).fillna(0) - 0.15 * (np.log1p(am) / 14).fillna(0) - 0.10 * turn.mean().fillna(0) / 6).clip(0, 1)
    return out


def test_features(spark, bars):
    df, pdf = bars
    got = setup.setup_features(df).toPandas().sort_values(["symbol", "trade_date"])
    for s, own in pdf.groupby("symbol"):
        want, have = by_hand(own), got[got.symbol == s].reset_index(drop=True)
        for c in want:
            a, b = have[c].iloc[150:].to_numpy(float), want[c].iloc[150:].to_numpy(float)  # past the warm-up
            assert np.allclose(a, b, atol=2e-6 if c == "eig_abs" else 1e-8, equal_nan=True), (c, np.nanmax(np.abs(a - b)))


def sc(x, lo, hi):
    return min(1.0, max(0.0, (x - lo) / (hi - lo)))


def test_qualities_and_latent_scores(spark, bars):
    df, _ = bars
    features = setup.setup_features(df)
    frame = setup.setup_frame(features).toPandas().dropna(subset=["setup_score"])
    latent = setup.latent_scores(features).toPandas().set_index(["symbol", "trade_date"])
    for r in frame.sample(300, random_state=1).itertuples():
        if pd.isna(r.pct):
            continue
        e = 0.50 * (1 - r.pct) + 0.30 * sc(r.gap, 0, 0.10) + 0.20 * sc(0.95 - r.pe_20, 0, 0.40)
        b = 0.06 * sc(r.ar1_state, 0.82, 0.97) + 0.18 * sc(r.ar1_adjusted, 0.80, 0.97) + 0.30 * sc(r.eig_abs, 0.68, 0.99) + 0.24 * sc(r.pi, 0.01, 0.25) + 0.12 * sc(0.22 - r.recovery, 0, 0.22) + 0.10 * sc(r.var_lift, -0.05, 0.20)
        half = lambda x: min(1.0, max(0.0, 0.5 + 0.5 * x))
        t = 0.30 * sc(r.breakout_10, 0, 0.04) + 0.20 * sc(r.breakout_20, 0, 0.06) + 0.18 * sc(r.volume_impulse, 0, 0.30) + 0.14 * sc(r.flow_impulse, -0.10, 0.80) + 0.10 * half(r.energy) + 0.08 * sc(r.accel, -0.01, 0.02)
        score = 0.32 * e + 0.48 * b + 0.20 * t
        assert np.allclose([r.entropy_quality, r.bifurcation_quality, r.trigger_quality, r.setup_score], [e, b, t, score])
        conditions = [
            r.pct <= 0.40 and r.gap >= 0.015, (r.eig_abs >= 0.66 and r.pi >= 0.008) or b >= 0.45, r.ar1_adjusted >= 0.60 or (r.distortion <= 0.12 and r.ar1_state >= 0.55),
            r.breakout_10 >= -0.02 and r.close >= r.ma_20 * 0.985 and r.ma_20 >= r.ma_60 * 0.98 and r.mf_z >= -0.80, score >= 0.44 and e >= 0.62 and b >= 0.20 and 1 - r.execution_cost >= 0.35,
        ]
        assert [r.compressed, r.instable, r.in_phase, r.triggered, r.of_quality, r.setup] == [*conditions, all(conditions)]
        s = latent.loc[(r.symbol, r.trade_date)]
        want = [
            0.45 * (1 - r.pct) + 0.30 * sc(r.gap, 0, 0.10) + 0.15 * sc(-r.breakout_10, -0.03, 0.03) + 0.10 * sc(0.20 - r.distortion, 0, 0.20),
            0.32 * sc(r.eig_abs, 0.68, 0.99) + 0.28 * sc(r.pi, 0.01, 0.25) + 0.20 * sc(r.ar1_adjusted, 0.80, 0.97) + 0.12 * sc(r.distortion, 0.02, 0.15) + 0.08 * sc(r.var_lift, -0.05, 0.20),
            0.30 * sc(r.breakout_10, 0, 0.04) + 0.20 * sc(r.volume_impulse, 0, 0.30) + 0.18 * sc(r.flow_impulse, -0.10, 0.80) + 0.17 * half(r.order_alignment) + 0.15 * sc(r.accel, -0.01, 0.02),
            0.28 * sc(r.breakout_20, 0, 0.07) + 0.22 * half(r.energy) + 0.22 * sc(r.mf_z, -0.20, 1.50) + 0.18 * sc(r.close / r.ma_20 - 1, -0.02, 0.08) + 0.10 * sc(0.25 - r.execution_cost, 0, 0.25),
        ]
        assert np.allclose(s[["s0", "s1", "s2", "s3"]].to_numpy(float), want)


COLUMNS = ["setup_score", "entropy_quality", "bifurcation_quality", "trigger_quality", "pct", "breakout_10", "energy", "eig_abs", "pi", "distortion", "turnover_rate", "skew", "execution_cost", "amount"]


@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(2)
    rows = []
    for k, day in enumerate(DAYS[:80]):
        calm = r.random(4)
        for s in range(20):
            rows.append((s, day.date(), *[float(x) for x in (r.random(), round(r.random(), 1), r.random(), r.random(), r.random() ** (1 + 3 * calm[0]), r.normal(0.01 * calm[1], 0.02 + 0.03 * calm[2]), r.normal(), r.random(), r.random() * 0.1, r.random() * 0.16 * calm[3], r.uniform(0, 16 * calm[2]), r.normal(0, 2 * calm[2]), r.random() ** (1 + 2 * calm[1]), r.uniform(3e5, 2e6))], bool(r.random() < 0.4), bool(r.random() < 0.05)))
    names = ["symbol", "trade_date", *COLUMNS, "setup", "abandon_seed"]
    pdf = pd.DataFrame(rows, columns=names)
    coupling = pd.DataFrame({"trade_date": [d.date() for d in DAYS[:80]], "coupling": r.random(80)})
    master = pd.DataFrame({"symbol": range(20), "name": ["*ST a" if s == 3 else "TEST" for s in range(20)], "industry": [f"i{s % 4}" for s in range(20)]})
    schema = "symbol int, trade_date date, " + ", ".join(f"{c} double" for c in COLUMNS) + ", setup boolean, abandon_seed boolean"
    return spark.createDataFrame(rows, schema), pdf, spark.createDataFrame(coupling), coupling.set_index("trade_date").coupling, spark.createDataFrame(master)


def test_cross_section_and_gates(market):
    df, pdf, coupling, c_by, master = market
    crossed = setup.cross_section(df, coupling)
    got = {(r["symbol"], r["trade_date"]): r for r in crossed.collect()}
    passes = {(r["symbol"], r["trade_date"]): r["passes"] for r in setup.setup_candidates(crossed, master).collect()}
    phases, modes, passed = set(), set(), 0
    for day, own in pdf.groupby("trade_date"):
        low, brk, en = (own.pct <= 0.25).mean(), (own.breakout_10 > 0).mean(), (own.energy > 0).mean()
        bif, dist, coup = ((own.eig_abs >= 0.72) & (own.pi >= 0.01)).mean(), (own.distortion >= 0.08).mean(), c_by[day]
        clip = lambda x, a=0.0, b=1.0: min(b, max(a, x))
        noise = clip(0.28 * own.breakout_10.abs().median() / 0.04 + 0.18 * own.turnover_rate.median() / 6 + 0.16 * own["skew"].abs().median() + 0.18 * own.execution_cost.median() + 0.20 * dist)
        regime = clip(0.22 * low + 0.26 * bif + 0.10 * en + 0.10 * brk + 0.20 * coup + 0.12 * (1 - noise))
        if noise >= 0.82 or (dist >= 0.55 and regime < 0.30):
            phase = "abandon"
        elif low >= 0.22 and brk < 0.12 and coup < 0.55 and dist < 0.45:
            phase = "compression"
        elif regime >= 0.42 and brk >= 0.16 and coup >= 0.55 and dist < 0.40:
            phase = "expansion"
        elif dist >= 0.45:
            phase = "distorted"
        else:
            phase = "transition" if regime >= 0.26 else "neutral"
        phases.add(phase)
        contexts = {}
        for r in own.itertuples():
            penalty = clip(0.65 * r.execution_cost + 0.35 * noise)
            cost = "blocked" if penalty >= 0.78 else "cautious" if penalty >= 0.60 else "normal"
            ab = clip(0.30 * penalty + 0.25 * noise + 0.20 * dist + 0.15 * (1 - r.setup_score) + 0.10 * (1 - coup))
            gone = r.abandon_seed or cost == "blocked" or phase == "abandon" or (penalty >= 0.70 and r.setup_score < 0.62) or (noise >= 0.78 and coup < 0.30) or ab >= 0.74
            context = clip(0.70 * r.setup_score + 0.20 * regime + 0.10 * (1 - penalty) - 0.30 * gone)
            contexts[r.symbol] = context
            if gone:
                plan = ("skip", 0.0, 0)
            elif cost == "cautious" or phase in ("compression", "distorted"):
                plan = ("probe", clip(0.25 + 0.40 * context, 0.25, 0.60), 3)
            elif phase == "transition":
                plan = ("staged", clip(0.35 + 0.45 * context, 0.35, 0.75), 2)
            else:
                plan = ("full", clip(0.45 + 0.55 * context, 0.45, 1.0), 1)
            modes.add(plan[0])
            g = got[r.symbol, day]
            assert np.allclose([g["noise"], g["regime"], g["penalty"], g["abandonment"], g["context"], g["scale"]], [noise, regime, penalty, ab, context, plan[1]])
            assert (g["phase"], g["cost_state"], g["abandoned"], g["mode"], g["entry_days"]) == (phase, cost, bool(gone), plan[0], plan[2])
            ok = r.setup and r.symbol != 3 and r.amount >= 5e5 and r.turnover_rate >= 1 and not gone and not (cost == "cautious" and r.setup_score < 0.62) and not (phase == "distorted" and r.setup_score < 0.45) and regime >= 0.10 and context >= 0.45
            assert passes[r.symbol, day] == ok
            passed += ok
        ranks = own.set_index("symbol").assign(context=pd.Series(contexts))[["setup_score", "entropy_quality", "bifurcation_quality", "trigger_quality", "context"]].rank(pct=True, method="average")
        for s, want in ranks.iterrows():
            assert np.allclose([got[s, day][c] for c in ("score_rank", "entropy_rank", "bifurcation_rank", "trigger_rank", "context_rank")], want.to_numpy())
    assert phases >= {"abandon", "transition", "distorted"} and modes >= {"skip", "probe", "staged"} and passed > 5


def test_lead_lag_entropy(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (60, 4))
    x[1:, 0] += 0.8 * x[:-1, 1]
    logs = spark.createDataFrame([(f"i{j}", DAYS[k].date(), k + 1, float(x[k, j])) for k in range(60) for j in range(4)], "industry string, trade_date date, day_no int, ret double")
    got = {r["trade_date"]: r["coupling"] for r in setup.lead_lag_entropy(logs, n=20).collect()}
    for k in range(25, 60):
        window = x[k - 19 : k + 1]
        strength = []
        for a in range(4):
            own = [np.corrcoef(window[1:, a], window[:-1, b])[0, 1] for b in range(4) if b != a]
            strength.append(sum(max(c, 0) for c in own))
        p = np.array([s for s in strength if s > 0])
        p /= p.sum()
        want = float(-(p * np.log(p)).sum() / np.log(len(p))) if len(p) > 1 else 0.0
        assert math.isclose(got[DAYS[k].date()], want, abs_tol=1e-9)
