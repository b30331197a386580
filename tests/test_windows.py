"""Kernels against plain Python written from the formulas, on ordinary and degenerate series."""

import datetime as dt
import math

import numpy as np
import pytest

from tapeloom.operators import windows as W

DAY = dt.date(2024, 1, 1)


def series(kind):
    r = np.random.default_rng(5)
    n = 70
    return {
        "random": 100 + np.cumsum(r.normal(0, 1, n)),
        "sine": 100 + 5 * np.sin(np.arange(n) / 3),
        "constant": np.full(n, 50.0),
        "short": np.array([10.0, 11.0, 9.0]),
        "ties": 20 + (np.arange(n) % 3).astype(float),
    }[kind]


@pytest.fixture(scope="module")
def rets(spark):
    rows = []
    for k, kind in enumerate(("random", "sine", "constant", "short", "ties")):
        for i, c in enumerate(series(kind)):
            rows.append((k, DAY + dt.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), 10.0 + i % 5, 1000.0 + i, float(i % 7 - 3), 0.5 + (i % 4)))
    bars = spark.createDataFrame(rows, "symbol int, trade_date date, open double, high double, low double, close double, vol double, amount double, net_mf double, turnover_rate double")
    return W.returns(bars)


def collected(df, col):
    out = {}
    for r in df.orderBy("symbol", "trade_date").collect():
        out.setdefault(r["symbol"], {})[(r["trade_date"] - DAY).days] = r[col]
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def pe(x):
    counts = {}
    for a, b, c in zip(x, x[1:], x[2:]):
        key = (a > b, a > c, b > c)
        counts[key] = counts.get(key, 0) + 1
    n = sum(counts.values())
    return -sum(v / n * math.log(v / n) for v in counts.values()) / math.log(6)


def kl(x):
    sd = np.std(x)
    s = [2 if v > 0.5 * sd else 0 if v < -0.5 * sd else 1 for v in x]
    c = np.zeros((3, 3))
    for a, b in zip(s, s[1:]):
        c[a, b] += 1
    p = c / c.sum()
    m = (p > 0) & (p.T > 0)
    return max(0.0, float((p[m] * np.log(p[m] / p.T[m])).sum()))


def eig(x):
    x = x - x.mean()
    a = [float(x[: len(x) - k] @ x[k:]) / (len(x) - k) for k in range(3)]
    phi = np.linalg.solve(np.array([[a[0] + 1e-8, a[1]], [a[1], a[0] + 1e-8]]), np.array(a[1:]))
    v = np.linalg.eigvals(np.array([[phi[0], phi[1]], [1, 0]]))
    best = v[np.argmax(abs(v))]
    return float(best.real), float(abs(best))


def test_permutation_entropy(rets):
    got = collected(W.permutation_entropy(rets), "pe")
    lr = np.diff(np.log(series("random")))
    for i in range(20, 70):
        assert close(got[0][i], pe(lr[i - 20 : i]))
    assert all(v is None for v in got[3].values())
    assert abs(got[2][60]) < 1e-12


def test_irreversibility_and_eigenvalue(rets):
    got, ev = collected(W.irreversibility(rets), "pi"), W.dominant_eigenvalue(rets)
    real, size = collected(ev, "eig_real"), collected(ev, "eig_abs")
    for k, kind in ((0, "random"), (1, "sine")):
        lr = np.diff(np.log(series(kind)))
        for i in range(20, 70):
            assert close(got[k][i], kl(lr[i - 20 : i]))
            want = eig(lr[i - 20 : i])
            assert abs(size[k][i] - want[1]) < 1e-6 and abs(abs(real[k][i]) - abs(want[0])) < 1e-6
    assert 2 not in real  # a constant series has no spread
    assert all(v is None or v >= 0 for s in got.values() for v in s.values())


def test_turnover_entropy_is_histogram(rets):
    got = collected(W.turnover_entropy(rets), "te")
    x = np.array([0.5 + i % 4 for i in range(70)])
    for i in (19, 33, 69):
        p = np.histogram(x[i - 19 : i + 1], bins=10)[0] / 20
        p = p[p > 0]
        assert close(got[0][i], float(-(p * np.log(p)).sum() / math.log(10)))


def test_hurst(rets):
    got = collected(W.hurst(rets), "hurst")
    x = series("random")
    for i in (39, 50, 69):
        w = x[i - 39 : i + 1]
        msd = [np.mean((w[k:] - w[:-k]) ** 2) for k in (2, 4, 8, 16)]
        assert abs(got[0][i] - np.polyfit(np.log([2, 4, 8, 16]), np.log(msd), 1)[0] / 2) < 1e-9
    assert got[2][69] == 0.5


def test_structure_is_the_three_kernels_joined(rets):
    keys = ["symbol", "trade_date"]
    want = W.permutation_entropy(rets).join(W.irreversibility(rets), keys).join(W.dominant_eigenvalue(rets), keys).where("pe IS NOT NULL AND pi IS NOT NULL AND eig_abs IS NOT NULL")
    want = {(r["symbol"], r["trade_date"]): (r["pe"], r["pi"], r["eig_abs"]) for r in want.collect()}
    got = {(r["symbol"], r["trade_date"]): (r["pe"], r["pi"], r["eig_abs"]) for r in W.structure(rets).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for k, v in got.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(v, want[k]))


def test_coherence_bounds(rets):
    rows = W.coherence(W.structure(rets)).collect()
    assert rows
    for r in rows:
        assert abs(r["trace"] - 1) < 1e-9 and 0.25 - 1e-9 <= r["purity"] <= 1 + 1e-9 and r["l1"] >= 0


def test_streak(spark):
    flows = [1, 2, -1, 3, 4, 5, 0, 1]
    names = [f"{s}_{t}" for t in ("sm", "md", "lg", "elg") for s in ("buy", "sell")]
    rows = [(1, DAY + dt.timedelta(days=i), *[0.0] * 4, float(max(f, 0)), float(max(-f, 0)), 0.0, 0.0) for i, f in enumerate(flows)]
    df = spark.createDataFrame(rows, "symbol int, trade_date date, " + ", ".join(f"{n} double" for n in names))
    assert list(collected(W.tiered_flow(df), "streak")[1].values()) == [1, 2, 0, 1, 2, 3, 0, 1]
