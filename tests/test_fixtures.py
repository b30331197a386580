"""The deterministic shapes of FIXTURES.md: sell-off and repair, trend with a sine; kernels over Arrow; file readers."""

import datetime as dt
import math

import numpy as np

from tapeloom.operators import kernels, scores
from tapeloom.operators import windows as W
from tapeloom.sources import files

DAY = dt.date(2024, 1, 2)
SCHEMA = "symbol int, trade_date date, open double, high double, low double, close double, vol double, amount double, net_mf double, turnover_rate double"


def bars(spark, closes, flow, amount):
    rows = []
    for i, c in enumerate(closes):
        rows.append((1, DAY + dt.timedelta(days=i), c * 0.998, c * 1.012, c * 0.988, c, 100.0, amount(i), flow(i) * amount(i), 2.0 + 0.1 * math.cos(i / 5) + (0.8 if i > 91 else 0)))
    return spark.createDataFrame(rows, SCHEMA)


def test_selloff_and_repair_is_a_candidate(spark):
    closes, c = [], 10.0
    for i in range(100):
        c *= 1.001 if i <= 71 else 0.982 if i <= 91 else 1.011
        closes.append(c)
    df = bars(spark, closes, lambda i: 0.08 if i > 91 else -0.03, lambda i: (1e6 + 5e4 * math.sin(i / 4)) * (1.5 if i > 91 else 1))
    last = scores.recovery(W.returns(df)).orderBy("trade_date").collect()[-1]
    assert all(last[x] is not None and 0 <= last[x] <= 1 for x in ("damage", "repair", "entry_window", "flow_support", "stability", "overheat"))
    assert last["repair_flag"] and last["candidate"]


def test_trend_with_sine_has_expansion_and_exhaustion(spark):
    df = bars(spark, [10 + 0.05 * i + 0.3 * math.sin(i / 6) for i in range(220)], lambda i: 0.01, lambda i: 1e6)
    last = scores.expansion(W.returns(df)).orderBy("trade_date").collect()[-1]
    assert last["expansion"] is not None and last["exhaustion"] is not None


def test_spectrum_entropy(spark):
    r = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(20):
        a = r.random((30, 4))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        rho = a.T @ a / 30
        e = np.linalg.eigvalsh(rho)
        want[k] = float(-(e * np.log(e)).sum())
        rows.append((k, DAY, *[float(rho[i, j]) for i in range(4) for j in range(i, 4)]))
    df = spark.createDataFrame(rows, "symbol int, trade_date date, " + ", ".join(f"{n} double" for n in kernels.ENTRIES))
    got = {x["symbol"]: x["spectrum_entropy"] for x in kernels.von_neumann(df).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rolling_rank_ic(spark):
    n = 70
    rows = [(1, "up", DAY + dt.timedelta(days=i), float(i % 9), float(i % 9) * 2, 0) for i in range(n)] + [(1, "flat", DAY + dt.timedelta(days=i), 1.0, float(i), 0) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol long, factor string, trade_date date, value double, fwd_5 double, x int")
    got = {r["factor"]: r for r in kernels.rolling_rank_ic(df).collect()}
    assert abs(got["up"]["mean_ic"] - 1) < 1e-9 and got["up"]["n_windows"] == 3
    assert got["flat"]["n_windows"] == 0 and got["flat"]["mean_ic"] is None
    assert kernels.average_ranks(np.array([3.0, 1.0, 3.0])).tolist() == [2.5, 1.0, 2.5]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "sh600000.csv").write_text("trade_date,open,close,amount\n20240102,1,2,x\n2024/01/03,nan,3,5\nbad,1,1,1\n")
    got = files.read_bars(spark, str(tmp_path / "a")).orderBy("trade_date").collect()
    assert [(r["symbol"], str(r["trade_date"]), r["open"], r["close"], r["amount"], r["high"]) for r in got] == [("sh600000", "2024-01-02", 1.0, 2.0, None, None), ("sh600000", "2024-01-03", None, 3.0, 5.0, None)]
    (tmp_path / "m" / "sz000001").mkdir(parents=True)
    (tmp_path / "m" / "sz000001" / "2024-01-02.csv").write_text("t,p\n2024-01-02 09:31:00,1.5\n,2\n")
    rows = files.read_minutes(spark, str(tmp_path / "m"), {"t": "time", "p": "close"}).collect()
    assert [(r["symbol"], r["close"]) for r in rows] == [("sz000001", 1.5)]
    warm = files.with_warmup(spark.createDataFrame([(1, d) for d in "abcdef"], "symbol int, trade_date string"), "d", 2)
    assert sorted(r["trade_date"] for r in warm.collect()) == list("bcdef")
    files.write_results({"picks": spark.createDataFrame([(1, "d1")], "symbol int, scan_date string")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "picks")).count() == 1
