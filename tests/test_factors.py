"""Factor research in steps that no task does whole: the panel's weights, exact percentiles."""

import math

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import factors, windows


def test_panel_takes_no_window_over_all_rows(spark):
    rows = [(s, f"20{y:02d}-{m:02d}-15", 10.0 + m + y) for s in ("a", "b", None) for y in range(3) for m in range(1, 13 if s else 12)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date string, close double").selectExpr("symbol", "CAST(trade_date AS DATE) AS trade_date", "close")
    rets = windows.returns(bars)
    few = windows.derived_factors(rets).where("symbol = 'a' AND trade_date < DATE '2001-01-01'")  # the newest month is that of the rows joined
    got = factors.panel(few, rets)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("[symbol" in line for line in plan.splitlines() if "Window [" in line)
    out = {r["trade_date"].month: r["weight"] for r in got.collect()}
    assert out == {m: pytest.approx(math.exp(-0.001 * (12 - m))) for m in range(1, 13)}


def test_quantiles_by_exact_percentiles_of_no_single_task(spark):
    r = np.random.default_rng(3)
    values = {"wide": r.standard_cauchy(1001), "few": r.integers(-2, 3, 500).astype(float), "one": np.full(40, 7.5), "tiny": np.array([-1e-300, 0.0, -0.0, 5e-324, 1e300, -1e-5, 2.0])}
    rows = pd.DataFrame([(f, float(x), k * 0.5) for f, xs in values.items() for k, x in enumerate(xs)], columns=["factor", "value", "fwd_5"])
    df = spark.createDataFrame(rows)
    got = factors.quantile_returns(df)
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for f, own in rows.groupby("factor"):
        edges = sorted(set(np.percentile(own.value, [0, 20, 40, 60, 80, 100]).tolist()))
        for x, y in zip(own.value, own.fwd_5):
            want.setdefault((f, sum(x > e for e in edges if e > edges[0])), []).append(y)
    out = {(x["factor"], x["bucket"]): (x["n"], x["mean_fwd"]) for x in got.collect()}
    assert out == {k: (len(v), pytest.approx(np.mean(v))) for k, v in want.items()}
