"""Features of one pass over a symbol's rows against the SQL operators, on odd rows and small batches; no sliding frame is left in their plans."""

import io
import math
import re
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import bars as B
from tapeloom.operators import detectors, dual, factors, kernels, rolling, scores, setup
from tapeloom.operators import windows as W
from tapeloom.plans import graph, market  # noqa: F401

SF = "/root/testdata/sf0.001"
FOUR = ("mom_5", "mom_20", "vs_20", "reversal")
SLIDING = re.compile(r"RowFrame, -\d+, currentrow")


@pytest.fixture(scope="module")
def odd(spark):
    """Symbols of 1 to 230 rows with constant stretches, gaps, zero and missing values, one of them without a name."""
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in ((1, 230), (2, 1), (3, 39), (4, 150), (5, 61), (None, 140)):
        days = pd.bdate_range("2001-01-01", periods=n)
        close = np.exp(np.cumsum(rng.normal(0, 0.03, n)) + 3)
        if symbol == 4:
            close[40:110] = 7.25
        for i, day in enumerate(days):
            c = 0.0 if (symbol, i) == (1, 70) else None if (symbol, i) in ((1, 120), (5, 3)) else float(close[i])
            gap = rng.random() < 0.03
            rows.append((symbol, day.date(), c, None if c is None else c * 1.02, None if c is None else c * 0.98, c, 100.0 if symbol == 4 else float(rng.integers(1, 9)), None if gap else float(rng.integers(0, 5) * 1e4), 0.5 if symbol == 4 else float(rng.random()), None if gap else float(rng.normal() * 1e3)))
    schema = "symbol long, trade_date date, open double, high double, low double, close double, vol double, amount double, turnover_rate double, net_mf double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark.createDataFrame(rows, schema).cache()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def same(got, want):
    assert dict(got.dtypes) == dict(want.select(*got.columns).dtypes) and set(got.columns) == set(want.columns)
    a, b = (x.toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) > 0
    for c in a.columns:
        if a[c].dtype == float and c != "symbol":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-8, atol=1e-8, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        graph.frame(spark, SF, name).explain()
    return out.getvalue()


@pytest.mark.parametrize("short, long", [(10, 40), (6, 12)])
def test_physics(odd, short, long):
    rows = B.with_returns(odd.where("coalesce(close, 1) <> 0"))
    same(rolling.physics(rows, short=short, long=long), scores.physics(rows, short=short, long=long))


def test_physics_has_no_sliding_frame(spark):
    for name in ("p1_physics", "p1_physics_week", "p1_physics_month"):
        assert "MapInArrow" in (text := plan(spark, name)) and not SLIDING.search(text), name


def test_setup(odd):
    same(rolling.setup_features(odd), setup.setup_features(odd))
    same(rolling.setup_features(odd, scored=True), setup.setup_frame(setup.setup_features(odd)))


def test_setup_has_no_sliding_frame(spark):
    assert "MapInArrow" in (text := plan(spark, "p5_p7_setup")) and not SLIDING.search(text)


def test_cross_section_ranks_within_dates_only(spark):
    text = plan(spark, "f6_setup_candidates")
    assert not SLIDING.search(text) and not re.search(r"\], \[trade_date#\d+, _w", text)


def flows(bars):
    tiers = [f"{side}_{t}" for side in ("buy", "sell") for t in ("sm", "md", "lg", "elg")]
    return bars.where("coalesce(close, 1) <> 0").selectExpr("*", *(f"abs(hash(symbol, trade_date, '{c}')) % 7 * 100e0 AS {c}" for c in tiers))


def test_detectors(odd):
    bars = flows(odd)
    rets = W.returns(bars)
    pe, long = W.permutation_entropy(rets), W.permutation_entropy(rets, n=60)
    want = detectors.detector_frame(W.volume_ratios(bars), pe, W.irreversibility(rets), W.dominant_eigenvalue(rets), W.coherence(W.structure(rets)), W.tiered_flow(bars), W.entropy_motion(pe, long))
    same(rolling.detector_frame(bars), want)


def test_daily_summary(odd):
    bars = odd.where("coalesce(close, 1) <> 0")
    rets = W.returns(bars)
    want = dual.daily_summary(rets, W.permutation_entropy(rets), W.permutation_entropy(rets, n=60), W.irreversibility(rets), W.dominant_eigenvalue(rets), W.variance_lift(rets))
    same(rolling.daily_summary(bars), want)


@pytest.mark.parametrize("name", ["detector_frame", "p27_daily_entropy"])
def test_no_joins_of_frames_of_the_same_bars(spark, name):
    assert "MapInArrow" in (text := plan(spark, name)) and "Join" not in text and not SLIDING.search(text)


def test_samples_read_their_factors_once(spark):
    from tapeloom.operators import samples
    from tapeloom.plans import learned

    got = learned.sequence_samples(spark, SF)
    text = got._jdf.queryExecution().toString()
    assert "Join" not in text
    factors = graph.frame(spark, SF, "w40_derived_factors")
    dates = factors.selectExpr("symbol", "trade_date", "row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS cal_no")
    want = samples.sequence_samples(factors, dates, n=60)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_recovery(odd):
    same(rolling.recovery(odd), scores.recovery(W.returns(odd)))


def test_plans_go_over_rows_made_once(spark):
    """Recovery features have no sliding frame; plans read them as written, with sectors and timing broadcast."""
    assert "MapInArrow" in (text := plan(spark, "p21_recovery")) and not SLIDING.search(text)
    text = plan(spark, "p22_k2_portfolio")
    assert "lineitem" not in text and "MapInArrow" not in text and "/recovery-" in text
    assert text.count("BroadcastHashJoin") >= 2 and "any_tradable" not in text


def test_entropies_are_added_as_the_text_adds_them():
    """Windows with equal shares may differ in the entropy's last bits, of which p2_resonance takes the sign."""
    rng = np.random.default_rng(1)
    for n in (6, 10, 12, 40):
        v = rng.integers(0, 11, (300, n)).astype(float)
        v[:, 0], v[:, -1] = 0, 10
        want = []
        for row in v:
            total = 0.0
            for k in range(10):
                share = sum(min(int(x), 9) == k for x in row) / n
                total = total + (share * math.log(share) if share else 0.0)
            want.append(-total)
        assert rolling.histogram_entropy(v).tolist() == want


def test_signals_of_equal_entropies(spark):
    """p4_signals_at on a date whose week and month scores hold a difference of equal entropies."""
    import duckdb

    from tapeloom.functions.sqlkit import DUCK

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("lineitem",):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text = graph.duckdb_sql("p2_resonance")
    steps, shown_ = text[: text.rindex(" SELECT ")], "symbol, support_count, round(resonance_score, 6) AS score"
    on = "DATE '1999-11-16'"
    want = con.sql(f"{steps} SELECT {shown_} FROM ({dual.signals_at.sql(DUCK, 'n_p2_resonance', on=on, exact=False)}) x").df().sort_values("symbol")
    got = dual.signals_at(graph.frame(spark, sf, "p2_resonance"), on=on, exact=False).selectExpr(*shown_.split(", ", 2)).toPandas().sort_values("symbol")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


def test_embedding_spectrum(spark, odd):
    """Against the SQL's DuckDB rows, with closes that stand still for longer than the windows; Spark's own text divides by 0 there."""
    import duckdb

    from tapeloom.functions.sqlkit import DUCK

    bars = odd.where("coalesce(close, 1) <> 0").selectExpr("symbol", "trade_date", "CASE WHEN symbol = 4 AND close = 7.25 OR symbol = 2 THEN close WHEN symbol = 4 AND trade_date > DATE '2001-02-01' THEN 7.25e0 ELSE close END AS close")
    con = duckdb.connect()
    con.register("bars", bars.toPandas())
    want = con.sql(f"WITH rets AS ({W.returns.sql(DUCK, 'bars')}) {W.embedding_spectrum.sql(DUCK, 'rets')}").df().sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    got = rolling.embedding_spectrum(bars).toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    assert got.columns.tolist() == want.columns.tolist() and len(got) == len(want) > 200
    assert (got.symbol.astype(str) == want.symbol.astype(str)).all() and (pd.to_datetime(got.trade_date) == pd.to_datetime(want.trade_date)).all()
    np.testing.assert_allclose(got.spectrum, want.spectrum, rtol=1e-8, atol=1e-8)
    assert 10 < got.spectrum.isna().sum() < 100


def test_embedding_spectrum_has_no_sliding_frame(spark):
    assert "MapInArrow" in (text := plan(spark, "w34_embedding_spectrum")) and "Window" not in text and not SLIDING.search(text)


def test_panel(odd):
    rets = W.returns(odd)
    want = factors.panel(W.derived_factors(rets), rets).drop("weight", "mom_60", "vs_60", "synergy")
    same(rolling.panel(odd), want)
    ahead = want.selectExpr("*", *(f"lead(trade_date, {n}) OVER (PARTITION BY symbol ORDER BY trade_date) AS known_{n}" for n in (10, 20)))
    same(rolling.panel(odd, (10, 20), together=True), ahead)


def test_panel_of_models_is_shuffled_once(spark, monkeypatch):
    from tapeloom.plans import learned
    from tapeloom.sources import workdir

    made = []
    monkeypatch.setattr(workdir, "written", lambda df, label: made.append(df) or (df, label))
    got = learned._panel(spark, SF, "fwd_10", 10, 20)
    text = made[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text
    rets = graph.frame(spark, SF, "rets")
    want = factors.panel(W.derived_factors(rets), rets)
    got = got.drop("known_10", "known_20")
    same(got, want.select(*got.columns))


def test_rank_correlations_of_many_windows_at_once(odd):
    """Against pairwise ranks of one window at a time, with ties and missing returns."""
    panel = rolling.panel(odd.selectExpr("symbol", "trade_date", "CASE WHEN symbol = 4 THEN close ELSE floor(close) END AS close"))
    rows = panel.toPandas().sort_values(["symbol", "trade_date"])
    want, gaps = {}, 0
    for symbol, own in rows.groupby("symbol"):
        for f in FOUR:
            part = own[own[f].notna()]
            x, y, ics = part[f].to_numpy(float), part["fwd_5"].to_numpy(float), []
            for end in range(30, len(x) + 1, 4):
                gaps += np.isnan(y[end - 30 : end]).any()
                a, b = (kernels.average_ranks(v[end - 30 : end]) for v in (x, y))
                if a.std() > 0 and b.std() > 0:
                    ics.append(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))
            if len(part):
                want[symbol, f] = (len(ics), np.mean(ics) if ics else None, np.mean(ics) / np.std(ics, ddof=1) if len(ics) > 1 else None)
    long = panel.selectExpr("symbol", "trade_date", "fwd_5", f"stack(4, {', '.join(f"'{f}', {f}" for f in FOUR)}) AS (factor, value)").where("value IS NOT NULL")
    assert gaps and max(n for n, _, _ in want.values()) > 20
    for got in (kernels.panel_rank_ic(panel, FOUR, window=30, step=4), kernels.rolling_rank_ic(long, window=30, step=4)):
        got = {(r["symbol"], r["factor"]): (r["n_windows"], r["mean_ic"], r["ic_ir"]) for r in got.collect()}
        assert got == {k: tuple(v if v is None else pytest.approx(v, abs=1e-9) for v in t) for k, t in want.items()}


def test_rank_correlations_read_the_bars_once(spark):
    from tapeloom.plans import learned

    text = learned.rolling_rank_ic(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "FlatMapGroups" not in text and text.count("FileScan") == 1 and text.count("Exchange") == 2


def test_samples_are_shuffled_once(spark):
    """Trades go to their symbol; bars, factors and windows of samples stay there."""
    from tapeloom.plans import learned

    text = learned.sequence_samples(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Join" not in text
