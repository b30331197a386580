"""Decline recovery: two industries that fall and recover, and every rule against plain Python over the same rows."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import recovery_plan, scores, windows
from tapeloom.plans import jobs

N = 110
DAYS = pd.bdate_range("2024-01-02", periods=N).date


def unit(x, lo, hi):
    return 0.0 if x is None or pd.isna(x) else min(1.0, max(0.0, (x - lo) / (hi - lo)))


def near(a, b):
    return (a is None or pd.isna(a)) and (b is None or pd.isna(b)) or a == b or math.isclose(a, b, abs_tol=1e-9)


def symbol_bars(name, rebound, flow, boost, shift):
    price, rows = 18.5 + shift, []
    for k, day in enumerate(DAYS):
        price *= 1 + (0.0012 + 0.001 * math.sin((k + shift) / 9) if k < 70 else -0.018 + 0.0012 * math.cos((k + shift) / 3.8) if k < 90 else rebound + 0.001 * math.sin((k + shift) / 4.5))
        open_ = price * (1 - 0.004 * math.cos((k + shift) / 6))
        amount = (7.2e5 + 6.5e4 * math.sin((k + shift) / 4)) * (boost if k >= 90 else 1)
        rows.append((name, day, open_, max(open_, price) * 1.014, min(open_, price) * 0.987, price, 1000.0, amount, 1.35 + 0.2 * math.cos((k + shift) / 5.5) + (0.55 if k >= 90 else 0), amount * (flow if k >= 90 else -0.03)))
    return rows


SPECS = [("a1", 0.0110, 0.070, 2.30, 0.10), ("a2", 0.0106, 0.065, 2.10, 0.25), ("a3", 0.0102, 0.062, 2.00, 0.40), ("b1", 0.0055, 0.025, 1.30, 0.15), ("b2", 0.0050, 0.022, 1.25, 0.30), ("b3", 0.0048, 0.020, 1.20, 0.45)]


@pytest.fixture(scope="module")
def market(spark):
    bars = spark.createDataFrame([r for s in SPECS for r in symbol_bars(*s)], "symbol string, trade_date date, open double, high double, low double, close double, vol double, amount double, turnover_rate double, net_mf double")
    master = spark.createDataFrame([(s[0], f"name {s[0]}", "chips" if s[0] < "b" else "drugs") for s in SPECS] + [("c1", "*ST old", "drugs")], "symbol string, name string, industry string")
    return bars, master


def test_stronger_sector_is_picked(market):
    bars, master = market
    found = jobs.recovery_scan(bars, master, members=3, top=1, rebound=(0.02, 0.20), hold=5, total=2, each=2)
    day = DAYS[96]
    timing = {r["trade_date"]: r["timing"] for r in found["market"].collect()}
    assert timing[day] in ("repair_watch", "buy_window") and timing[DAYS[60]] == "no_setup"
    sectors = {r["industry"]: r["place"] for r in found["sectors"].where(f"trade_date = '{day}'").collect()}
    assert sectors == {"chips": 1, "drugs": 2}
    picked = [r for r in found["selected"].collect() if r["trade_date"] in DAYS[94:97]]
    assert picked and {r["industry"] for r in picked} == {"chips"} and all(r["place"] <= 2 for r in picked)
    assert found["trades"].count() > 0 and found["nav"].count() > 0


@pytest.fixture(scope="module")
def rows(spark):
    """Random features, so that every rule's branches are met."""
    r = np.random.default_rng(3)
    out = []
    level = {}
    for day in DAYS[:60]:
        level[day] = r.random(4)
        for s in range(60):
            u = lambda k: float(np.clip(level[day][k] * 0.7 + r.random() * 0.5 - 0.1, 0, 1))
            g = lambda m, sd: None if r.random() < 0.03 else float(r.normal(m, sd))
            down = (level[day][0] - 0.5) * 0.15
            out.append((s, day, f"i{s % 7}", bool(r.random() < 0.9), float(r.uniform(4e5, 2e6)), float(r.uniform(0.8, 3)), g(0.005, 0.02), g(-down / 3, 0.02), g(-down / 2, 0.03), g(-down, 0.05), g(-down, 0.06), g(-0.12 * level[day][0], 0.06), g(-down, 0.05),
                        g(0.01, 0.03), g(1.1, 0.3), float(r.uniform(0, 0.2)), g(0.04, 0.02), u(0), u(1), u(2), u(3), u(1), u(2) ** 3, bool(r.random() < level[day][1]), bool(r.random() < level[day][2] * 0.4), bool(r.random() < 0.1 + 0.4 * (level[day][3] > 0.8)), bool(r.random() < 0.3)))
    names = "symbol int, trade_date date, industry string, tradable boolean, amount double, turnover_rate double, r1 double, ret_3 double, r5 double, ret_10 double, ret_20 double, dd_20 double, to_ma20 double, flow_5 double, amount_ratio double, rebound double, atr double, damage double, repair double, entry_window double, flow_support double, stability double, overheat double, repair_flag boolean, early_flag boolean, overheat_flag boolean, candidate boolean"
    return spark.createDataFrame(out, names), pd.DataFrame(out, columns=[c.split()[0] for c in names.split(", ")])


def hand_market(pdf):
    out = {}
    for day, own in pdf.groupby("trade_date"):
        u = own[own.tradable] if own.tradable.any() else own
        m = {"n": len(u), **{f"eq_{k}": u[c].astype(float).mean() for k, c in ((1, "r1"), (3, "ret_3"), (5, "r5"), (10, "ret_10"), (20, "ret_20"))}}
        f = lambda c: u[c].astype(float)
        m |= {"below_share": (f("to_ma20") < 0).mean(), "down_share": ((u.damage >= 0.32) | (f("ret_10") <= -0.06)).mean(), "deep_share": (f("dd_20") <= -0.12).mean(), "repair_share": u.repair_flag.mean(), "early_share": u.early_flag.mean(), "flow_share": (f("flow_5") > 0).mean(), "amount_share": (f("amount_ratio") >= 1.05).mean(), "hot_share": u.overheat_flag.mean()}
        m["washout"] = 0.30 * unit(-m["eq_10"], 0.01, 0.08) + 0.25 * unit(m["below_share"], 0.30, 0.85) + 0.25 * unit(m["deep_share"], 0.08, 0.55) + 0.20 * unit(m["down_share"], 0.20, 0.75)
        m["repair"] = 0.25 * unit(m["eq_3"], -0.005, 0.03) + 0.25 * unit(m["repair_share"], 0.20, 0.60) + 0.20 * unit(m["early_share"], 0.03, 0.25) + 0.15 * unit(m["flow_share"], 0.40, 0.70) + 0.15 * unit(m["amount_share"], 0.20, 0.55)
        m["overheat"] = 0.60 * unit(m["hot_share"], 0.10, 0.35) + 0.40 * unit(m["eq_5"], 0.02, 0.08)
        out[day] = m
    days = sorted(out)
    for k, day in enumerate(days):
        m = out[day]
        peak = max(out[x]["washout"] for x in days[max(0, k - 5) : k + 1])
        score = min(1, max(0, 0.55 * peak + 0.45 * m["repair"] - 0.35 * m["overheat"]))
        state = "selloff"
        if peak < 0.5:
            state = "no_setup"
        elif m["overheat"] >= 0.58:
            state = "rebound_crowded"
        elif m["repair"] >= 0.44 and m["early_share"] >= 0.03 and score >= 0.5:
            state = "buy_window"
        elif m["repair"] >= 0.30 and m["eq_1"] >= -0.01 and score >= 0.38:
            state = "repair_watch"
        m |= {"washout_peak": peak, "buy_score": score, "timing": state, "can_buy": state in ("buy_window", "repair_watch")}
    return out


def hand_sectors(pdf, market, members, top):
    out = {}
    for day, own in pdf[pdf.tradable].groupby("trade_date"):
        found = []
        for industry, g in own.groupby("industry"):
            if len(g) < members:
                continue
            s = {"industry": industry, "n": len(g), "damage": g.damage.mean(), "repair": g.repair.mean(), "entry": g.candidate.mean(), "flow": g.flow_support.mean(), "overheat": g.overheat.mean(), "ret_5": g.r5.astype(float).mean()}
            s["relative"] = s["ret_5"] - market[day]["eq_5"]
            s["score"] = min(1, max(0, 0.20 * s["damage"] + 0.28 * s["repair"] + 0.17 * s["entry"] + 0.15 * s["flow"] + 0.10 * unit(s["relative"], -0.02, 0.05) + 0.10 * (1 - s["overheat"])))
            s["state"] = "leading_repair" if s["score"] >= 0.62 and s["repair"] >= 0.5 else "watch" if s["score"] >= 0.48 else "lagging"
            found.append(s)
        found.sort(key=lambda s: (-s["score"], -s["relative"], -s["repair"], -s["n"], s["industry"]))
        for k, s in enumerate(found, 1):
            s |= {"place": k, "chosen": k <= top and s["score"] >= 0.48 and s["repair"] >= 0.45}
            out[day, s["industry"]] = s
    return out


def hand_plan(r, s, m, top, lo, hi):
    s = s or {"place": 999, "score": 0.0, "repair": 0.0, "relative": 0.0, "ret_5": 0.0}
    z = lambda x: 0.0 if x is None or pd.isna(x) else x
    relative = z(r.r5) - s["ret_5"]
    score = min(1, max(0, 0.18 * r.damage + 0.24 * r.repair + 0.16 * r.entry_window + 0.14 * r.flow_support + 0.08 * r.stability + 0.12 * s["score"] + 0.08 * unit(relative, -0.04, 0.08) - 0.10 * r.overheat))
    near_top = s["place"] <= max(1, min(3, top))
    strong = near_top and r.repair >= 0.60 and r.entry_window >= 0.55 and r.flow_support >= 0.45 and r.stability >= 0.38 and s["repair"] >= 0.55
    sector_least = 0.40 if strong and s["relative"] >= -0.01 else 0.48
    valid = r.tradable and r.damage >= (0.24 if strong else 0.32) and r.repair >= 0.48 and r.entry_window >= 0.40 and r.flow_support >= 0.35 and lo <= r.rebound <= hi and s["score"] >= sector_least and s["place"] <= top
    cost = "blocked" if r.amount < 600000 or r.turnover_rate < 1 else "cautious" if z(r.amount_ratio) < 0.9 or z(r.atr) > 0.08 or r.overheat > 0.45 else "normal"
    override = valid and m["timing"] in ("no_setup", "selloff") and m["buy_score"] >= 0.34 and near_top and s["score"] >= sector_least and strong and r.overheat <= 0.20 and r.rebound <= min(hi, 0.13) and score >= 0.52
    access = "broad_market" if m["can_buy"] else "local_repair_override" if override else "blocked"
    state = valid and access != "blocked" and score >= (0.46 if m["can_buy"] else 0.50)
    plan = ("skip", 0.0, 0, "abandon")
    if state and access == "local_repair_override":
        plan = ("probe", 0.25 if cost == "normal" else 0.15, 1, "reduce")
    elif state and m["timing"] == "repair_watch":
        plan = ("probe", 0.35 if cost == "normal" else 0.25, 1, "reduce")
    elif state and m["timing"] == "buy_window" and m["buy_score"] >= 0.68 and score >= 0.76 and cost == "normal":
        plan = ("full", 1.0, 1, "trail")
    elif state and m["timing"] == "buy_window":
        plan = ("staged", 0.65 if cost == "normal" else 0.50, 2, "trail")
    return {"strategy_score": score, "candidate_ok": bool(valid), "cost_state": cost, "access": access, "strategy_state": bool(state), "mode": plan[0], "scale": plan[1], "entry_days": plan[2], "exit_mode": plan[3]}


def test_rules_by_hand(rows):
    df, pdf = rows
    top, lo, hi = 4, 0.01, 0.19
    market = recovery_plan.market_row(df)
    timing = recovery_plan.market_timing(market)
    sectors = recovery_plan.sector_rank(df, market, members=3, top=top)
    plans = recovery_plan.entry_plan(df, sectors, timing, top=top, rebound_least=lo, rebound_most=hi)
    want = hand_market(pdf)
    got = {r["trade_date"]: r.asDict() for r in timing.collect()}
    assert got.keys() == want.keys() and {m["timing"] for m in want.values()} >= {"no_setup", "selloff", "buy_window", "repair_watch"}
    for day, m in want.items():
        assert all(near(got[day][c], v) for c, v in m.items()), day
    sector_want = hand_sectors(pdf, want, 3, top)
    sector_got = {(r["trade_date"], r["industry"]): r for r in sectors.collect()}
    assert sector_got.keys() == sector_want.keys()
    for key, s in sector_want.items():
        g = sector_got[key]
        assert near(g["sector_score"], s["score"]) and (g["state"], g["place"], g["chosen"], g["n"]) == (s["state"], s["place"], s["chosen"], s["n"])
    plan_got = {(r["symbol"], r["trade_date"]): r for r in plans.collect()}
    seen = set()
    for r in pdf.itertuples():
        w = hand_plan(r, sector_want.get((r.trade_date, r.industry)), want[r.trade_date], top, lo, hi)
        g = plan_got[r.symbol, r.trade_date]
        assert all(near(g[c], v) if isinstance(v, float) else g[c] == v for c, v in w.items()), (r, w, g)
        seen.add((w["access"] if w["strategy_state"] else "-", w["mode"]))
    assert {m for _, m in seen} >= {"skip", "probe", "staged"}
    # greedy choice by the order of the keys
    eligible = sorted((r for r in plan_got.values() if r["strategy_state"] and r["mode"] != "skip"), key=lambda r: (r["trade_date"], -r["sector_score"], -r["strategy_score"], -r["repair"], -r["flow_support"], -r["amount"], r["symbol"]))
    taken = {}
    for r in eligible:
        own = taken.setdefault(r["trade_date"], [])
        if len(own) < 3 and sum(x["industry"] == r["industry"] for x in own) < 1:
            own.append(r)
    picked = sorted((r["trade_date"], r["place"], r["symbol"]) for r in recovery_plan.portfolio(plans, total=3, each=1).collect())
    assert picked == sorted((d, k, r["symbol"]) for d, own in taken.items() for k, r in enumerate(own, 1))


def test_recovery_rows_mark_what_may_be_traded(market):
    bars, master = market
    recovered = scores.recovery(windows.returns(bars))
    rows = recovery_plan.recovery_rows(recovered.union(recovered.where("symbol = 'a1'").selectExpr("'c1'", *recovered.columns[1:])), master)
    assert rows.where("symbol = 'c1' AND tradable").count() == 0 and rows.where("symbol = 'a1' AND tradable").count() == rows.where("symbol = 'a1' AND amount >= 6e5 AND turnover_rate >= 1").count() > 0


def test_sectors_equal_but_for_last_bits_are_ties(spark):
    day = lambda k: datetime.date(2001, 1, k)
    r = random.Random(4)
    values = sorted(r.random() for _ in range(3000))
    assert np.cumsum(values)[-1] != np.cumsum(values[::-1])[-1]
    rows = []
    for k, orders in ((1, (values, values[::-1])), (2, (values[::-1], values))):
        for industry, r5, repairs in (("better", -0.5, orders[0]), ("worse", -0.6, orders[1])):
            rows += [(day(k), industry, 0.5, x, False, 0.5, 0.0, 0.0, r5, True) for x in repairs]
    df = spark.createDataFrame(rows, "trade_date date, industry string, damage double, repair double, candidate boolean, flow_support double, overheat double, ret_3 double, r5 double, tradable boolean").coalesce(1)
    market = spark.createDataFrame([(day(k), 0.0) for k in (1, 2)], "trade_date date, eq_5 double")
    got = {(r["trade_date"], r["industry"]): r["place"] for r in recovery_plan.sector_rank(df, market, members=2).collect()}
    assert got == {(day(k), i): p for k in (1, 2) for i, p in (("better", 1), ("worse", 2))}


def test_market_of_sums_equals_market_of_rows(rows):
    """Also on a date without a tradable symbol, and with missing values."""
    df, pdf = rows
    df = df.withColumn("tradable", F.col("tradable") & (F.col("trade_date") != F.lit(DAYS[7])))
    got, want = (x.toPandas().sort_values("trade_date").reset_index(drop=True) for x in (recovery_plan.market_sums(df), recovery_plan.market_row(df)))
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)
    assert len(got) == 60 and got.n[7] == 60 > got.n.drop(7).max()
    text = recovery_plan.market_sums(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "partial_avg" in text
