"""Adaptive states of symbols at scan dates: scores by thresholds, a model's probability, and a hold that expires.

A state looks back on the scans since the last break-out or collapse only, so
the fold over a symbol's scans is two window functions; the streaming form in
``streaming.keyed`` carries the same state from batch to batch.  Thresholds,
weights and ranges are parameters; the defaults are fixed values of the method.
"""

from __future__ import annotations

from tapeloom.functions.sqlkit import BY, bit, clip, operator, rolling

THRESHOLDS = {
    "pe_acc": 0.65, "pi_acc": 0.05, "imbalance_min": 0.3, "streak_min": 3, "eig_breakout": 0.85, "impulse_breakout": 1.8, "pe_breakout_max": 0.75,
    "pe_collapse": 0.90, "pi_collapse": 0.01, "accel_collapse": 0.05, "purity_collapse_max": 0.3, "collapse_need": 4,
}
#: Weight, lower and upper end of each factor; a lower entropy is better, as is a faster decay.
ACCUMULATION = {"pe": (0.25, 0.3, 1.0), "pi": (0.20, 0.0, 0.5), "ratio_ma": (0.15, -0.1, 0.1), "purity_norm": (0.15, 0.0, 1.0), "streak": (0.15, 0.0, 10.0), "imbalance": (0.10, -1.0, 2.0)}
BREAKOUT = {"eig": (0.20, 0.5, 1.0), "vol_impulse": (0.20, 1.0, 5.0), "pe": (0.10, 0.3, 1.0), "pi": (0.10, 0.0, 0.5), "decay": (0.15, -0.05, 0.05), "momentum": (0.15, -2.0, 2.0), "big_ratio": (0.10, -0.3, 0.3)}


def _share(conds: list[tuple[str, str]]) -> str:
    """Conditions met among those whose value is there; 0 if fewer than two are."""
    there = " + ".join(f"({bit(f'{x} IS NOT NULL')})" for x, _ in conds)
    met = " + ".join(f"({bit(f'{x} {c}')})" for x, c in conds)
    return f"CASE WHEN {there} < 2 THEN 0e0 ELSE CAST({met} AS DOUBLE) / ({there}) END"


def _quality(weights: dict[str, tuple[float, float, float]]) -> str:
    """Weighted sum of factors scaled to 0..1; missing ones add nothing."""

    def scaled(x: str, lo: float, hi: float) -> str:
        if x == "decay":
            return clip("-decay / 0.05", 0.0, 1.0)
        unit = clip(f"({x} - ({lo})) / {hi - lo}", 0.0, 1.0)
        return f"1 - ({unit})" if x == "pe" else unit

    return clip(" + ".join(f"{w} * coalesce({scaled(x, lo, hi)}, 0)" for x, (w, lo, hi) in weights.items()), 0.0, 1.0)


@operator
def adaptive_scores(d, frame, dates, model, thresholds=THRESHOLDS, accumulation=ACCUMULATION, breakout=BREAKOUT):
    """Each symbol at each scan date: shares of conditions met, qualities, and the model's probability (0.5 without one).

    ``dates`` has ``trade_date, scan_no``; ``model`` has ``symbol, trade_date, up_prob``.
    """
    t = thresholds
    acc = [("pe", f"< {t['pe_acc']}"), ("pi", f"> {t['pi_acc']}"), ("imbalance", f"> {t['imbalance_min']}"), ("streak", f"> {t['streak_min']}")]
    brk = [("eig", f"> {t['eig_breakout']}"), ("vol_impulse", f"> {t['impulse_breakout']}"), ("pe", f"< {t['pe_breakout_max']}"), ("momentum", "> 0")]
    col = [f"pe > {t['pe_collapse']}", f"pi < {t['pi_collapse']}", f"accel > {t['accel_collapse']}", f"purity_norm < {t['purity_collapse_max']}"]
    return f"""
    SELECT f.symbol, f.trade_date, s.scan_no, {_share(acc)} AS accum_score, {_share(brk)} AS breakout_score,
      least(1e0, CAST({' + '.join(f'({bit(c)})' for c in col)} AS DOUBLE) / {t['collapse_need']}) AS collapse_score,
      CASE WHEN {' + '.join(f"({bit(f'{x} IS NOT NULL')})" for x, _ in acc)} >= 2 THEN {_quality(accumulation)} ELSE 0e0 END AS aq, {_quality(breakout)} AS bq, coalesce(m.up_prob, 0.5e0) AS up_prob
    FROM (SELECT *, {rolling('avg', 'big_ratio', 5, 1)} AS ratio_ma FROM {frame}) f JOIN {dates} s ON f.trade_date = s.trade_date
    LEFT JOIN {model} m ON f.symbol = m.symbol AND f.trade_date = m.trade_date"""


@operator
def adaptive_states(d, scored, hold_scans=3, weight=0.4):
    """Collapse, else break-out (which begins a hold), else hold, else accumulation, else idle.

    A hold lasts until ``hold_scans`` scans after its break-out; the first scan of
    the symbol at or after that is idle and ends it.  A low probability lowers
    the scores or, with a half collapse, raises that; a high one raises them.
    """
    by = "PARTITION BY symbol ORDER BY scan_no"
    before = f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    panic = "up_prob < 0.3 AND collapse_score > 0.5"
    adjusted = lambda x: f"CASE WHEN {panic} THEN {x} WHEN up_prob < 0.4 THEN {x} * 0.7 WHEN up_prob > 0.6 THEN least(1e0, {x} * 1.1) ELSE {x} END"
    event = "CASE WHEN collapsing THEN -scan_no WHEN breaking THEN scan_no END"  # scan numbers begin at 1
    last = d.pick(f"last({event}, true) {before}", f"last_value({event} IGNORE NULLS) {before}")
    return f"""
    SELECT symbol, trade_date, scan_no, state, CASE WHEN state = 'hold' THEN scan_no - entry END AS held, aq, CASE WHEN state = 'breakout' THEN bq ELSE 0e0 END AS bq,
      {clip(f"{weight} * aq + {1 - weight} * CASE WHEN state = 'breakout' THEN bq ELSE 0e0 END", 0.0, 1.0)} AS confidence FROM (
      SELECT *, CASE WHEN collapsing THEN 'collapse' WHEN breaking THEN 'breakout' WHEN entry > 0 AND scan_no - entry < {hold_scans} THEN 'hold'
          WHEN entry > 0 AND (earlier <= entry OR earlier - entry < {hold_scans}) THEN 'idle' WHEN accum > 0.5 THEN 'accumulation' ELSE 'idle' END AS state FROM (
        SELECT *, {last} AS entry, lag(scan_no) OVER ({by}) AS earlier FROM (
          SELECT *, collapse >= 1.0 AS collapsing, NOT collapse >= 1.0 AND broke > 0.5 AND broke >= accum AS breaking FROM (
            SELECT *, {adjusted('accum_score')} AS accum, {adjusted('breakout_score')} AS broke, CASE WHEN {panic} THEN least(1e0, collapse_score * 1.3) ELSE collapse_score END AS collapse FROM {scored}) a) b) c) e"""


@operator
def scan_dates(d, calendar, every=5):
    """Every n-th date of a calendar (``trade_date, cal_no``), numbered from 1."""
    return f"SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS scan_no FROM {calendar} WHERE (cal_no - 1) % {every} = 0"


@operator
def up_share_model(d, efficiency):
    """Stand-in for a model's probability: the share of days up."""
    return f"SELECT symbol, trade_date, up_ratio AS up_prob FROM {efficiency}"


@operator
def scan_summary(d, states):
    """Symbols by state at each scan date."""
    return f"SELECT trade_date, scan_no, state, count(*) AS n, avg(confidence) AS confidence FROM {states} GROUP BY trade_date, scan_no, state"


@operator
def adaptive_outcomes(d, states, bars, hold=10):
    """Break-outs of a replay with the next bar's open as entry and the close ``hold`` bars on, or the last one before, as exit."""
    return f"""
    SELECT s.symbol, s.trade_date, s.confidence, b.entry_date, b.entry_price, b.exit_date, b.exit_price / nullif(b.entry_price, 0) - 1 AS ret FROM {states} s JOIN (
      SELECT symbol, trade_date, lead(trade_date) OVER ({BY}) AS entry_date, lead(open) OVER ({BY}) AS entry_price,
        coalesce(lead(trade_date, {hold}) OVER ({BY}), max(trade_date) OVER (PARTITION BY symbol)) AS exit_date,
        coalesce(lead(close, {hold}) OVER ({BY}), last_value(close) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit_price FROM {bars}) b
      ON s.symbol = b.symbol AND s.trade_date = b.trade_date WHERE s.state = 'breakout' AND b.entry_date IS NOT NULL"""
