"""Scores and states of single symbols: projections over windowed features, latches and hysteresis."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.sqlkit import BY, bit, clip, clip_term, div, flag, lag, operator, rolling, scaled, so_far, triangular, w
from tapeloom.operators.windows import displacements, entropy_of, histogram_bins, hurst_of, moves, windows_of


@operator
def physics(d, bars, short=10, long=40, entry=0.1, persist=2):
    """Energy, temperature, order, phase and switch terms; their weighted score, its least of the last bars, the state.

    Weights and scales are fixed values.  Entropies, Hurst slopes and all other
    windows are made in one pass over the bars, without a join; an entropy is
    missing where a return of the long window is.
    """
    far = max(short, long)
    ps, pl = max(3, short // 3), max(5, long // 3)
    def z(x):
        return div(f"{x} - ({rolling('avg', x, max(long, 12), max(long, 12) // 3)})", rolling("stddev_pop", x, max(long, 12), max(long, 12) // 3))
    return f"""
    SELECT symbol, trade_date, close, open, energy, temperature, order_term, phase_term, switch_term, score, score_min,
      {flag(f'score_min >= {entry} AND energy >= -0.5 AND order_term >= 0 AND phase_term >= -0.5')} AS state FROM (
      SELECT *, CASE WHEN count(score) {w(persist)} = {persist} THEN min(score) {w(persist)} END AS score_min FROM (
        SELECT *, {clip('0.25 * energy + 0.15 * temperature + 0.30 * order_term + 0.20 * phase_term + 0.10 * switch_term', -1.0, 1.0)} AS score FROM (
          SELECT *, {clip('0.45 * ma_term + 0.35 * spread_term + 0.20 * breakout_term', -1.0, 1.0)} AS order_term, {clip('0.40 * breakout_term + 0.30 * entropy_term + 0.30 * fractal_term', -1.0, 1.0)} AS switch_term,
            {clip('0.55 * entropy_term + 0.45 * fractal_term', -1.0, 1.0)} AS phase_term FROM (
            SELECT symbol, trade_date, open, close, {clip('(0.60 * mf_z + 0.40 * amount_z) / 2.5', -1.0, 1.0)} AS energy, {clip('(0.65 * turnover_z - 0.85 * vol_z) / 2.0', -1.0, 1.0)} AS temperature,
              {clip_term('close / nullif(ma_s, 0) - 1', 0.10)} AS ma_term, {clip_term('ma_s / nullif(ma_l, 0) - 1', 0.12)} AS spread_term, {clip_term('close / nullif(prev_high, 0) - 1', 0.08)} AS breakout_term,
              {clip_term('entropy_rel', 0.25)} AS entropy_term, {clip_term('hs - hl', 0.12)} AS fractal_term FROM (
              SELECT *, {z('vol_s')} AS vol_z FROM (
                SELECT *, CASE WHEN m = {far} THEN (el - es) / nullif(abs(el), 0) END AS entropy_rel, {clip('h_s', 0.0, 1.0)} AS hs, {clip('h_l', 0.0, 1.0)} AS hl FROM (
                  SELECT symbol, trade_date, open, close, ma_s, ma_l, prev_high, vol_s, turnover_z, amount_z, mf_z, m, {hurst_of(short, 's', 'n_s')} AS h_s, {hurst_of(long, 'l', 'n_l')} AS h_l,
                    {entropy_of(d, 's')}, {entropy_of(d, 'l')} FROM (
                    SELECT *, CASE WHEN m = {far} THEN {histogram_bins(d, 'a_s', 'lo_s', 'hi_s')} END AS b_s, CASE WHEN m = {far} THEN {histogram_bins(d, 'a_l', 'lo_l', 'hi_l')} END AS b_l FROM (
                      SELECT symbol, trade_date, open, close, {rolling('avg', 'close', short, ps)} AS ma_s, {rolling('avg', 'close', long, pl)} AS ma_l, {rolling('max', 'close', long, pl, end=1)} AS prev_high,
                        {rolling('stddev_pop', 'ret', short, ps)} AS vol_s, {z('turnover_sum')} AS turnover_z, {z('ln(1 + greatest(amount_sum, 0))')} AS amount_z, {z('mf_sum')} AS mf_z,
                        {windows_of(d, 'ret', short, long)}, count(ret) {w(far)} AS m, count(*) {w(short)} AS n_s, count(*) {w(long)} AS n_l, {displacements(short, 's')}, {displacements(long, 'l')} FROM (
                        SELECT *, {moves(far)} FROM {bars}) r) b) j) i) h) x) y) t) u) v"""


def _carry(d, x: str) -> str:
    return d.pick(f"last({x}, true) {so_far()}", f"last_value({x} IGNORE NULLS) {so_far()}")


@operator
def resonance(d, daily, weekly, monthly, least=-0.2, support=1, persist=2):
    """Scores of three time frames, the higher ones as of their last finished bar, and their joint state."""
    cols = ("score_min", "order_term", "phase_term")
    ctx = ", ".join(f"{p}.{c} AS {p}_{c}_raw" for p in "km" for c in cols) + ", " + ", ".join(f"CAST({p}.state AS INT) AS {p}_state_raw" for p in "km")
    carry = ", ".join(f"{_carry(d, f'{p}_{c}_raw')} AS {p}_{c}" for p in "km" for c in cols) + ", " + ", ".join(f"coalesce({_carry(d, f'{p}_state_raw')}, 0) AS {p}_state" for p in "km")
    bonus = " + ".join(f"({bit(f'{p}{c} > 0')})" for p in ("", "k_", "m_") for c in ("order_term", "phase_term"))
    return f"""
    SELECT symbol, trade_date, open, close, score_min, support_count, resonance_score, coalesce(min({bit('ready')}) {w(persist)} = 1 AND count(*) {w(persist)} = {persist}, false) AS resonance_state FROM (
      SELECT *, {flag(f'day_state = 1 AND score_min >= {least} AND k_score_min >= {least} AND m_score_min >= {least} AND support_count >= {support} AND resonance_score >= {least}')} AS ready FROM (
        SELECT *, day_state + k_state + m_state AS support_count,
          {clip(f'0.50 * coalesce(score_min, -1) + 0.30 * coalesce(k_score_min, -1) + 0.20 * coalesce(m_score_min, -1) + 0.10 * CAST({bonus} AS DOUBLE) / 6', -1.0, 1.0)} AS resonance_score FROM (
          SELECT symbol, trade_date, open, close, score_min, order_term, phase_term, CAST(state AS INT) AS day_state, {carry} FROM (
            SELECT x.*, {ctx} FROM {daily} x LEFT JOIN {weekly} k ON x.symbol = k.symbol AND x.trade_date = k.trade_date LEFT JOIN {monthly} m ON x.symbol = m.symbol AND x.trade_date = m.trade_date) j) c) s) r"""


@operator
def first_signal(d, scored, year=1999):
    """First resonance of a year: entry at the next open, return and highest gain to the year's end, number of signals."""
    return f"""
    SELECT s.symbol, s.signal_date, s.entry_date, s.entry_price, max_by(b.close, b.trade_date) / nullif(s.entry_price, 0) - 1 AS ret_to_end, max(b.close) / nullif(s.entry_price, 0) - 1 AS runup, s.n_signals FROM (
      SELECT symbol, min(trade_date) AS signal_date, min_by(next_date, trade_date) AS entry_date, min_by(next_open, trade_date) AS entry_price, count(*) AS n_signals FROM (
        SELECT symbol, trade_date, resonance_state, lead(trade_date) OVER ({BY}) AS next_date, lead(open) OVER ({BY}) AS next_open FROM {scored}) a
      WHERE resonance_state AND year(trade_date) = {year} GROUP BY symbol) s
    LEFT JOIN {scored} b ON b.symbol = s.symbol AND b.trade_date >= s.entry_date AND b.trade_date <= make_date({year}, 12, 31)
    GROUP BY s.symbol, s.signal_date, s.entry_date, s.entry_price, s.n_signals"""


@operator
def accumulation(d, rets, pe, pct):
    """Accumulation: at least three of four conditions on each of three days, with a quality; break-out and collapse counts."""
    conds = ["pe <= 0.9", "pct <= 0.4", "mf_20 > 0", "vol_ratio <= 1.0"]
    breaks = ["close >= prev_high", "vol_ratio > 1.2", "r5 > 0.2", "net_mf > 0"]
    falls = ["close < ma_20", "pe > 0.97", "net_mf < 0", "r5 < -0.2", "vol_ratio > 2"]
    k = lambda cs: " + ".join(f"({bit(c)})" for c in cs)
    return f"""
    SELECT symbol, trade_date, met, coalesce(min({bit('met >= 3')}) {w(3)} = 1 AND count(*) {w(3)} = 3, false) AS accumulating, quality, CAST(broke AS INT) AS broke, broke >= 3 AND max({bit('met >= 3')}) {w(10)} = 1 AS breakout,
      CAST(fell AS INT) AS fell, fell >= 3 AS collapse, CASE WHEN fell >= 3 THEN 'collapse' WHEN broke >= 3 THEN 'breakout' WHEN met >= 3 THEN 'accumulation' ELSE 'idle' END AS phase FROM (
      SELECT symbol, trade_date, CAST({k(conds)} AS INT) AS met, {k(breaks)} AS broke, {k(falls)} AS fell,
        0.5 * ({scaled('1 - pe', 0.0, 0.3)}) + 0.3 * (1 - ({scaled('pct', 0.0, 1.0)})) + 0.2 * ({scaled('coalesce(vol_ratio, 1)', 0.5, 1.5)}) AS quality FROM (
        SELECT r.symbol, r.trade_date, p.pe, q.pct, r.close, r.r5, r.net_mf, r.mf_20, r.vol_ratio, r.prev_high, r.ma_20 FROM (
          SELECT symbol, trade_date, close, r5, net_mf, {rolling('sum', 'net_mf', 20, 7)} AS mf_20, {div(rolling('avg', 'vol', 5, 3), rolling('avg', 'vol', 20, 7))} AS vol_ratio, {rolling('max', 'high', 20, 7, end=1)} AS prev_high,
            {rolling('avg', 'close', 20, 7)} AS ma_20 FROM {rets}) r JOIN {pe} p ON r.symbol = p.symbol AND r.trade_date = p.trade_date JOIN {pct} q ON r.symbol = q.symbol AND r.trade_date = q.trade_date) x) y"""


@operator
def expansion(d, rets):
    """Rapid expansion and its exhaustion: scores, recent occurrence, hold and exit seeds."""
    return f"""
    SELECT symbol, trade_date, expansion, exhaustion, {flag('expansion >= 0.55')} AS hold_seed, {flag('exhaustion >= 0.55 AND recent = 1')} AS exit_seed FROM (
      SELECT *, max({bit('expansion >= 0.55')}) {w(10)} AS recent, 0.5 * ({scaled(f'{rolling("max", "expansion", 5, 1)} - expansion', 0.0, 0.5)}) + 0.3 * ({scaled('-r5', 0.0, 0.5)}) + 0.2 * ({scaled('coalesce(amount_ratio, 1)', 1.0, 3.0)}) AS exhaustion FROM (
        SELECT *, 0.35 * ({scaled('r5', 0.0, 1.0)}) + 0.25 * ({scaled('efficiency', 0.2, 0.9)}) + 0.2 * ({scaled('up_ratio', 0.3, 0.8)}) + 0.2 * ({scaled('coalesce(amount_ratio, 1)', 0.8, 2.0)}) AS expansion FROM (
          SELECT symbol, trade_date, r5, {div(f'abs(close - {lag("close", 5)})', rolling('sum', 'step', 5))} AS efficiency, {rolling('avg', 'up', 10, 5)} AS up_ratio, {div('amount', rolling('avg', 'amount', 20, 10))} AS amount_ratio
          FROM (SELECT *, abs(close - {lag('close')}) AS step, CASE WHEN r1 > 0 THEN 1e0 ELSE 0e0 END AS up FROM {rets}) a) b) c) e"""


@operator
def hold_path(d, expansions, start="DATE '1999-03-01'", persist=2):
    """From a start date on: an exit that lasts some days latches for good; states by priority."""
    return f"""
    SELECT symbol, trade_date, exited, CASE WHEN exited THEN 'exit' WHEN hold_seed THEN 'rapid' WHEN expansion >= 0.35 THEN 'hold' ELSE 'observe' END AS path_state FROM (
      SELECT *, max({bit('lasting = 1')}) {so_far()} = 1 AS exited FROM (
        SELECT symbol, trade_date, expansion, hold_seed, CASE WHEN sum({bit('exit_seed')}) {w(persist)} = {persist} THEN 1 ELSE 0 END AS lasting FROM {expansions} WHERE trade_date >= {start}) a) b"""


@operator
def path_transitions(d, paths):
    """The changes of state in order, and days, first and last date of each state."""
    return f"""
    SELECT symbol, path_state, count(*) AS n_days, min(trade_date) AS first_date, max(trade_date) AS last_date, count(CASE WHEN changed THEN 1 END) AS n_entries FROM (
      SELECT *, coalesce(path_state <> {lag('path_state')}, true) AS changed FROM {paths}) x GROUP BY symbol, path_state"""


@operator
def recovery(d, rets):
    """Decline and recovery: damage, repair, entry window, flow support, stability, overheating, and four flags.

    Weights, bounds and thresholds are fixed values.
    """
    r = lambda k: f"close / nullif({lag('close', k)}, 0) - 1"
    return f"""
    SELECT symbol, trade_date, close, amount, turnover_rate, r1, ret_3, r5, ret_10, ret_20, dd_20, to_ma20, flow_5, amount_ratio, rebound, atr, damage, repair, entry_window, flow_support, stability, overheat, {flag('above_5 = 1 AND ret_3 >= 0.01 AND amount_ratio >= 0.90')} AS repair_flag,
      {flag('above_5 = 1 AND rebound >= 0.03 AND rebound <= 0.15 AND ret_3 >= 0.01 AND flow_5 >= -0.01')} AS early_flag, {flag('overheat >= 0.60')} AS overheat_flag,
      {flag('damage >= 0.32 AND repair >= 0.45 AND entry_window >= 0.40 AND flow_support >= 0.35 AND NOT overheat >= 0.60')} AS candidate FROM (
      SELECT *, 0.35 * ({scaled('-ret_10', 0.01, 0.10)}) + 0.25 * ({scaled('-dd_20', 0.04, 0.18)}) + 0.25 * ({scaled('-dd_60', 0.08, 0.30)}) + 0.15 * ({scaled('neg_7', 3.0, 7.0)}) AS damage,
        0.35 * ({scaled('ret_3', -0.01, 0.08)}) + 0.20 * ({scaled('amount_ratio', 0.80, 1.80)}) + 0.20 * ({scaled('flow_5', -0.02, 0.06)}) + 0.15 * above_5 + 0.10 * ({scaled('slope', -0.01, 0.03)}) AS repair,
        0.65 * ({triangular('rebound', 0.02, 0.07, 0.16)}) + 0.35 * ({triangular('to_ma20', -0.08, -0.01, 0.08)}) AS entry_window,
        0.50 * ({scaled('flow_5', -0.01, 0.05)}) + 0.30 * ({scaled('amount_ratio', 0.90, 1.80)}) + 0.20 * ({scaled('turnover_ratio', 0.85, 1.50)}) AS flow_support,
        0.45 * ({scaled('to_ma20', -0.08, 0.04)}) + 0.25 * (1 - ({scaled('vol_10', 0.02, 0.09)})) + 0.15 * (1 - ({scaled('atr', 0.01, 0.06)})) + 0.15 * above_10 AS stability,
        0.55 * ({scaled('rebound', 0.12, 0.25)}) + 0.45 * ({scaled('r5', 0.06, 0.16)}) AS overheat FROM (
        SELECT *, {bit('close >= ma_5')} AS above_5, {bit('close >= ma_10')} AS above_10, ma_5 / nullif({lag('ma_5', 3)}, 0) - 1 AS slope FROM (
          SELECT symbol, trade_date, close, amount, turnover_rate, r1, r5, {r(3)} AS ret_3, {r(10)} AS ret_10, {r(20)} AS ret_20, {rolling('avg', 'close', 5)} AS ma_5, {rolling('avg', 'close', 10)} AS ma_10, {div('amount', rolling('avg', 'amount', 20, 10))} AS amount_ratio,
            {div('turnover_rate', rolling('avg', 'turnover_rate', 20, 10))} AS turnover_ratio, {rolling('avg', 'flow', 5, 3)} AS flow_5, {div('close', rolling('max', 'high', 20, 10))} - 1 AS dd_20, {div('close', rolling('max', 'high', 60, 30))} - 1 AS dd_60,
            {div('close', rolling('min', 'low', 10, 5))} - 1 AS rebound, {div('close', rolling('avg', 'close', 20))} - 1 AS to_ma20, {div(rolling('avg', 'tr', 14, 7), 'close')} AS atr, {rolling('stddev_samp', 'r1', 10, 6)} * sqrt(10.0) AS vol_10, {rolling('sum', 'neg', 7, 4)} AS neg_7
          FROM (SELECT *, {div('net_mf', 'amount')} AS flow, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, CASE WHEN r1 < 0 THEN 1 ELSE 0 END AS neg FROM {rets}) a) b) c) e"""


@operator
def stock_state(d, setups, pi):
    """Four layers: qualities to state flow, signal, cost, abandonment, final action, reasons as text."""
    reasons = d.pick("concat_ws(',', CASE WHEN entropy_quality >= 0.5 THEN 'ordered' END, CASE WHEN bifurcation_quality >= 0.5 THEN 'critical' END, CASE WHEN trigger_quality >= 0.5 THEN 'triggered' END)", "concat_ws(',', CASE WHEN entropy_quality >= 0.5 THEN 'ordered' END, CASE WHEN bifurcation_quality >= 0.5 THEN 'critical' END, CASE WHEN trigger_quality >= 0.5 THEN 'triggered' END)")
    return f"""
    SELECT symbol, trade_date, state_flow, signal, abandonment, CASE WHEN abandonment >= 0.7 THEN 'abandon' WHEN state_flow = 'ready' AND signal >= 0.5 THEN 'buy' WHEN state_flow = 'watch' THEN 'watch' ELSE 'wait' END AS action, reasons FROM (
      SELECT *, CASE WHEN entropy_quality >= 0.4 AND bifurcation_quality >= 0.4 THEN 'ready' WHEN entropy_quality >= 0.3 OR bifurcation_quality >= 0.5 THEN 'watch' ELSE 'idle' END AS state_flow, {clip('0.6 * execution_cost + 0.4 * (1 - trigger_quality)', 0.0, 1.0)} AS abandonment, {reasons} AS reasons FROM (
        SELECT s.*, {clip('0.5 * setup_score + 0.5 * least(coalesce(i.pi, 0), 1.0)', 0.0, 1.0)} AS signal FROM {setups} s LEFT JOIN {pi} i ON s.symbol = i.symbol AND s.trade_date = i.trade_date WHERE s.setup_score IS NOT NULL) a) b"""


@operator
def volume_breakout(d, rets):
    """Compression, volume, position and momentum against the 20 bars before, and the exit vote."""
    votes = ["r1 < 0", "vol_ratio > 2", "position < 0.3", "momentum < 0"]
    return f"""
    SELECT symbol, trade_date, 0.3 * ({scaled('compression', 0.0, 0.6)}) + 0.3 * ({scaled('vol_ratio', 1.0, 3.0)}) + 0.2 * position + 0.2 * ({scaled('momentum', 0.0, 0.5)}) AS score, CAST({' + '.join(f'({bit(v)})' for v in votes)} AS INT) AS exit_votes FROM (
      SELECT symbol, trade_date, r1, 1 - {div(rolling('stddev_samp', 'close', 10, 5), rolling('stddev_samp', 'close', 40, 20))} AS compression, {div('vol', rolling('avg', 'vol', 20, 10, end=1))} AS vol_ratio,
        {clip(div(f'close - ({rolling("min", "low", 20, 10)})', f'({rolling("max", "high", 20, 10)}) - ({rolling("min", "low", 20, 10)})'), 0.0, 1.0)} AS position, close / nullif({lag('close', 10)}, 0) - 1 AS momentum FROM {rets}) x"""


@operator
def prefilter(d, accumulated, pct):
    """Loose accumulation or loose break-out; compressed symbols; hard gates with the reason of failing."""
    return f"""
    SELECT a.symbol, a.trade_date, coalesce(a.met >= 2 OR a.broke >= 2, false) AS kept, coalesce(p.pct <= 0.4, false) AS compressed,
      CASE WHEN a.quality < 0.2 THEN 'quality' WHEN p.pct > 0.9 THEN 'percentile' WHEN a.fell >= 3 THEN 'collapse' ELSE 'pass' END AS gate
    FROM {accumulated} a JOIN {pct} p ON a.symbol = p.symbol AND a.trade_date = p.trade_date"""


@operator
def entropy_hold(d, setups, expansions):
    """Hold and exit seeds of the entropy model beside the expansion model's, on the dates both have."""
    return f"""
    SELECT s.symbol, s.trade_date, 0.6 * s.entropy_quality + 0.4 * s.bifurcation_quality AS hold_score, {flag('0.6 * s.entropy_quality + 0.4 * s.bifurcation_quality >= 0.45')} AS entropy_hold, e.hold_seed AS rapid_hold, e.exit_seed AS exhausted
    FROM {setups} s JOIN {expansions} e ON s.symbol = e.symbol AND s.trade_date = e.trade_date WHERE s.setup_score IS NOT NULL AND e.expansion IS NOT NULL"""


@operator
def trade_factors(d, trades, factors, rets, ahead=10):
    """Trades with the factors of their signal date and what followed; buy quality and sell weight."""
    return f"""
    SELECT t.symbol, t.entry_date, t.ret, 0.4 * ({scaled('f.mom_20', -0.5, 1.0)}) + 0.3 * ({scaled('f.vs_20', -0.5, 1.0)}) + 0.3 * ({scaled('f.reversal', -2.0, 2.0)}) AS buy_quality,
      0.5 * ({scaled('-t.ret', 0.0, 0.5)}) + 0.5 * ({scaled('-f.mom_5', 0.0, 0.5)}) AS sell_weight, r.later FROM {trades} t
    LEFT JOIN {factors} f ON t.symbol = f.symbol AND t.trade_date = f.trade_date
    LEFT JOIN (SELECT symbol, trade_date, lead(close, {ahead}) OVER ({BY}) / nullif(close, 0) - 1 AS later FROM {rets}) r ON t.symbol = r.symbol AND t.exit_date = r.trade_date"""


@operator
def factor_health(d, summary):
    """Issues and status of factors by coverage, size and consensus."""
    issues = "concat_ws(',', CASE WHEN n < 50 THEN 'few symbols' END, CASE WHEN abs(median_ic) < 0.02 THEN 'weak' END, CASE WHEN consensus < 0.4 THEN 'no consensus' END)"
    return f"SELECT factor, {issues} AS issues, CASE WHEN {issues} = '' THEN 'ok' ELSE 'check' END AS status FROM {summary}"
