"""Bifurcation setups: features in one pass over a symbol's bars, qualities and state, latent states, the market's cross section and the plan.

Weights, bounds and thresholds are fixed values of the method; limits that a
user sets are parameters.  A value is missing where its window isn't full (the
pandas-like short windows of averages excepted); scores with a missing part are
missing, and conditions on missing values aren't met.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.sqlkit import centered, clip, div, flag, lag, operator, rolling, scaled, shannon, shown, w
from tapeloom.operators import rolling as rolling_rows
from tapeloom.operators.windows import EIG_ABS, YULE_WALKER, _states, _transitions, ar1, autocovariances, irreversibility_of, pair_counts, pattern, returns
from tapeloom.sources import workdir

CODES = (0, 1, 3, 4, 6, 7)


@operator
def setup_features(d, bars, n=20, long=60, past=120):
    """All features of the setup, one row a bar.

    Entropies that differ by less than 1e-9 count as equal in their percentile.
    The state is the detrended log close, less its last values' mean on the same
    weekday, part of the month and month of the quarter.
    """

    def less(x, phase, rows, least):
        frame = f"OVER (PARTITION BY symbol, {phase} ORDER BY trade_date ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
        return f"{x} - coalesce(CASE WHEN count({x}) {frame} >= {least} THEN avg({x}) {frame} END, 0)"

    counts = ", ".join(f"sum(CASE WHEN code = {k} THEN 1 ELSE 0 END) {w(m - 2)} AS c{m}_{k}" for m in (n, long) for k in CODES)
    pe = lambda m: f"CASE WHEN n_{m} = {m - 2} THEN {shannon([f'c{m}_{k}' for k in CODES], f'nullif(n_{m}, 0)', 6.0)} END AS pe_{m}"
    full = lambda x, k: f"CASE WHEN count({x}) {w(k)} = {k} THEN {d.collect(x)} {w(k)} END"
    at_most = d.pick(f"size(filter(a_pe, y -> y <= pe_{n} + 1e-9))", f"len(list_filter(a_pe, lambda y: y <= pe_{n} + 1e-9))")
    have = d.pick(f"collect_list(pe_{n}) {w(past)}", f"list(pe_{n}) FILTER (WHERE pe_{n} IS NOT NULL) {w(past)}")
    m = f"count(detrended) {w(20)}"
    skew = d.pick(f"skewness(detrended) {w(20)} * sqrt({m} * ({m} - 1)) / ({m} - 2)", f"skewness(detrended) {w(20)}")  # the sample's in both
    keep = "symbol, trade_date, close, amount, turnover_rate, ma_20, ma_60, breakout_10, breakout_20, volume_impulse, flow_impulse, mf_z, execution_cost, ar1_state, ar1_adjusted, skew, var_lift"
    return f"""
    SELECT {keep}, pe_{n}, pe_{long}, pe_{long} - pe_{n} AS gap, pct, pi, eig_abs, abs(ar1_state - ar1_adjusted) AS distortion, 1 - ar1_adjusted AS recovery, slope - {lag('slope')} AS accel,
      {clip('0.55 * coalesce(volume_impulse, 0) + 0.45 * coalesce(flow_impulse, 0)', -1.0, 1.0)} AS energy,
      {clip(f"0.35 * coalesce({div('close - ma_20', 'ma_20')}, 0) + 0.35 * coalesce({div('ma_20 - ma_60', 'ma_60')}, 0) + 0.30 * coalesce(breakout_10, 0)", -1.0, 1.0)} AS order_alignment FROM (
      SELECT *, CASE WHEN n_rows = {past} AND {d.size('a_pe')} >= {max(8, past // 3)} AND pe_{n} IS NOT NULL THEN {at_most} / CAST({d.size('a_pe')} AS DOUBLE) END AS pct, (pe_{n} - {lag(f'pe_{n}', 5)}) / 5 AS slope FROM (
        SELECT *, {have} AS a_pe FROM (
          SELECT {keep}, n_rows, {pe(n)}, {pe(long)}, CASE WHEN lr_sd <= 1e-12 THEN 0e0 ELSE {irreversibility_of(3)} END AS pi, CASE WHEN disc IS NOT NULL THEN {EIG_ABS} END AS eig_abs FROM (
            SELECT *, p1 * p1 + 4 * p2 AS disc FROM (
              SELECT *, {YULE_WALKER} FROM (
                SELECT *, {pair_counts(d, 'pairs', 3)}, {autocovariances(d)} FROM (
                  SELECT *, {_transitions(d, 's', 3)} AS pairs FROM (
                    SELECT *, CASE WHEN adj_sd > 1e-12 THEN {d.map('a_adj', 'x - adj_mean')} END AS c, {_states(d, 'a_lr', '0.5 * lr_sd')} AS s FROM (
                      SELECT *, {counts}, count(code) {w(n - 2)} AS n_{n}, count(code) {w(long - 2)} AS n_{long}, {full('adjusted', n)} AS a_adj, avg(adjusted) {w(n)} AS adj_mean, stddev_pop(adjusted) {w(n)} AS adj_sd, {full('lr', n)} AS a_lr, stddev_pop(lr) {w(n)} AS lr_sd,
                        {ar1('detrended', 'd_prev', n - 1)} AS ar1_state, {ar1('adjusted', 'a_prev', n - 1)} AS ar1_adjusted, {rolling('var_pop', 'detrended', 10, 5)} / nullif({rolling('var_pop', 'detrended', 20, 10)}, 0) - 1 AS var_lift, count(*) {w(past)} AS n_rows,
                        CASE WHEN count(detrended) {w(20)} >= 10 AND stddev_pop(detrended) {w(20)} > 1e-9 THEN {skew} END AS skew FROM (
                        SELECT *, {lag('detrended')} AS d_prev, {lag('adjusted')} AS a_prev, {pattern('detrended')} AS code FROM (
                          SELECT *, {less('x2', 'ph3', 18, 4)} AS adjusted FROM (
                            SELECT *, {less('x1', 'ph2', 10, 3)} AS x2 FROM (
                              SELECT *, {less('detrended', 'ph1', 12, 3)} AS x1 FROM (
                                SELECT *, CASE WHEN lc_sd > 0 THEN (lc - lc_mean) / lc_sd END AS detrended,
                                  {clip("0.45 * coalesce(vol_20, 0) / 0.04 + 0.30 * coalesce(turn_sd, 0) - 0.15 * coalesce(ln(1 + greatest(am_20, 0)) / 14, 0) - 0.10 * coalesce(turn_20, 0) / 6", 0.0, 1.0)} AS execution_cost FROM (
                                  SELECT symbol, trade_date, close, amount, turnover_rate, lc, lr, {d.weekday('trade_date')} AS ph1, CASE WHEN day(trade_date) <= 7 THEN 0 WHEN day(trade_date) >= 23 THEN 2 ELSE 1 END AS ph2, (month(trade_date) - 1) % 3 AS ph3,
                                    {rolling('avg', 'close', 20, 10)} AS ma_20, {rolling('avg', 'close', 60, 30)} AS ma_60, {rolling('stddev_pop', 'lr', 20, 10)} AS vol_20, {rolling('avg', 'lc', 20, 10)} AS lc_mean, {rolling('stddev_pop', 'lc', 20, 10)} AS lc_sd,
                                    close / nullif({rolling('max', 'high', 10, 5, end=1)}, 0) - 1 AS breakout_10, close / nullif({rolling('max', 'high', 20, 10, end=1)}, 0) - 1 AS breakout_20, {rolling('avg', 'amount', 20, 10)} AS am_20,
                                    {rolling('avg', 'amount', 5, 3)} / nullif({rolling('avg', 'amount', 20, 10)}, 0) - 1 AS volume_impulse, {rolling('avg', 'turnover_rate', 20, 10)} AS turn_20, {rolling('stddev_pop', 'turnover_rate', 20, 10)} AS turn_sd,
                                    {rolling('avg', 'net_mf', 5, 3)} / nullif({rolling('avg', 'abs(net_mf)', 20, 10)}, 0) AS flow_impulse, (net_mf - {rolling('avg', 'net_mf', 60, 20)}) / nullif({rolling('stddev_pop', 'net_mf', 60, 20)}, 0) AS mf_z FROM (
                                    SELECT *, lc - {lag('lc')} AS lr FROM (
                                      SELECT symbol, trade_date, high, close, coalesce(amount, 0) AS amount, coalesce(turnover_rate, 0) AS turnover_rate, coalesce(net_mf, 0) AS net_mf, CASE WHEN close > 0 THEN ln(close) END AS lc FROM {bars} WHERE close IS NOT NULL) f1) f2) f3) f4) f5) f6) f7) f8) f9) g1) g2) g3) g4) g5) g6) g7) g8"""


@operator
def setup_frame(d, features, n=20):
    """Entropy, bifurcation, trigger and execution quality, the state's score, five conditions and the setup."""
    pe = f"pe_{n}"
    ent = f"0.50 * (1 - coalesce(pct, 1)) + 0.30 * ({scaled('gap', 0.0, 0.10)}) + 0.20 * ({scaled(f'0.95 - {pe}', 0.0, 0.40)})"
    bif = f"""0.06 * ({scaled('ar1_state', 0.82, 0.97)}) + 0.18 * ({scaled('ar1_adjusted', 0.80, 0.97)}) + 0.30 * ({scaled('eig_abs', 0.68, 0.99)}) + 0.24 * ({scaled('pi', 0.01, 0.25)})
      + 0.12 * ({scaled('0.22 - recovery', 0.0, 0.22)}) + 0.10 * ({scaled('var_lift', -0.05, 0.20)})"""
    trig = f"""0.30 * ({scaled('breakout_10', 0.0, 0.04)}) + 0.20 * ({scaled('breakout_20', 0.0, 0.06)}) + 0.18 * ({scaled('volume_impulse', 0.0, 0.30)}) + 0.14 * ({scaled('flow_impulse', -0.10, 0.80)})
      + 0.10 * ({centered('energy', 1.0)}) + 0.08 * ({scaled('accel', -0.01, 0.02)})"""
    return f"""
    SELECT *, {flag('execution_cost >= 0.82 AND setup_score < 0.65')} AS abandon_seed, compressed AND instable AND in_phase AND triggered AND of_quality AS setup FROM (
      SELECT *, {flag('pct <= 0.40 AND gap >= 0.015')} AS compressed, {flag('(eig_abs >= 0.66 AND pi >= 0.008) OR bifurcation_quality >= 0.45')} AS instable, {flag('ar1_adjusted >= 0.60 OR (distortion <= 0.12 AND ar1_state >= 0.55)')} AS in_phase,
        {flag('breakout_10 >= -0.02 AND close >= ma_20 * 0.985 AND ma_20 >= ma_60 * 0.98 AND mf_z >= -0.80')} AS triggered, {flag('setup_score >= 0.44 AND entropy_quality >= 0.62 AND bifurcation_quality >= 0.20 AND 1 - execution_cost >= 0.35')} AS of_quality FROM (
        SELECT *, {clip('0.32 * entropy_quality + 0.48 * bifurcation_quality + 0.20 * trigger_quality', 0.0, 1.0)} AS setup_score FROM (
          SELECT *, {clip(ent, 0.0, 1.0)} AS entropy_quality, {clip(bif, 0.0, 1.0)} AS bifurcation_quality, {clip(trig, 0.0, 1.0)} AS trigger_quality FROM {features}) a) b) c"""


@operator
def latent_scores(d, features):
    """Scores of the four latent states: compression, instability, launch, diffusion."""
    return f"""
    SELECT symbol, trade_date,
      {clip(f"0.45 * (1 - coalesce(pct, 1)) + 0.30 * ({scaled('gap', 0.0, 0.10)}) + 0.15 * ({scaled('-breakout_10', -0.03, 0.03)}) + 0.10 * ({scaled('0.20 - distortion', 0.0, 0.20)})", 0.0, 1.0)} AS s0,
      {clip(f"0.32 * ({scaled('eig_abs', 0.68, 0.99)}) + 0.28 * ({scaled('pi', 0.01, 0.25)}) + 0.20 * ({scaled('ar1_adjusted', 0.80, 0.97)}) + 0.12 * ({scaled('distortion', 0.02, 0.15)}) + 0.08 * ({scaled('var_lift', -0.05, 0.20)})", 0.0, 1.0)} AS s1,
      {clip(f"0.30 * ({scaled('breakout_10', 0.0, 0.04)}) + 0.20 * ({scaled('volume_impulse', 0.0, 0.30)}) + 0.18 * ({scaled('flow_impulse', -0.10, 0.80)}) + 0.17 * ({centered('order_alignment', 1.0)}) + 0.15 * ({scaled('accel', -0.01, 0.02)})", 0.0, 1.0)} AS s2,
      {clip(f"0.28 * ({scaled('breakout_20', 0.0, 0.07)}) + 0.22 * ({centered('energy', 1.0)}) + 0.22 * ({scaled('mf_z', -0.20, 1.50)}) + 0.18 * ({scaled('close / nullif(ma_20, 0) - 1', -0.02, 0.08)}) + 0.10 * ({scaled('0.25 - execution_cost', 0.0, 0.25)})", 0.0, 1.0)} AS s3
    FROM {features}"""


LATENT = ("compression", "instability", "launch", "diffusion")


def latent_states(scores: DataFrame, margin: float = 0.05, window: int = 5) -> DataFrame:
    """``symbol, trade_date, state, label, structure``: the best score's state, which replaces the last one only by a margin.

    ``structure`` is the best score less a quarter of the share of switches among
    the last rows.  Rows without all four scores have no state.  A symbol's sorted
    rows stream through a step that carries the state, in any number of batches.
    """
    columns = ("s0", "s1", "s2", "s3")

    def run(batches):
        symbol, state, recent = object(), None, []
        for b in batches:
            states, structures = [], []
            for own, *s in zip(*(b.column(c).to_pylist() for c in ("symbol", *columns))):
                best = max(s)
                new = s.index(best)
                if own != symbol:
                    symbol, recent = own, [0]
                else:
                    if new != state and best - s[state] < margin:
                        new = state
                    recent = [*recent[1 - window :], int(new != state)]
                state = new
                states.append(state)
                structures.append(min(1.0, max(0.0, best - 0.25 * sum(recent) / len(recent))))
            labels = [LATENT[k] for k in states]
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("trade_date"), pa.array(states, pa.int32()), pa.array(labels, pa.string()), pa.array(structures, pa.float64())], names=["symbol", "trade_date", "state", "label", "structure"])

    rows = scores.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).selectExpr("symbol", "CAST(trade_date AS DATE) AS trade_date", *[f"CAST({c} AS DOUBLE) AS {c}" for c in columns])
    return rows.repartition("symbol").sortWithinPartitions("symbol", "trade_date").mapInArrow(run, f"symbol {dict(scores.dtypes)['symbol']}, trade_date date, state int, label string, structure double")


@operator
def industry_logs(d, features_rets, master):
    """Mean log return by industry and date, dates numbered."""
    return f"""
    SELECT i.industry, i.trade_date, c.day_no, i.ret FROM (
      SELECT coalesce(m.industry, 'UNKNOWN') AS industry, r.trade_date, avg(r.lr) AS ret FROM {features_rets} r LEFT JOIN {master} m ON r.symbol = m.symbol WHERE r.lr IS NOT NULL GROUP BY coalesce(m.industry, 'UNKNOWN'), r.trade_date) i
    JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_no FROM (SELECT DISTINCT trade_date FROM {features_rets}) x) c ON i.trade_date = c.trade_date"""


@operator
def lead_lag_entropy(d, logs, n=20, least=6):
    """Normalised entropy by date of each industry's summed positive correlations with the others' returns a date before; 0 for one industry or none."""
    last = f"OVER (PARTITION BY a_industry, b_industry ORDER BY day_no RANGE BETWEEN {n - 2} PRECEDING AND CURRENT ROW)"
    return f"""
    SELECT trade_date, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0e0 END AS coupling FROM (
      SELECT trade_date, strength / sum(strength) OVER (PARTITION BY trade_date) AS p FROM (
        SELECT trade_date, a_industry, sum(greatest(pair_corr, 0e0)) AS strength FROM (
          SELECT trade_date, a_industry, CASE WHEN m >= {least} AND va > 1e-18 AND vb > 1e-18 THEN c / sqrt(va * vb) END AS pair_corr FROM (
            SELECT a_industry, trade_date, count(*) {last} AS m, covar_pop(x, y) {last} AS c, var_pop(x) {last} AS va, var_pop(y) {last} AS vb FROM (
              SELECT a.industry AS a_industry, b.industry AS b_industry, a.trade_date, a.day_no, a.ret AS x, b.ret AS y FROM {logs} a JOIN {logs} b ON a.day_no = b.day_no + 1 AND a.industry <> b.industry) p) q) u GROUP BY trade_date, a_industry HAVING sum(greatest(pair_corr, 0e0)) > 0) v) x GROUP BY trade_date"""


NOISE = clip("0.28 * (coalesce(breakout_noise, 0) / 0.04) + 0.18 * (coalesce(turnover_noise, 0) / 6.0) + 0.16 * coalesce(skew_noise, 0) + 0.18 * coalesce(cost_noise, 0) + 0.20 * distortion_share", 0.0, 1.0)


def _phases(noisy: str) -> str:
    """Regime and phase of a text's shares, noise and coupling."""
    return f"""
      SELECT *, CASE WHEN noise >= 0.82 OR (distortion_share >= 0.55 AND regime < 0.30) THEN 'abandon' WHEN low_share >= 0.22 AND breakout_share < 0.12 AND coupling < 0.55 AND distortion_share < 0.45 THEN 'compression'
        WHEN regime >= 0.42 AND breakout_share >= 0.16 AND coupling >= 0.55 AND distortion_share < 0.40 THEN 'expansion' WHEN distortion_share >= 0.45 THEN 'distorted' WHEN regime >= 0.26 THEN 'transition' ELSE 'neutral' END AS phase FROM (
        SELECT *, {clip('0.22 * low_share + 0.26 * bifurcation_share + 0.10 * energy_share + 0.10 * breakout_share + 0.20 * coupling + 0.12 * (1 - noise)', 0.0, 1.0)} AS regime FROM (
          {noisy}) m1) m2"""


@operator
def cross_section(d, setups, couplings):
    """The market at each date (shares, noise, regime, phase), each symbol's penalty, abandonment, context and plan, and five percent ranks."""
    by = "OVER (PARTITION BY trade_date)"
    share = lambda c: f"avg(CASE WHEN {c} THEN 1e0 ELSE 0e0 END)"
    market = _phases(f"""SELECT g.*, coalesce(c.coupling, 0e0) AS coupling, {NOISE} AS noise FROM (
            SELECT trade_date, count(*) AS n, {share('pct <= 0.25')} AS low_share, {share('breakout_10 > 0')} AS breakout_share, {share('energy > 0')} AS energy_share, {share('eig_abs >= 0.72 AND pi >= 0.01')} AS bifurcation_share, {share('distortion >= 0.08')} AS distortion_share,
              {d.median('abs(breakout_10)')} AS breakout_noise, {d.median('turnover_rate')} AS turnover_noise, {d.median('abs(skew)')} AS skew_noise, {d.median('execution_cost')} AS cost_noise FROM {setups} GROUP BY trade_date) g LEFT JOIN {couplings} c ON g.trade_date = c.trade_date""")

    def rank(x):
        own = shown(x, 9)  # values that differ in the last bits only are ties
        return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, {x} IS NULL ORDER BY {own}) + (count(*) OVER (PARTITION BY trade_date, {own}) - 1) / 2e0) / count({x}) {by} END"

    rows = f"SELECT s.*, k.low_share, k.breakout_share, k.energy_share, k.bifurcation_share, k.distortion_share, k.coupling, k.noise, k.regime, k.phase, coalesce(s.setup_score, 0) AS score0, {clip('0.65 * coalesce(s.execution_cost, 1) + 0.35 * k.noise', 0.0, 1.0)} AS penalty FROM {setups} s JOIN ({market}) k ON s.trade_date = k.trade_date"
    if d.spark:  # all by the date in one shuffle, with one sort a rank; a coupling is a row a date
        whole = lambda x: f"{x} {by}"
        seen = f"""
          SELECT /*+ BROADCAST(c) */ w.*, coalesce(c.coupling, 0e0) AS coupling FROM (
            SELECT symbol, trade_date, amount, turnover_rate, setup, setup_score, entropy_quality, bifurcation_quality, trigger_quality, execution_cost, abandon_seed, {whole(share('pct <= 0.25'))} AS low_share, {whole(share('breakout_10 > 0'))} AS breakout_share, {whole(share('energy > 0'))} AS energy_share,
              {whole(share('eig_abs >= 0.72 AND pi >= 0.01'))} AS bifurcation_share, {whole(share('distortion >= 0.08'))} AS distortion_share, {whole(d.median('abs(breakout_10)'))} AS breakout_noise, {whole(d.median('turnover_rate'))} AS turnover_noise, {whole(d.median('abs(skew)'))} AS skew_noise, {whole(d.median('execution_cost'))} AS cost_noise
            FROM {setups} WHERE trade_date IS NOT NULL) w LEFT JOIN {couplings} c ON w.trade_date = c.trade_date"""
        rows = f"SELECT *, coalesce(setup_score, 0) AS score0, {clip('0.65 * coalesce(execution_cost, 1) + 0.35 * noise', 0.0, 1.0)} AS penalty FROM ({_phases(f'SELECT *, {NOISE} AS noise FROM ({seen}) m3')}) k"

        def rank(x):
            ties = f"PARTITION BY trade_date ORDER BY {shown(x, 9)} NULLS LAST"
            return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({ties}) + (count(*) OVER ({ties} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2e0) / count({x}) {by} END"

    return f"""
    SELECT symbol, trade_date, amount, turnover_rate, setup, setup_score, low_share, breakout_share, energy_share, bifurcation_share, distortion_share, coupling, noise, regime, phase, penalty, cost_state, abandonment, abandoned, context, mode, scale, entry_days,
      {rank('setup_score')} AS score_rank, {rank('entropy_quality')} AS entropy_rank, {rank('bifurcation_quality')} AS bifurcation_rank, {rank('trigger_quality')} AS trigger_rank, {rank('context')} AS context_rank FROM (
      SELECT *, CASE WHEN abandoned THEN 'skip' WHEN cost_state = 'cautious' OR phase IN ('compression', 'distorted') THEN 'probe' WHEN phase = 'transition' THEN 'staged' ELSE 'full' END AS mode,
        CASE WHEN abandoned THEN 0e0 WHEN cost_state = 'cautious' OR phase IN ('compression', 'distorted') THEN {clip('0.25 + 0.40 * context', 0.25, 0.60)} WHEN phase = 'transition' THEN {clip('0.35 + 0.45 * context', 0.35, 0.75)} ELSE {clip('0.45 + 0.55 * context', 0.45, 1.00)} END AS scale,
        CASE WHEN abandoned THEN 0 WHEN cost_state = 'cautious' OR phase IN ('compression', 'distorted') THEN 3 WHEN phase = 'transition' THEN 2 ELSE 1 END AS entry_days FROM (
        SELECT *, {clip('0.70 * score0 + 0.20 * regime + 0.10 * (1 - penalty) - CASE WHEN abandoned THEN 0.30 ELSE 0e0 END', 0.0, 1.0)} AS context FROM (
          SELECT *, abandon_seed OR cost_state = 'blocked' OR phase = 'abandon' OR (penalty >= 0.70 AND score0 < 0.62) OR (noise >= 0.78 AND coupling < 0.30) OR abandonment >= 0.74 AS abandoned FROM (
            SELECT *, CASE WHEN penalty >= 0.78 THEN 'blocked' WHEN penalty >= 0.60 THEN 'cautious' ELSE 'normal' END AS cost_state,
              {clip('0.30 * penalty + 0.25 * noise + 0.20 * distortion_share + 0.15 * (1 - score0) + 0.10 * (1 - coupling)', 0.0, 1.0)} AS abandonment FROM (
              {rows}) a) b) c) e) f"""


def market_sections(bars: DataFrame, master: DataFrame) -> DataFrame:
    """``cross_section`` of daily bars; bars, and the industries' means (a row an industry and date), are written once."""
    kept, _ = workdir.written(bars.select("symbol", "trade_date", "high", "close", "amount", "turnover_rate", "net_mf"), "bars")
    logs = returns(kept).join(F.broadcast(master.select("symbol", "industry")), "symbol", "left").groupBy(F.coalesce("industry", F.lit("UNKNOWN")).alias("industry"), "trade_date").agg(F.avg("lr").alias("ret"))
    means, _ = workdir.written(logs, "industries")
    days = means.select("trade_date").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("trade_date")))
    return cross_section(rolling_rows.setup_features(kept, scored=True), lead_lag_entropy(means.where("ret IS NOT NULL").join(F.broadcast(days), "trade_date")))


@operator
def setup_candidates(d, crossed, master, min_amount=500000.0, min_turnover=1.0, exclude_marked=True):
    """Setups that pass all gates: mark, amount, turnover, abandonment, cost, phase, regime and context."""
    marked = "coalesce(regexp_matches(upper(trim(m.name)), '^[*]?ST'), false)" if not d.spark else "coalesce(upper(trim(m.name)) RLIKE '^[*]?ST', false)"
    gates = f"""c.setup AND NOT {marked if exclude_marked else 'false'} AND coalesce(c.amount, 0) >= {min_amount} AND coalesce(c.turnover_rate, 0) >= {min_turnover} AND NOT c.abandoned AND c.cost_state <> 'blocked' AND c.phase <> 'abandon'
      AND NOT (c.cost_state = 'cautious' AND coalesce(c.setup_score, 0) < 0.62) AND NOT (c.phase = 'distorted' AND coalesce(c.setup_score, 0) < 0.45) AND c.regime >= 0.10 AND c.context >= 0.45"""
    return f"SELECT c.*, m.industry, coalesce({gates}, false) AS passes FROM {crossed} c LEFT JOIN {master} m ON c.symbol = m.symbol"
