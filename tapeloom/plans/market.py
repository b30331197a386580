"""The engine's queries over the given tables."""

from __future__ import annotations

from tapeloom.operators import adaptive as Y
from tapeloom.operators import bars as B
from tapeloom.operators import cross as A
from tapeloom.operators import detectors as D
from tapeloom.operators import dual as E
from tapeloom.operators import factors as R
from tapeloom.operators import intraday as M
from tapeloom.operators import joins as J
from tapeloom.operators import outcomes as O
from tapeloom.operators import recovery_plan as V
from tapeloom.operators import regimes as Z
from tapeloom.operators import rolling as K
from tapeloom.operators import scores as P
from tapeloom.operators import setup as X
from tapeloom.operators import sources as S
from tapeloom.operators import windows as W
from tapeloom.plans.graph import NODES, node, on_spark, query

KEY = "symbol trade_date "

# sources and sinks
query("b1_daily_bars", KEY + "~open ~high ~low ~close ~2:vol ~2:amount ~2:net_mf ~4:turnover_rate", S.daily_bars, "lineitem")
node("rets", W.returns, "b1_daily_bars")
query("s8_security_master", "symbol name industry area display_name ~2:float_share", S.master, "supplier", "nation", "region")
query("s2_board_bars", KEY + "~close n_rows bar_no", S.board_bars, "b1_daily_bars")
query("s4_index_bars", "trade_date ~open ~high ~low ~close ~2:vol members", S.index_bars, "b1_daily_bars")
query("s5_limit_prices", KEY + "~up_limit ~down_limit", S.limit_prices, "b1_daily_bars")
query("s6_margin", "trade_date ~2:rzye ~2:rzmre ~2:rqye ~2:rzrqye", S.margin, "orders")
query("s7_interbank_rate", "trade_date ~on_rate ~w1_rate", S.interbank, "orders")
query("s9_industry_membership", "symbol industry", None, "s8_security_master")
query("s10_money_flow", KEY + "~2:buy_sm ~2:sell_sm ~2:buy_md ~2:sell_md ~2:buy_lg ~2:sell_lg ~2:buy_elg ~2:sell_elg", S.money_flow, "b1_daily_bars")
query("b1_bar_returns", KEY + "bar_end ~close ~2:amount_sum ~ret", B.with_returns, "b1_daily_bars")
query("b2_weekly_bars", "symbol period_end bar_start bar_end ~open ~high ~low ~close ~2:amount_sum ~4:turnover_mean ~2:mf_sum ~ret", B.period_bars, "b1_daily_bars", period="week")
query("b2_monthly_bars", "symbol period_end bar_start bar_end ~open ~high ~low ~close ~2:amount_sum ~4:turnover_mean ~2:mf_sum ~ret", B.period_bars, "b1_daily_bars", period="month")
query("b3_count_bars", "symbol block trade_date ~open ~high ~low ~close ~2:vol ~change ~pct_chg", B.count_bars, "b1_daily_bars")
query("b5_year_returns", "symbol yr ~year_return", B.year_returns, "b1_daily_bars")
query("s12_lookback_trim", KEY + "~close", S.lookback_trim, "b1_daily_bars")
query("s13_scan_date", "latest resolved", S.scan_date, "b1_daily_bars")
query("s14_calendar", "trade_date cal_no", S.calendar, "b1_daily_bars")
query("s15_daily_full", KEY + "~close industry ~share_turnover ~2:net_elg", S.daily_full, "b1_daily_bars", "s8_security_master", "s10_money_flow")
query("s16_newer_rows", KEY + "~close", S.newer_rows, "b1_daily_bars", "s12_lookback_trim")
query("s23_refresh_window", KEY + "mode", S.refresh_window, "b1_daily_bars", "s12_lookback_trim")
query("s3_ticks", "event_id symbol ts trade_date ~price ~volume side", S.ticks, "events")
query("r2_minute_bars", "symbol minute ~open ~high ~low ~close ~2:volume ~2:amount n_ticks", B.minute_bars, "s3_ticks")
query("m12_minutes_to_days", "symbol trade_date ~open ~high ~low ~close ~2:volume ~2:amount", B.minutes_to_days, "r2_minute_bars")
node("factors", S.day_factors, "s3_ticks")
query("s17_s18_adjusted_minutes", "symbol minute ~close_adj ~avg_price ~turnover", S.adjusted_minutes, "r2_minute_bars", "factors")
query("s19_missing_days", "symbol trade_date", S.missing_days, "r2_minute_bars")
query("s24_f15_posts", "doc_id source n_body passes keyword", S.posts, "documents")
query("f17_dates", "o_orderkey parsed", S.wide_dates, "orders")

# rolling windows
query("w1_returns", KEY + "~r1 ~r5 ~lr bar_no", None, "rets")
query("w2_moving_averages", KEY + "~ma_5 ~ma_10 ~ma_20 ~ma_60 ~ma_120", W.moving_averages, "b1_daily_bars")
query("w3_range_position", KEY + "~breakout ~range_pos new_high", W.range_position, "b1_daily_bars")
query("w4_volatility", KEY + "~vs ~vl ~vp ~vol_ratio ~compression", W.volatility, "rets")
query("w5_zscore", KEY + "~vol_z ~amount_z ~net_mf_z ~turnover_rate_z", W.zscore, "b1_daily_bars")
query("w6_bollinger", KEY + "~width ~width_pct", W.bollinger, "b1_daily_bars")
query("w7_detrended", KEY + "~detrended", W.detrended, "b1_daily_bars")
query("w8_permutation_entropy", KEY + "~pe", W.permutation_entropy, "rets")
query("w8_permutation_entropy_60", KEY + "~pe", W.permutation_entropy, "rets", n=60)
query("w8_permutation_entropy_plain", KEY + "~pe", W.permutation_entropy, "rets", x="close", normalise=False, drop_last=True)
query("w10_irreversibility", KEY + "~pi", W.irreversibility, "rets")
query("w8_w10_features", KEY + "~pe ~pi", W.entropy_pair, "w8_permutation_entropy", "w10_irreversibility")
query("w10_joint_irreversibility", KEY + "~pi9", W.joint_irreversibility, "rets")
query("w11_dominant_eigenvalue", KEY + "~eig_real ~eig_abs", W.dominant_eigenvalue, "rets")
query("w12_turnover_entropy", KEY + "~te", W.turnover_entropy, "b1_daily_bars")
query("w13_relative_entropy", KEY + "~es ~el ~entropy_rel", W.relative_entropy, "rets")
query("w14_hurst", KEY + "~hurst", W.hurst, "b1_daily_bars")
query("w15_recovery_rate", KEY + "~ar1 ~recovery", W.recovery_rate, "rets")
query("w16_percentile_of_last", KEY + "~pct", W.percentile_of_last, "rets")
query("w16_percentile_below_last", KEY + "~pct", W.percentile_of_last, "rets", inclusive=False)
query("w17_w19_phase_adjusted", KEY + "~adjusted ~plain ~distortion", W.phase_adjusted, "rets")
query("w20_variance_lift", KEY + "~var_lift", W.variance_lift, "rets")
query("w21_skew", KEY + "~skew", W.adjusted_skew, "rets")
query("w22_entropy_motion", KEY + "~gap ~gap_5 ~slope ~accel ~velocity", W.entropy_motion, "w8_permutation_entropy", "w8_permutation_entropy_60")
node("structures", W.structure, "rets")
query("w23_coherence", KEY + "~l1 ~purity ~purity_norm ~decay ~trace", W.coherence, "structures")
query("w25_volume_ratios", KEY + "~vol_impulse ~shrink ~amount_ratio", W.volume_ratios, "b1_daily_bars")
query("w26_flow_impulse", KEY + "~2:mf_5 ~2:mf_20 ~mf_impulse ~flow_impulse", W.flow_impulse, "b1_daily_bars")
query("w27_w28_tiered_flow", KEY + "~2:big_net ~big_ratio ~2:big_10 ~small_share ~imbalance ~2:momentum streak", W.tiered_flow, "s10_money_flow")
query("w29_weekly_extra", "symbol bar_end ~level_pct ~2:mf_4 ~shrink", W.weekly_extra, "b2_weekly_bars")
query("w30_true_range", KEY + "~tr ~atr_ratio", W.true_range, "b1_daily_bars")
query("w31_drawdown", KEY + "~drawdown ~rebound ~down_days", W.drawdown, "b1_daily_bars")
query("w32_efficiency", KEY + "~efficiency ~up_ratio", W.efficiency, "rets")
query("w33_loop_score", KEY + "~loop", W.loop_score, "rets")
query("w34_embedding_spectrum", KEY + "~spectrum", W.embedding_spectrum, "rets")
query("w35_w36_persistence", KEY + "~least all_up n_up recent", W.persistence, "rets")
query("w37_peak_fade", KEY + "~fade ~change_3", W.peak_fade, "rets")
query("w38_since_entry", KEY + "~peak_ratio", W.since_entry, "rets")
query("w39_low_run", KEY + "run", W.low_run, "w16_percentile_of_last")
query("w40_derived_factors", KEY + "~mom_5 ~mom_20 ~mom_60 ~vs_20 ~vs_60 ~synergy ~reversal", W.derived_factors, "rets")
query("w41_alignment", KEY + "bull bear ~accel", W.alignment, "w2_moving_averages")
query("w42_order_flow", KEY + "~4:flow", W.order_flow, "b1_daily_bars")

# joins and predicates
query("j1_asof_context", KEY + "~week_close ~week_ret ~month_close ~month_ret", J.asof_context, "b1_bar_returns", "b2_weekly_bars", "b2_monthly_bars")
query("j3_asof_macro", "trade_date ~2:rzye ~on_rate", J.asof_macro, "s14_calendar", "s6_margin", "s7_interbank_rate")
query("j4_latest_rows", KEY + "~close ~r1 n_rows", J.latest_rows, "rets")
query("j11_r16_offset_labels", KEY + "~gain_short ~gain_long big_short big_long", J.offset_labels, "b1_daily_bars", "s14_calendar")
query("j12_o1_picks", KEY + "entry_date ~entry_price exit_date ~exit_price ~ret", J.picks, "rets")
query("j13_interval_stats", "symbol entry_date exit_date ~hi ~lo ~mean_close n_bars", J.interval_stats, "j12_o1_picks", "b1_daily_bars")
query("j14_first_exit", "symbol entry_date hit_date ~hit_close", J.first_exit, "j12_o1_picks", "b1_daily_bars")
query("j15_a5_limit_hits", "trade_date n_up n_down n", J.limit_hits, "b1_daily_bars", "s5_limit_prices")
query("f5_f7_candidate_filter", KEY + "passes reason", J.candidate_filter, "b1_daily_bars", "s8_security_master")
query("f8_f10_universe", KEY + "liquid ~4:sd", J.universe, "b1_daily_bars")
query("f1_f4_scalar_scores", KEY + "~clipped ~scaled ~tent trinary", J.scalar_scores, "b1_daily_bars")
query("f16_resolved_symbols", "asked symbol how", J.resolved_symbols, "s8_security_master", "b1_daily_bars")

# scores and states
query("p1_physics", KEY + "~energy ~temperature ~order_term ~phase_term ~switch_term ~score ~score_min state", P.physics, "b1_bar_returns")
for _p in ("week", "month"):
    query(f"p1_physics_{_p}", KEY + "~score ~score_min state", P.physics, "b2_weekly_bars" if _p == "week" else "b2_monthly_bars", short=6, long=12)
query("p2_resonance", KEY + "~score_min support_count ~resonance_score resonance_state", P.resonance, "p1_physics", "p1_physics_week", "p1_physics_month")
query("p3_first_signal", "symbol signal_date entry_date ~entry_price ~ret_to_end ~runup n_signals", P.first_signal, "p2_resonance")
node("setup_features", X.setup_features, "b1_daily_bars")
query("p5_p7_setup", KEY + "~entropy_quality ~bifurcation_quality ~trigger_quality ~execution_cost ~setup_score setup", X.setup_frame, "setup_features")
query("p5_setup_features", KEY + "~pe_20 ~pe_60 ~gap ~pct ~pi ~eig_abs ~ar1_state ~ar1_adjusted ~distortion ~skew ~var_lift ~breakout_10 ~breakout_20 ~volume_impulse ~flow_impulse ~mf_z ~energy ~order_alignment ~accel", None, "setup_features")
query("p6_latent_scores", KEY + "~s0 ~s1 ~s2 ~s3", X.latent_scores, "setup_features")
query("p6_latent_states", KEY + "state label ~structure", X.latent_states, "p6_latent_scores")
query("p6_latent_states_whole", KEY + "state", None, "p6_latent_states")
query("p8_p14_accumulation", KEY + "met accumulating ~quality broke breakout fell collapse phase", P.accumulation, "rets", "w8_permutation_entropy", "w16_percentile_of_last")
node("detector_frame", D.detector_frame, "w25_volume_ratios", "w8_permutation_entropy", "w10_irreversibility", "w11_dominant_eigenvalue", "w23_coherence", "w27_w28_tiered_flow", "w22_entropy_motion")
query("p8_p9_accumulation", KEY + "met accumulating ~quality", D.detect_accumulation, "detector_frame")
query("p10_p11_breakout", KEY + "breakout ~breakout_quality", D.detect_breakout, "p8_p9_accumulation")
query("p12_p13_collapse", KEY + "signs collapse phase", D.detect_collapse, "p10_p11_breakout")
query("p16_p17_expansion", KEY + "~expansion ~exhaustion hold_seed exit_seed", P.expansion, "rets")
query("p18_p19_hold_path", KEY + "exited path_state", P.hold_path, "p16_p17_expansion")
query("p20_path_transitions", "symbol path_state n_days first_date last_date n_entries", P.path_transitions, "p18_p19_hold_path")
query("p21_recovery", KEY + "~damage ~repair ~entry_window ~flow_support ~stability ~overheat repair_flag early_flag overheat_flag candidate", P.recovery, "rets")
query("p25_stock_state", KEY + "state_flow ~signal ~abandonment action reasons", P.stock_state, "p5_p7_setup", "w10_irreversibility")
query("p32_p36_volume_breakout", KEY + "~score exit_votes", P.volume_breakout, "rets")

# cross sections
node("inputs", A.stock_inputs, "rets", "s8_security_master")
query("a2_stock_inputs", KEY + "industry above_20 new_high ~sd", None, "inputs")
query("a1_breadth", "trade_date n ~advance ~above_ma ~new_high ~inflow ~panic ~sd_median ~r_median", A.breadth, "inputs")
query("a3_sector_flow", "trade_date industry n ~2:net ~mean_r ~momentum place", A.sector_flow, "inputs")
query("a4_a16_dispersion", "trade_date ~dispersion ~flow_entropy ~hhi", A.dispersion, "a3_sector_flow")
query("a6_macro", "trade_date ~2:rzye ~change ~2:ma_5 ~2:ma_20 ~rate_diff", A.macro, "j3_asof_macro")
query("a7_ema", "trade_date ~ema ~thrust", Z.ema, "a1_breadth")
query("a8_c9_trend", "trade_date ~composite trend", A.trend, "a1_breadth", "a7_ema", "a4_a16_dispersion", "a6_macro")
node("trend_inputs", D.trend_inputs, "rets", "s8_security_master", "w8_permutation_entropy", "w27_w28_tiered_flow")
node("trend_micro", D.trend_micro, "trend_inputs")
query("a8_market_trend", "trade_date ~breadth ~money ~volatility ~entropy_score ~momentum ~leverage ~liquidity ~composite trend", D.market_trend, "trend_micro", "a7_ema", "j15_a5_limit_hits", "j3_asof_macro")
query("a9_s21_trend_returns", "trend n ~share ~same_day ~later", A.trend_returns, "a8_market_trend", "s4_index_bars")
node("recovery_rows", V.recovery_rows, "p21_recovery", "s8_security_master", min_amount=1e4, min_turnover=0.1)  # the given tables have small amounts
query("a10_market_row", "trade_date n ~eq_1 ~eq_3 ~eq_5 ~eq_10 ~eq_20 ~below_share ~down_share ~deep_share ~repair_share ~early_share ~flow_share ~amount_share ~hot_share ~washout ~repair ~overheat", V.market_row, "recovery_rows")
query("a11_market_timing", "trade_date timing can_buy ~buy_score ~washout_peak", V.market_timing, "a10_market_row")
query("a12_s22_sector_rank", "trade_date industry n ~sector_score ~relative ~repair state place chosen", V.sector_rank, "recovery_rows", "a10_market_row", members=2)
query("p22_p23_entry_plan", KEY + "industry ~strategy_score sector_place timing access cost_state candidate_ok strategy_state mode ~scale entry_days exit_mode", V.entry_plan, "recovery_rows", "a12_s22_sector_rank", "a11_market_timing", min_amount=1e4, min_turnover=0.1)
query("p22_k2_portfolio", KEY + "industry ~strategy_score mode ~scale place", V.portfolio, "p22_p23_entry_plan")
node("industry_logs", X.industry_logs, "rets", "s8_security_master")
query("a13_coupling", "trade_date ~coupling", X.lead_lag_entropy, "industry_logs")
query("a13_a15_cross_section", KEY + "~score_rank ~entropy_rank ~bifurcation_rank ~trigger_rank ~context_rank ~low_share ~breakout_share ~energy_share ~bifurcation_share ~distortion_share ~coupling ~noise ~regime phase ~penalty cost_state ~abandonment abandoned ~context mode ~scale entry_days", X.cross_section, "p5_p7_setup", "a13_coupling")
query("f6_setup_candidates", KEY + "industry setup passes", X.setup_candidates, "a13_a15_cross_section", "s8_security_master", min_amount=1e4, min_turnover=0.1)
query("a17_industry_days", "industry trade_date day_no ~ret", A.industry_days, "inputs")
query("j19_lead_lag", "industry leader ~lead_corr n", J.lead_lag, "a17_industry_days")
node("pair_correlations", Z.pair_correlations, "a17_industry_days", "s8_security_master", least=2)  # the given tables have few symbols an industry
query("a17_coupling", "trade_date ~coupling", Z.coupling, "pair_correlations", "a17_industry_days")
query("a18_noise_cost", "trade_date ~noise ~clustering ~imbalance ~jumps ~extremes", Z.noise_cost, "rets")
query("a18_a19_noise_cost", "trade_date ~coupling ~noise coupling_level noise_level state ~gate", Z.market_phase, "a17_coupling", "a18_noise_cost")
query("a20_industry_factors", KEY + "~industry_momentum ~industry_breadth ~relative", A.industry_factors, "inputs")
query("a21_hot_industries", "industry n_days", A.hot_industries, "a3_sector_flow")
query("a22_leaders", KEY + "~score place", A.leaders, "a20_industry_factors")
query("j16_in_hot_industries", KEY + "industry", J.in_hot_industries, "j12_o1_picks", "s8_security_master", "a21_hot_industries")
query("j17_not_recent", KEY + "~close", J.not_recent, "b1_daily_bars", "j12_o1_picks")
query("j18_merged_picks", KEY + "origin", J.merged_picks, "j12_o1_picks", "a22_leaders")
query("j18_merged_picks_by_date", KEY + "origin", J.merged_picks_by_date, "j12_o1_picks", "a22_leaders")
query("a23_index_regime", "trade_date regime ~ma_20 ~dd", A.index_regime, "s4_index_bars")
node("month_rows", Z.month_rows, "b1_daily_bars")
query("a24_month_regime", "month_end ~close ~close_over_ma ~hurst ~mf_z ~entropy_rel raw lasting", Z.month_regime, "month_rows")
query("j2_regime_by_date", "trade_date ~close regime", D.regime_by_date, "s4_index_bars", "a24_month_regime")
query("j9_snapshot_with_week", KEY + "~close ~r1 w_bar_end ~w_close ~w_ret ~2:w_amount_sum", D.snapshot_with_week, "rets", "b2_weekly_bars")
query("k3_filled_top", KEY + "~score place fallback", D.filled_top, "p2_resonance")
query("a25_a26_summary", "industry state n n_symbols ~mean_score", A.summary, "p2_resonance", "s8_security_master")
query("a27_standardized", KEY + "~mom_5_z ~mom_20_z ~vs_20_z ~reversal_z", A.standardized, "w40_derived_factors")

# outcomes, ranking and sets
query("o1_fixed_horizon", KEY + "~ret ~runup ~drawdown held full_hold", O.fixed_horizon, "rets")
query("o2_o3_first_hit", "symbol entry_date exit_date reason ~ret", O.first_hit, "j12_o1_picks", "b1_daily_bars")
query("o5_o6_marked", "symbol entry_date trade_date ~day_ret scale", O.marked, "j12_o1_picks", "b1_daily_bars")
query("o7_cohort_nav", "trade_date n_live ~ret", O.cohort_nav, "o5_o6_marked")
query("o8_nav_metrics", "n_days ~sharpe", O.nav_metrics, "o7_cohort_nav")
query("o9_o12_trade_metrics", "reason n ~win_rate ~mean_ret ~median_ret ~profit_factor ~best ~worst verdict", O.trade_metrics, "o2_o3_first_hit")
query("o10_period_performance", "period n_days ~up_share", O.period_performance, "o7_cohort_nav")
query("o11_blockers", "blocker n n_only", O.blockers, "p21_recovery")
query("o13_top_gainers", "symbol ~gain n_picks outcome", O.top_gainers, "b1_daily_bars", "j12_o1_picks")
query("o14_contribution", "bucket n ~total", O.contribution, "o2_o3_first_hit")
query("o15_coverage_gap", "factor ~gap n", O.coverage_gap, "w40_derived_factors", "o13_top_gainers")
query("o4_o16_hit_rates", "yr n_short ~hit_short n_long ~hit_long", O.hit_rates, "j11_r16_offset_labels")
query("o17_o23_exit_quality", "reason n ~later ~premature ~own_corr intervene", O.exit_quality, "o2_o3_first_hit", "rets")
query("o18_rolling_summary", "quarter n ~mean_ret ~win_rate", O.rolling_summary, "j12_o1_picks")
query("o21_cohort_replay", "trade_date n ~cohort_ret", O.cohort_replay, "rets", "s14_calendar")
query("o20_fees", "symbol entry_date ~ret ~net_ret", O.fees, "j12_o1_picks")
query("k1_k2_capped_top", KEY + "industry ~score place", O.capped_top, "p1_physics", "s8_security_master")
query("k4_nth_dates", "trade_date cal_no", O.nth_dates, "s14_calendar")
query("k6_last_of_week", "week_end trade_date", O.last_of_week, "s14_calendar")
query("k5_extremes", "symbol entry_date ~ret side", O.extremes, "o2_o3_first_hit")
query("u2_u3_missed", "symbol what", O.missed, "o13_top_gainers", "j12_o1_picks")
query("u4_last_kept", KEY + "~ret", O.last_kept, "j12_o1_picks")
query("j22_blindness", "industry n_missed n_caught", J.blindness, "inputs", "j16_in_hot_industries")

# factor research
query("r1_r2_panel", KEY + "~fwd_5 ~fwd_10 ~fwd_20 ~weight", R.panel, "w40_derived_factors", "rets")
query("r7_factor_rows", KEY + "factor ~value ~fwd_5", R.factor_rows, "r1_r2_panel")
query("r3_rank_ic", "symbol factor n ~ic", R.rank_ic, "r7_factor_rows")
query("r5_recent_ic", "symbol factor ~spearman ~pearson n", R.recent_ic, "r7_factor_rows")
query("r13_date_ic", "factor ~mean_ic ~ic_ir n_months", R.date_ic, "r7_factor_rows")
query("r6_r14_quantile_returns", "factor bucket n ~mean_fwd", R.quantile_returns, "r7_factor_rows")
query("r8_r9_factor_summary", "factor n n_pos n_neg ~median_ic ~consensus ~weight", R.factor_summary, "r3_rank_ic")
query("r10_r12_ic_score", KEY + "~score n_factors main_factor", R.ic_score, "r7_factor_rows", "r8_r9_factor_summary")
query("r11_horizon_residual", KEY + "~residual", R.horizon_residual, "r1_r2_panel")
query("r15_event_study", "rel n ~path", R.event_study, "rets")
query("r17_stay_labels", KEY + "stays collapses bars_to_fall", R.stay_labels, "rets")
query("r18_holding_features", "symbol entry_date trade_date days_held ~pnl ~max_pnl ~from_peak", R.holding_features, "o5_o6_marked", "j12_o1_picks")
query("r19_sequences", KEY + "steps ~sum_a ~sum_b split", R.sequences, "w40_derived_factors")
query("r20_neutralized", KEY + "~neutral", R.neutralized, "r1_r2_panel", "b1_daily_bars")
query("r27_adjusted_weights", "factor ~weight", R.adjusted_weights, "r3_rank_ic")

# ticks and minutes
query("m1_tick_returns", "event_id symbol ~lr ~flow ~waited", M.tick_returns, "s3_ticks")
query("m1_m13_tick_state", "event_id symbol ~pe state", M.tick_state, "m1_tick_returns")
query("m2_waiting_entropy", "event_id symbol ~we", M.waiting_entropy, "m1_tick_returns")
query("m3_m7_volume_share", KEY + "~entropy ~hhi ~active_ratio ~range_ratio", M.volume_share, "r2_minute_bars")
query("m4_m8_whole_day", KEY + "n_ticks ~pe ~pi ~shift label", M.whole_day, "m1_tick_returns", least=4)
query("m9_m10_day_deltas", KEY + "~entropy_drop ~entropy_rise ~hhi_drop ~entropy_5", M.day_deltas, "m3_m7_volume_share")
query("m11_multi_scale", "symbol scale n_bars ~spread ~entropy", M.multi_scale, "s3_ticks")
query("p28_p31_fusion", KEY + "~buy_score ~sell_score decision", M.fusion, "m3_m7_volume_share", "m9_m10_day_deltas", "m4_m8_whole_day")
query("entry_scan", KEY + "industry ~score place", None, "k1_k2_capped_top")
query("w9_ordinal_entropy", KEY + "~pe", W.ordinal_entropy, "rets")
query("p26_structure_score", KEY + "~structure", W.structure_score, "rets")
query("r21_filled_sequences", KEY + "~filled ~mean_filled", W.filled_sequences, "w40_derived_factors")
query("f9_f14_prefilter", KEY + "kept compressed gate", P.prefilter, "p8_p14_accumulation", "w16_percentile_of_last")
query("p15_j10_entropy_hold", KEY + "~hold_score entropy_hold rapid_hold exhausted", P.entropy_hold, "p5_p7_setup", "p16_p17_expansion")
query("j21_p33_p34_trade_factors", "symbol entry_date ~ret ~buy_quality ~sell_weight ~later", P.trade_factors, "j12_o1_picks", "w40_derived_factors", "rets")
query("o22_factor_health", "factor issues status", P.factor_health, "r8_r9_factor_summary")
node("weekly_table", S.precomputed_weekly, "b2_weekly_bars")
query("s11_weekly_or_resampled", "symbol bar_end ~close origin", S.weekly_or_resampled, "weekly_table", "b2_weekly_bars")
node("industry_trades", J.trades_by_industry, "j12_o1_picks", "s8_security_master")
query("j23_stop_list", KEY + "industry", J.stop_list, "industry_trades", losses=150)

# dual entropy; sessions of the given ticks are short, so windows and least counts are
query("p27_daily_entropy", KEY + "~pe ~pe_long ~gap ~pct ~pi ~eig ~lift compressed days ~pe_move ~pi_move", E.daily_summary, "rets", "w8_permutation_entropy", "w8_permutation_entropy_60", "w10_irreversibility", "w11_dominant_eigenvalue", "w20_variance_lift")
query("f12_p29_bifurcation", KEY + "passes ~eig_part ~gap_part ~direction_part ~momentum_part ~total signal", E.bifurcation, "p27_daily_entropy", "rets", liquidity_gate=1e3)
node("short_minutes", B.minute_bars, "s3_ticks", minutes=5)
query("m6_entropy_curve", KEY + "~pe ~shift ~trend ~spread", E.entropy_curve, "short_minutes", n=4, least=4, half=3, points=2)
node("intraday_frame", E.intraday_frame, "m3_m7_volume_share", "m4_m8_whole_day", "m6_entropy_curve", "p27_daily_entropy")
query("p28_buy_signal", KEY + "passes ~compression ~concentration ~direction ~volume_pattern ~total signal", E.buy_signal, "intraday_frame")
query("p30_sell_signal", KEY + "~diffusion ~stealth ~exhaustion ~anomaly ~total kind signal", E.sell_signal, "intraday_frame")
query("p31_trend_hold", "symbol entry_date trade_date alive ~sell_from", E.trend_hold, "r18_holding_features", "p27_daily_entropy")
query("p4_signals_at", KEY + "resonance_state support_count ~score_min ~resonance_score", E.signals_at, "p2_resonance", exact=False)
query("f18_pruned", KEY + "~2:buy_sm", R.pruned, "s10_money_flow", names=("symbol", "trade_date", "buy_sm", "sell_sm", "buy_md", "sell_md", "buy_lg", "sell_lg", "buy_elg", "sell_elg"))

# adaptive states at every fifth date, and their replay
node("scans", Y.scan_dates, "s14_calendar")
node("up_model", Y.up_share_model, "w32_efficiency")
node("adaptive_scores", Y.adaptive_scores, "detector_frame", "scans", "up_model")
query("p14_adaptive_state", KEY + "scan_no state held ~aq ~bq ~confidence", Y.adaptive_states, "adaptive_scores")
query("p14_state_counts", "trade_date scan_no state n ~confidence", Y.scan_summary, "p14_adaptive_state")
query("c13_signal_replay", KEY + "entry_date ~entry_price exit_date ~confidence ~ret", Y.adaptive_outcomes, "p14_adaptive_state", "b1_daily_bars")

# what many sliding frames would take too long for: one pass over a symbol's rows
on_spark("p1_physics", K.physics, "b1_bar_returns")
for _p in ("week", "month"):
    on_spark(f"p1_physics_{_p}", K.physics, "b2_weekly_bars" if _p == "week" else "b2_monthly_bars", short=6, long=12)
on_spark("w34_embedding_spectrum", K.embedding_spectrum, "b1_daily_bars")
on_spark("setup_features", K.setup_features, "b1_daily_bars")
on_spark("p5_p7_setup", K.setup_features, "b1_daily_bars", scored=True)
on_spark("a13_a15_cross_section", X.market_sections, "b1_daily_bars", "s8_security_master")
on_spark("detector_frame", K.detector_frame, "b1_daily_bars")
on_spark("p27_daily_entropy", K.daily_summary, "b1_daily_bars")
on_spark("p21_recovery", K.recovery, "b1_daily_bars")
on_spark("recovery_rows", V.kept_rows, "p21_recovery", "s8_security_master", **NODES["recovery_rows"].params)
on_spark("a10_market_row", V.kept_market, "recovery_rows")
on_spark("p22_p23_entry_plan", V.planned, "recovery_rows", "a12_s22_sector_rank", "a11_market_timing", **NODES["p22_p23_entry_plan"].params)
