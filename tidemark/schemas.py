"""Explicit schemas of the feeds (DDL). An absent field reads as missing."""

FILING = "STRUCT<accepted: TIMESTAMP, date: DATE, form: STRING, category: STRING, items: ARRAY<STRING>, text_tags: ARRAY<STRING>, url: STRING>"
NEWS = "STRUCT<title: STRING, url: STRING, published: TIMESTAMP, source: STRING, polarity: INT, tags: ARRAY<STRING>>"
REASON = "STRUCT<text: STRING, url: STRING, family: STRING, strength: INT>"
SHORTABILITY = "STRUCT<status: STRING, available: DOUBLE, fee_rate: DOUBLE, asof: TIMESTAMP>"
PREMARKET = "STRUCT<price: DOUBLE, prev_close: DOUBLE, gap_pct: DOUBLE, asof: TIMESTAMP>"
FAMILIES = "STRUCT<dilution: DOUBLE, exhaustion: DOUBLE, decay: DOUBLE, flow: DOUBLE, street: DOUBLE, news: DOUBLE>"
PARTS = "STRUCT<model: DOUBLE, fee: DOUBLE, scarcity: DOUBLE, si: DOUBLE, dtc: DOUBLE, float: DOUBLE, short_vol: DOUBLE>"
SIZE = (
    "STRUCT<capacity: DOUBLE, exp_dvol: DOUBLE, cap_borrow: DOUBLE, spread: DOUBLE, breakeven: DOUBLE, avg_move: DOUBLE, "
    "`limit`: STRING, move_basis: STRING, spread_source: STRING, spread_estimated: BOOLEAN, "
    "costs: MAP<STRING, DOUBLE>, participation: MAP<STRING, DOUBLE>>"
)
METRICS = (
    "STRUCT<r1: DOUBLE, r3: DOUBLE, r5: DOUBLE, r20: DOUBLE, rvol1: DOUBLE, rsi14: DOUBLE, dist_ma20: DOUBLE, "
    "dist_ma50: DOUBLE, dd_52w: DOUBLE, vol20: DOUBLE, dvol20: DOUBLE, float: DOUBLE, shares_out: DOUBLE, "
    "si_pct_float: DOUBLE, days_to_cover: DOUBLE, short_ratio_5d: DOUBLE, rs_count_2y: BIGINT, n_offer_90: BIGINT, n_reg_90: BIGINT, "
    "short_interest: STRUCT<interest: DOUBLE, settlement_date: DATE>>"
)
DILUTION = (
    "STRUCT<shares_now: DOUBLE, shares_asof: DATE, shares_growth_1y: DOUBLE, shares_1y_ago: DOUBLE, cash: DOUBLE, cash_date: DATE, "
    "quarterly_burn: DOUBLE, runway_q: DOUBLE, atm_capacity: DOUBLE, warrants: STRUCT<shares: DOUBLE, exercise_price: DOUBLE>, "
    "last_offering: STRUCT<date: DATE, type: STRING, form: STRING, price: DOUBLE, shares: DOUBLE, gross: DOUBLE>, sources: ARRAY<STRING>>"
)
INSIDER = (
    "STRUCT<fpi: BOOLEAN, n_sales: BIGINT, n_buys: BIGINT, n_144: BIGINT, value_sold: DOUBLE, value_bought: DOUBLE, "
    "trades: ARRAY<STRUCT<date: DATE, name: STRING, title: STRING, code: STRING, shares: DOUBLE, price: DOUBLE, url: STRING>>>"
)
CHATTER = "STRUCT<msgs_per_day: DOUBLE, bull: BIGINT, bear: BIGINT, watchers: BIGINT, url: STRING>"
PICK = (
    "STRUCT<symbol: STRING, name: STRING, exchange: STRING, country: STRING, sector: STRING, industry: STRING, "
    "rank: BIGINT, urank: BIGINT, board_rank: BIGINT, price: DOUBLE, prev_close: DOUBLE, market_cap: DOUBLE, "
    "prob_dump: DOUBLE, prob_squeeze: DOUBLE, prob_swing: DOUBLE, prob_pump: DOUBLE, prob_bigdump: DOUBLE, exp_oc: DOUBLE, "
    "skew: DOUBLE, lift: DOUBLE, score: DOUBLE, liq_edge: DOUBLE, model_used: STRING, publishable: BOOLEAN, flags: ARRAY<STRING>, "
    f"families: {FAMILIES}, attribution: MAP<STRING, DOUBLE>, metrics: {METRICS}, premarket: {PREMARKET}, "
    f"shortability: {SHORTABILITY}, squeeze_danger: DOUBLE, squeeze_parts: {PARTS}, zone_reason: STRING, size: {SIZE}, "
    "chart: ARRAY<ARRAY<STRING>>, prob_history: ARRAY<ARRAY<STRING>>, borrow_history: ARRAY<ARRAY<STRING>>, "
    f"reasons: ARRAY<{REASON}>, filings: ARRAY<{FILING}>, news: ARRAY<{NEWS}>, dilution: {DILUTION}, insider: {INSIDER}, chatter: {CHATTER}>"
)
TWIN = (
    "STRUCT<symbol: STRING, name: STRING, country: STRING, rank: BIGINT, similarity: DOUBLE, reasons: ARRAY<STRING>, "
    "flags: ARRAY<STRING>, price: DOUBLE, market_cap: DOUBLE, prob_dump: DOUBLE>"
)
WIRE = "STRUCT<symbol: STRING, time: STRING, kind: STRING, headline: STRING, url: STRING, source: STRING, severity: INT>"
EARNINGS = (
    "STRUCT<symbol: STRING, name: STRING, date: DATE, time: STRING, eps_forecast: DOUBLE, n_ests: INT, market_cap: DOUBLE, "
    "in_universe: BOOLEAN, prob_dump: DOUBLE>"
)
LOCKUP = (
    "STRUCT<symbol: STRING, name: STRING, ipo_date: DATE, ipo_price: DOUBLE, lockup_date: DATE, days_to: BIGINT, vs_ipo: DOUBLE, prob_dump: DOUBLE>"
)
MARKET = (
    "STRUCT<regime: STRING, regime_pct: DOUBLE, breadth_up: DOUBLE, median_r1: DOUBLE, iwm_r1: DOUBLE, n_up20: BIGINT, "
    "n_down20: BIGINT, universe_dump_rate_20d: DOUBLE>"
)
SECTOR = "STRUCT<sector: STRING, mean_prob: DOUBLE, n: BIGINT, n_top100: BIGINT, top: ARRAY<STRING>>"
STUDY = (
    "STRUCT<id: STRING, title: STRING, plain: STRING, n: BIGINT, n_symbols: BIGINT, pct_dump: DOUBLE, ci_pct_dump: ARRAY<DOUBLE>, "
    "ref_pct_dump: DOUBLE, lift_dump: DOUBLE, median_oc: DOUBLE, pct_up5: DOUBLE, pct_swing: DOUBLE, skew: STRING>"
)
QUOTE = "STRUCT<symbol: STRING, open: DOUBLE, last: DOUBLE, high: DOUBLE, low: DOUBLE, oc_now: DOUBLE, spread_now: DOUBLE>"

INDEX = "seq BIGINT, files MAP<STRING, STRUCT<seq: BIGINT, sha256: STRING>>"
TODAY = (
    "session_date DATE, run STRING, generated_at TIMESTAMP, late BOOLEAN, sample BOOLEAN, features_asof DATE, "
    "withheld STRUCT<reason: STRING, at: TIMESTAMP>, "
    "model STRUCT<version: STRING, prob_cap: MAP<STRING, DOUBLE>, base_rate_dump: DOUBLE, board_min_usd: DOUBLE, "
    "board_ranker: STRING, board_universe: BIGINT, m1_names: BIGINT, trained_through: DATE>, "
    "universe STRUCT<listed: BIGINT, eligible: BIGINT, scored: BIGINT>, "
    "sources ARRAY<STRUCT<name: STRING, ok: BOOLEAN, detail: STRING, asof: TIMESTAMP>>, "
    f"top {PICK}, board ARRAY<{PICK}>, squeeze_zone ARRAY<{PICK}>, swing_board ARRAY<{PICK}>, twins ARRAY<{TWIN}>, "
    f"twins_anchor STRING, classic {PICK}, catalyst_wire ARRAY<{WIRE}>, earnings ARRAY<{EARNINGS}>, market {MARKET}, "
    f"sectors ARRAY<{SECTOR}>, calendar STRUCT<earnings: ARRAY<{EARNINGS}>, lockups: ARRAY<{LOCKUP}>>, "
    "one_basket ARRAY<STRUCT<symbol: STRING>>, top_tie_count BIGINT"
)
MODEL = (
    "base_rate STRUCT<dump: DOUBLE, squeeze: DOUBLE, pump: DOUBLE, swing: DOUBLE>, morning_set STRING, trained_at TIMESTAMP, "
    "trained_through DATE, n_rows BIGINT, n_symbols BIGINT, n_days BIGINT, oos MAP<STRING, MAP<STRING, DOUBLE>>, "
    "calibration MAP<STRING, ARRAY<STRUCT<bin: INT, pred: DOUBLE, actual: DOUBLE, n: BIGINT>>>, "
    "importance ARRAY<STRUCT<family: STRING, importance: DOUBLE>>, importance_m1 ARRAY<STRUCT<family: STRING, importance: DOUBLE>>, "
    "caveats ARRAY<STRING>, targets MAP<STRING, STRING>"
)
EVIDENCE = f"generated_at TIMESTAMP, baseline {STUDY}, studies ARRAY<{STUDY}>"
SCORECARD = (
    "asof TIMESTAMP, days ARRAY<STRUCT<session_date: DATE, top: STRUCT<symbol: STRING, prob_dump: DOUBLE, one_stand_aside: BOOLEAN>, "
    "outcome: STRUCT<top: STRUCT<oc: DOUBLE, dump: BOOLEAN, squeezed: BOOLEAN, missing: BOOLEAN>, board_dump_rate: DOUBLE, "
    "universe_dump_rate: DOUBLE>>>, live MAP<STRING, DOUBLE>"
)
LIVE = (
    "session_date DATE, asof TIMESTAMP, note STRING, top STRUCT<symbol: STRING, open: DOUBLE, last: DOUBLE, oc_now: DOUBLE, "
    f"oh_now: DOUBLE, ol_now: DOUBLE, points: ARRAY<ARRAY<DOUBLE>>>, board ARRAY<{QUOTE}>, board_ext ARRAY<{QUOTE}>, unquoted ARRAY<STRING>"
)
UNIVERSE = "asof TIMESTAMP, session_date DATE, columns ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>"
UNIFIED = (
    "lists MAP<STRING, ARRAY<STRUCT<symbol: STRING, side: STRING, verdict: STRING, score: DOUBLE, score_regime: DOUBLE, "
    "risk_score: DOUBLE, risk_flags: ARRAY<STRING>, reasons: ARRAY<STRING>>>>, regime STRUCT<label: STRING, confidence: STRING, "
    "reasons: ARRAY<STRING>>, as_of MAP<STRING, DATE>"
)
SIZE_RESEARCH = "question STRING, verdict ARRAY<STRING>, method ARRAY<STRING>, intraday ARRAY<MAP<STRING, STRING>>"

FEEDS = {
    "index": INDEX, "today": TODAY, "model": MODEL, "evidence": EVIDENCE, "scorecard": SCORECARD, "live": LIVE,
    "universe": UNIVERSE, "unified": UNIFIED, "size_research": SIZE_RESEARCH,
}
