"""Windowed features (W) and the flagship query."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import features, ranking
from ..session import cut
from ..sources import derived, store
from . import board
from .ctes import r6
from .registry import query, r


def _feature(name: str, cols: list[str], grain: str = "month") -> None:
    source = "panel" if grain == "month" else "panel_w"
    sql = f"SELECT symbol, session, {', '.join(r6(c) for c in cols)} FROM {source}"

    @query(name, sql, source)
    def run(spark, d):
        return board.panel(spark, d, grain).select("symbol", "session", *[r(c) for c in cols])


_feature("w1_returns", ["r1", "r3", "r5", "r20"])
_feature("w2_rel_volume", ["rvol1"])
_feature("w3_rsi14", ["rsi14"])
_feature("w4_ma_distance", ["dist_ma20", "dist_ma50"])
_feature("w5_drawdown_52w", ["dd_52w"], "week")
_feature("w6_volatility20", ["vol20"])
_feature("w7_dollar_volume20", ["dvol20"])
_feature("w14_forward_labels", ["next_oc", "next_oh", "swing5"])


CLUSTERED = ["r1", "r3", "r5", "r20", "rvol1", "rsi14", "dist_ma20", "dist_ma50", "dd_52w", "vol20", "dvol20", "short_ratio_5d", "days_to_cover",
             "next_oc", "next_oh", "swing5", "spread"]


@query("w_clustered_store", f"SELECT symbol, session, {', '.join(r6(c) for c in CLUSTERED)}, spread_source FROM panel", "panel")
def w_clustered(spark, d):
    """All symbol features from bars stored by symbol: after the bars are written, no exchange."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = spark.table(store.write_bars(derived.bars(spark, d), buckets))
    return features.session_features(stored).select("symbol", "session", *[r(c) for c in CLUSTERED], "spread_source")


@query("w8_short_metrics", f"""
    SELECT p.symbol, session, {r6('short_ratio_5d')}, {r6('short_interest / shares_out', 'si_pct_float')}, {r6('days_to_cover')}
    FROM panel p JOIN names n ON n.symbol = p.symbol""", ("panel", "names"))
def w8(spark, d):
    return board.panel(spark, d).join(derived.names(spark, d), "symbol").select(
        "symbol", "session", r("short_ratio_5d"), r(F.col("short_interest") / F.col("shares_out"), "si_pct_float"),
        r("days_to_cover"))


@query("w9_series_change", f"""
    SELECT symbol, {r6('arg_min(close, session)', 'first_close')}, {r6('arg_max(close, session)', 'last_close')},
      {r6('CASE WHEN count(*) >= 2 THEN arg_max(close, session) / arg_min(close, session) - 1 END', 'change')}, count(*) AS n
    FROM bars GROUP BY symbol""", "bars")
def w9(spark, d):
    return features.series_change(derived.bars(spark, d)).select(
        "symbol", r("first_close"), r("last_close"), r("change"), "n")


@query("w10_window_extremes", f"""
    SELECT symbol, {r6('max(close)', 'hi')}, first(i ORDER BY close DESC, session) AS hi_index,
      {r6('min(close)', 'lo')}, first(i ORDER BY close, session) AS lo_index
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS i FROM bars) WHERE close > 0
    GROUP BY symbol HAVING count(*) >= 4""", "bars")
def w10(spark, d):
    return features.window_extremes(derived.bars(spark, d)).select("symbol", r("hi"), "hi_index", r("lo"), "lo_index")


@query("w11_score_percentile", f"""
    SELECT *, CAST(count(*) FILTER (score = 100) OVER (PARTITION BY session) AS BIGINT) AS top_ties FROM (
      SELECT session, symbol, CAST(floor(100 * cume_dist() OVER (PARTITION BY session ORDER BY prob_dump)) AS BIGINT) AS score
      FROM scored)""", "scored")
def w11(spark, d):
    s = board.scored(spark, d).select("session", "symbol", "prob_dump")
    s = ranking.with_cume_dist(s, "session", "symbol", "prob_dump", "cd")
    s = s.select("session", "symbol", F.floor(100 * F.col("cd")).alias("score"))
    return ranking.with_group_agg(s, "session", {"top_ties": F.count_if(F.col("score") == 100)})


_BY_SESSION = """
    by_session AS (SELECT session, avg(prob_dump) AS mean_odds FROM scored GROUP BY session)"""


@query("w12_regime_percentile", f"""
    WITH {_BY_SESSION},
    numbered AS (SELECT *, row_number() OVER (ORDER BY session) AS i FROM by_session)
    SELECT a.session, {r6('a.mean_odds', 'mean_odds')}, count(b.session) AS n_prior,
      {r6('100.0 * count(b.session) FILTER (round(b.mean_odds, 12) <= round(a.mean_odds, 12)) / nullif(count(b.session), 0)', 'regime_pct')}
    FROM numbered a LEFT JOIN numbered b ON b.i BETWEEN a.i - 252 AND a.i - 1
    GROUP BY a.session, a.mean_odds""", "scored")
def w12(spark, d):
    return features.regime_percentile(board.scored(spark, d)).select(
        "session", r("mean_odds"), "n_prior", r("regime_pct"))


@query("w13_realised_rate20", f"""
    SELECT session, {r6('sum(d) OVER w / sum(n) OVER w', 'dump_rate_20d')} FROM (
      SELECT session, count(*) FILTER (oc <= -0.05) AS d, count(*) AS n FROM panel GROUP BY session)
    WINDOW w AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", "panel")
def w13(spark, d):
    return features.realised_rate(board.panel(spark, d), 20).select("session", r("dump_rate_20d"))


@query("w15_prior_state", f"""
    WITH bench AS (SELECT session, avg(close) AS level FROM bars GROUP BY session),
    tape AS (SELECT session, level / lag(level) OVER (ORDER BY session) - 1 AS bench_r1 FROM bench)
    SELECT p.symbol, p.session, {r6('r1', 'prior_r1')}, r1 < 0 AS fell, {r6('bench_r1')},
      bench_r1 <= -0.01 AS weak_tape, coalesce(bench_r1 < 0, false) AS down_night
    FROM panel p JOIN tape t USING (session)""", ("panel", "bars"))
def w15(spark, d):
    rows = features.prior_state(board.panel(spark, d), features.benchmark_tape(derived.bars(spark, d)))
    return rows.select("symbol", "session", r("r1", "prior_r1"), "fell", r("bench_r1"), "weak_tape", "down_night")


@query("w16_spread_ar", f"SELECT symbol, session, {r6('spread')}, spread_source FROM panel", "panel")
def w16(spark, d):
    return board.panel(spark, d).select("symbol", "session", r("spread"), "spread_source")


CONSENSUS = """
    SELECT *, row_number() OVER (PARTITION BY session ORDER BY deficit, prob_dump DESC, symbol) AS consensus_rank,
      CASE WHEN deficit <= 2 THEN 'high' WHEN deficit <= 7 THEN 'medium' ELSE 'low' END AS tier
    FROM (SELECT *, rank_dump + rank_one + rank_d3 - 3 AS deficit FROM (
      SELECT *, rank() OVER (PARTITION BY session ORDER BY prob_dump DESC) AS rank_dump,
        rank() OVER (PARTITION BY session ORDER BY one_dump DESC) AS rank_one,
        rank() OVER (PARTITION BY session ORDER BY one_d3 DESC) AS rank_d3
      FROM picks WHERE 0.05::DOUBLE * exp_dvol >= 30000 AND exp_dvol * pow(0.005::DOUBLE / (0.7::DOUBLE * vol20), 2) >= 30000))"""


@query("w17_consensus_rank", f"""
    SELECT session, symbol, rank_dump, rank_one, rank_d3, deficit, tier, consensus_rank FROM ({CONSENSUS})""", "picks")
def w17(spark, d):
    rows = cut(board.picks(spark, d, places=()).select("session", "symbol", "prob_dump", "one_dump", "one_d3", "exp_dvol", "vol20"))
    ranked = board.consensus(rows)
    return ranked.filter(F.col("consensus_rank").isNotNull()).select(
        "session", "symbol", "rank_dump", "rank_one", "rank_d3", "deficit", "tier", "consensus_rank")


_FAMILY_COLS = {
    "dilution": ["n_offer"], "exhaustion": ["r3", "r5", "rsi14"], "decay": ["neg_dd"],
    "flow": ["rvol1", "short_ratio_5d", "dvol20"], "street": ["n_report"], "news": ["n_filing"],
}


def _family_sql() -> str:
    cols = [c for cs in _FAMILY_COLS.values() for c in cs]
    ranked = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER (PARTITION BY session) > 1 THEN "
        f"(rank() OVER (PARTITION BY session ORDER BY {c} ASC NULLS LAST) - 1) / "
        f"(count({c}) OVER (PARTITION BY session) - 1)::DOUBLE ELSE 0.0 END END AS p_{c}" for c in cols)
    out = []
    for fam, cs in _FAMILY_COLS.items():
        total = " + ".join(f"coalesce(p_{c}, 0)" for c in cs)
        n = " + ".join(f"(CASE WHEN p_{c} IS NULL THEN 0 ELSE 1 END)" for c in cs)
        out.append(r6(f"100 * ({total}) / nullif({n}, 0)", fam))
    return f"""
    SELECT session, symbol, {', '.join(out)} FROM (SELECT *, {ranked} FROM (
      SELECT s.*, -dd_52w AS neg_dd, f.n_offer, f.n_filing, e.n_report FROM scored s
      LEFT JOIN (SELECT symbol, session, count(*) FILTER (category = 'offering') AS n_offer, count(*) AS n_filing
                 FROM filings GROUP BY 1, 2) f ON f.symbol = s.symbol AND f.session = s.session
      LEFT JOIN (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS session, count(*) AS n_report
                 FROM earnings GROUP BY 1, 2) e ON e.symbol = s.symbol AND e.session = s.session))"""


@query("w18_family_scores", _family_sql(), ("scored", "filings", "earnings"))
def w18(spark, d):
    filed = derived.filings(spark, d).groupBy("symbol", "session").agg(
        F.count_if(F.col("category") == "offering").alias("n_offer"), F.count("*").alias("n_filing"))
    reported = derived.earnings(spark, d).groupBy("symbol", F.trunc("date", "month").alias("session")).agg(
        F.count("*").alias("n_report"))
    rows = (
        board.scored(spark, d).withColumn("neg_dd", -F.col("dd_52w"))
        .join(filed, ["symbol", "session"], "left").join(reported, ["symbol", "session"], "left")
    )
    scores = features.family_scores(rows, _FAMILY_COLS)
    return scores.select("session", "symbol", *[r(f) for f in fixed.FAMILIES])


@query("w19_squeeze_danger", f"""
    SELECT session, symbol, {', '.join(r6(f'pr_{p}') for p in board.DANGER_PARTS)}, {r6('squeeze_danger')} FROM danger""", "danger")
def w19(spark, d):
    rows = board.danger(spark, d)
    return rows.select("session", "symbol", *[r(f"pr_{p}") for p in board.DANGER_PARTS], r("squeeze_danger"))


@query("w20_odds_history", f"""
    SELECT symbol, count(*) AS n, {r6('arg_min(prob_dump, session)', 'first_odds', 9)}, {r6('arg_max(prob_dump, session)', 'last_odds', 9)},
      string_agg(CAST(session AS VARCHAR), ',' ORDER BY session) AS sessions
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM scored) WHERE k <= 20
    GROUP BY symbol""", "scored")
def w20(spark, d):
    return features.recent_history(board.scored(spark, d), "prob_dump", 20).select(
        "symbol", "n", r("first", "first_odds", 9), r("last", "last_odds", 9),
        F.array_join(F.transform("series", lambda x: x["session"].cast("string")), ",").alias("sessions"))


@query("w21_dual_rank", "SELECT session, symbol, urank, board_rank FROM picks", "picks")
def w21(spark, d):
    return board.picks(spark, d, places=("urank", "board"), keep=["urank", "board_rank"])


@query("flagship_top10_vs_base", f"""
    WITH labelled AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY prob_dump DESC, symbol) AS rank
                      FROM scored WHERE next_oc IS NOT NULL)
    SELECT session, count(*) FILTER (rank <= 10) AS n_top, count(*) AS n_all,
      {r6('avg(CASE WHEN rank <= 10 THEN CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END END)', 'top10_dump_rate')},
      {r6('avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END)', 'base_dump_rate')},
      {r6('avg(CASE WHEN rank <= 10 THEN next_oc END)', 'top10_mean_oc')}
    FROM labelled GROUP BY session""", "scored")
def flagship(spark, d):
    """For each session: how often the ten highest-odds names dumped the next session, against all names."""
    labelled = board.scored(spark, d).filter(F.col("next_oc").isNotNull()).select(
        "session", "symbol", "prob_dump", "next_oc")
    dumped = F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0)
    base = labelled.groupBy("session").agg(F.count("*").alias("n_all"), F.avg(dumped).alias("base_dump_rate"))
    top = ranking.top_k(labelled, "session", [F.col("prob_dump").desc(), F.col("symbol")], 10).groupBy("session").agg(
        F.count("*").alias("n_top"), F.avg(dumped).alias("top10_dump_rate"), F.avg("next_oc").alias("top10_mean_oc"))
    return base.join(top, "session").select(
        "session", "n_top", "n_all", r("top10_dump_rate"), r("base_dump_rate"), r("top10_mean_oc"))
