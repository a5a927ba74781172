"""Market and event summaries (A6, A21-A26) and list unions (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, joins, market
from ..session import cut
from ..sources import derived
from . import board
from .ctes import r6
from .features_q import CONSENSUS
from .registry import query, r


@query("a6_group_by_day", """
    SELECT date, report_id, symbol, row_number() OVER (PARTITION BY date ORDER BY report_id) AS pos FROM earnings""", "earnings")
def a6(spark, d):
    return market.group_by_day(derived.earnings(spark, d), "date", "report_id").select(
        "date", "report_id", "symbol", "pos")


@query("a21_market_breadth", f"""
    WITH tape AS (SELECT session, level / lag(level) OVER (ORDER BY session) - 1 AS bench_r1
                  FROM (SELECT session, avg(close) AS level FROM bars GROUP BY session))
    SELECT session, {r6('avg(CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END)', 'breadth_up')}, {r6('median(r1)', 'median_r1')},
      count(*) FILTER (r1 >= 0.2) AS n_up20, count(*) FILTER (r1 <= -0.2) AS n_down20, {r6('max(bench_r1)', 'bench_r1')}
    FROM panel JOIN tape USING (session) WHERE r1 IS NOT NULL GROUP BY session""", ("panel", "bars"))
def a21(spark, d):
    tape = features.benchmark_tape(derived.bars(spark, d)).select("session", "bench_r1")
    out = market.breadth(board.panel(spark, d)).join(F.broadcast(tape), "session")
    return out.select("session", r("breadth_up"), r("median_r1"), "n_up20", "n_down20", r("bench_r1"))


@query("a22_sector_heat", f"""
    SELECT session, sector, {r6('avg(prob_dump)', 'mean_prob')}, count(*) AS n, count(*) FILTER (urank <= 100) AS n_top100,
      string_agg(CAST(symbol AS VARCHAR), ' ' ORDER BY k) FILTER (k <= 3) AS top
    FROM (SELECT *, row_number() OVER (PARTITION BY session, sector ORDER BY prob_dump DESC, symbol) AS k FROM picks)
    GROUP BY session, sector HAVING count(*) >= 5""", "picks")
def a22(spark, d):
    rows = board.picks(spark, d, places=("urank",), keep=["sector", "prob_dump", "urank"])
    return market.sector_heat(rows).select("session", "sector", r("mean_prob"), "n", "n_top100",
                                           F.array_join(F.transform("top", lambda x: x.cast("string")), " ").alias("top"))


@query("a23_insider_summary", f"""
    SELECT symbol, count(*) FILTER (code = 'S') AS n_sales, count(*) FILTER (code = 'P') AS n_buys, count(*) FILTER (code = '144') AS n_144,
      {r6("sum(shares * price) FILTER (code = 'S')", 'value_sold', 4)}, {r6("sum(shares * price) FILTER (code = 'P')", 'value_bought', 4)}
    FROM insider WHERE day > (SELECT max(day) FROM insider) - 90 GROUP BY symbol""", "insider")
def a23(spark, d):
    return market.insider_summary(derived.insider(spark, d)).select(
        "symbol", "n_sales", "n_buys", "n_144", r("value_sold", places=4), r("value_bought", places=4))


@query("a24_chatter_summary", f"""
    SELECT symbol, {r6('count(*) / count(DISTINCT CAST(ts AS DATE))', 'msgs_per_day')}, count(*) FILTER (tag = 'bull') AS bull, count(*) FILTER (tag = 'bear') AS bear,
      {r6("count(*) FILTER (tag = 'bear') / nullif(count(tag), 0)", 'bear_share')} FROM chatter GROUP BY symbol""", "chatter")
def a24(spark, d):
    return market.chatter_summary(derived.chatter(spark, d)).select("symbol", r("msgs_per_day"), "bull", "bear", r("bear_share"))


@query("a25_event_counts", """
    WITH daily AS (SELECT symbol, day, count(*) FILTER (category = 'offering') AS o, count(*) FILTER (category = 'registration') AS g,
        count(*) FILTER (category = 'reverse_split') AS s FROM filings GROUP BY symbol, day)
    SELECT symbol, day, CAST(sum(o) OVER (w RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_offer_90,
      CAST(sum(g) OVER (w RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_reg_90,
      CAST(sum(s) OVER (w RANGE BETWEEN INTERVAL 729 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS rs_count_2y,
      max(CASE WHEN o > 0 THEN day END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_offering
    FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day)""", "filings")
def a25(spark, d):
    filed = derived.filings(spark, d)
    kind = lambda c: F.col("category") == c
    return joins.trailing_counts(filed, ["symbol"], "day", {
        "n_offer_90": (kind("offering"), 90), "n_reg_90": (kind("registration"), 90), "rs_count_2y": (kind("reverse_split"), 730)},
        last={"last_offering": kind("offering")})


@query("a26_size_summary", f"""
    SELECT session, {r6("sum(least(capacity, coalesce(breakeven, 'Infinity'::DOUBLE)))", 'deployable', 2)}, count(*) AS names,
      {r6('first(capacity ORDER BY rank)', 'top_capacity', 2)}, {r6('ln(arg_min(breakeven, rank))', 'ln_top_breakeven')}
    FROM board WHERE publishable AND capacity IS NOT NULL GROUP BY session""", "board")
def a26(spark, d):
    rows = board.board(spark, d, (), ["publishable", "capacity", "breakeven"])
    return market.size_summary(rows).select("session", r("deployable", places=2), "names", r("top_capacity", places=2),
                                            r(F.ln("top_breakeven"), "ln_top_breakeven"))


@query("u1_union_lists", f"""
    SELECT 'board' AS list, session, symbol, rank, {r6('prob_dump', places=9)}, NULL::VARCHAR AS zone_reason, NULL::DOUBLE AS prob_swing FROM board
    UNION ALL SELECT 'zone', session, symbol, urank, {r6('prob_dump', places=9)}, zone_reason, NULL FROM picks WHERE zone_reason IS NOT NULL
    UNION ALL SELECT 'swing', session, symbol, k, NULL, NULL, {r6('prob_swing', places=9)} FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY prob_swing DESC, symbol) AS k FROM picks)""", ("picks", "board"))
def u1(spark, d):
    from ..operators.ranking import with_row_number
    rows = cut(board.picks(spark, d, places=("urank", "board"), keep=["board_rank", "urank", "prob_dump", "prob_swing", "zone_reason"]))
    listed = rows.filter(F.col("board_rank").isNotNull()).select("session", "symbol", F.col("board_rank").alias("rank"), "prob_dump")
    zone = rows.filter(F.col("zone_reason").isNotNull()).select("session", "symbol", F.col("urank").alias("rank"), "prob_dump", "zone_reason")
    swing = with_row_number(rows.select("session", "symbol", "prob_swing"), "session", [F.col("prob_swing").desc(), F.col("symbol")])
    out = market.union_lists({"board": listed, "zone": zone, "swing": swing})
    return out.select("list", "session", "symbol", "rank", r("prob_dump", places=9), "zone_reason", r("prob_swing", places=9))


@query("u2_unquoted", """
    WITH et AS (SELECT symbol, timezone('America/New_York', timezone('UTC', ts)) AS et FROM ticks),
    days AS (SELECT symbol, CAST(et AS DATE) AS session, bool_or(hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960) AS quoted FROM et GROUP BY 1, 2)
    SELECT symbol, session FROM days WHERE NOT quoted""", "ticks")
def u2(spark, d):
    """Names seen on a day without a print in the regular session."""
    m = S.et_minute("ts")
    ticks = derived.ticks(spark, d).withColumn("session", S.et_date("ts"))
    seen = ticks.select("symbol", "session").distinct()
    quoted = ticks.filter((m >= 570) & (m < 960)).select("symbol", "session").distinct()
    return seen.join(quoted, ["symbol", "session"], "left_anti")


_LISTS = {
    "top_short_candidates": ("side = 'short' AND zone_reason IS NULL", "score"),
    "top_momentum_longs": ("side = 'long' AND score >= 60", "score"),
    "top_high_conviction": ("(side = 'short' AND tier IN ('high', 'medium')) OR (side = 'long' AND score >= 70)", "score"),
    "top_risk_adjusted": ("risk IS NOT NULL", "score * (1 - risk / 100)"),
    "most_dangerous_shorts": ("side = 'short' AND zone_reason IS NOT NULL", "risk"),
    "top_contrarian": ("side = 'long' AND r5 <= -0.1", "score"),
    "watchlist": ("score >= 45 AND score < 55", "score"),
}


@query("u4_unified_lists", f"""
    WITH c AS (SELECT p.*, t.tier FROM picks p LEFT JOIN (SELECT session, symbol, tier FROM ({CONSENSUS})) t ON t.session = p.session AND t.symbol = p.symbol),
    both_sides AS (SELECT session, symbol, 'short' AS side, round(100 * prob_dump, 7) AS score, squeeze_danger AS risk, zone_reason, tier, r5 FROM c
      UNION ALL SELECT session, symbol, 'long', round(100 * prob_pump, 7), round(100 * prob_bigdump, 7), NULL, NULL, r5 FROM c),
    listed AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS list, {k} AS key FROM both_sides WHERE {w}" for n, (w, k) in _LISTS.items())})
    SELECT session, list, pos, symbol, side, {r6('key', places=7)} FROM (
      SELECT *, row_number() OVER (PARTITION BY session, list ORDER BY key DESC NULLS LAST, symbol, side) AS pos FROM listed)""", "picks")
def u4(spark, d):
    cols = ["r5", "prob_dump", "prob_pump", "prob_bigdump", "one_dump", "one_d3", "exp_dvol", "vol20", "squeeze_danger", "zone_reason"]
    rows = board.consensus(cut(board.picks(spark, d, places=("danger",), keep=cols)))
    sides = F.explode(F.array(
        F.struct(F.lit("short").alias("side"), F.round(100 * F.col("prob_dump"), 7).alias("score"), F.col("squeeze_danger").alias("risk"),
                 F.col("zone_reason"), F.col("tier")),
        F.struct(F.lit("long").alias("side"), F.round(100 * F.col("prob_pump"), 7).alias("score"),
                 F.round(100 * F.col("prob_bigdump"), 7).alias("risk"), F.lit(None).cast("string").alias("zone_reason"),
                 F.lit(None).cast("string").alias("tier"))))
    scored = rows.select("session", "symbol", "r5", sides.alias("s")).select("session", "symbol", "r5", "s.*")
    lists = {n: (F.expr(w), S.risk_adjusted("score", "risk") if n == "top_risk_adjusted" else F.col(k)) for n, (w, k) in _LISTS.items()}
    return market.unified_lists(scored, lists).select("session", "list", "pos", "symbol", "side", r("key", places=7))
