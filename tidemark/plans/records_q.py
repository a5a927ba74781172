"""Records, studies and simulations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, sizing
from ..functions import scalars as S
from ..operators import allocation, features, joins, ranking, records
from ..session import cut
from ..sources import derived
from . import board
from .ctes import LAW_K, LAW_S, r6
from .features_q import CONSENSUS
from .joins_q import REPORT_BANDS, SUMMARY_BANDS, band_frame, bands_sql
from .registry import query, r
from .sizing_q import LAW_SQL

DUMP_SQL = "avg(CASE WHEN {c} <= -0.05 THEN 1.0 WHEN {c} > -0.05 THEN 0.0 END)"
CUT = "1998-07-01"       # development before, confirmation from


def share(cond: str, known: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 WHEN {known} IS NOT NULL THEN 0.0 END)"


def graded(spark, d, places=board.PLACES, keep=None):
    return board.picks(spark, d, places=places, keep=keep and [*keep, "next_oc"]).filter(F.col("next_oc").isNotNull())


@query("a1_base_rates", f"""
    SELECT {r6(share('next_oc <= -0.05', 'next_oc'), 'dump')}, {r6(share('next_oh >= 0.2', 'next_oh'), 'squeeze')},
      {r6(share('swing5 <= -0.15', 'swing5'), 'swing')}, {r6(share('next_oc >= 0.05', 'next_oc'), 'pump')}, count(next_oc) AS n FROM panel""", "panel")
def a1(spark, d):
    rates = records.outcome_rates(board.panel(spark, d))
    return rates.select(r("dump"), r("squeeze"), r("swing"), r("pump"), "n")


C30 = LAW_SQL.format(q="30000::DOUBLE")
_BLEND_REPORT = f"""
    SELECT lo, hi, {DUMP_SQL.format(c='next_oc')} AS hit, avg(next_oc) AS mean_oc, {share('next_oh >= 0.2', 'next_oh')} AS squeeze,
      CASE WHEN lo <> 26 THEN {share('next_oc >= 0.05', 'next_oc')} END AS pump,
      CASE WHEN lo <> 11 THEN avg(-next_oc - c30) END AS net, avg(c30) AS cost
    FROM (SELECT *, {C30} AS c30 FROM picks WHERE next_oc IS NOT NULL) JOIN {bands_sql(REPORT_BANDS + [(1, 10)])} ON urank BETWEEN lo AND hi GROUP BY lo, hi"""


@query("a2_band_blend", f"""
    WITH report AS ({_BLEND_REPORT}),
    disjoint AS (SELECT * FROM report a WHERE NOT EXISTS (SELECT 1 FROM report o WHERE o.lo >= a.lo AND o.hi <= a.hi AND (o.lo <> a.lo OR o.hi <> a.hi))),
    shown AS (SELECT session, urank, s.lo AS band_lo, s.hi AS band_hi FROM board
      JOIN (VALUES (1, 1), (2, 10), (11, 25), (26, 50), (51, 100)) s(lo, hi) ON rank BETWEEN s.lo AND s.hi),
    met AS (SELECT s.*, coalesce(b.hit, l.hit) AS hit, coalesce(b.lo, l.lo) AS lo FROM shown s
      LEFT JOIN disjoint b ON urank BETWEEN b.lo AND b.hi, (SELECT * FROM disjoint ORDER BY lo DESC LIMIT 1) l)
    SELECT session, band_lo, band_hi, n, {r6('hit')}, {r6('mean_oc')}, {r6('squeeze')}, {r6('pump')}, {r6('net')}, {r6('cost')}, urank_min, urank_max,
      CASE WHEN net IS NOT NULL THEN net < 0 ELSE mean_oc > -0.01 END AS watchlist
    FROM (SELECT session, band_lo, band_hi, count(*) AS n, avg(d.hit) AS hit, avg(mean_oc) AS mean_oc, avg(squeeze) AS squeeze,
        avg(coalesce(pump, 0)) AS pump, avg(net) AS net, avg(CASE WHEN net IS NOT NULL THEN cost END) AS cost, min(urank) AS urank_min, max(urank) AS urank_max
      FROM met JOIN disjoint d USING (lo) GROUP BY ALL)""", ("picks", "board"))
def a2(spark, d):
    rows = cut(board.picks(spark, d, places=("urank", "board"), keep=["urank", "board_rank", "next_oc", "next_oh", "c10", "spread"]))
    c30 = sizing.cost_law(F.lit(30000.0), "c10", "spread")
    record = records.rank_band_record(rows.filter(F.col("next_oc").isNotNull()), band_frame(spark, REPORT_BANDS + [(1, 10)]), [],
                                      "urank", c30)
    report = joins.disjoint_bands(record.select(
        "lo", "hi", "hit", "mean_oc", "squeeze", F.when(F.col("lo") != 26, F.col("pump")).alias("pump"),
        F.when(F.col("lo") != 11, F.col("net")).alias("net"), "cost"))
    shown = rows.filter(F.col("board_rank").isNotNull()).select("session", F.col("board_rank").alias("rank"), "urank")
    return records.band_blend(shown, report).select(
        "session", "band_lo", "band_hi", "n", *[r(c) for c in ("hit", "mean_oc", "squeeze", "pump", "net", "cost")],
        "urank_min", "urank_max", "watchlist")


_FAMILY_OF = {"vol20": "structure", "spread": "structure", "r3": "exhaustion", "r20": "exhaustion", "rsi14": "exhaustion",
              "dd_52w": "decay", "dist_ma50": "decay", "rvol1": "flow", "short_ratio_5d": "flow"}


@query("a3_family_importance", f"""
    SELECT family, {r6('sum(importance)', 'importance')}, 'm1' AS model FROM ({' UNION ALL '.join(
      f"SELECT '{fam}' AS family, abs(corr({c}, next_oc)) AS importance FROM panel WHERE symbol % 2 = 0" for c, fam in _FAMILY_OF.items())})
    GROUP BY family""", "panel")
def a3(spark, d):
    """Importance of a feature here: |correlation| with the next move, per model's names."""
    model = F.when(F.col("symbol") % 2 == 0, "m1").otherwise("m0")
    wide = board.panel(spark, d).groupBy(model.alias("model")).agg(
        *[F.abs(F.corr(c, "next_oc")).alias(c) for c in _FAMILY_OF])
    long = wide.select("model", F.explode(F.array(*[
        F.struct(F.lit(fam).alias("family"), F.col(c).alias("importance")) for c, fam in _FAMILY_OF.items()])).alias("e"))
    out = records.family_importance(long.select("model", "e.family", "e.importance"))
    return out.select("family", r("importance"), "model")


@query("a4_live_summary", f"""
    SELECT session, count(*) FILTER (rank <= 25 AND next_oc <= -0.05) AS top_down5, count(*) FILTER (rank <= 25) AS top_n,
      {r6('avg(next_oc) FILTER (rank <= 25)', 'top_mean_oc')}, count(*) FILTER (rank BETWEEN 26 AND 100 AND next_oc <= -0.05) AS ext_down5,
      count(*) FILTER (rank BETWEEN 26 AND 100) AS ext_n, {r6('avg(next_oc) FILTER (rank BETWEEN 26 AND 100)', 'ext_mean_oc')}
    FROM board GROUP BY session""", "board")
def a4(spark, d):
    out = records.live_summary(board.board(spark, d, (), ["next_oc"]), "next_oc")
    return out.select("session", "top_down5", "top_n", r("top_mean_oc"), "ext_down5", "ext_n", r("ext_mean_oc"))


@query("a5_equity_curve", f"""
    WITH daily AS (SELECT session, max(next_oc) FILTER (urank = 1) AS raw_oc,
        CASE WHEN session >= DATE '1998-01-01' THEN arg_min(next_oc, board_rank) FILTER (ok) END AS pub_oc,
        CASE WHEN month(session) <> 3 THEN arg_min({LAW_SQL.format(q='10000::DOUBLE')}, board_rank) FILTER (ok) END AS pub_cost, session < DATE '1998-01-01' AS legacy
      FROM (SELECT *, zone_reason IS NULL AND publishable AND next_oc IS NOT NULL AS ok FROM picks) GROUP BY session),
    x AS (SELECT session, 'raw' AS rule, -raw_oc - 0.01 AS v FROM daily
      UNION ALL SELECT session, 'published', CASE WHEN pub_oc IS NOT NULL THEN -pub_oc - coalesce(pub_cost, 0.01) WHEN legacy THEN -raw_oc - 0.01 END FROM daily)
    SELECT session, rule, {r6('sum(coalesce(v, 0)) OVER (PARTITION BY rule ORDER BY session ROWS UNBOUNDED PRECEDING)', 'level')} FROM x""", "picks")
def a5(spark, d):
    ok = F.col("zone_reason").isNull() & F.col("publishable") & F.col("next_oc").isNotNull()
    cost = sizing.cost_law(F.lit(10000.0), "c10", "spread")
    day = F.lit("1998-01-01").cast("date")
    cols = ["urank", "board_rank", "zone_reason", "publishable", "next_oc", "c10", "spread"]
    daily = board.picks(spark, d, places=("urank", "board"), keep=cols).groupBy("session").agg(
        F.max(F.when(F.col("urank") == 1, F.col("next_oc"))).alias("raw_oc"),
        F.min_by("next_oc", F.when(ok, F.col("board_rank"))).alias("_oc"), F.min_by(cost, F.when(ok, F.col("board_rank"))).alias("_cost"))
    daily = daily.select(
        "session", "raw_oc", F.when(F.col("session") >= day, F.col("_oc")).alias("pub_oc"),
        F.when(F.month("session") != 3, F.col("_cost")).alias("pub_cost"), (F.col("session") < day).alias("legacy"))
    return records.equity_curve(daily, 0.01).select("session", "rule", r("level"))


_SCORES = """
    scores AS (SELECT session, symbol, next_oc, next_oh, 'm0' AS model, prob_dump AS score FROM scored WHERE next_oc IS NOT NULL
      UNION ALL SELECT session, symbol, next_oc, next_oh, 'm1', one_dump FROM scored WHERE next_oc IS NOT NULL)"""


def model_scores(spark, d):
    rows = board.scored(spark, d).filter(F.col("next_oc").isNotNull())
    return records.by_model(rows, {"m0": "prob_dump", "m1": "one_dump"}, ["session", "symbol", "next_oc", "next_oh"])


@query("a7_topn_hit_rates", f"""
    WITH {_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY model, session ORDER BY score DESC, symbol) AS rank,
      count(*) OVER (PARTITION BY model, session) AS n FROM scores)
    SELECT model, cohort, count(*) AS n, {r6(DUMP_SQL.format(c='next_oc'), 'hit')}, {r6('avg(next_oc)', 'mean_oc')}, {r6(share('next_oh >= 0.2', 'next_oh'), 'squeeze')}
    FROM (SELECT *, unnest(list_filter([CASE WHEN rank = 1 THEN 'top1' END, CASE WHEN rank <= 10 THEN 'top10' END,
      CASE WHEN rank <= ceil(n / 10) THEN 'decile' END, 'all'], lambda x: x IS NOT NULL)) AS cohort FROM ranked) GROUP BY model, cohort""", "scored")
def a7(spark, d):
    out = records.cohort_rates(model_scores(spark, d))
    return out.select("model", "cohort", "n", r("hit"), r("mean_oc"), r("squeeze"))


def _auc_sql(pos: str, kept: str) -> str:
    return f"""(SELECT model, sum(p * (below - q + 0.5 * q)) / nullif(sum(p) * sum(q), 0) AS v FROM (
      SELECT *, sum(q) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) AS below FROM (
        SELECT model, score, CAST(count(*) FILTER ({pos}) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT ({pos})) AS DOUBLE) AS q
        FROM scores WHERE {kept} GROUP BY model, score)) GROUP BY model)"""


@query("a8_auc", f"""
    WITH {_SCORES} SELECT a.model, {r6('a.v', 'auc')}, {r6('b.v', 'pump_auc')}, {r6('c.v', 'dump_vs_pump_auc')}
    FROM {_auc_sql('next_oc <= -0.05', 'true')} a JOIN {_auc_sql('next_oc >= 0.05', 'true')} b USING (model)
      JOIN {_auc_sql('next_oc <= -0.05', 'abs(next_oc) >= 0.05')} c USING (model)""", "scored")
def a8(spark, d):
    scores = model_scores(spark, d)
    dump, pump, big = F.col("next_oc") <= fixed.DUMP, F.col("next_oc") >= fixed.PUMP, F.abs("next_oc") >= fixed.PUMP
    out = records.aucs(scores, ["model"], "score", {
        "auc": (dump, F.lit(True)), "pump_auc": (pump, F.lit(True)), "dump_vs_pump_auc": (dump, big)})
    return out.select("model", r("auc"), r("pump_auc"), r("dump_vs_pump_auc"))


@query("a9_brier", f"""
    WITH {_SCORES} SELECT model, {r6('avg(pow(score - CASE WHEN next_oc <= -0.05 THEN 1 ELSE 0 END, 2))', 'brier')}, count(*) AS n FROM scores GROUP BY model""", "scored")
def a9(spark, d):
    return records.brier(model_scores(spark, d)).select("model", r("brier"), "n")


@query("a10_calibration", f"""
    WITH {_SCORES} SELECT model, bin, {r6('avg(score)', 'pred')}, {r6(DUMP_SQL.format(c='next_oc'), 'actual')}, count(*) AS n FROM (
      SELECT *, CAST(floor((row_number() OVER (PARTITION BY model ORDER BY score, session, symbol) - 1) * 10 / count(*) OVER (PARTITION BY model)) AS BIGINT) AS bin
      FROM scores) GROUP BY model, bin""", "scored")
def a10(spark, d):
    out = records.calibration(model_scores(spark, d), 10)
    return out.select("model", "bin", r("pred"), r("actual"), "n")


@query("a11_rank_band_record", f"""
    SELECT model_used, lo, hi, count(*) AS n, {r6(DUMP_SQL.format(c='next_oc'), 'hit')}, {r6('avg(next_oc)', 'mean_oc')}, {r6('median(next_oc)', 'median_oc')},
      {r6(share('next_oh >= 0.2', 'next_oh'), 'squeeze')}, {r6(share('next_oc >= 0.05', 'next_oc'), 'pump')}, {r6('avg(c30)', 'cost')},
      {r6('avg(-next_oc - c30)', 'net')}, {r6('avg(CASE WHEN -next_oc - c30 > 0 THEN 1.0 ELSE 0.0 END)', 'win')}
    FROM (SELECT *, {C30} AS c30 FROM picks WHERE next_oc IS NOT NULL) JOIN {bands_sql(SUMMARY_BANDS)} ON urank BETWEEN lo AND hi GROUP BY ALL""", "picks")
def a11(spark, d):
    c30 = sizing.cost_law(F.lit(30000.0), "c10", "spread")
    out = records.rank_band_record(graded(spark, d, ("urank",)), band_frame(spark, SUMMARY_BANDS), ["model_used"], "urank", c30)
    return out.select("model_used", "lo", "hi", "n", *[r(c) for c in (
        "hit", "mean_oc", "median_oc", "squeeze", "pump", "cost", "net", "win")])


_SETUPS = {
    "run up 20": "r20 >= 0.2", "gap up": "gap_pct >= 0.1", "stretched": "rsi14 >= 60", "busy": "rvol1 >= 1.5",
    "restricted": "ssr_trigger", "offering filed": "n_offer > 0",
}


@query("a12_event_study", f"""
    WITH rows AS (SELECT p.*, f.n_offer FROM panel p LEFT JOIN (SELECT symbol, session, count(*) FILTER (category = 'offering') AS n_offer
        FROM filings GROUP BY 1, 2) f USING (symbol, session) WHERE next_oc IS NOT NULL),
    held AS (SELECT *, unnest(list_filter(['baseline', {', '.join(f"CASE WHEN {s} THEN '{n}' END" for n, s in _SETUPS.items())}], lambda x: x IS NOT NULL)) AS study FROM rows),
    a AS (SELECT study, count(*) AS n, count(DISTINCT symbol) AS n_symbols, {DUMP_SQL.format(c='next_oc')} AS pct_dump, median(next_oc) AS median_oc,
      {share('next_oc >= 0.05', 'next_oc')} AS pct_up5, {share('swing5 <= -0.15', 'swing5')} AS pct_swing FROM held GROUP BY study),
    b AS (SELECT pct_dump AS bd, pct_up5 AS bu FROM a WHERE study = 'baseline')
    SELECT study, n, n_symbols, {r6('pct_dump')}, {r6('median_oc')}, {r6('pct_up5')}, {r6('pct_swing')}, {r6('pct_dump / nullif(bd, 0)', 'lift_dump')},
      {r6('(pct_dump + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(pct_dump * (1 - pct_dump) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)', 'ci_lo')},
      {r6('(pct_dump + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(pct_dump * (1 - pct_dump) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)', 'ci_hi')},
      CASE WHEN pct_dump > bd AND pct_up5 > bu THEN 'both' WHEN pct_dump > bd THEN 'down' WHEN pct_up5 > bu THEN 'up' ELSE 'none' END AS tilt
    FROM a, b""", ("panel", "filings"))
def a12(spark, d):
    filed = derived.filings(spark, d).groupBy("symbol", "session").agg(F.count_if(F.col("category") == "offering").alias("n_offer"))
    rows = board.panel(spark, d).join(filed, ["symbol", "session"], "left")
    out = records.event_study(rows, {n: F.expr(s) for n, s in _SETUPS.items()})
    return out.select("study", "n", "n_symbols", *[r(c) for c in ("pct_dump", "median_oc", "pct_up5", "pct_swing", "lift_dump", "ci_lo", "ci_hi")], "tilt")


@query("a13_scorecard", f"""
    SELECT cohort, count(DISTINCT session) AS n_days, count(*) FILTER (ok) AS n_graded, count(*) FILTER (next_oc IS NULL) AS n_missing,
      count(*) FILTER (halted) AS n_halted, {r6('avg(CASE WHEN ok THEN CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END END)', 'dump_rate')},
      {r6('avg(next_oc) FILTER (ok)', 'mean_oc')}, {r6('avg(CASE WHEN ok THEN CASE WHEN next_oh >= 0.2 THEN 1.0 ELSE 0.0 END END)', 'squeeze_rate')}
    FROM (SELECT *, next_oc IS NOT NULL AND NOT halted AS ok, unnest(list_filter([CASE WHEN board_rank = 1 THEN 'top' END, CASE WHEN board_rank <= 25 THEN 'board' END, 'universe'],
        lambda x: x IS NOT NULL)) AS cohort
      FROM (SELECT *, coalesce(next_oh = next_ol, false) AS halted FROM picks WHERE month(session) NOT IN (7, 11))) GROUP BY cohort""", "picks")
def a13(spark, d):
    """July runs stand for late ones, November runs for unverified ones."""
    rows = board.picks(spark, d, places=("board",), keep=["prob_dump", "board_rank", "next_oc", "next_oh", "next_ol"]).withColumns({
        "late": F.month("session") == 7, "unverified": F.month("session") == 11, "halted": F.col("next_oh") == F.col("next_ol")})
    out = records.scorecard(rows)
    return out.select("cohort", "n_days", "n_graded", "n_missing", "n_halted", r("dump_rate"), r("mean_oc"), r("squeeze_rate"))


_TAPE = """tape AS (SELECT session, level / lag(level) OVER (ORDER BY session) - 1 AS bench_r1
      FROM (SELECT session, avg(close) AS level FROM bars GROUP BY session))"""
_SUBSETS = {
    "tier:high": "tier = 'high'", "tier:medium": "tier = 'medium'", "tier:low": "tier = 'low'",
    "weak tape": "bench_r1 <= -0.01", "other tape": "bench_r1 > -0.01",
    "down night": "bench_r1 < 0", "other night": "bench_r1 >= 0",
    "suggested": "bench_r1 > -0.01 AND one_d3 >= 0.5", "stood aside": "NOT (bench_r1 > -0.01 AND one_d3 >= 0.5)",
    "era 1": f"session < DATE '{CUT}'", "era 2": f"session >= DATE '{CUT}'", "all": "true",
}


def the_one(spark, d):
    """The consensus #1 of each session with the benchmark's move; one row per session."""
    return board.first_choices(spark, d).filter(F.col("next_oc").isNotNull()).drop("level")


ONE_SQL = f"one AS (SELECT * FROM ({CONSENSUS}) JOIN tape USING (session) WHERE consensus_rank = 1 AND next_oc IS NOT NULL)"


@query("a14_subset_records", f"""
    WITH {_TAPE}, {ONE_SQL}
    SELECT subset, count(*) AS n, {r6(DUMP_SQL.format(c='next_oc'), 'dump_rate')}, {r6(share('next_oc <= -0.03', 'next_oc'), 'd3_rate')},
      {r6('avg(next_oc)', 'mean_oc')}, {r6(share('next_oc >= 0.1', 'next_oc'), 'up10')}
    FROM (SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN {s} THEN '{n}' END" for n, s in _SUBSETS.items())}], lambda x: x IS NOT NULL)) AS subset FROM one)
    GROUP BY subset""", ("picks", "bars"))
def a14(spark, d):
    out = records.subset_record(the_one(spark, d), {n: F.expr(s) for n, s in _SUBSETS.items()})
    return out.select("subset", "n", r("dump_rate"), r("d3_rate"), r("mean_oc"), r("up10"))


@query("a15_dev_confirm", f"""
    SELECT model_used, {', '.join(r6(f"{e} FILTER (session {op} DATE '{CUT}')", f'{p}_{n}') for p, op in (('dev', '<'), ('confirm', '>='))
      for n, e in (('hit', DUMP_SQL.format(c='next_oc')), ('mean_oc', 'avg(next_oc)'), ('squeeze', share('next_oh >= 0.2', 'next_oh')), ('net', 'avg(-next_oc - c10)')))}
    FROM picks WHERE next_oc IS NOT NULL AND urank <= 10 GROUP BY model_used""", "picks")
def a15(spark, d):
    rows = graded(spark, d, ("urank",), ["urank", "model_used", "next_oh", "c10"]).filter(F.col("urank") <= 10)
    out = records.dev_confirm(rows, "model_used", CUT, {
        "hit": records.rate(F.col("next_oc") <= fixed.DUMP), "mean_oc": F.avg("next_oc"),
        "squeeze": records.rate(F.col("next_oh") >= fixed.SQUEEZE), "net": F.avg(-F.col("next_oc") - F.col("c10"))})
    return out.select("model_used", *[r(f"{p}_{n}") for p in ("dev", "confirm") for n in ("hit", "mean_oc", "squeeze", "net")])


_SIM_COLS = ("net_mean", "win_rate", "mean_cost", "worst_trade", "compounded")


def _sim_sql(rows: str, oc: str) -> str:
    return f"""
    SELECT size, count(*) AS n_trades, {r6('avg(net)', 'net_mean')}, {r6('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r6('avg(cost)', 'mean_cost')},
      {r6('min(net)', 'worst_trade')}, {r6('CASE WHEN bool_and(1 + 0.1 * net > 0) THEN exp(sum(ln(CASE WHEN 1 + 0.1 * net > 0 THEN 1 + 0.1 * net END))) END', 'compounded')}
    FROM (SELECT *, -{oc} - cost AS net FROM (SELECT *, {LAW_SQL.format(q='size')} AS cost FROM {rows}, (SELECT unnest([10000::DOUBLE, 50000::DOUBLE]) AS size))) WHERE {oc} IS NOT NULL GROUP BY size"""


def _priced(rows):
    rows = rows.withColumn("size", F.explode(F.array(F.lit(10000.0), F.lit(50000.0))))
    return rows.withColumn("cost", sizing.cost_law("size", "c10", "spread"))


@query("a16_trade_sim", _sim_sql("(SELECT * FROM picks WHERE urank = 1)", "next_oc"), "picks")
def a16(spark, d):
    out = records.trade_sim(_priced(board.picks(spark, d, places=("urank",), keep=["urank", "next_oc", "c10", "spread"]).filter(F.col("urank") == 1)), ["size"])
    return out.select("size", "n_trades", *[r(c) for c in _SIM_COLS])


_SWING_ONE = """(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY session) - 1 AS i FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY prob_swing DESC, symbol) AS k FROM picks WHERE swing5 IS NOT NULL) WHERE k = 1) WHERE i % 5 = 0)"""


def swing_trades(spark, d):
    rows = board.picks(spark, d, places=()).filter(F.col("swing5").isNotNull())
    first = ranking.top_k(rows, "session", [F.col("prob_swing").desc(), F.col("symbol")], 1, "swing_rank")
    return records.every_nth(first, 5)


@query("a17_swing_sim", f"""
    SELECT count(*) AS n_trades, {r6('avg(net)', 'mean_trade_net')}, {r6('median(net)', 'median_trade_net')},
      {r6('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r6('min(net)', 'worst_trade')}
    FROM (SELECT -swing5 - 0.01 AS net FROM {_SWING_ONE})""", "picks")
def a17(spark, d):
    net = swing_trades(spark, d).select((-F.col("swing5") - 0.01).alias("net"))     # at most one row per session
    return net.agg(F.count("*").alias("n_trades"), r(F.avg("net"), "mean_trade_net"), r(F.median("net"), "median_trade_net"),
                   r(records.rate(F.col("net") > 0), "win_rate"), r(F.min("net"), "worst_trade"))


_LEGS = {"open to close": ("open", "close"), "open to 10:30": ("open", "p1030"), "open to 12:30": ("open", "p1230"), "10:30 to close": ("p1030", "close")}


@query("a18_timing_table", f"""
    WITH prices AS (SELECT symbol, CAST(et AS DATE) AS session, arg_min(price, ts) AS open, arg_max(price, ts) AS close,
        arg_max(price, ts) FILTER (m <= 630) AS p1030, arg_max(price, ts) FILTER (m <= 750) AS p1230
      FROM (SELECT *, hour(et) * 60 + minute(et) AS m FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS et FROM ticks))
      WHERE m >= 570 AND m < 960 GROUP BY 1, 2),
    legs AS ({' UNION ALL '.join(f"SELECT '{n}' AS leg, -({b} / nullif({a}, 0) - 1) AS ret, p1030 / nullif(open, 0) - 1 AS s FROM prices" for n, (a, b) in _LEGS.items())})
    SELECT leg, cond, {r6('avg(ret)', 'mean')}, {r6('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)', 'win')}, count(*) AS n FROM (
      SELECT *, unnest(list_filter(['all', CASE WHEN s > 0 THEN 'up' WHEN s <= 0 THEN 'down' END], lambda x: x IS NOT NULL)) AS cond FROM legs WHERE ret IS NOT NULL)
    GROUP BY leg, cond""", "ticks")
def a18(spark, d):
    m = S.et_minute("ts")
    in_session = derived.ticks(spark, d).withColumns({"m": m, "session": S.et_date("ts")}).filter((F.col("m") >= 570) & (F.col("m") < 960))
    prices = in_session.groupBy("symbol", "session").agg(
        F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"),
        F.max_by("price", F.when(F.col("m") <= 630, F.col("ts"))).alias("p1030"),
        F.max_by("price", F.when(F.col("m") <= 750, F.col("ts"))).alias("p1230"))
    split = F.try_divide(F.col("p1030"), F.col("open")) - 1
    return records.leg_returns(prices, _LEGS, split).select("leg", "cond", r("mean"), r("win"), "n")


@query("a19_corr", f"""
    WITH et AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS et FROM ticks),
    gaps AS (SELECT symbol, CAST(et AS DATE) AS session, arg_max(price, ts) FILTER (strftime(et, '%H:%M') < '08:00') AS pre,
      arg_min(price, ts) FILTER (hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960) AS official FROM et GROUP BY 1, 2),
    known AS (SELECT symbol, session + 1 AS known_on, close FROM bars_d)
    SELECT {r6('corr(pre / nullif(close, 0) - 1, official / nullif(close, 0) - 1)', 'corr_gap')}, count(*) AS n
    FROM gaps g ASOF JOIN known k ON g.symbol = k.symbol AND g.session >= k.known_on WHERE pre IS NOT NULL AND official IS NOT NULL""", ("ticks", "bars_d"))
def a19(spark, d):
    m = S.et_minute("ts")
    ticks = derived.ticks(spark, d).withColumn("session", S.et_date("ts"))
    gaps = ticks.groupBy("symbol", "session").agg(
        F.max_by("price", F.when(S.et_hhmm("ts") < "08:00", F.col("ts"))).alias("pre"),
        F.min_by("price", F.when((m >= 570) & (m < 960), F.col("ts"))).alias("official"))
    known = derived.daily_bars(spark, d).select("symbol", F.date_add("session", 1).alias("known_on"), "close")
    met = joins.asof_join(gaps.filter(F.col("pre").isNotNull() & F.col("official").isNotNull()), known, ["symbol"], "session",
                          "known_on", ["close"]).filter(F.col("close").isNotNull())
    return met.agg(r(F.corr(S.move_from_open("pre", "close"), S.move_from_open("official", "close")), "corr_gap"), F.count("*").alias("n"))


@query("a20_binomial_tail", f"""
    WITH base AS (SELECT avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS p FROM scored WHERE next_oc IS NOT NULL),
    recs AS (SELECT symbol, count(*) AS n, count(*) FILTER (next_oc <= -0.05) AS k FROM scored WHERE next_oc IS NOT NULL GROUP BY symbol),
    tails AS (SELECT symbol, n, k, least(1, list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))) AS tail FROM recs, base)
    SELECT symbol, n, k, {r6('tail')}, CASE WHEN n < 20 THEN 'too few days' WHEN tail < 0.05 THEN 'below' ELSE 'consistent' END AS status FROM tails""", "scored")
def a20(spark, d):
    rows = board.scored(spark, d).filter(F.col("next_oc").isNotNull())
    base = rows.agg(records.rate(F.col("next_oc") <= fixed.DUMP).alias("p")).scalar()
    recs = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("next_oc") <= fixed.DUMP).alias("k"))
    recs = recs.withColumn("p", base).withColumn("t", records.binomial_tail(F.col("k"), F.col("n"), F.col("p")))
    return recs.select("symbol", "n", "k", r("t", "tail"), records.tail_status(F.col("t"), F.col("n")).alias("status"))


@query("a27_basket_return", f"""
    SELECT session, {r6('basket')}, {r6('min(basket) OVER ()', 'worst_day')} FROM (
      SELECT session, avg(next_oc) AS basket FROM board WHERE rank <= 3 AND next_oc IS NOT NULL GROUP BY session)""", "board")
def a27(spark, d):
    days = board.board(spark, d, (), ["next_oc"]).filter((F.col("rank") <= 3) & F.col("next_oc").isNotNull()).groupBy("session").agg(
        F.avg("next_oc").alias("basket"))
    worst = F.min("basket").over(W.partitionBy())        # one row per session
    return days.select("session", r("basket"), r(worst, "worst_day"))


@query("a28_distinct_counts", "SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT session) AS n_days, count(*) AS n_rows FROM scored", "scored")
def a28(spark, d):
    return board.scored(spark, d).agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("session").alias("n_days"),
                                      F.count("*").alias("n_rows"))


_SPANS = [("all", "1900-01-01", "2100-01-01"), ("one year", "1995-01-01", "1995-12-31"), ("confirm", CUT, "2100-01-01"), ("one session", "1996-03-01", "1996-03-31")]


@query("a28_distinct_sketch", f"""
    WITH spans(id, a, b) AS (VALUES {', '.join(f"('{i}', DATE '{a}', DATE '{b}')" for i, a, b in _SPANS)})
    SELECT id, count(DISTINCT symbol) AS n_symbols, count(DISTINCT session) AS n_days, count(*) AS n_rows
    FROM spans JOIN scored ON session BETWEEN a AND b GROUP BY id""", "scored")
def a28_sketch(spark, d):
    """Distinct names of several spans from one stored sketch per session; the rows are scanned once.

    Equal to the exact count as long as a span's names are few enough to be held one by one (384); beyond, within the sketch's error.
    """
    stored = cut(records.distinct_sketches(board.scored(spark, d)))
    spans = spark.createDataFrame(_SPANS, "id string, start string, end string").select("id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return records.distinct_in_spans(stored, spans).select("id", "n_symbols", "n_days", "n_rows")


@query("a29_tstat", f"""
    SELECT count(net) AS indep, {r6('avg(net)', 'mean')}, {r6('avg(net) / nullif(stddev_samp(net) / sqrt(count(net)), 0)', 't')}
    FROM (SELECT -swing5 - 0.01 AS net FROM {_SWING_ONE})""", "picks")
def a29(spark, d):
    return records.t_statistic(swing_trades(spark, d), -F.col("swing5") - 0.01).select("indep", r("mean"), r("t"))


@query("a30_majority_model", """
    SELECT session, CASE WHEN count(*) FILTER (model_used = 'm1') * 2 > count(*) THEN 'm1' ELSE 'm0' END AS model FROM board GROUP BY session""", "board")
def a30(spark, d):
    m1 = F.count_if(F.col("model_used") == "m1")
    return board.board(spark, d, (), ["model_used"]).groupBy("session").agg(F.when(m1 * 2 > F.count("*"), "m1").otherwise("m0").alias("model"))


@query("a31_basket_backtest", f"""
    WITH able AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rank) AS pos FROM board WHERE publishable AND capacity IS NOT NULL),
    q AS (SELECT *, least(capacity, 50000) AS q FROM able, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE pos <= k AND next_oc IS NOT NULL),
    c AS (SELECT *, q * (-next_oc - {LAW_SQL.format(q='q')}) AS pnl, CASE WHEN session < DATE '{CUT}' THEN 'dev' ELSE 'confirm' END AS period FROM q),
    days AS (SELECT period, k, session, sum(pnl) AS pnl, sum(q) AS q FROM c GROUP BY ALL)
    SELECT period, k, count(*) AS n_days, {r6('sum(pnl) / sum(q)', 'net_per_dollar')}, {r6('avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', 'day_win')} FROM days GROUP BY period, k""", "board")
def a31(spark, d):
    rows = board.board(spark, d, (), ["publishable", "capacity", "next_oc", "c10", "spread"])
    return allocation.basket_backtest(rows, 50000.0, CUT).select(
        "period", "k", "n_days", r("net_per_dollar"), r("day_win"))


_TIER = """(0.05::DOUBLE * exp_dvol >= size AND exp_dvol * pow(0.005::DOUBLE / (0.7::DOUBLE * vol20), 2) >= size)"""


@query("a32_size_tier_table", f"""
    WITH held AS (SELECT *, {LAW_SQL.format(q='size')} AS cost, 2 * 0.7::DOUBLE * vol20 * sqrt(size / exp_dvol) + CASE WHEN close >= 1 THEN 0.01 / close ELSE 0.0001 / close END AS tight
      FROM picks, (SELECT unnest([{', '.join(f'{q}::DOUBLE' for q in fixed.SIZES)}]) AS size) WHERE capacity >= size AND next_oc IS NOT NULL),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY size, session ORDER BY prob_dump DESC, symbol) AS k FROM held),
    days AS (SELECT size, session, count(*) AS names, {DUMP_SQL.format(c='next_oc')} AS base, max(next_oc) FILTER (k = 1) AS oc, max(cost) FILTER (k = 1) AS cost, max(tight) FILTER (k = 1) AS tight
      FROM firsts GROUP BY ALL)
    SELECT size, count(*) AS n_days, {r6('avg(names)', 'names_per_day')}, {r6('avg(base)', 'base_dump')}, {r6(DUMP_SQL.format(c='oc'), 'top1_hit')}, {r6('avg(oc)', 'top1_mean_oc')},
      {r6('avg(cost)', 'cost')}, {r6('avg(-oc - cost)', 'net')}, {r6('avg(-oc - tight)', 'net_tight')} FROM days GROUP BY size""", "picks")
def a32(spark, d):
    cols = ["capacity", "close", "prob_dump", "c10", "spread", "vol20", "exp_dvol"]
    out = allocation.size_tiers(graded(spark, d, (), cols), fixed.SIZES)
    return out.select("size", "n_days", *[r(c) for c in ("names_per_day", "base_dump", "top1_hit", "top1_mean_oc", "cost", "net", "net_tight")])


@query("a33_survivorship_gap", f"""
    WITH fwd AS (SELECT symbol, session, lead(close, 20) OVER w / lead(open) OVER w - 1 AS fwd20 FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session)),
    rows AS (SELECT p.symbol, p.session, p.r5, p.spread, f.fwd20, p.dvol20 >= 5000000 AS liquid FROM panel_w p JOIN fwd f USING (symbol, session) WHERE p.dvol20 IS NOT NULL),
    today AS (SELECT symbol FROM rows WHERE session = (SELECT max(session) FROM rows) AND liquid),
    held AS (SELECT 'today' AS list, * FROM rows WHERE symbol IN (SELECT symbol FROM today) UNION ALL SELECT 'point in time', * FROM rows WHERE liquid),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY list, session ORDER BY r5 DESC NULLS LAST, symbol) AS k FROM held WHERE fwd20 IS NOT NULL)
    SELECT list, count(*) AS n, {r6('avg(fwd20)', 'tier_mean')}, {r6('avg(-fwd20 - spread) FILTER (k = 1)', 'net')} FROM firsts GROUP BY list""", ("bars_w", "panel_w"))
def a33(spark, d):
    rows = features.session_features(derived.bars(spark, d, "week"), horizon=20).filter(F.col("dvol20").isNotNull())
    last = derived.trades(spark, d).agg(F.trunc(F.max("day"), "week").alias("s")).scalar()
    out = records.survivorship(rows, F.col("dvol20") >= 5e6, last)
    return out.select("list", "n", r("tier_mean"), r("net"))
