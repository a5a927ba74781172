"""Feeds written as documents, landed, loaded under their schemas and unfolded (S1): one query per feed, and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import fresh_path
from ..sources import derived, feeds
from ..streaming import tape
from . import board, feeds_q, market_q, records_q
from .ctes import r6
from .registry import ORACLES, query, r
from .streams_q import _TAPE


def land(docs: DataFrame, folder: str, feed: str) -> None:
    """Documents (name, json) of a feed as files."""
    feeds.write_documents(docs, f"{folder}/{feed}")


def loaded(docs: DataFrame, feed: str) -> DataFrame:
    """The feed's good documents after landing and loading."""
    folder = fresh_path(docs.sparkSession, "feeds")
    land(docs, folder, feed)
    return feeds.load_feeds(docs.sparkSession, folder, [feed])[0][feed]


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json")


def index_documents(spark, d):
    older, newer = feeds_q.manifests(spark, d)
    entry = F.map_from_entries(F.collect_list(F.struct("name", F.struct("seq", "sha256"))))
    return older.agg(F.max("seq").alias("seq"), entry.alias("files")).select(F.lit("older").alias("name"), _json(seq=F.col("seq"), files=F.col("files"))).unionByName(
        newer.agg(F.max("seq").alias("seq"), entry.alias("files")).select(F.lit("newer").alias("name"), _json(seq=F.col("seq"), files=F.col("files"))))


@query("feed_index", """
    WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS closed FROM orders GROUP BY 1),
    files AS (SELECT 'older' AS document, 'orders/' || month AS file, closed AS seq FROM o WHERE month < '1999-06'
      UNION ALL SELECT 'newer', 'orders/' || month, CASE WHEN month[6:7] IN ('03', '09') THEN n ELSE closed END FROM o WHERE month >= '1995-06')
    SELECT document, max(seq) OVER (PARTITION BY document) AS index_seq, file, seq FROM files""")
def feed_index(spark, d):
    """Which files an index publishes, each with its own seq."""
    return loaded(index_documents(spark, d), "index").select(
        F.col("name").alias("document"), F.col("seq").alias("index_seq"), F.explode("files").alias("file", "f")).select(
        "document", "index_seq", "file", "f.seq")


def universe_documents(spark, d):
    cols = list(feeds_q._UNIVERSE)[:-1]
    rows = board.picks(spark, d, places=("board",), keep=cols).select("session", *cols)
    docs = rows.groupBy("session", F.floor(F.col("symbol") / 500).alias("part")).agg(F.collect_list(F.array(*[F.col(c).cast("string") for c in cols])).alias("rows"))
    return docs.select(F.concat_ws("-", "session", "part").alias("name"), _json(session_date=F.col("session"), columns=F.array(*[F.lit(c) for c in cols]), rows=F.col("rows")))


@query("feed_universe", f"""
    SELECT session AS session_date, symbol, name, {r6('prob_dump', places=9)}, {r6('capacity', places=2)}, board_rank FROM picks""", "picks")
def feed_universe(spark, d):
    """Documents of 500 names at most; columns and rows unfolded from files."""
    docs = loaded(universe_documents(spark, d), "universe")
    out = feeds.columnar_to_rows(docs, feeds_q._UNIVERSE, keep=["session_date"])
    return out.select("session_date", "symbol", "name", r("prob_dump", places=9), r("capacity", places=2), "board_rank")


_LIVE_NAMES = 100


def live_documents(spark, d):
    quotes = tape.live_tape(derived.ticks(spark, d)).filter(F.col("symbol") <= _LIVE_NAMES)
    held = F.struct(F.col("symbol").cast("string").alias("symbol"), "open", "last", "high", "low", "oc_now")
    docs = quotes.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("symbol", held.alias("q")))).alias("b"))
    every = F.transform("b", lambda x: x["q"])
    return docs.select(F.col("session").cast("string").alias("name"), _json(
        session_date=F.col("session"), board=F.slice(every, 1, 25), board_ext=F.slice(every, 26, _LIVE_NAMES)))


@query("feed_live", f"""
    SELECT session AS session_date, CASE WHEN row_number() OVER (PARTITION BY session ORDER BY symbol) <= 25 THEN 'board' ELSE 'board_ext' END AS part,
      CAST(symbol AS VARCHAR) AS symbol, {r6('open')}, {r6('last')}, {r6('last / nullif(open, 0) - 1', 'oc_now')} FROM ({_TAPE}) WHERE symbol <= {_LIVE_NAMES}""", "ticks")
def feed_live(spark, d):
    """Quotes of the board and of its extension, as one snapshot a session holds them."""
    docs = loaded(live_documents(spark, d), "live")
    part = lambda p: docs.select("session_date", F.lit(p).alias("part"), F.explode(p).alias("q"))
    return part("board").unionByName(part("board_ext")).select("session_date", "part", "q.symbol", r("q.open", "open"), r("q.last", "last"), r("q.oc_now", "oc_now"))


def scorecard_documents(spark, d):
    rows = board.picks(spark, d, places=("board",), keep=["prob_dump", "next_oc", "board_rank"]).filter(F.col("next_oc").isNotNull())
    dumped = F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0)
    first = F.col("board_rank") == 1
    one = lambda c: F.max(F.when(first, F.col(c)))
    days = rows.groupBy("session").agg(
        one("symbol").cast("string").alias("symbol"), one("prob_dump").alias("prob_dump"), one("next_oc").alias("oc"),
        F.avg(F.when(F.col("board_rank").isNotNull(), dumped)).alias("board_dump_rate"), F.avg(dumped).alias("universe_dump_rate"))
    day = F.struct(F.col("session").alias("session_date"), F.struct("symbol", "prob_dump").alias("top"), F.struct(
        F.struct("oc", (F.col("oc") <= fixed.DUMP).alias("dump"), F.col("oc").isNull().alias("missing")).alias("top"), "board_dump_rate", "universe_dump_rate").alias("outcome"))
    return days.groupBy(F.year("session").cast("string").alias("name")).agg(F.sort_array(F.collect_list(day)).alias("days")).select("name", _json(days=F.col("days")))


@query("feed_scorecard", f"""
    SELECT session AS session_date, CAST(max(symbol) FILTER (board_rank = 1) AS VARCHAR) AS top_symbol, {r6('max(next_oc) FILTER (board_rank = 1)', 'top_oc')},
      coalesce(max(next_oc) FILTER (board_rank = 1) <= -0.05) AS top_dump,
      {r6('avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) FILTER (board_rank IS NOT NULL)', 'board_dump_rate')},
      {r6('avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END)', 'universe_dump_rate')} FROM picks WHERE next_oc IS NOT NULL GROUP BY session""", "picks")
def feed_scorecard(spark, d):
    """Days of the live record, one document a year."""
    docs = loaded(scorecard_documents(spark, d), "scorecard")
    return docs.select(F.explode("days").alias("x")).select(
        "x.session_date", F.col("x.top.symbol").alias("top_symbol"), r("x.outcome.top.oc", "top_oc"), F.col("x.outcome.top.dump").alias("top_dump"),
        r("x.outcome.board_dump_rate", "board_dump_rate"), r("x.outcome.universe_dump_rate", "universe_dump_rate"))


def evidence_documents(spark, d):
    rows = records_q.a12(spark, d)
    study = F.struct(F.col("study").alias("id"), "n", "n_symbols", "pct_dump", F.array("ci_lo", "ci_hi").alias("ci_pct_dump"), "lift_dump", "median_oc", "pct_up5", "pct_swing",
                     F.col("tilt").alias("skew"))
    return rows.agg(F.collect_list(study).alias("studies")).select(F.lit("evidence").alias("name"), _json(
        baseline=F.filter("studies", lambda s: s["id"] == "baseline")[0], studies=F.filter("studies", lambda s: s["id"] != "baseline")))


@query("feed_evidence", f"""
    SELECT study AS id, n, pct_dump, ci_lo, ci_hi, lift_dump, tilt AS skew, max(pct_dump) FILTER (study = 'baseline') OVER () AS baseline_dump
    FROM ({ORACLES['a12_event_study']}) QUALIFY study <> 'baseline'""")
def feed_evidence(spark, d):
    """Studies beside their baseline."""
    docs = loaded(evidence_documents(spark, d), "evidence")
    return docs.select(F.explode("studies").alias("s"), F.col("baseline.pct_dump").alias("baseline_dump")).select(
        "s.id", "s.n", "s.pct_dump", F.col("s.ci_pct_dump")[0].alias("ci_lo"), F.col("s.ci_pct_dump")[1].alias("ci_hi"), "s.lift_dump", "s.skew", "baseline_dump")


def model_documents(spark, d):
    rates = records_q.a1(spark, d).select(F.struct("dump", "squeeze", "pump", "swing").alias("base_rate"), F.col("n").alias("n_rows"))
    bins = records_q.a10(spark, d).groupBy("model").agg(F.sort_array(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), "pred", "actual", "n"))).alias("bins"))
    table = bins.agg(F.map_from_entries(F.collect_list(F.struct("model", "bins"))).alias("calibration"))
    return rates.crossJoin(table).select(F.lit("model").alias("name"), _json(base_rate=F.col("base_rate"), n_rows=F.col("n_rows"), calibration=F.col("calibration")))     # one row each


@query("feed_model", f"""
    SELECT model, CAST(bin AS INTEGER) AS bin, pred, actual, c.n, dump AS base_dump, r.n AS n_rows FROM ({ORACLES['a10_calibration']}) c, ({ORACLES['a1_base_rates']}) r""")
def feed_model(spark, d):
    """The model report: calibration bins of each model beside the base rate."""
    docs = loaded(model_documents(spark, d), "model")
    bins = docs.select("base_rate", "n_rows", F.explode("calibration").alias("model", "bins")).select("base_rate", "n_rows", "model", F.explode("bins").alias("b"))
    return bins.select("model", "b.bin", "b.pred", "b.actual", "b.n", F.col("base_rate.dump").alias("base_dump"), "n_rows")


def unified_documents(spark, d):
    rows = market_q.u4(spark, d).filter(F.col("pos") <= 50)
    entry = F.struct("pos", F.col("symbol").cast("string").alias("symbol"), "side", F.col("key").alias("score"))
    lists = rows.groupBy("session", "list").agg(F.sort_array(F.collect_list(entry)).alias("names"))
    shown = F.transform("names", lambda x: F.struct(x["symbol"].alias("symbol"), x["side"].alias("side"), x["score"].alias("score")))
    return lists.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("list", shown))).alias("lists")).select(
        F.col("session").cast("string").alias("name"), _json(lists=F.col("lists"), as_of=F.create_map(F.lit("session"), F.col("session"))))


@query("feed_unified", f"""
    SELECT session, list, CAST(pos AS BIGINT) AS pos, CAST(symbol AS VARCHAR) AS symbol, side, key AS score FROM ({ORACLES['u4_unified_lists']}) WHERE pos <= 50""")
def feed_unified(spark, d):
    """The first 50 of each list of a session, in the list's order."""
    docs = loaded(unified_documents(spark, d), "unified")
    lists = docs.select(F.col("as_of")["session"].alias("session"), F.explode("lists").alias("list", "names"))
    return lists.select("session", "list", F.posexplode("names").alias("i", "x")).select(
        "session", "list", (F.col("i") + 1).cast("long").alias("pos"), "x.symbol", "x.side", "x.score")


def size_documents(spark, d):
    rows = records_q.a18(spark, d)
    cells = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in ("leg", "cond", "mean", "win", "n")]))
    return rows.agg(F.collect_list(cells).alias("intraday")).select(F.lit("size").alias("name"), _json(question=F.lit("when"), intraday=F.col("intraday")))


@query("feed_size_research", f"SELECT leg, cond, mean, win, n FROM ({ORACLES['a18_timing_table']})")
def feed_size_research(spark, d):
    """The timing table from its report, whose cells are text."""
    cell = lambda c, t: F.col("x")[c].cast(t).alias(c)
    return loaded(size_documents(spark, d), "size_research").select(F.explode("intraday").alias("x")).select(
        cell("leg", "string"), cell("cond", "string"), cell("mean", "double"), cell("win", "double"), cell("n", "long"))


@query("s1_quarantine", """
    WITH named AS (SELECT DISTINCT CAST(session AS VARCHAR) AS name, month(session) AS m FROM board)
    SELECT 'today' AS feed, name, CASE m WHEN 2 THEN 'broken' WHEN 5 THEN 'broken' ELSE 'no run' END AS reason FROM named WHERE m IN (2, 5, 8)
    UNION ALL SELECT 'index', 'newer', 'broken' WHERE EXISTS (FROM orders)""", "board")
def s1_quarantine(spark, d):
    """Cut-off documents, fields of a wrong type and documents without a needed field are set aside, feed by feed; the others load."""
    folder = fresh_path(spark, "feeds")
    today = feeds_q.board_documents(spark, d)
    m = F.month("session")
    spoilt = F.when(m == 2, F.expr("left(json, int(length(json) / 2))")).when(m == 5, F.regexp_replace("json", r'"rank":\d+', '"rank":"first"')).when(
        m == 8, F.regexp_replace("json", '"run":"morning"', '"run":null')).otherwise(F.col("json"))
    land(today.select(F.col("session").cast("string").alias("name"), spoilt.alias("json")), folder, "today")
    index = index_documents(spark, d)
    land(index.select("name", F.when(F.col("name") == "newer", F.expr("left(json, 40)")).otherwise(F.col("json")).alias("json")), folder, "index")
    return feeds.load_feeds(spark, folder)[1].select("feed", "name", "reason")
