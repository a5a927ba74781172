"""Streaming queries (T): drained over what has landed, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..schemas import INDEX
from ..session import cut, fresh_path
from ..sources import derived
from ..streaming import spreads, tape
from . import board
from .ctes import r6
from .feeds_q import manifests
from .registry import query, r


def tick_stream(spark, d, files_per_trigger=None):
    ev = tape.stream_table(spark, d, "events", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))
    return derived.shape_ticks(ev)


def drained(stream, name, mode="append"):
    path = tape.drain(stream, name, mode)
    return tape.landed(stream.sparkSession, path, stream.schema.add("batch", "long"))


_ET = "timezone('America/New_York', timezone('UTC', ts))"
_TAPE = f"""SELECT CAST(et AS DATE) AS session, symbol, first(price ORDER BY ts, event_id) AS open, last(price ORDER BY ts, event_id) AS last,
        max(price) AS high, min(price) AS low, count(*) AS n
      FROM (SELECT *, {_ET} AS et FROM ticks) WHERE isodow(et) < 6 AND hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960 GROUP BY 1, 2"""


@query("t1_live_tape", f"""
    SELECT session, symbol, {r6('open')}, {r6('last')}, {r6('high')}, {r6('low')}, n, {r6('last / nullif(open, 0) - 1', 'oc_now')}, {r6('high / nullif(open, 0) - 1', 'oh_now')}, {r6('low / nullif(open, 0) - 1', 'ol_now')}
    FROM ({_TAPE})""", "ticks")
def t1(spark, d):
    updates = drained(tape.live_tape(tick_stream(spark, d)), "live", "update")
    return tape.latest(updates, ["session", "symbol"]).select(
        "session", "symbol", *[r(c) for c in ("open", "last", "high", "low")], "n", *[r(c) for c in ("oc_now", "oh_now", "ol_now")])


@query("t1_live_board", f"""
    WITH newest AS (SELECT symbol, rank FROM board WHERE session = (SELECT max(session) FROM board)),
    quoted AS (SELECT session, rank, last / nullif(open, 0) - 1 AS oc FROM ({_TAPE}) JOIN newest USING (symbol))
    SELECT session, count(*) FILTER (rank <= 25 AND oc <= -0.05) AS top_down5, count(*) FILTER (rank <= 25) AS top_n, {r6('avg(oc) FILTER (rank <= 25)', 'top_mean_oc')},
      count(*) FILTER (rank > 25 AND oc <= -0.05) AS ext_down5, count(*) FILTER (rank > 25) AS ext_n, {r6('avg(oc) FILTER (rank > 25)', 'ext_mean_oc')},
      (SELECT count(*) FROM newest) - count(*) AS unquoted FROM quoted GROUP BY session""", ("ticks", "board"))
def t1_board(spark, d):
    """The last published board held against every day of the tape."""
    published = cut(board.board(spark, d, (), []).select("session", "symbol", "rank"))
    last = published.agg(F.max("session")).first()[0]
    path = tape.live_board(tick_stream(spark, d), published.filter(F.col("session") == last).drop("session"))
    updates = tape.landed(spark, path, "session date, top_down5 bigint, top_n bigint, top_mean_oc double, ext_down5 bigint, ext_n bigint, "
                                       "ext_mean_oc double, unquoted bigint, batch bigint")
    return tape.latest(updates, ["session"]).select(
        "session", "top_down5", "top_n", r("top_mean_oc"), "ext_down5", "ext_n", r("ext_mean_oc"), "unquoted")


def _bars_sql(minutes: int) -> str:
    return f"""
    SELECT CAST(epoch(start) AS BIGINT) AS start_s, symbol, {r6('open')}, {r6('high')}, {r6('low')}, {r6('close')}, volume FROM (
      SELECT time_bucket(INTERVAL {minutes} MINUTE, ts) AS start, symbol, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2)"""


def _bars(spark, d, width):
    updates = drained(tape.intraday_bars(tick_stream(spark, d), width), "intraday", "update")
    return tape.latest(updates, ["start", "symbol"]).select(
        F.unix_seconds("start").alias("start_s"), "symbol", *[r(c) for c in ("open", "high", "low", "close")], "volume")


@query("t2_intraday_bars", _bars_sql(15), "ticks")
def t2(spark, d):
    return _bars(spark, d, "15 minutes")


@query("t2_intraday_bars_hourly", _bars_sql(60), "ticks")
def t2_hourly(spark, d):
    return _bars(spark, d, "1 hour")


@query("t3_snapshot_dedup", "SELECT DISTINCT symbol, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS asof_s FROM ticks", "ticks")
def t3(spark, d):
    """Snapshots stamped by the day: many ticks of a name repeat one stamp."""
    snaps = tick_stream(spark, d).select("symbol", F.date_trunc("day", "ts").alias("asof"))
    return drained(tape.snapshot_dedup(snaps), "snapshots").select("symbol", F.unix_seconds("asof").alias("asof_s"))


@query("t4_late_exclusion", f"""
    SELECT event_id, CASE WHEN isodow(et) >= 6 OR strftime(et, '%Y-%m-%d') IN ({', '.join(repr(h) for h in fixed.HOLIDAYS)}) THEN 'no session' WHEN hour(et) * 60 + minute(et) >= 570 THEN 'late' WHEN event_type = 'signup' THEN 'unverified' ELSE 'counted' END AS status
    FROM (SELECT *, {_ET} AS et FROM ticks)""", "ticks")
def t4(spark, d):
    """Ticks stand for published runs; sessions are the weekdays of the data's calendar that are no holidays."""
    days = derived.ticks(spark, d).select(S.et_date("ts").alias("session")).distinct().filter(
        ~F.dayofweek("session").isin(1, 7) & ~F.date_format("session", "yyyy-MM-dd").isin(fixed.HOLIDAYS))
    sessions = days.select("session", F.to_utc_timestamp(
        F.to_timestamp("session") + F.expr("INTERVAL 570 MINUTES"), "America/New_York").alias("open_ts"))
    runs = tick_stream(spark, d).select("event_id", S.et_date("ts").alias("session"), F.col("ts").alias("published_at"),
                                        (F.col("event_type") != "signup").alias("confirmed"))
    judged = tape.late_exclusion(runs, sessions)
    path = fresh_path(spark, "runs")
    tape.drain(judged, "late", each=tape.route_late(path))
    read = lambda part: spark.read.schema(judged.schema).parquet(f"{path}/{part}")
    return read("main").unionByName(read("side")).select("event_id", "status")


def quote_stream(spark, d):
    return tick_stream(spark, d).select("symbol", "ts", (F.col("price") * (1 - F.col("size") / 10000)).alias("bid"),
                                        (F.col("price") * (1 + F.col("size") / 10000)).alias("ask"))


@query("t5_spread_stream", f"""
    SELECT CAST(ts AS DATE) AS day, symbol, {r6('quantile_disc((ask - bid) / nullif((ask + bid) / 2, 0), 0.5)', 'spread')}, count(*) AS n FROM quotes GROUP BY 1, 2""", "quotes")
def t5(spark, d):
    updates = drained(tape.spread_stream(quote_stream(spark, d)), "spreads", "update")
    return tape.latest(updates, ["day", "symbol"]).select("day", "symbol", r("spread"), "n")


@query("t5_recent_spread", f"""
    WITH days AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM quotes)),
    q AS (SELECT day, i, symbol, (ask - bid) / nullif((ask + bid) / 2, 0) AS rel FROM quotes JOIN days ON CAST(ts AS DATE) = day)
    SELECT t.day, t.symbol, {r6('quantile_disc(q.rel, 0.5)', 'spread')}, count(*) AS n, count(DISTINCT q.day) AS sessions
    FROM (SELECT DISTINCT day, i, symbol FROM q WHERE rel IS NOT NULL) t JOIN q ON q.symbol = t.symbol AND q.i BETWEEN t.i - 19 AND t.i
    WHERE q.rel IS NOT NULL GROUP BY t.day, t.symbol""", "quotes")
def t5_recent(spark, d):
    """Median quoted spread of each name over the 20 sessions up to each day, from sketches kept by day."""
    updates = tape.landed(spark, spreads.recent_spread_stream(quote_stream(spark, d)), spreads.RECENT + ", batch bigint")
    return tape.latest(updates, ["day", "symbol"]).select("day", "symbol", r("spread"), "n", "sessions")


@query("t6_wire_stream", f"""
    WITH pre AS (SELECT symbol, ts, price, CAST({_ET} AS DATE) AS session FROM ticks WHERE strftime({_ET}, '%H:%M') < '08:00'),
    known AS (SELECT symbol, session + 1 AS session, close FROM bars_d),
    moves AS (SELECT symbol, ts, price / nullif(close, 0) - 1 AS gap FROM pre JOIN known USING (symbol, session)),
    wire AS (SELECT symbol, CAST(day AS TIMESTAMP) AS time, 'filing' AS kind, category AS headline,
        CASE WHEN category IN ('offering', 'toxic_financing') THEN 3 WHEN category IN ('atm', 'unregistered_sale', 'reverse_split') THEN 2 ELSE 1 END AS severity FROM filings
      UNION SELECT symbol, ts, 'headline', 'error', 1 FROM ticks WHERE event_type = 'error'
      UNION SELECT symbol, ts, 'move', CASE WHEN gap < 0 THEN 'down' ELSE 'up' END, CASE WHEN abs(gap) >= 0.5 THEN 3 ELSE 2 END FROM moves WHERE abs(gap) >= 0.2)
    SELECT symbol, CAST(floor(epoch(time)) AS BIGINT) AS time_s, kind, headline, CAST(severity AS INTEGER) AS severity FROM wire""", ("ticks", "bars_d", "filings"))
def t6(spark, d):
    """Filings, bearish headlines and pre-market moves of 20% or more against the previous day's close."""
    li = tape.stream_table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    category = F.element_at(F.array(*[F.lit(c) for c in derived.CATEGORIES]), (F.col("l_linenumber") % 5).cast("int") + 1)
    filed = li.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").cast("timestamp").alias("t"), category.alias("category"))
    filings = tape.wire_item(filed, "filing", F.col("t"), F.col("category"), tape.filing_severity())
    news = tape.wire_item(tick_stream(spark, d).filter(F.col("event_type") == "error"), "headline", F.col("ts"), F.col("event_type"), F.lit(1))
    known = derived.daily_bars(spark, d).select("symbol", F.date_add("session", 1).alias("session"), "close")
    pre = tick_stream(spark, d).filter(S.et_hhmm("ts") < "08:00").withColumn("session", S.et_date("ts")).join(known, ["symbol", "session"])
    gap = S.move_from_open("price", "close")
    moves = tape.wire_item(pre.withColumn("gap", gap).filter(F.abs("gap") >= 0.2), "move", F.col("ts"),
                           F.when(F.col("gap") < 0, "down").otherwise("up"), F.when(F.abs("gap") >= 0.5, 3).otherwise(2))
    wire = drained(tape.wire_stream([filings, news, moves]), "wire")
    return wire.select("symbol", F.unix_seconds("time").alias("time_s"), "kind", "headline", "severity")


@query("t7_freshness_monitor", """
    WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS closed FROM orders GROUP BY 1),
    old AS (SELECT 'orders/' || month AS name, closed AS seq FROM o WHERE month < '1999-06'),
    new AS (SELECT 'orders/' || month AS name, CASE WHEN month[6:7] IN ('03', '09') THEN n ELSE closed END AS seq FROM o WHERE month >= '1995-06')
    SELECT 0::BIGINT AS batch, name, seq AS new_seq, 'added' AS status FROM old
    UNION ALL SELECT 1, b.name, b.seq, CASE WHEN a.seq IS NULL THEN 'added' ELSE 'changed' END FROM new b LEFT JOIN old a USING (name) WHERE a.seq IS NULL OR b.seq > a.seq""")
def t7(spark, d):
    """Two published indexes arrive one after the other; each lists one row per monthly file."""
    inbox = fresh_path(spark, "indexes")
    for i, m in enumerate(manifests(spark, d)):
        index = m.agg(F.max("seq").alias("seq"), F.map_from_entries(F.collect_list(F.struct("name", F.struct("seq", "sha256")))).alias("files"))
        index.coalesce(1).write.mode("append").json(f"{inbox}/publish={i}")
    stream = spark.readStream.schema(INDEX).option("maxFilesPerTrigger", 1).json(f"{inbox}/publish=*")
    moved, _ = tape.freshness_monitor(stream)
    return spark.read.schema("name string, new_seq bigint, status string, batch bigint").parquet(moved).select(
        "batch", "name", "new_seq", "status")
