"""Feeds and audits (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import TODAY, UNIVERSE
from ..session import cut, fresh_path
from ..sources import derived, feeds, refresh
from ..sources.tables import events, table
from . import board
from .ctes import r6
from .registry import query, r


def board_documents(spark, d):
    """The day's feed document of every session: a board of at most 100 picks."""
    cols = ["name", "country", "urank", "prob_dump", "flags", "model_used", "status", "available", "fee_rate", "capacity", "spread", "c10"]
    rows = board.board(spark, d, ("urank",), cols)
    held = F.struct("rank", F.col("symbol").cast("string").alias("symbol"), *cols)
    docs = rows.groupBy("session").agg(F.sort_array(F.collect_list(held)).alias("b"))
    pick = lambda x: F.struct(
        *[x[c].alias(c) for c in ("symbol", "name", "country", "rank", "urank", "prob_dump", "flags", "model_used")],
        F.struct(*[x[c].alias(c) for c in ("status", "available", "fee_rate")]).alias("shortability"),
        F.struct(x["capacity"].alias("capacity"), x["spread"].alias("spread"), F.create_map(F.lit("10000"), x["c10"]).alias("costs")).alias("size"))
    return docs.select("session", F.to_json(F.struct(
        F.col("session").alias("session_date"), F.lit("morning").alias("run"), F.transform("b", pick).alias("board"))).alias("json"))


@query("s1_feed_load", f"""
    SELECT session AS session_date, 'morning' AS run, CAST(symbol AS VARCHAR) AS symbol, rank, {r6('prob_dump', places=9)}, status, {r6('fee_rate')},
      {r6('c10', 'cost_10k')}, 0::BIGINT AS n_optional FROM board""", "board")
def s1(spark, d):
    """Documents are written below the shared folder and read back under the schema; the optional feed is absent."""
    path = fresh_path(spark, "today")
    feeds.write_documents(board_documents(spark, d), path, "session")
    today = feeds.load_feed(spark, path, TODAY)
    absent = feeds.load_feed(spark, path + "-unified", "lists MAP<STRING, STRING>").count()
    return today.select("session_date", "run", F.explode("board").alias("p")).select(
        "session_date", "run", "p.symbol", "p.rank", r("p.prob_dump", "prob_dump", 9), "p.shortability.status",
        r("p.shortability.fee_rate", "fee_rate"), r(F.col("p.size.costs")["10000"], "cost_10k"),
        F.lit(absent).cast("bigint").alias("n_optional"))


_UNIVERSE = {"symbol": "bigint", "name": "string", "prob_dump": "double", "capacity": "double", "board_rank": "bigint",
             "fee_rate": "double", "missing": "double"}


@query("s2_columnar_to_rows", f"""
    SELECT session AS session_date, symbol, name, {r6('prob_dump', places=9)}, {r6('capacity', places=2)}, board_rank, {r6('fee_rate')}, NULL::DOUBLE AS missing FROM picks""", "picks")
def s2(spark, d):
    """Universe documents hold at most 500 names each."""
    cols = [c for c in _UNIVERSE if c != "missing"]
    rows = board.picks(spark, d, places=("board",), keep=cols).select("session", *cols)
    docs = rows.groupBy("session", F.floor(F.col("symbol") / 500).alias("part")).agg(
        F.collect_list(F.array(*[F.col(c).cast("string") for c in cols])).alias("rows"))
    text = docs.select(F.to_json(F.struct(F.col("session").alias("session_date"), F.array(*[F.lit(c) for c in cols]).alias("columns"), "rows")).alias("json"))
    parsed = text.select(F.from_json("json", UNIVERSE).alias("u")).select("u.*")
    out = feeds.columnar_to_rows(parsed, _UNIVERSE, keep=["session_date"])
    return out.select("session_date", "symbol", "name", r("prob_dump", places=9), r("capacity", places=2), "board_rank", r("fee_rate"), "missing")


@query("s3_explode_bars", f"""
    SELECT symbol, bar, session, {r6('close')}, open IS NOT NULL AS strict_ok FROM (
      SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS bar, session,
        CASE WHEN month(session) = 5 AND symbol % 10 = 3 THEN NULL ELSE open END AS open,
        CASE WHEN month(session) = 7 AND symbol % 10 = 4 THEN NULL ELSE close END AS close FROM bars) WHERE close IS NOT NULL""", "bars")
def s3(spark, d):
    """Charts as the feed nests them, with some non-finite prices; one bar per session of the calendar."""
    broken = lambda c, m, k: F.when((F.month("session") == m) & (F.col("symbol") % 10 == k), "NaN").otherwise(F.col(c).cast("string"))
    bar = F.array(F.col("session").cast("string"), broken("open", 5, 3), F.col("high").cast("string"), F.col("low").cast("string"),
                  broken("close", 7, 4), F.col("volume").cast("string"))
    charts = derived.bars(spark, d).groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("session", bar.alias("bar")))), lambda x: x["bar"]).alias("chart"))
    loose = feeds.explode_bars(charts, ["symbol"])
    return loose.select("symbol", "bar", "session", r("close"), F.col("open").isNotNull().alias("strict_ok"))


def manifests(spark, d):
    """Two published manifests of the monthly order files, an older and a newer one."""
    o = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "O").alias("closed"))
    name = F.concat(F.lit("orders/"), F.col("month"))
    entry = lambda seq: [name.alias("name"), seq.alias("seq"), F.sha2(F.concat(name, F.lit(":"), seq.cast("string")), 256).alias("sha256")]
    old = o.filter(F.col("month") < "1999-06").select(*entry(F.col("closed")))
    moved = F.when(F.substring("month", 6, 2).isin("03", "09"), F.col("n")).otherwise(F.col("closed"))
    new = o.filter(F.col("month") >= "1995-06").select(*entry(moved))
    return old, new


@query("s4_manifest_diff", """
    WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS closed FROM orders GROUP BY 1),
    old AS (SELECT 'orders/' || month AS name, closed AS seq FROM o WHERE month < '1999-06'),
    new AS (SELECT 'orders/' || month AS name, CASE WHEN month[6:7] IN ('03', '09') THEN n ELSE closed END AS seq FROM o WHERE month >= '1995-06')
    SELECT name, old_seq, new_seq, status, status IN ('added', 'changed') AS reread FROM (
      SELECT coalesce(a.name, b.name) AS name, a.seq AS old_seq, b.seq AS new_seq,
        CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' WHEN b.seq > a.seq THEN 'changed' ELSE 'same' END AS status
      FROM old a FULL JOIN new b ON a.name = b.name)""")
def s4(spark, d):
    return feeds.manifest_diff(*manifests(spark, d))


_BLOCK = "CAST((day - DATE '1992-01-01') // 30 AS BIGINT)"


@query("s4_incremental_refresh", f"""
    WITH blocked AS (SELECT *, {_BLOCK} AS block, CAST(date_trunc('month', day) AS DATE) AS session FROM trades),
    published AS (SELECT *, CASE WHEN block % 12 = 5 THEN price * 1.1::DOUBLE ELSE price END AS now FROM blocked WHERE block >= 3),
    moved AS (SELECT DISTINCT session FROM blocked WHERE block < 3 OR block % 12 = 5 OR block >= 60)
    SELECT symbol, session, {r6('first(now ORDER BY day, seq)', 'open')}, {r6('max(now)', 'high')}, {r6('min(now)', 'low')}, {r6('last(now ORDER BY day, seq)', 'close')},
      {r6('sum(qty) * 1000', 'volume', 2)}, CAST(CASE WHEN session IN (FROM moved) THEN 2 ELSE 1 END AS INTEGER) AS built FROM published GROUP BY symbol, session""", "trades")
def s4_refresh(spark, d):
    """Monthly bars from published files of 30 days each, refreshed after a second index added, changed and removed some of them."""
    home = fresh_path(spark, "derived")
    prints = derived.trades(spark, d).withColumn("block", F.floor(F.datediff("day", F.lit("1992-01-01").cast("date")) / 30))
    prints = prints.withColumn("name", F.format_string("prints-%04d", "block")).select("name", "block", "symbol", "day", "price", "qty", "linestatus", "returnflag", "seq")
    changed = F.col("block") % 12 == 5

    def land(rows, version):
        rows.drop("block").withColumn("version", F.lit(version)).repartition("name").write.mode("append").partitionBy("name", "version").parquet(f"{home}/landed")

    def index(rows, version):
        files = rows.select("name", version.cast("bigint").alias("seq")).distinct()
        return files.withColumn("sha256", F.sha2(F.concat_ws(":", "name", "seq"), 256))

    def read(files):
        paths = [f"{home}/landed/name={n}/version={v}" for n, v in files]
        rows = spark.read.option("basePath", f"{home}/landed").parquet(*paths)
        return rows.withColumn("session", F.trunc("day", "month"))

    derive = lambda rows: derived.session_bars(rows, "month")
    land(prints.filter("block < 60"), 1)
    refresh.refresh(index(prints.filter("block < 60"), F.lit(1)), home, read, derive)
    land(prints.filter(changed & (F.col("block") >= 3) | (F.col("block") >= 60)).withColumn("price", F.when(changed, F.col("price") * 1.1).otherwise(F.col("price"))), 2)
    later = prints.filter("block >= 3")
    refresh.refresh(index(later, F.when(changed | (F.col("block") >= 60), 2).otherwise(1)), home, read, derive)
    bars = refresh.current(spark, home, "symbol bigint, open double, high double, low double, close double, volume double, built int, session date")
    return bars.select("symbol", "session", *[r(c) for c in ("open", "high", "low", "close")], r("volume", places=2), "built")


@query("s5_manifest_monotonic", """
    SELECT event_id, held, coalesce(seq >= held, true) AS accepted FROM (
      SELECT *, max(seq) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
      FROM (SELECT *, event_id + 20 * size AS seq FROM ticks))""", "ticks")
def s5(spark, d):
    log = derived.ticks(spark, d).withColumn("seq", F.col("event_id") + 20 * F.col("size"))
    return feeds.monotonic(log, ["symbol"], "ts", "seq").select("event_id", "held", "accepted")


@query("s6_feed_integrity", "SELECT DISTINCT CAST(session AS VARCHAR) AS name, month(session) <> 3 AS ok FROM board", "board")
def s6(spark, d):
    """March documents carry a wrong digest in the manifest."""
    docs = cut(board_documents(spark, d))
    path = fresh_path(spark, "published")
    feeds.write_documents(docs, path, "session")
    digest = F.sha2(F.concat("json", F.when(F.month("session") == 3, "?").otherwise("\n")), 256)
    manifest = docs.select(F.col("session").cast("string").alias("name"), digest.alias("sha256"))
    return feeds.integrity(spark, path, manifest).select("name", "ok")


@query("s7_history_append", f"""
    SELECT symbol, count(*) AS n, {r6('arg_min(prob_dump, session)', 'first_odds', 9)}, {r6('arg_max(prob_dump, session)', 'last_odds', 9)}, 0::BIGINT AS rewritten
    FROM scored GROUP BY symbol""", "scored")
def s7(spark, d):
    """Two snapshots that overlap: the second adds only the sessions the first did not have."""
    path = fresh_path(spark, "history")
    snap = cut(board.scored(spark, d).select("symbol", "prob_dump", "session"))
    feeds.append_history(snap.filter(F.col("session") < F.lit("1999-01-01").cast("date")), path)
    feeds.append_history(snap.withColumn("prob_dump", F.when(
        F.col("session") < F.lit("1999-01-01").cast("date"), -1.0).otherwise(F.col("prob_dump"))), path)
    held = feeds.load_history(spark, path, "symbol bigint, prob_dump double, session date")
    series = feeds.history_series(held, "prob_dump")
    value = lambda i: F.element_at("series", i)["prob_dump"]
    return series.select("symbol", F.size("series").cast("bigint").alias("n"), r(value(1), "first_odds", 9), r(value(-1), "last_odds", 9),
                         F.size(F.filter("series", lambda x: x["prob_dump"] < 0)).cast("bigint").alias("rewritten"))


@query("s8_source_health", """
    SELECT CAST(ts AS DATE) AS run, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) AS n_sources,
      count(*) FILTER (event_type <> 'error') = count(*) AS all_ok FROM events GROUP BY 1""")
def s8(spark, d):
    return feeds.source_health(events(spark, d).withColumn("run", F.to_date("ts")), "run", F.col("event_type") != "error")


_ET_DAY = "CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)"


@query("s9_staleness_audit", f"""
    WITH f AS (SELECT event_id, ts, size, event_type = 'signup' AS late, event_type = 'error' AS withheld, CASE WHEN event_type = 'error' AND size % 10 > 0 THEN ts + (size - 50) * INTERVAL 1 MINUTE END AS withheld_at,
        {_ET_DAY} - CAST(size % 3 AS INT) AS session_date, CASE WHEN size % 2 = 0 THEN 'evening' ELSE 'morning' END AS run,
        {_ET_DAY} - CAST(size % 10 AS INT) AS layer_session, CASE WHEN size % 4 > 0 THEN {_ET_DAY} END AS live_session, size % 25 = 0 AS sample FROM ticks)
    SELECT event_id, late AS is_late, withheld AND coalesce(withheld_at > ts, true) AS newer_withheld, NOT sample AND session_date < {_ET_DAY} AS stale_session,
      NOT sample AND run = 'evening' AND session_date = {_ET_DAY} AND strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') >= '08:45' AS morning_missing,
      session_date - layer_session > 4 AS layer_stale, coalesce(live_session <> session_date, false) AS live_other_session, sample AS is_sample FROM f""", "ticks")
def s9(spark, d):
    """Each event stands for a feed run as seen at its own instant."""
    t, day = derived.ticks(spark, d), S.et_date("ts")
    runs = t.select(
        "event_id", F.col("ts").alias("now"), F.col("ts").alias("generated_at"), (F.col("event_type") == "signup").alias("late"),
        F.when(F.col("event_type") == "error", "checks").alias("withheld_reason"),
        F.when((F.col("event_type") == "error") & (F.col("size") % 10 > 0), F.timestamp_micros(F.unix_micros("ts") + (F.col("size") - 50) * 60_000_000)).alias("withheld_at"),
        F.date_sub(day, (F.col("size") % 3).cast("int")).alias("session_date"),
        F.when(F.col("size") % 2 == 0, "evening").otherwise("morning").alias("run"),
        F.date_sub(day, (F.col("size") % 10).cast("int")).alias("layer_session"),
        F.when(F.col("size") % 4 > 0, day).alias("live_session"), (F.col("size") % 25 == 0).alias("sample"))
    return feeds.staleness(runs).select("event_id", "is_late", "newer_withheld", "stale_session", "morning_missing", "layer_stale",
                                        "live_other_session", "is_sample")


@query("s10_coverage_funnel", """
    SELECT session, count(*) AS listed, count(*) FILTER (dvol20 >= 300000) AS eligible,
      count(*) FILTER (vol20 IS NOT NULL AND dist_ma20 IS NOT NULL AND r1 IS NOT NULL) AS scored,
      count(*) FILTER (vol20 IS NOT NULL AND dist_ma20 IS NOT NULL AND r1 IS NOT NULL AND symbol % 2 = 0) AS m1_names FROM panel GROUP BY session""", "panel")
def s10(spark, d):
    scored = F.col("vol20").isNotNull() & F.col("dist_ma20").isNotNull() & F.col("r1").isNotNull()
    return feeds.funnel(board.panel(spark, d), {
        "listed": F.lit(True), "eligible": F.col("dvol20") >= 300000, "scored": scored, "m1_names": scored & (F.col("symbol") % 2 == 0)})
