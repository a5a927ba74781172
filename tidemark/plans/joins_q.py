"""Joins (J): precedence, bands, as-of, intervals, lookalikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, predicates
from ..functions import scalars as S
from ..operators import joins, market, ranking, records
from ..session import cut
from ..sources import derived
from ..sources.tables import events, table
from . import board
from .ctes import r6
from .features_q import CONSENSUS
from .registry import query, r

PRECEDENCE = ["one", "board", "top", "zone", "classic", "swing", "twin"]


def pick_lists(spark, d):
    """The named lists of a session in one long table: (session, symbol, list, pos, prob_dump).

    Whole lists: the board, the held-off names, and the orders of swing and squeeze odds.
    """
    cols = ["one_dump", "one_d3", "exp_dvol", "vol20", "prob_swing", "prob_squeeze", "publishable", "zone_reason"]
    rows, on = cut(board.picks(spark, d, places=("board",), keep=["prob_dump", *cols, "board_rank"])), ["session", "symbol"]
    first = [F.col("publishable").desc(), F.col("prob_dump").desc(), F.col("symbol")]
    classic = ranking.top_k(rows.select(*on, "prob_dump", "publishable"), "session", first, 1, "classic_rank").select(*on, "classic_rank")
    whole = ranking.row_numbers(rows, "session", "symbol", {
        "urank": F.col("prob_dump"), "swing_rank": F.col("prob_swing"), "twin_rank": F.col("prob_squeeze")})
    rows = ranking.beside(ranking.beside(board.consensus(rows), whole, on), classic, on, "left")
    entry = lambda cond, name, pos: F.when(cond, F.struct(F.lit(name).alias("list"), pos.cast("bigint").alias("pos")))
    lists = F.explode(F.array(
        entry(F.col("consensus_rank") == 1, "one", F.lit(1)),
        entry(F.col("board_rank").isNotNull(), "board", F.col("board_rank")),
        entry(F.col("board_rank") == 1, "top", F.lit(1)),
        entry(F.col("zone_reason").isNotNull(), "zone", F.col("urank")),
        entry(F.col("publishable") & (F.col("classic_rank") == 1), "classic", F.lit(1)),
        entry(F.col("prob_swing").isNotNull(), "swing", F.col("swing_rank")),
        entry(F.col("prob_squeeze").isNotNull(), "twin", F.col("twin_rank"))))
    long = rows.select("session", "symbol", "prob_dump", lists.alias("e")).filter(F.col("e").isNotNull())
    return long.select("session", "symbol", "e.list", "e.pos", "prob_dump")


LISTS_SQL = f"""
    WITH ranked AS (
      SELECT p.*, c.consensus_rank,
        row_number() OVER (PARTITION BY p.session ORDER BY publishable DESC, p.prob_dump DESC, p.symbol) AS classic_rank,
        row_number() OVER (PARTITION BY p.session ORDER BY prob_swing DESC, p.symbol) AS swing_rank,
        row_number() OVER (PARTITION BY p.session ORDER BY prob_squeeze DESC, p.symbol) AS twin_rank
      FROM picks p LEFT JOIN (SELECT session, symbol, consensus_rank FROM ({CONSENSUS})) c
        ON c.session = p.session AND c.symbol = p.symbol),
    lists AS (
      SELECT session, symbol, 'one' AS list, 1 AS prio, 1 AS pos, prob_dump FROM ranked WHERE consensus_rank = 1
      UNION ALL SELECT session, symbol, 'board', 2, board_rank, prob_dump FROM ranked WHERE board_rank IS NOT NULL
      UNION ALL SELECT session, symbol, 'top', 3, 1, prob_dump FROM ranked WHERE board_rank = 1
      UNION ALL SELECT session, symbol, 'zone', 4, urank, prob_dump FROM ranked WHERE zone_reason IS NOT NULL
      UNION ALL SELECT session, symbol, 'classic', 5, 1, prob_dump FROM ranked WHERE publishable AND classic_rank = 1
      UNION ALL SELECT session, symbol, 'swing', 6, swing_rank, prob_dump FROM ranked WHERE prob_swing IS NOT NULL
      UNION ALL SELECT session, symbol, 'twin', 7, twin_rank, prob_dump FROM ranked WHERE prob_squeeze IS NOT NULL)
"""


@query("j1_record_merge", LISTS_SQL + f""",
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, symbol ORDER BY prio, pos) AS k FROM lists) WHERE k = 1)
    SELECT f.session, f.symbol, CASE f.list WHEN 'top' THEN 'board' ELSE f.list END AS "where", CAST(f.pos AS BIGINT) AS pos, {r6('f.prob_dump', 'prob_dump', 9)},
      t.pos AS twin_pos, CASE WHEN f.list <> 'classic' THEN c.pos END AS classic_pos, CASE WHEN f.list <> 'swing' THEN w.pos END AS swing_pos
    FROM first f
      LEFT JOIN (SELECT session, symbol, CAST(pos AS BIGINT) AS pos FROM lists WHERE list = 'twin') t ON t.session = f.session AND t.symbol = f.symbol
      LEFT JOIN (SELECT session, symbol, CAST(pos AS BIGINT) AS pos FROM lists WHERE list = 'classic') c ON c.session = f.session AND c.symbol = f.symbol
      LEFT JOIN (SELECT session, symbol, CAST(pos AS BIGINT) AS pos FROM lists WHERE list = 'swing') w ON w.session = f.session AND w.symbol = f.symbol""",
       "picks")
def j1(spark, d):
    merged = joins.merge_records(pick_lists(spark, d), ["session", "symbol"], PRECEDENCE, ["twin", "classic", "swing"])
    return merged.select("session", "symbol", "where", "pos", r("prob_dump", places=9), F.col("as_twin.pos").alias("twin_pos"),
                         F.col("as_classic.pos").alias("classic_pos"), F.col("as_swing.pos").alias("swing_pos"))


@query("j2_has_record", """
    SELECT f.orderkey, f.line, f.symbol, f.day, f.category, b.symbol IS NOT NULL AS has_record
    FROM filings f LEFT JOIN (SELECT DISTINCT session, symbol FROM board) b ON b.symbol = f.symbol AND b.session = f.session""",
       ("filings", "board"))
def j2(spark, d):
    return joins.mark_known(derived.filings(spark, d), board.board(spark, d, (), []), ["session", "symbol"], "has_record").select(
        "orderkey", "line", "symbol", "day", "category", "has_record")


# Report bands of the rank-band record (ranks beyond the last fall into it).
REPORT_BANDS = [(1, 1), (2, 10), (11, 25), (26, 50)]


def band_frame(spark, bands):
    return spark.createDataFrame([(lo, hi) for lo, hi in bands], "lo bigint, hi bigint")


def bands_sql(bands) -> str:
    return "(VALUES " + ", ".join(f"({lo}::BIGINT, {hi}::BIGINT)" for lo, hi in bands) + ") b(lo, hi)"


@query("j3_band_join", f"""
    SELECT session, symbol, urank, coalesce(lo, 26) AS lo, coalesce(hi, 50) AS hi
    FROM picks LEFT JOIN {bands_sql(REPORT_BANDS)} ON urank BETWEEN lo AND hi""", "picks")
def j3(spark, d):
    rows = board.picks(spark, d, places=("urank",), keep=["urank"])
    return joins.band_join(rows, band_frame(spark, REPORT_BANDS), "urank")


SUMMARY_BANDS = [(1, 1), (2, 10), (11, 25), (26, 50), (51, 100), (1, 10), (1, 100)]


def band_report(rows, bands, value, by=()):
    """Hit rate per band, summaries included: each rank is looked up in every band that holds it."""
    met = rows.join(F.broadcast(bands), (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    return met.groupBy(*by, "lo", "hi").agg(
        F.avg(F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0)).alias("hit"), F.avg("next_oc").alias("mean_oc"),
        F.count("*").alias("n"))


_REPORT_SQL = f"""
    SELECT model_used, lo, hi, avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS hit, avg(next_oc) AS mean_oc, count(*) AS n
    FROM picks JOIN {bands_sql(SUMMARY_BANDS)} ON urank BETWEEN lo AND hi WHERE next_oc IS NOT NULL GROUP BY ALL"""


@query("j4_disjoint_bands", f"""
    WITH report AS ({_REPORT_SQL})
    SELECT model_used, lo, hi, {r6('hit')}, {r6('mean_oc')}, n FROM report a WHERE NOT EXISTS (
      SELECT 1 FROM report o WHERE o.model_used = a.model_used AND o.lo >= a.lo AND o.hi <= a.hi AND (o.lo <> a.lo OR o.hi <> a.hi))""",
       "picks")
def j4(spark, d):
    rows = board.picks(spark, d, places=("urank",), keep=["urank", "model_used", "next_oc"]).filter(F.col("next_oc").isNotNull())
    report = band_report(rows, band_frame(spark, SUMMARY_BANDS), "urank", ["model_used"])
    return joins.disjoint_bands(report, ["model_used"]).select("model_used", "lo", "hi", r("hit"), r("mean_oc"), "n")


@query("j5_asof_bar", f"""
    SELECT e.report_id, e.symbol, e.date, b.session AS bar_session, {r6('b.close', 'bar_close')}
    FROM earnings e ASOF LEFT JOIN bars_w b ON e.symbol = b.symbol AND e.date >= b.session""", ("earnings", "bars_w"))
def j5(spark, d):
    met = joins.asof_join(derived.earnings(spark, d), derived.bars(spark, d, "week"), ["symbol"], "date", "session",
                          ["session", "close"], grain="QUARTER", prefix="bar_")
    return met.select("report_id", "symbol", "date", "bar_session", r("bar_close"))


@query("j6_premarket_asof", f"""
    WITH pre AS (SELECT symbol, CAST(et AS DATE) AS session, arg_max(price, ts) AS price, max(ts) AS asof FROM (
        SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS et FROM ticks)
      WHERE strftime(et, '%H:%M') < '08:00' GROUP BY 1, 2),
    known AS (SELECT symbol, session + 1 AS known_on, close FROM bars_d)
    SELECT p.symbol, p.session, {r6('p.price', 'price')}, CAST(floor(epoch(p.asof)) AS BIGINT) AS asof_s, {r6('k.close', 'prev_close')},
      {r6('p.price / nullif(k.close, 0) - 1', 'gap_pct')}
    FROM pre p ASOF LEFT JOIN known k ON p.symbol = k.symbol AND p.session >= k.known_on""", ("ticks", "bars_d"))
def j6(spark, d):
    ticks = derived.ticks(spark, d).withColumn("session", S.et_date("ts"))
    pre = joins.latest_before(ticks, ["symbol", "session"], "ts", S.et_hhmm("ts") < "08:00", ["price", "ts"])
    known = derived.daily_bars(spark, d).select("symbol", F.date_add("session", 1).alias("known_on"), "close")
    met = joins.asof_join(pre, known, ["symbol"], "session", "known_on", ["close"], grain="MONTH", prefix="prev_")
    return met.select("symbol", "session", r("price"), F.unix_seconds("ts").alias("asof_s"), r("prev_close"),
                      r(F.try_divide(F.col("price"), F.col("prev_close")) - 1, "gap_pct"))


@query("j7_borrow_asof", f"""
    SELECT p.symbol, p.session, b.day AS borrow_day, b.status, {r6('b.fee_rate', 'fee_rate')}, {r6('b.available', 'available')}
    FROM (SELECT symbol, session, last_day(session) AS publish FROM bars) p
      ASOF LEFT JOIN borrow b ON p.symbol = b.symbol AND p.publish >= b.day""", ("bars", "borrow"))
def j7(spark, d):
    published = derived.bars(spark, d).select("symbol", "session", F.last_day("session").alias("publish"))
    met = joins.asof_join(published, derived.borrow(spark, d), ["symbol"], "publish", "day",
                          ["day", "status", "fee_rate", "available"], prefix="b_")
    return met.select("symbol", "session", F.col("b_day").alias("borrow_day"), F.col("b_status").alias("status"),
                      r("b_fee_rate", "fee_rate"), r("b_available", "available"))


@query("j8_pit_features", f"""
    WITH met AS (SELECT p.symbol, p.session, p.decided, b.known_at, b.fee_rate
      FROM (SELECT symbol, session, session + 14 AS decided FROM bars) p
        ASOF LEFT JOIN (SELECT symbol, day + 2 AS known_at, fee_rate FROM borrow) b ON p.symbol = b.symbol AND p.decided >= b.known_at)
    SELECT session, count(*) AS n, count(known_at) AS n_known, count(*) FILTER (known_at > decided) AS violations,
      {r6('avg(fee_rate)', 'mean_fee')} FROM met GROUP BY session""", ("bars", "borrow"))
def j8(spark, d):
    """Borrow rows become known two days after their day; a pick is decided mid-session."""
    decided = derived.bars(spark, d).select("symbol", "session", F.date_add("session", 14).alias("decided"))
    known = derived.borrow(spark, d).select("symbol", F.date_add("day", 2).alias("known_at"), "fee_rate")
    met = joins.asof_join(decided, known, ["symbol"], "decided", "known_at", ["known_at", "fee_rate"])
    return met.groupBy("session").agg(
        F.count("*").alias("n"), F.count("known_at").alias("n_known"),
        F.count_if(F.col("known_at") > F.col("decided")).alias("violations"), r(F.avg("fee_rate"), "mean_fee"))


@query("j9_reference_group", f"""
    WITH base AS (SELECT avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS b FROM panel WHERE next_oc IS NOT NULL),
    study AS (SELECT category, avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS pct_dump, count(*) AS n
      FROM (SELECT DISTINCT symbol, session, category FROM filings) f JOIN panel p USING (symbol, session)
      WHERE next_oc IS NOT NULL GROUP BY category),
    ref AS (SELECT category, avg(CASE WHEN next_oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS r FROM (
        SELECT DISTINCT symbol, category FROM filings WHERE category IN ('offering', 'atm')) f JOIN panel p USING (symbol)
      WHERE next_oc IS NOT NULL GROUP BY category)
    SELECT category, n, {r6('pct_dump')}, {r6('coalesce(r, b)', 'reference')}, r IS NOT NULL AS own_group,
      {r6('pct_dump / nullif(coalesce(r, b), 0)', 'lift')} FROM study LEFT JOIN ref USING (category), base""", ("filings", "panel"))
def j9(spark, d):
    """Each category against names that ever filed it where such a group is kept, else against all names."""
    rows = board.panel(spark, d).filter(F.col("next_oc").isNotNull()).select("symbol", "session", "next_oc")
    filed = derived.filings(spark, d)
    dumped = F.avg(F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0))
    study = rows.join(filed.select("symbol", "session", "category").distinct(), ["symbol", "session"]).groupBy("category").agg(
        dumped.alias("pct_dump"), F.count("*").alias("n"))
    own = filed.filter(F.col("category").isin("offering", "atm")).select("symbol", "category").distinct()
    ref = rows.join(own, "symbol").groupBy("category").agg(dumped.alias("ref"))
    base = rows.agg(dumped.alias("b")).scalar()
    return market.against_reference(study, ref, base, "category").select(
        "category", "n", r("pct_dump"), r("reference"), "own_group", r("lift"))


@query("j11_first_passing", """
    SELECT session, symbol, urank, CASE WHEN urank = pick THEN 'picked' ELSE 'passed over' END AS role
    FROM picks JOIN (SELECT session, min(urank) FILTER (zone_reason IS NULL AND publishable) AS pick FROM picks GROUP BY session) USING (session)
    WHERE urank <= pick""", "picks")
def j11(spark, d):
    passes = F.col("zone_reason").isNull() & F.col("publishable")
    rows = cut(board.picks(spark, d, places=("urank", "danger"), keep=["urank", "zone_reason", "publishable"]))
    return joins.first_passing(rows, "session", "urank", passes).select("session", "symbol", "urank", "role")


LOOKALIKE_COLS = ["price", "market_cap", "dd_52w", "short_ratio_5d", "vol20"]
_Z = {c: f"coalesce(({c} - avg({c}) OVER s) / nullif(stddev_samp({c}) OVER s, 0), 0)" for c in LOOKALIKE_COLS}
_DOT = lambda a, b: " + ".join(f"{a}.z_{c} * {b}.z_{c}" for c in LOOKALIKE_COLS)


@query("j12_lookalikes", f"""
    WITH z AS (SELECT *, {', '.join(f'{e} AS z_{c}' for c, e in _Z.items())} FROM picks WINDOW s AS (PARTITION BY session)),
    sim AS (SELECT a.session, a.symbol AS anchor, b.symbol, round(({_DOT('a', 'b')}) / nullif(sqrt({_DOT('a', 'a')}) * sqrt({_DOT('b', 'b')}), 0), 9) AS similarity
      FROM z a JOIN z b ON a.session = b.session AND a.symbol <> b.symbol WHERE a.urank = 1)
    SELECT session, anchor, symbol, {r6('similarity')}, twin_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY similarity DESC, symbol) AS twin_rank FROM sim WHERE similarity >= 0.5)
    WHERE twin_rank <= 10""", "picks")
def j12(spark, d):
    rows = cut(board.picks(spark, d, places=("urank",), keep=["urank", *LOOKALIKE_COLS]))
    z = joins.zscores(rows, "session", LOOKALIKE_COLS)
    vector = F.array(*[F.col(f"z_{c}") for c in LOOKALIKE_COLS])
    return joins.lookalikes(z, "session", "symbol", vector, F.col("urank"), 10, 0.5).select(
        "session", "anchor", "symbol", r("similarity"), "twin_rank")


@query("j12_lookalikes_embeddings", f"""
    WITH a AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e, min(vec_id) AS anchor FROM embeddings GROUP BY label)
    SELECT label, anchor, vec_id, {r6('similarity')}, twin_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS twin_rank FROM (
        SELECT b.label, anchor, vec_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings b JOIN a USING (label) WHERE vec_id <> anchor) WHERE similarity >= 0.0) WHERE twin_rank <= 10""")
def j12_embeddings(spark, d):
    """The same operator on stored vectors: group = label, anchor = smallest id of the label."""
    rows = table(spark, d, "embeddings")
    return joins.lookalikes(rows, "label", "vec_id", F.col("embedding"), F.col("vec_id"), 10, 0.0).select(
        "label", "anchor", "vec_id", r("similarity"), "twin_rank")


@query("j13_same_days", f"""
    WITH a AS (SELECT session, next_oc AS oc_a FROM picks WHERE urank = 1 AND next_oc IS NOT NULL),
    b AS (SELECT session, arg_min(next_oc, urank) AS oc_b FROM picks WHERE zone_reason IS NULL AND publishable AND next_oc IS NOT NULL GROUP BY session)
    SELECT count(*) AS n_days, {r6('avg(oc_a)', 'mean_a')}, {r6('avg(oc_b)', 'mean_b')},
      {r6('avg(CASE WHEN oc_a <= -0.05 THEN 1.0 ELSE 0.0 END)', 'dump_a')}, {r6('avg(CASE WHEN oc_b <= -0.05 THEN 1.0 ELSE 0.0 END)', 'dump_b')}
    FROM a JOIN b USING (session)""", "picks")
def j13(spark, d):
    graded = board.picks(spark, d, places=("urank", "danger")).filter(F.col("next_oc").isNotNull())
    passes = F.col("zone_reason").isNull() & F.col("publishable")
    both = records.same_days(graded, {"oc_a": F.col("urank") == 1, "oc_b": passes}, "urank", "next_oc")
    dump = lambda c: F.avg(F.when(F.col(c) <= fixed.DUMP, 1.0).otherwise(0.0))
    return both.agg(
        F.count("*").alias("n_days"), r(F.avg("oc_a"), "mean_a"), r(F.avg("oc_b"), "mean_b"),
        r(dump("oc_a"), "dump_a"), r(dump("oc_b"), "dump_b"))


@query("j14_calendar_earnings", f"""
    WITH held AS (SELECT DISTINCT session FROM bars),
    later AS (SELECT CAST(d AS DATE) AS session FROM (SELECT unnest(generate_series((SELECT max(session) FROM held) + INTERVAL 1 DAY,
        (SELECT max(session) FROM held) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS d)
      WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN ({', '.join(repr(h) for h in fixed.HOLIDAYS)}) ORDER BY d LIMIT 5),
    s AS (SELECT session, row_number() OVER (ORDER BY session) AS i FROM (SELECT session FROM held UNION ALL SELECT session FROM later)),
    ends AS (SELECT a.session, b.session AS until FROM s a JOIN s b ON b.i = a.i + 5)
    SELECT e.report_id, e.symbol, e.date, x.session,
      (SELECT count(*) FROM s WHERE s.session > x.session AND s.session < e.date) + 1 AS sessions_ahead
    FROM earnings e JOIN ends x ON e.date > x.session AND e.date <= x.until""",
       ("bars", "earnings"))
def j14(spark, d):
    sessions = derived.bars(spark, d).select("session").distinct()
    return joins.upcoming_events(derived.earnings(spark, d), sessions, "date", 5).select(
        "report_id", "symbol", "date", "session", "sessions_ahead")


@query("j14_calendar_lockups", f"""
    WITH ipo AS (SELECT symbol, min(session) AS ipo_date, arg_min(open, session) AS ipo_price FROM bars GROUP BY symbol)
    SELECT b.symbol, b.session, ipo_date + 180 AS lockup_date, CAST((ipo_date + 180) - b.session AS BIGINT) AS days_to,
      {r6('b.close / nullif(ipo_price, 0) - 1', 'vs_ipo')}
    FROM bars b JOIN ipo USING (symbol) WHERE abs((ipo_date + 180) - b.session) <= 60""", "bars")
def j14_lockups(spark, d):
    return market.lockups(derived.bars(spark, d), 180, 60).select("symbol", "session", "lockup_date", "days_to", r("vs_ipo"))


@query("j15_event_since_close", """
    SELECT p.session, p.symbol, p.urank FROM (SELECT *, session + 20 AS last_close, session + 27 AS publish FROM picks) p
    WHERE EXISTS (SELECT 1 FROM filings f WHERE f.symbol = p.symbol AND f.category = 'registration' AND f.day > p.last_close AND f.day <= p.publish)""",
       ("picks", "filings"))
def j15(spark, d):
    rows = board.picks(spark, d, places=("urank",)).select("session", "symbol", "urank", F.date_add("session", 20).alias("last_close"),
                                        F.date_add("session", 27).alias("publish"))
    results = derived.filings(spark, d).filter(F.col("category") == "registration")
    return joins.has_event_between(rows, results, ["symbol"], "last_close", "publish", "day").select("session", "symbol", "urank")
