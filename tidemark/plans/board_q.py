"""Filters (F), orders and limits (O) of the board and the lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, predicates, sizing
from ..functions import scalars as S
from ..operators import ranking, records
from ..sources import derived, search_index
from ..sources.tables import events, table
from . import board
from .ctes import r6
from .registry import query, r
from .scalars_q import _MIXED_SQL, _mixed_text

_ASIA = ", ".join(repr(c) for c in fixed.ASIA)
BOARD_TESTS = {
    "shortable": "coalesce(status IN ('ETB', 'HTB'), false) AND NOT coalesce(available <= 0, false)",
    "nosq": "coalesce(squeeze_danger < 45, false)",
    "asia": f"(list_contains(flags, 'ASIA') OR country IN ({_ASIA}))",
    "offer24": "fresh_supply",
    "sub1": "coalesce(price < 1, false)",
    "fits": "coalesce(capacity >= 30000, false)",
}
_SUBSETS = {
    "calm": ["shortable", "nosq"], "cheap asia": ["asia", "sub1"], "supply": ["offer24"],
    "all six": list(BOARD_TESTS), "none": [],
}


def _and(tests, ids):
    return " AND ".join(f"({tests[i]})" for i in ids) or "true"


#: What the board's filters read.
_FILTERED = ["status", "available", "squeeze_danger", "flags", "country", "fresh_supply", "price", "capacity"]


@query("f1_board_filters", f"""
    SELECT session, symbol, rank, unnest(list_filter([{', '.join(f"CASE WHEN {_and(BOARD_TESTS, ids)} THEN '{n}' END" for n, ids in _SUBSETS.items())}],
      lambda x: x IS NOT NULL)) AS filters FROM board""", "board")
def f1(spark, d):
    tests = predicates.board_filters()
    held = {n: predicates.all_of([tests[i] for i in ids]) for n, ids in _SUBSETS.items()}
    return records.in_subsets(board.board(spark, d, (), _FILTERED), held, "filters").select("session", "symbol", "rank", "filters")


@query("f2_facet_counts", f"""
    SELECT session, {', '.join(f'count(*) FILTER ({t}) AS "{n}"' for n, t in BOARD_TESTS.items())} FROM board GROUP BY session""", "board")
def f2(spark, d):
    return board.board(spark, d, (), _FILTERED).groupBy("session").agg(
        *[F.count_if(p).alias(n) for n, p in predicates.board_filters().items()])


@query("f3_fresh_event_24h", "SELECT symbol, session, fresh_supply FROM supply_m", "supply_m")
def f3(spark, d):
    return board.supply_by_session(derived.filings(spark, d)).select("symbol", "session", "fresh_supply")


LOOKUP_TESTS = {
    "short": "coalesce(status IN ('ETB', 'HTB'), false)",
    "nossr": "NOT coalesce(ssr_next, false)",
    "sub1": "coalesce(price < 1, false)",
    "board": "board_rank IS NOT NULL",
    "fits500": "coalesce(capacity >= 500000, false)",
}


def lookup(spark, d, places=board.PLACES, keep=None):
    return board.picks(spark, d, places=places, keep=keep).drop("ssr").withColumnRenamed("ssr_next", "ssr")


@query("f4_lookup_filters", f"""
    SELECT session, symbol, {', '.join(f'{t} AS "is_{n}"' for n, t in LOOKUP_TESTS.items())},
      {_and(LOOKUP_TESTS, ['short', 'nossr', 'board'])} AS kept FROM picks""", "picks")
def f4(spark, d):
    tests = predicates.lookup_filters()
    return lookup(spark, d, ("board",), ["status", "ssr_next", "price", "capacity", "board_rank"]).select(
        "session", "symbol", *[p.alias(f"is_{n}") for n, p in tests.items()],
        predicates.all_of([tests["short"], tests["nossr"], tests["board"]]).alias("kept"))


@query("f5_search", """
    SELECT symbol, name, row_number() OVER (ORDER BY (lower(CAST(symbol AS VARCHAR)) = '1') DESC, symbol) AS pos
    FROM names WHERE starts_with(lower(CAST(symbol AS VARCHAR)), '1') OR contains(lower(name), '1')""", "names")
def f5(spark, d):
    q = " 1 "
    ticker = F.col("symbol").cast("string")
    hits = derived.names(spark, d).filter(predicates.search_match(q, ticker, "name")).withColumn("_g", F.lit(1))
    hits = ranking.with_row_number(hits, "_g", predicates.search_order(q, "symbol", ticker), "pos")
    return hits.select("symbol", "name", "pos")


@query("f5_search_documents", """
    SELECT doc_id, source, lower(source) = 'src1' AS exact FROM documents
    WHERE starts_with(lower(source), 'src1') OR contains(lower(text), 'src1')""")
def f5_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(predicates.search_match("src1", "source", "text")).select(
        "doc_id", "source", (F.lower("source") == "src1").alias("exact"))


_SEARCHES = ("lier#00000001", "src1", "permission", "the ")


@query("f5_search_index", " UNION ALL ".join(f"""
    SELECT '{q}' AS query, 'name' AS kind, symbol AS key FROM names WHERE starts_with(lower(CAST(symbol AS VARCHAR)), '{q.strip()}') OR contains(lower(name), '{q.strip()}')
    UNION ALL SELECT '{q}', 'document', doc_id FROM documents WHERE starts_with(lower(source), '{q.strip()}') OR contains(lower(text), '{q.strip()}')""" for q in _SEARCHES), "names")
def f5_index(spark, d):
    """Several searches of names and documents through postings of trigrams, written once."""
    docs = search_index.build(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text")
    listed = derived.names(spark, d).select("symbol", F.col("symbol").cast("string").alias("ticker"), "name")
    listed = search_index.build(listed, "symbol", "ticker", "name")
    found = [index.search(q).select(F.lit(q).alias("query"), F.lit(kind).alias("kind"), F.col(index.key).alias("key"))
             for q in _SEARCHES for kind, index in (("name", listed), ("document", docs))]
    return reduce(DataFrame.unionByName, found)


@query("f6_fits_size", f"""
    SELECT session, symbol, {', '.join(f'coalesce(capacity >= {q}, false) AS fits_{q}' for q in fixed.SIZES)} FROM picks""", "picks")
def f6(spark, d):
    return board.picks(spark, d, places=()).select("session", "symbol", *[predicates.fits_size(q).alias(f"fits_{q}") for q in fixed.SIZES])


_TRADABLE = ("coalesce({price} >= 1 AND 0.05::DOUBLE * exp_dvol >= {q} AND "
             "exp_dvol * pow(0.005::DOUBLE / (0.7::DOUBLE * vol20), 2) >= {q}, false)")


@query("f7_tradable_universe", f"""
    SELECT session, symbol, {_TRADABLE.format(price='price', q=30000)} AS at_30k, {_TRADABLE.format(price='price', q=100000)} AS at_100k,
      publishable FROM picks""", "picks")
def f7(spark, d):
    return board.picks(spark, d, places=()).select(
        "session", "symbol", predicates.tradable(30000).alias("at_30k"), predicates.tradable(100000).alias("at_100k"),
        "publishable")


@query("f8_ssr_flag", "SELECT symbol, session, coalesce(ssr_trigger, false) AS triggered, coalesce(ssr, false) AS restricted FROM panel_w", "panel_w")
def f8(spark, d):
    return board.panel(spark, d, "week").select(
        "symbol", "session", F.coalesce("ssr_trigger", F.lit(False)).alias("triggered"),
        F.coalesce("ssr", F.lit(False)).alias("restricted"))


@query("f9_do_not_short", "SELECT session, symbol, zone_reason, zone_reason IS NOT NULL AS held_off FROM picks", "picks")
def f9(spark, d):
    return board.picks(spark, d, places=("danger",), keep=["zone_reason"]).select("session", "symbol", "zone_reason", F.col("zone_reason").isNotNull().alias("held_off"))


from .features_q import CONSENSUS  # noqa: E402


@query("f10_stand_aside", f"""
    WITH tape AS (SELECT session, level / lag(level) OVER (ORDER BY session) - 1 AS bench_r1
                  FROM (SELECT session, avg(close) AS level FROM bars GROUP BY session))
    SELECT session, symbol, tier, CASE WHEN bench_r1 <= -0.01 THEN 'tape' WHEN one_d3 < 0.5 THEN 'conviction'
      WHEN tier NOT IN ('high', 'medium') THEN 'tier' END AS reason
    FROM ({CONSENSUS}) JOIN tape USING (session) WHERE consensus_rank = 1""", ("picks", "bars"))
def f10(spark, d):
    return board.first_choices(spark, d).select(
        "session", "symbol", "tier", predicates.stand_aside("bench_r1", "one_d3", "tier").alias("reason"))


@query("f11_small_sample", """
    SELECT session, category, count(*) AS n, count(*) < 200 AS small_study, count(DISTINCT day) AS n_days,
      count(DISTINCT day) < 60 AS small_live FROM filings GROUP BY session, category""", "filings")
def f11(spark, d):
    n = derived.filings(spark, d).groupBy("session", "category").agg(
        F.count("*").alias("n"), F.countDistinct("day").alias("n_days"))
    return n.select("session", "category", "n", predicates.small_sample("n", 200).alias("small_study"),
                    "n_days", predicates.small_sample("n_days", 60).alias("small_live"))


@query("f12_drop_invalid", """
    SELECT event_id, title FROM (SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'signup' THEN NULL ELSE event_type END AS title,
      nullif(user_id, 3) AS symbol FROM events) WHERE title IS NOT NULL AND title <> '' AND symbol IS NOT NULL""")
def f12(spark, d):
    items = events(spark, d).select(
        "event_id", F.when(F.col("event_type") == "error", "").when(F.col("event_type") != "signup", F.col("event_type")).alias("title"),
        F.nullif("user_id", F.lit(3)).alias("symbol"))
    return items.filter(predicates.present("title", "symbol")).select("event_id", "title")


# ── orders and limits ───────────────────────────────────────────────────────

_LAW = "greatest(spread, 0.001::DOUBLE) + greatest(c10 - greatest(spread, 0.001::DOUBLE), 0) / 100 * sqrt(30000::DOUBLE)"
_SORT_SQL = {
    "prob": "prob_dump", "edge": "liq_edge", "lift": "lift", "gap": "gap_pct", "fee": "fee_rate",
    "sq": "squeeze_danger", "size": f"round({_LAW}, 9)", "symbol": "symbol", "rank": "rank",
}


def _pos_sql(key: str, flipped: bool) -> str:
    up = fixed.BOARD_SORTS[key][1] != flipped
    return (f"row_number() OVER (PARTITION BY session ORDER BY {_SORT_SQL[key]} {'ASC' if up else 'DESC'} NULLS LAST, rank) "
            f"AS {key}_{'flipped' if flipped else 'pos'}")


@query("o1_board_sort", f"""
    SELECT session, symbol, {', '.join(_pos_sql(k, f) for k in fixed.BOARD_SORTS for f in (False, True))} FROM board""", "board")
def o1(spark, d):
    cols = ["prob_dump", "liq_edge", "lift", "gap_pct", "fee_rate", "squeeze_danger", "c10", "spread"]
    rows = board.board(spark, d, ("lift",), cols).withColumn(
        "cost_at_size", F.round(sizing.cost_law(F.lit(30000.0), "c10", "spread"), 9))
    for k in fixed.BOARD_SORTS:
        for flipped in (False, True):     # a board holds at most 100 rows per session
            rows = ranking.with_row_number(rows, "session", ranking.board_order(k, flipped),
                                           f"{k}_{'flipped' if flipped else 'pos'}", small=True)
    return rows.select("session", "symbol", *[f"{k}_{s}" for k in fixed.BOARD_SORTS for s in ("pos", "flipped")])


@query("o2_paginate", f"""
    SELECT session, symbol, {r6('prob_dump', places=9)} FROM scored ORDER BY prob_dump DESC, session, symbol LIMIT 50 OFFSET 100""", "scored")
def o2(spark, d):
    rows = board.scored(spark, d)
    return ranking.paginate(rows, [F.col("prob_dump").desc(), F.col("session"), F.col("symbol")], 2).select(
        "session", "symbol", r("prob_dump", places=9))


_NEWEST = "SELECT *, prob_dump / nullif(prob_dump + prob_pump, 0) AS skew FROM picks WHERE session = (SELECT max(session) FROM picks)"


def newest(spark, d):
    """The lookup table's rows: all names of the last session."""
    rows = lookup(spark, d)
    last = rows.select("session").distinct().agg(F.max("session").alias("_last"))
    return rows.join(F.broadcast(last), F.col("session") == F.col("_last"), "left_semi").withColumn(
        "skew", S.down_skew("prob_dump", "prob_pump"))


def _lookup_sql(key: str, flipped: bool) -> str:
    col, up = fixed.LOOKUP_SORTS[key]
    return (f"row_number() OVER (ORDER BY {col if col == 'symbol' else f'round({col}, 9)'} {'ASC' if up != flipped else 'DESC'} NULLS LAST, symbol) "
            f"AS {key}_{'flipped' if flipped else 'pos'}")


@query("o2_lookup_sort", f"""
    SELECT symbol, {', '.join(_lookup_sql(k, f) for k in fixed.LOOKUP_SORTS for f in (False, True))} FROM ({_NEWEST})""", "picks")
def o2_sort(spark, d):
    """Positions of the last session's names under each of the ten orders, both ways."""
    shown = newest(spark, d)
    rows = shown.select("session", "symbol", *[F.round(c, 9).alias(c) for c, _ in fixed.LOOKUP_SORTS.values() if c != "symbol"])
    orders = {}
    for k, (c, up) in fixed.LOOKUP_SORTS.items():          # symbols are numbers here
        value = F.col(c).cast("double") if c == "symbol" else S.finite(c)
        orders |= {f"{k}_pos": -value if up else value, f"{k}_flipped": value if up else -value}
    return ranking.row_numbers(rows, "session", "symbol", orders).select("symbol", *[f"{k}_{s}" for k in fixed.LOOKUP_SORTS for s in ("pos", "flipped")])


@query("o2_lookup_page", f"""
    SELECT symbol, {r6('capacity', places=4)}, {r6('prob_dump', places=9)} FROM ({_NEWEST})
    WHERE {LOOKUP_TESTS['nossr']} ORDER BY round(capacity, 9) DESC NULLS LAST, symbol LIMIT 20 OFFSET 20""", "picks")
def o2_page(spark, d):
    """Second page of twenty names without a Rule 201 mark, largest capacity first."""
    rows = newest(spark, d).withColumn("capacity", F.round("capacity", 9))
    return ranking.lookup_page(rows, [predicates.lookup_filters()["nossr"]], key="capacity", page=1, per_page=20).select(
        "symbol", r("capacity", places=4), r("prob_dump", places=9))


_WHEN_SQL = """coalesce(CASE WHEN NOT regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN timezone('UTC', TRY_CAST(s AS TIMESTAMPTZ)) END,
      CASE WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}') THEN CAST(
        CAST(make_date(CAST(s[1:4] AS INT), 1, 1) + (CAST(s[6:7] AS INT) - 1) * INTERVAL 1 MONTH AS DATE) + (CAST(s[9:10] AS INT) - 1) AS TIMESTAMP) END)"""


@query("o3_wire_sort", f"""
    SELECT event_id, row_number() OVER (ORDER BY instant DESC NULLS LAST, event_id) AS pos
    FROM (SELECT event_id, {_WHEN_SQL} AS instant FROM ({_MIXED_SQL})) ORDER BY instant DESC NULLS LAST, event_id""")
def o3(spark, d):
    wire = events(spark, d).select("event_id", _mixed_text().alias("s"))
    at = F.coalesce(S.parse_ts("s"), S.parse_day("s").cast("timestamp"))
    order = ranking.newest_first(F.col("at"), "event_id")
    placed = wire.withColumns({"at": at, "_g": F.lit(1)})
    return ranking.with_row_number(placed, "_g", order, "pos").select("event_id", "pos")


@query("o4_topk_per_session", """
    SELECT session, symbol, rank, rank <= 1 AS top1, rank <= 3 AS top3, rank <= 10 AS top10, rank <= 25 AS top25 FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY prob_dump DESC, symbol) AS rank FROM scored) WHERE rank <= 100""", "scored")
def o4(spark, d):
    rows = ranking.top_k(board.scored(spark, d), "session", [F.col("prob_dump").desc(), F.col("symbol")], 100)
    return rows.select("session", "symbol", "rank", *[(F.col("rank") <= k).alias(f"top{k}") for k in (1, 3, 10, 25)])


@query("o5_top_reasons", """
    SELECT session, symbol, string_agg(flag, '|' ORDER BY strength DESC, i) AS reasons FROM (
      SELECT *, row_number() OVER (PARTITION BY session, symbol ORDER BY strength DESC, i) AS k FROM (
        SELECT session, symbol, flag, i, length(flag) % 3 + 1 AS strength FROM (
          SELECT session, symbol, unnest(flags) AS flag, generate_subscripts(flags, 1) AS i FROM picks))) WHERE k <= 3
    GROUP BY session, symbol""", "picks")
def o5(spark, d):
    reasons = F.transform("flags", lambda x: F.struct(x.alias("text"), (F.length(x) % 3 + 1).alias("strength")))
    rows = board.picks(spark, d, places=()).filter(F.size("flags") > 0).withColumn("reasons", reasons)
    best = F.transform(ranking.top_reasons("reasons", 3), lambda x: x["text"])
    return rows.select("session", "symbol", F.array_join(best, "|").alias("reasons"))


@query("o6_top_attribution", f"""
    SELECT session, symbol, string_agg(family, '|' ORDER BY share DESC, i) AS families, {r6('max(share)', 'largest')} FROM (
      SELECT *, row_number() OVER (PARTITION BY session, symbol ORDER BY share DESC, i) AS k FROM (
        {' UNION ALL '.join(f"SELECT session, symbol, '{p}' AS family, pr_{p} AS share, {i} AS i FROM danger" for i, p in enumerate(board.DANGER_PARTS))})
      WHERE share > 0) WHERE k <= 6 GROUP BY session, symbol""", "danger")
def o6(spark, d):
    rows = board.danger(spark, d)
    shares = F.create_map(*[x for p in board.DANGER_PARTS for x in (F.lit(p), F.coalesce(F.col(f"pr_{p}"), F.lit(0.0)))])
    rows = rows.withColumn("shares", shares).withColumn("best", ranking.top_attribution("shares", 6)).filter(F.size("best") > 0)
    return rows.select("session", "symbol", F.array_join("best.family", "|").alias("families"),
                       r(F.col("best")[0]["share"], "largest"))


@query("o7_live_sort", """
    SELECT session, symbol, row_number() OVER (PARTITION BY session ORDER BY coalesce(next_oc, 9), symbol) AS pos FROM board""", "board")
def o7(spark, d):
    rows = ranking.with_row_number(board.board(spark, d, (), ["next_oc"]), "session", ranking.live_order("next_oc"), "pos", small=True)
    return rows.select("session", "symbol", "pos")


@query("o8_recent_n", f"""
    SELECT symbol, day, code, k, {r6('price')} FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC, seq DESC) AS k FROM insider) WHERE k <= 8""", "insider")
def o8(spark, d):
    return ranking.top_k(derived.insider(spark, d), "symbol", [F.col("day").desc(), F.col("seq").desc()], 8, "k").select(
        "symbol", "day", "code", "k", r("price"))
