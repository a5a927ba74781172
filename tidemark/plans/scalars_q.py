"""Scalar expressions (P) over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import market
from ..session import cut
from ..sources import derived
from ..sources.tables import events, table
from . import board
from .ctes import r6
from .registry import query, r

# A feed's text form of a number: two event types stand for the non-finite spellings.
_TEXT_VALUE = "CASE event_type WHEN 'error' THEN 'NaN' WHEN 'signup' THEN 'Infinity' ELSE CAST(value AS {t}) END"


@query("p1_finite", f"""
    SELECT event_id, {r6('CASE WHEN isfinite(x) THEN x END', 'x')}, NOT isfinite(x) AS was_missing
    FROM (SELECT event_id, CAST({_TEXT_VALUE.format(t='VARCHAR')} AS DOUBLE) AS x FROM events)""")
def p1(spark, d):
    x = F.expr(_TEXT_VALUE.format(t="STRING")).cast("double")
    return events(spark, d).select("event_id", x.alias("x0")).select(
        "event_id", r(S.finite("x0"), "x"), S.finite("x0").isNull().alias("was_missing"))


# Mixed date texts: bare days (some out of range), instants with and without offsets, junk.
def _mixed_text():
    day, clock = F.date_format("ts", "yyyy-MM-"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        F.when(F.col("event_type") == "view", F.concat(day, F.lpad((k % 40).cast("string"), 2, "0")))
        .when(F.col("event_type") == "click", F.concat(clock, F.lit("-05:00")))
        .when(F.col("event_type") == "purchase", F.concat(clock, F.lit("Z")))
        .when(F.col("event_type") == "signup", F.lit("n/a"))
    )


_MIXED_SQL = """
    SELECT event_id, CASE event_type
      WHEN 'view' THEN strftime(ts, '%Y-%m-') || lpad(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 40 AS VARCHAR), 2, '0')
      WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00'
      WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
      WHEN 'signup' THEN 'n/a' END AS s
    FROM events"""


@query("p2_parse_time", f"""
    SELECT event_id, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN
        CAST(make_date(CAST(s[1:4] AS INT), 1, 1) + (CAST(s[6:7] AS INT) - 1) * INTERVAL 1 MONTH AS DATE) + (CAST(s[9:10] AS INT) - 1)
      END AS day,
      CASE WHEN NOT regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(epoch(TRY_CAST(s AS TIMESTAMPTZ)) AS BIGINT) END AS epoch_s
    FROM ({_MIXED_SQL})""")
def p2(spark, d):
    return events(spark, d).select("event_id", _mixed_text().alias("s")).select(
        "event_id", S.parse_day("s").alias("day"), F.unix_seconds(S.parse_ts("s")).alias("epoch_s"))


_ET = "timezone('America/New_York', timezone('UTC', {ts}))"


@query("p3_et_date_time", f"""
    SELECT event_id, CAST({_ET.format(ts='ts')} AS DATE) AS et_date, strftime({_ET.format(ts='ts')}, '%H:%M') AS et_time FROM events""")
def p3(spark, d):
    return events(spark, d).select("event_id", S.et_date("ts").alias("et_date"), S.et_hhmm("ts").alias("et_time"))


_LATER = "INTERVAL 731 DAYS"     # moves the events onto the years the holiday calendar covers


@query("p4_market_phase", f"""
    SELECT event_id, CASE WHEN isodow(et) >= 6 OR strftime(et, '%Y-%m-%d') IN ({', '.join(repr(h) for h in fixed.HOLIDAYS)}) THEN 'closed'
      WHEN m >= 240 AND m < 570 THEN 'pre-market' WHEN m >= 570 AND m < 960 THEN 'open'
      WHEN m >= 960 AND m < 1200 THEN 'after-hours' ELSE 'closed' END AS phase
    FROM (SELECT event_id, et, hour(et) * 60 + minute(et) AS m FROM (
      SELECT event_id, {_ET.format(ts=f'ts + {_LATER}')} AS et FROM events))""")
def p4(spark, d):
    return events(spark, d).select("event_id", S.market_phase(F.col("ts") + F.expr(_LATER)).alias("phase"))


@query("p5_days_between", """
    SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def p5(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.days_between(F.to_date("o_orderdate"), F.to_date("l_shipdate")).cast("bigint").alias("days"))


_NOW = "TIMESTAMP '2024-01-30 23:58:00'"


@query("p6_age_bucket", f"""
    SELECT event_id, CASE WHEN sec < 90 THEN 'just now' WHEN sec / 60 < 60 THEN 'min' WHEN sec / 3600 < 36 THEN 'h' ELSE 'days' END AS unit,
      CAST(CASE WHEN sec < 90 THEN 0 WHEN sec / 60 < 60 THEN floor(sec / 60 + 0.5) WHEN sec / 3600 < 36 THEN floor(sec / 3600 + 0.5)
        ELSE floor(sec / 3600 / 24 + 0.5) END AS BIGINT) AS amount
    FROM (SELECT event_id, greatest(0.0::DOUBLE, (epoch_us({_NOW}) - epoch_us(ts)) / 1000000) AS sec FROM events)""")
def p6(spark, d):
    return events(spark, d).select("event_id", S.age("ts", F.expr(_NOW)).alias("a")).select("event_id", "a.unit", "a.amount")


@query("p7_url_host", """
    WITH cut AS (SELECT page_id, trim(url, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS u FROM pages),
    rest AS (SELECT page_id, u, split_part(split_part(split_part(substr(u, strpos(u, '://') + 3), '/', 1), '?', 1), '#', 1) AS authority,
      lower(split_part(u, '://', 1)) IN ('http', 'https') AND contains(u, '://') AS web FROM cut),
    named AS (SELECT *, CASE WHEN contains(authority, '@') THEN substr(authority, strpos(authority, '@') + 1) ELSE authority END AS named FROM rest),
    hosts AS (SELECT *, CASE WHEN starts_with(named, '[') THEN split_part(named, ']', 1) || ']' ELSE split_part(split_part(named, ':', 1), ' ', 1) END AS host FROM named)
    SELECT page_id, coalesce(web AND host <> '', false) AS usable,
      CASE WHEN web AND host <> '' THEN CASE WHEN starts_with(lower(host), 'www.') THEN substr(lower(host), 5) ELSE lower(host) END END AS host,
      CASE WHEN web AND host <> '' THEN u END AS address FROM hosts""")
def p7(spark, d):
    """Every third address with white space around it."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\t \n"), "url", F.lit("\r\n "))).otherwise(F.col("url"))
    pages = table(spark, d, "pages").withColumn("url", url)
    return pages.select("page_id", S.safe_url("url").isNotNull().alias("usable"), S.url_host("url").alias("host"), S.safe_url("url").alias("address"))


@query("p8_flag_class", r"""
    SELECT session, symbol, flag, CASE WHEN regexp_matches(flag, '^(OFFERING|ATM|DILUTION|PUMP|GAP|RUN)\b') THEN 'red'
      WHEN regexp_matches(flag, '^(NO BORROW|HALTED)$') THEN 'solid' ELSE 'plain' END AS kind
    FROM (SELECT session, symbol, unnest(flags) AS flag FROM picks)""", "picks")
def p8(spark, d):
    return board.picks(spark, d, places=()).select("session", "symbol", F.explode("flags").alias("flag")).withColumn(
        "kind", S.flag_class("flag"))


@query("p9_danger_level", """
    SELECT session, symbol, CASE WHEN squeeze_danger IS NULL THEN 'unknown' WHEN squeeze_danger >= 70 THEN 'high'
      WHEN squeeze_danger >= 45 THEN 'elevated' ELSE 'low' END AS level,
      CAST(floor(least(greatest(squeeze_danger, 0), 100) / 10 + 0.5) AS BIGINT) AS cells FROM danger""", "danger")
def p9(spark, d):
    rows = board.danger(spark, d)
    return rows.select("session", "symbol", S.danger_word("squeeze_danger").alias("level"),
                       S.danger_cells("squeeze_danger").alias("cells"))


@query("p10_lift", f"""
    SELECT session, symbol, {r6('prob_dump / nullif(avg(CASE WHEN oc <= -0.05 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session), 0)', 'lift')} FROM scored""",
       "scored")
def p10(spark, d):
    rows = cut(board.scored(spark, d).select("session", "symbol", "prob_dump", "oc"))
    rows = board.with_base(rows, rows)
    return rows.select("session", "symbol", r(S.lift("prob_dump", "base"), "lift"))


@query("p11_skew", f"""
    SELECT session, symbol, {r6('prob_dump / nullif(prob_dump + prob_pump, 0)', 'skew')},
      prob_dump / nullif(prob_dump + prob_pump, 0) >= 0.5 AS red FROM scored""", "scored")
def p11(spark, d):
    skew = S.down_skew("prob_dump", "prob_pump")
    return board.scored(spark, d).select("session", "symbol", r(skew, "skew"), (skew >= 0.5).alias("red"))


_CAPS = {"m0": 0.35, "m1": 0.45}


@query("p12_cap_marker", f"""
    SELECT session, symbol, model, coalesce(least(prob_dump, 0.45) >= CASE model WHEN 'm0' THEN 0.35 WHEN 'm1' THEN 0.45 END - 1e-4, false) AS at_cap
    FROM (SELECT *, CASE WHEN symbol % 5 = 0 THEN 'mx' ELSE model_used END AS model FROM scored)""", "scored")
def p12(spark, d):
    model = F.when(F.col("symbol") % 5 == 0, "mx").otherwise(F.col("model_used"))
    return board.scored(spark, d).select(
        "session", "symbol", model.alias("model"),
        S.at_cap(F.least("prob_dump", F.lit(0.45)), model, _CAPS).alias("at_cap"))


@query("p13_edge_percentile", """
    SELECT session, symbol, CAST(floor((0.5 - liq_edge) * 100 + 0.5) AS BIGINT) AS percentile FROM scored""", "scored")
def p13(spark, d):
    return board.scored(spark, d).select("session", "symbol", S.edge_percentile("liq_edge").alias("percentile"))


@query("p14_outcome_label", """
    SELECT session, symbol, CASE WHEN next_oc IS NULL THEN 'no data' WHEN next_oc <= -0.05 THEN 'dumped'
      WHEN next_oh >= 0.2 THEN 'squeezed' ELSE 'no dump' END AS result FROM panel""", "panel")
def p14(spark, d):
    return board.panel(spark, d).select("session", "symbol", S.outcome_label(
        F.col("next_oc").isNull(), F.col("next_oc") <= fixed.DUMP, F.col("next_oh") >= fixed.SQUEEZE).alias("result"))


@query("p15_short_net", f"""
    SELECT session, symbol, {r6('net')}, CASE WHEN abs(net) < 0.0005 THEN 'broke even' WHEN net < 0 THEN 'lost' WHEN net IS NOT NULL THEN 'made' END AS word
    FROM (SELECT session, symbol, -next_oc - spread AS net FROM panel)""", "panel")
def p15(spark, d):
    net = S.short_net("next_oc", "spread")
    return board.panel(spark, d).select("session", "symbol", r(net, "net"), S.short_word(net).alias("word"))


@query("p16_session_moves", f"""
    SELECT symbol, session, {r6('close / nullif(open, 0) - 1', 'oc')}, {r6('high / nullif(open, 0) - 1', 'oh')},
      {r6('low / nullif(open, 0) - 1', 'ol')} FROM bars_w""", "bars_w")
def p16(spark, d):
    return derived.bars(spark, d, "week").select(
        "symbol", "session", r(S.move_from_open("close", "open"), "oc"), r(S.move_from_open("high", "open"), "oh"),
        r(S.move_from_open("low", "open"), "ol"))


@query("p17_outcome_flags", """
    SELECT symbol, session, oc <= -0.05 AS dump5, oc <= -0.03 AS d3, oc <= -0.1 AS big10, oc <= -0.15 AS bigdump15,
      oc >= 0.05 AS pump5, oc >= 0.1 AS up10, oh >= 0.2 AS squeeze20
    FROM (SELECT *, close / open - 1 AS oc, high / open - 1 AS oh FROM bars)""", "bars")
def p17(spark, d):
    flags = S.outcome_flags(S.move_from_open("close", "open"), S.move_from_open("high", "open"))
    return derived.bars(spark, d).select("symbol", "session", *[c.alias(n) for n, c in flags.items()])


@query("p18_earn_time", """
    SELECT report_id, CASE WHEN time LIKE '%pre%' THEN 'before the open' WHEN time LIKE '%after%' THEN 'after the close'
        ELSE 'time n/a' END AS slot,
      CASE time WHEN 'time-pre-market' THEN 'before the open' WHEN 'time-after-hours' THEN 'after the close'
        WHEN 'time-not-supplied' THEN 'time n/a' WHEN 'during_market' THEN 'During market' END AS calendar_slot
    FROM earnings""", "earnings")
def p18(spark, d):
    return derived.earnings(spark, d).select(
        "report_id", S.report_time("time").alias("slot"), S.calendar_time("time").alias("calendar_slot"))


@query("p19_region_flag", f"""
    SELECT session, symbol, list_contains(flags, 'ASIA') OR country IN ({', '.join(repr(c) for c in fixed.ASIA)}) AS linked
    FROM picks""", "picks")
def p19(spark, d):
    return board.picks(spark, d, places=()).select("session", "symbol", S.region_linked("flags", "country").alias("linked"))


@query("p20_label_dim", f"""
    SELECT orderkey, line, symbol, day, code, coalesce(CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_LABELS.items())} END,
      upper(left(replace(code, '_', ' '), 1)) || substr(replace(code, '_', ' '), 2)) AS label
    FROM (SELECT *, CASE WHEN line = 7 THEN 'shelf_take_down' ELSE category END AS code FROM filings)""", "filings")
def p20(spark, d):
    coded = derived.filings(spark, d).withColumn(
        "code", F.when(F.col("line") == 7, "shelf_take_down").otherwise(F.col("category")))
    return market.with_label(coded, "code", fixed.CATEGORY_LABELS, "label").select(
        "orderkey", "line", "symbol", "day", "code", "label")


@query("p21_runway_ratios", f"""
    SELECT c_custkey, {r6('c_acctbal / nullif(burn, 0)', 'runway_q')}, coalesce(c_acctbal / nullif(burn, 0) < 2, false) AS short_runway,
      {r6('n_now / nullif(n_before, 0)', 'growth_1y')}, {r6('burn / 12', 'monthly')}
    FROM customer LEFT JOIN (
      SELECT o_custkey, sum(o_totalprice) / 371 AS burn, CAST(count(*) AS DOUBLE) AS n_now,
        CAST(count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS DOUBLE) AS n_before FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def p21(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.sum("o_totalprice") / 371).alias("burn"), F.count("*").cast("double").alias("n_now"),
        F.count_if(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).cast("double").alias("n_before"))
    runway = S.runway("c_acctbal", "burn")
    return table(spark, d, "customer").join(spent, "c_custkey", "left").select(
        "c_custkey", r(runway, "runway_q"), F.coalesce(runway < 2, F.lit(False)).alias("short_runway"),
        r(S.ratio("n_now", "n_before"), "growth_1y"), r(F.col("burn") / 12, "monthly"))


@query("p22_stance", """
    SELECT event_id, CASE WHEN p < 0 THEN 'bearish' WHEN p > 0 THEN 'bullish' ELSE 'none' END AS stance
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END AS p FROM events)""")
def p22(spark, d):
    polarity = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "purchase", 1).when(
        F.col("event_type") == "view", 0)
    return events(spark, d).select("event_id", S.stance(polarity).alias("stance"))


@query("p23_base_fallback", f"""
    WITH overall AS (SELECT avg(CASE WHEN oc <= -0.05 THEN 1.0 ELSE 0.0 END) AS model_base FROM panel),
    today AS (SELECT session, CASE WHEN count(*) FILTER (oc >= 0.05) > 0 THEN
        count(*) FILTER (oc <= -0.05) / CAST(count(*) FILTER (oc >= 0.05) AS DOUBLE) ELSE 'Infinity'::DOUBLE END AS today_base
      FROM panel GROUP BY session)
    SELECT session, {r6('CASE WHEN isfinite(today_base) THEN today_base ELSE model_base END', 'base')},
      NOT isfinite(today_base) AS fell_back FROM today, overall""", "panel")
def p23(spark, d):
    oc = S.move_from_open("close", "open")
    counts = derived.bars(spark, d).groupBy("session").agg(
        F.count_if(oc >= fixed.PUMP).alias("ups"), F.count_if(oc <= fixed.DUMP).alias("downs"), F.count("*").alias("n"))
    whole = W.partitionBy()                  # one row per session
    today = counts.select(
        "session", F.coalesce(F.try_divide("downs", "ups"), F.lit(float("inf"))).alias("today_base"),
        (F.sum("downs").over(whole) / F.sum("n").over(whole)).alias("overall"))
    return today.select("session", r(S.first_finite("today_base", "overall"), "base"),
                        S.finite("today_base").isNull().alias("fell_back"))


@query("p24_risk_adjusted", f"""
    SELECT session, symbol, {r6('100 * prob_dump * (1 - squeeze_danger / 100)', 'adjusted')} FROM danger""", "danger")
def p24(spark, d):
    rows = board.danger(spark, d)
    return rows.select("session", "symbol", r(S.risk_adjusted(100 * F.col("prob_dump"), "squeeze_danger"), "adjusted"))
