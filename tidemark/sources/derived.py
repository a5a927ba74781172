"""Engine inputs derived from the landed tables (see FIXTURES.md, section 3).

Each derivation is one map-side-combinable aggregation, so a symbol with a third
of all trades is reduced inside the scan tasks before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import fresh_supply
from .tables import events, table

LOT = 1000.0        # shares per traded unit, so that dollar gates are neither empty nor full

# Country by nation key modulo eight (the landed names are placeholders).
COUNTRIES = ["China", "Hong Kong", "United States", "Israel", "Singapore", "Canada", "Cayman Islands", "Germany"]
CATEGORIES = ["other", "offering", "atm", "registration", "reverse_split"]
STATUSES = ["ETB", "HTB", "NONE", "UNKNOWN"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def trades(spark: SparkSession, d: str) -> DataFrame:
    """One print per line item.

    `seq` orders the prints of a symbol inside a day: order key, line, then the
    three numbers the price is made of (equal seq means equal price). It is one
    64-bit integer so that first and last prints stay in the hash aggregate; a
    struct as order key would force a sort of every scan partition.
    """
    price = 100 * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * (0.9 + F.col("l_quantity") / 250)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16384 + (
        F.col("l_quantity").cast("bigint") * 256 + cents("l_discount") * 16 + cents("l_tax"))
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        price.alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_tax").alias("tax"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_orderkey").alias("orderkey"),
        seq.alias("seq"),
    )


def session_bars(prints: DataFrame, grain: str) -> DataFrame:
    """OHLCV per (symbol, session); a session is a calendar `grain` (month, week)."""
    placed = prints.withColumn("session", F.trunc("day", grain))
    order = F.datediff("day", "session") * F.lit(1 << 57) + F.col("seq")      # at most 31 days: 62 bits
    return placed.withColumn("_order", order).groupBy("symbol", "session").agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        (F.sum("qty") * LOT).alias("volume"),
        (F.sum(F.when(F.col("linestatus") == "F", F.col("qty")).otherwise(0.0)) * LOT).alias("short_volume"),
        (F.sum(F.when(F.col("returnflag") == "R", F.col("qty")).otherwise(0.0)) * LOT).alias("short_interest"),
    )


def bars(spark: SparkSession, d: str, grain: str = "month") -> DataFrame:
    return session_bars(trades(spark, d), grain)


def session_facts(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars with the session's last borrow row and its supply filings, in one scan of the trades.

    Prints are reduced to (symbol, day) and then to (symbol, session); the same
    rows would otherwise be scanned and shuffled once per input.
    """
    t = trades(spark, d)
    accepted, category = _filing_time(), _filing_category()
    filed = F.col("returnflag") == "R"
    publish = F.to_timestamp(F.last_day("day")) + F.expr("INTERVAL 12 HOURS")
    by_day = t.groupBy("symbol", "day").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("qty").alias("qty"),
        F.sum(F.when(F.col("linestatus") == "F", F.col("qty")).otherwise(0.0)).alias("short_qty"),
        F.sum(F.when(filed, F.col("qty")).otherwise(0.0)).alias("interest_qty"), F.avg("tax").alias("tax"),
        F.bool_or(filed & fresh_supply(category, accepted, "day", publish)).alias("fresh_supply"),
        F.bool_or(filed & (category == "offering")).alias("offered"), F.bool_or(filed & (category == "atm")).alias("has_atm"))
    lent = by_day.select("*", *_borrow_terms(F.col("tax"), F.col("qty")))
    facts = lent.groupBy("symbol", F.trunc("day", "month").alias("session")).agg(
        F.min_by("open", "day").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "day").alias("close"), (F.sum("qty") * LOT).alias("volume"),
        (F.sum("short_qty") * LOT).alias("short_volume"), (F.sum("interest_qty") * LOT).alias("short_interest"),
        F.max("day").alias("borrow_asof"), F.max_by("fee_rate", "day").alias("fee_rate"),
        F.max_by("available", "day").alias("available"), F.bool_or("fresh_supply").alias("fresh_supply"),
        F.bool_or("offered").alias("offered"), F.bool_or("has_atm").alias("has_atm"))
    return facts.withColumn("status", _status())


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return shape_ticks(events(spark, d))


def shape_ticks(ev: DataFrame) -> DataFrame:
    """symbol, ts, price, size from event rows; works on batches and streams."""
    return ev.select(
        "event_id", F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"), "event_type",
    )


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily OHLCV of the ticks."""
    return ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("session")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    t = ticks(spark, d)
    return t.select("*", (F.col("price") * (1 - F.col("size") / 10000)).alias("bid"),
                    (F.col("price") * (1 + F.col("size") / 10000)).alias("ask"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol. Nation and region are fixed small dimensions."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return table(spark, d, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"),
        _pick(COUNTRIES, F.col("n_nationkey") % 8).alias("country"),
        F.col("r_name").alias("sector"),
        (F.col("s_acctbal") * 1e4).alias("market_cap"),
        ((1000 + F.abs("s_acctbal")) * 1000).alias("shares_out"),
    )


def _status() -> Column:
    return _pick(STATUSES, F.col("symbol") % 4)


def _borrow_terms(tax: Column, qty: Column) -> list[Column]:
    status = _status()
    return [
        status.alias("status"),
        F.when(status != "UNKNOWN", F.round(tax * 100, 9)).alias("fee_rate"),
        F.when(status == "NONE", 0.0).when(status != "UNKNOWN", F.greatest(qty - 10, F.lit(0.0)) * LOT).alias("available"),
    ]


def borrow(spark: SparkSession, d: str) -> DataFrame:
    """Borrow list per (symbol, day): status, fee in percent units, shares available."""
    by_day = trades(spark, d).groupBy("symbol", "day").agg(F.avg("tax").alias("tax"), F.sum("qty").alias("qty"))
    return by_day.select("symbol", "day", *_borrow_terms(F.col("tax"), F.col("qty")))


def _filing_category() -> Column:
    return _pick(CATEGORIES, F.col("line") % 5)


def _filing_time() -> Column:
    """Every second filing carries an instant, the others a day only."""
    return F.when(F.col("line") % 2 == 0, F.to_timestamp("day") + F.make_dt_interval(F.lit(0), F.col("line") * 3))


def filings(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).filter(F.col("returnflag") == "R").select(
        "symbol", "day", "orderkey", "line", "qty", _filing_category().alias("category"),
        _filing_time().alias("accepted"), F.trunc("day", "month").alias("session"))


def insider(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("returnflag") == "A", "P").when(F.col("returnflag") == "N", "S").otherwise("144")
    return trades(spark, d).select("symbol", "day", code.alias("code"), F.col("qty").alias("shares"), "price",
                                   "orderkey", "line", "seq")


def earnings(spark: SparkSession, d: str) -> DataFrame:
    """Report dates: one per order, spread over the symbols."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n_symbols"))
    time = (
        F.when(F.col("o_orderpriority").startswith("1"), "time-pre-market")
        .when(F.col("o_orderpriority").startswith("2"), "time-after-hours")
        .when(F.col("o_orderpriority").startswith("3"), "time-not-supplied")
        .when(F.col("o_orderpriority").startswith("4"), "during_market")
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        (F.col("o_custkey") % n.select("n_symbols").scalar()).alias("symbol"),
        F.to_date("o_orderdate").alias("date"), time.alias("time"))


def chatter(spark: SparkSession, d: str) -> DataFrame:
    """Messages: purchase = bullish tag, error = bearish tag."""
    tag = F.when(F.col("event_type") == "purchase", "bull").when(F.col("event_type") == "error", "bear")
    return ticks(spark, d).select("symbol", "ts", tag.alias("tag"))
