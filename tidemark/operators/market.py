"""Market, calendar and event summaries, label lookups and list unions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import humanise


def with_label(df: DataFrame, code: str, labels: Mapping[str, str], name: str) -> DataFrame:
    """Label of a code from a fixed dimension, else the code in plain words."""
    dim = df.sparkSession.createDataFrame(list(labels.items()), f"{code} string, _label string")
    return df.join(F.broadcast(dim), code, "left").withColumn(
        name, F.coalesce(F.col("_label"), humanise(code))).drop("_label")


def against_reference(study: DataFrame, ref: DataFrame, base: Column, key: str) -> DataFrame:
    """Each study beside its own matched group, else beside all names. Both hold one row per study."""
    return study.join(ref, key, "left").select(
        *study.columns, F.coalesce("ref", base).alias("reference"), F.col("ref").isNotNull().alias("own_group"),
        F.try_divide(F.col("pct_dump"), F.coalesce("ref", base)).alias("lift"))


def lockups(bars: DataFrame, days: int, around: int) -> DataFrame:
    """Sessions within `around` days of each name's lock-up end (first session + `days`)."""
    ipo = bars.groupBy("symbol").agg(F.min("session").alias("ipo_date"), F.min_by("open", "session").alias("ipo_price"))
    rows = bars.join(ipo, "symbol").withColumn("lockup_date", F.date_add("ipo_date", days))
    rows = rows.withColumn("days_to", F.datediff("lockup_date", "session").cast("bigint"))
    return rows.filter(F.abs("days_to") <= around).withColumn(
        "vs_ipo", F.try_divide(F.col("close"), F.col("ipo_price")) - 1)


def union_lists(lists: Mapping[str, DataFrame]) -> DataFrame:
    """Named lists one under another, with their origin; columns a list lacks are missing."""
    out = None
    for name, df in lists.items():
        df = df.withColumn("list", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def group_by_day(events: DataFrame, day: str, key: str, small: bool = False) -> DataFrame:
    """Events of each day numbered in feed order.

    The day's list stays rows, so a day with very many events is never one value.
    """
    from .ranking import with_row_number
    return with_row_number(events, day, [F.col(key)], "pos", small)


def breadth(rows: DataFrame) -> DataFrame:
    """Share of names up, median return, and counts of big movers per session."""
    from .ranking import agg_with_median
    known = rows.filter(F.col("r1").isNotNull())
    tally = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    sums = {"_names": F.lit(1), "_up": tally(F.col("r1") > 0), "n_up20": tally(F.col("r1") >= 0.2), "n_down20": tally(F.col("r1") <= -0.2)}
    finals = [(F.col("_up") / F.col("_names")).alias("breadth_up"), "n_up20", "n_down20"]
    return agg_with_median(known, "session", sums, finals, "r1", "median_r1")


def sector_heat(rows: DataFrame, least: int = 5, top: int = 3) -> DataFrame:
    """Mean odds per session and sector with its best names; small sectors are left out."""
    from .ranking import top_k
    heat = rows.groupBy("session", "sector").agg(
        F.avg("prob_dump").alias("mean_prob"), F.count("*").alias("n"),
        F.count_if(F.col("urank") <= 100).alias("n_top100")).filter(F.col("n") >= least)
    best = top_k(rows, ["session", "sector"], [F.col("prob_dump").desc(), F.col("symbol")], top, "_k")
    names = best.groupBy("session", "sector").agg(F.array_sort(F.collect_list(F.struct("_k", "symbol"))).alias("_t"))
    return heat.join(names.select("session", "sector", F.transform("_t", lambda x: x["symbol"]).alias("top")), ["session", "sector"])


def insider_summary(trades: DataFrame, days: int = 90) -> DataFrame:
    """Open-market sales and buys and sale notices of the last `days` days of the data, per name."""
    last = trades.agg(F.max("day").alias("d")).scalar()
    recent = trades.filter(F.col("day") > F.date_sub(last, days))
    value = F.col("shares") * F.col("price")
    return recent.groupBy("symbol").agg(
        F.count_if(F.col("code") == "S").alias("n_sales"), F.count_if(F.col("code") == "P").alias("n_buys"),
        F.count_if(F.col("code") == "144").alias("n_144"),
        F.sum(F.when(F.col("code") == "S", value)).alias("value_sold"), F.sum(F.when(F.col("code") == "P", value)).alias("value_bought"))


def chatter_summary(messages: DataFrame) -> DataFrame:
    """Messages per active day, tags, and the bearish share of the tagged."""
    bull, bear = F.count_if(F.col("tag") == "bull"), F.count_if(F.col("tag") == "bear")
    out = messages.groupBy("symbol", F.to_date("ts").alias("_d")).agg(F.count("*").alias("_n"), bull.alias("_u"), bear.alias("_e"))
    return out.groupBy("symbol").agg(
        F.avg("_n").alias("msgs_per_day"), F.sum("_u").alias("bull"), F.sum("_e").alias("bear"),
        F.try_divide(F.sum("_e"), F.sum("_u") + F.sum("_e")).alias("bear_share"))


def size_summary(rows: DataFrame) -> DataFrame:
    """What the publishable names of a session can take together, and the first name's limits."""
    able = rows.filter(F.col("publishable") & F.col("capacity").isNotNull())
    return able.groupBy("session").agg(
        F.sum(F.least(F.col("capacity"), F.coalesce("breakeven", F.lit(float("inf"))))).alias("deployable"), F.count("*").alias("names"),
        F.min_by("capacity", "rank").alias("top_capacity"), F.min_by("breakeven", "rank").alias("top_breakeven"))


def unified_lists(scored: DataFrame, lists: Mapping[str, tuple[Column, Column]], k: int | None = None) -> DataFrame:
    """U4: every named list over one scored union, or its top k rows: name -> (membership, order key)."""
    from .ranking import top_k, with_row_number
    entries = F.explode(F.array(*[
        F.when(member, F.struct(F.lit(n).alias("list"), key.cast("double").alias("key"))) for n, (member, key) in lists.items()]))
    long = scored.withColumn("_e", entries).filter(F.col("_e").isNotNull()).select(*scored.columns, "_e.list", "_e.key")
    order = [F.col("key").desc_nulls_last(), F.col("symbol"), F.col("side")]
    if k is None:
        return with_row_number(long, ["session", "list"], order, "pos")
    return top_k(long, ["session", "list"], order, k, "pos")
