"""Quoted spreads over recent sessions, from one mergeable sketch per symbol and day.

A quantile sketch (KLL) of a day's relative spreads is kept in place of its quotes. Any span of days
is answered by merging its sketches; no quote is read again. Up to about `k` quotes a sketch holds them all
and the median is exact; beyond, its rank is off by at most `rank_error(k)` (with 99% confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh_path
from .tape import LATE, drain, latest

K = 4096
SESSIONS = 20
SKETCHES = "symbol bigint, sketch binary, n bigint, batch bigint, day date"
RECENT = "day date, symbol bigint, spread double, n bigint, sessions bigint"


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile of a sketch of size k (published fit for this sketch)."""
    return 2.296 / k ** 0.9723


def spread_sketches(quotes: DataFrame, k: int = K) -> DataFrame:
    """(day, symbol, sketch, n): relative quoted spreads of each symbol and day; quotes without a spread are not counted."""
    rel = F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2)
    known = quotes.withColumn("_rel", rel).filter(F.col("_rel").isNotNull() & ~F.isnan("_rel"))
    agg = known.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(
        F.kll_sketch_agg_double("_rel", F.lit(k)).alias("sketch"), F.count("*").alias("n"))
    return agg.select(F.to_date("w.start").alias("day"), "symbol", "sketch", "n")


def recent_spread(sketches: DataFrame, calendar: DataFrame, sessions: int = SESSIONS) -> DataFrame:
    """Median spread per symbol over the `sessions` sessions of the calendar that end on each of its days.

    `calendar` has one row per session: (day, i), numbered without gaps.
    """
    w = W.partitionBy("symbol").orderBy("i").rangeBetween(1 - sessions, 0)
    placed = sketches.join(F.broadcast(calendar), "day")                  # one row per session
    merged = placed.select("day", "symbol", F.kll_merge_agg_double("sketch").over(w).alias("_all"),
                           F.sum("n").over(w).alias("n"), F.count("*").over(w).alias("sessions"))
    return merged.select("day", "symbol", F.kll_sketch_get_quantile_double("_all", F.lit(0.5)).alias("spread"), "n", "sessions")


def recent_spread_stream(quotes: DataFrame, sessions: int = SESSIONS, k: int = K, name: str = "recent-spread") -> str:
    """T5 over recent sessions: after every micro-batch, the days whose span holds a day the batch touched.

    The state of the stream is a sketch per open day and symbol. Sketches land by batch and day; a batch reads
    only the days within `sessions` of the ones it touched, and of each day and symbol the newest sketch. A batch
    that is run again overwrites its own folders. Lands (day, symbol, spread, n, sessions) as `batch=<id>`; returns the folder.
    """
    spark = quotes.sparkSession
    path, held = fresh_path(spark, name), fresh_path(spark, f"{name}-sketches")

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{held}/batch={batch_id}")
        known = spark.read.schema(SKETCHES).option("basePath", held).parquet(f"{held}/batch=*").filter(F.col("batch") <= batch_id)
        days = [x.day for x in known.select("day").distinct().orderBy("day").collect()]                # the calendar
        touched = {x.day for x in known.filter(F.col("batch") == batch_id).select("day").distinct().collect()}
        at = [i for i, day in enumerate(days) if day in touched]
        shown = {j for i in at for j in range(i, min(i + sessions, len(days)))}
        read = {j for i in shown for j in range(max(0, i - sessions + 1), i + 1)}
        calendar = spark.createDataFrame([(days[j], j) for j in sorted(read)], "day date, i int")
        needed = latest(known.filter(F.col("day").isin([days[j] for j in sorted(read)])), ["day", "symbol"])
        out = recent_spread(needed, calendar, sessions).filter(F.col("day").isin([days[j] for j in sorted(shown)]))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(spread_sketches(quotes, k), name, "update", each=merge)
    return path
