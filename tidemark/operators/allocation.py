"""Water-filling and basket plans, many portfolios at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, sizing
from ..functions.scalars import finite
from ..session import cut
from .ranking import beside, running_total


def waterfill(caps: DataFrame, by: Sequence[str], key: Sequence[str], total: str = "total", cap: str = "cap",
              small: bool = False) -> DataFrame:
    """Split `total` of each portfolio equally, each name within its cap, excess shared on.

    Closed form: with the positive caps in ascending order, the water level is
    (total - sum of the smaller caps) / (names left) at the first name whose cap
    reaches it. Adds `alloc` and the portfolio's `left_over`.
    """
    by, key = list(by), list(key)
    c = F.greatest(F.coalesce(F.col(cap), F.lit(0.0)), F.lit(0.0))
    rows = caps.withColumn("_c", c)
    if small:
        return _waterfill_windows(rows, caps.columns, by, key, total)
    rows = cut(rows)
    filled = running_total(rows.filter(F.col("_c") > 0), by, [F.col("_c"), *[F.col(k) for k in key]],
                           {"_upto": F.col("_c"), "_i": F.lit(1).cast("bigint")}, small)
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("_c") > 0).alias("_n"), F.sum("_c").alias("_room"))
    placed = filled.select(*by, "_c", "_upto", "_i", F.col(total).alias("_t"))
    placed = beside(placed, sizes, by)
    left = F.col("_n") - F.col("_i") + 1
    before = F.col("_upto") - F.col("_c")
    reached = before + F.col("_c") * left >= F.col("_t")
    level = placed.groupBy(*by).agg(F.min_by(
        F.try_divide(F.col("_t") - before, left), F.when(reached, F.col("_i"))).alias("_level"))
    out = beside(beside(rows, sizes, by), level, by, "left")
    alloc = F.least(F.col("_c"), F.coalesce(F.col("_level"), F.lit(float("inf"))))
    return out.select(*caps.columns, alloc.alias("alloc"),
                      F.greatest(F.col(total) - F.col("_room"), F.lit(0.0)).alias("left_over"))


def _waterfill_windows(rows: DataFrame, columns: Sequence[str], by: list[str], key: list[str], total: str) -> DataFrame:
    """The closed form over small portfolios: one exchange, no join."""
    whole = W.partitionBy(*by)
    ascending = whole.orderBy((F.col("_c") > 0).desc(), "_c", *key)
    placed = rows.select(
        "*", F.count_if(F.col("_c") > 0).over(whole).alias("_n"), F.sum("_c").over(whole).alias("_room"),
        F.row_number().over(ascending).alias("_i"),
        F.sum("_c").over(ascending.rowsBetween(W.unboundedPreceding, 0)).alias("_upto"))
    left, before = F.col("_n") - F.col("_i") + 1, F.col("_upto") - F.col("_c")
    reached = (F.col("_c") > 0) & (before + F.col("_c") * left >= F.col(total))
    level = F.min_by(F.try_divide(F.col(total) - before, left), F.when(reached, F.col("_i"))).over(whole)
    placed = placed.withColumn("_level", level)
    return placed.select(*columns, F.least(F.col("_c"), F.coalesce("_level", F.lit(float("inf")))).alias("alloc"),
                         F.greatest(F.col(total) - F.col("_room"), F.lit(0.0)).alias("left_over"))


def basket_rows(board: DataFrame, totals: Sequence[int] = fixed.PLAN_TOTALS, ks: Sequence[int] = fixed.PLAN_K) -> DataFrame:
    """One row per session, total, k and name: the first k publishable names with a capacity."""
    able = board.filter(F.col("publishable") & finite("capacity").isNotNull())
    w = W.partitionBy("session").orderBy("rank")
    placed = able.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= max(ks))
    grid = placed.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("pos") <= F.col("k"))
    grid = grid.withColumn("total", F.explode(F.array(*[F.lit(float(t)) for t in totals])))
    limit = F.least(F.col("capacity"), F.coalesce(finite("breakeven"), F.lit(float("inf"))))
    why = F.when(F.coalesce(finite("breakeven"), F.lit(float("inf"))) < F.col("capacity"), "breakeven").otherwise("capacity")
    return grid.select("session", "total", "k", "symbol", "pos", "c10", "spread", "next_oc",
                       F.when(limit >= 1000, limit).otherwise(0.0).alias("cap"), why.alias("why"))


def plan_basket(board: DataFrame, totals: Sequence[int] = fixed.PLAN_TOTALS, ks: Sequence[int] = fixed.PLAN_K) -> DataFrame:
    """Allocation and own cost of every name of every plan; a plan holds at most max(ks) names."""
    rows = waterfill(basket_rows(board, totals, ks), ["session", "total", "k"], ["symbol"], small=True)
    return rows.withColumn("cost", F.when(F.col("alloc") > 0, sizing.cost_law("alloc", "c10", "spread")))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Deployed, left over and size-weighted cost per plan; a missing cost weighs nothing."""
    deployed = F.sum("alloc")
    return plan.groupBy("session", "total", "k").agg(
        F.count("*").alias("n_names"), deployed.alias("deployed"), F.max("left_over").alias("left_over"),
        F.when(deployed > 0, F.try_divide(F.sum(F.coalesce(F.col("alloc") * F.col("cost"), F.lit(0.0))), deployed)).alias("mean_cost"))


def basket_backtest(board: DataFrame, most: float, cut: str, ks: Sequence[int] = fixed.PLAN_K) -> DataFrame:
    """First k eligible names a day, each at its capacity up to `most`: net per dollar and winning days."""
    able = board.filter(F.col("publishable") & finite("capacity").isNotNull())
    placed = able.withColumn("pos", F.row_number().over(W.partitionBy("session").orderBy("rank"))).filter(F.col("pos") <= max(ks))
    q = F.least(F.col("capacity"), F.lit(most))
    rows = placed.filter(F.col("next_oc").isNotNull()).withColumn("q", q).withColumn(
        "pnl", F.col("q") * (-F.col("next_oc") - sizing.cost_law("q", "c10", "spread")))
    grid = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("pos") <= F.col("k"))
    days = grid.groupBy("session", "k").agg(F.sum("pnl").alias("pnl"), F.sum("q").alias("q"))
    period = F.when(F.col("session") < F.lit(cut).cast("date"), "dev").otherwise("confirm")
    return days.groupBy(period.alias("period"), "k").agg(
        F.count("*").alias("n_days"), F.try_divide(F.sum("pnl"), F.sum("q")).alias("net_per_dollar"),
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("day_win"))


def size_tiers(graded: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Per position size: names that can take it a day, their base rate, and the #1 among them."""
    rows = graded.withColumn("size", F.explode(F.array(*[F.lit(float(q)) for q in sizes]))).filter(
        F.col("capacity") >= F.col("size"))
    tick = F.when(F.col("close") >= 1, 0.01 / F.col("close")).otherwise(0.0001 / F.col("close"))
    dumped = F.avg(F.when(F.col("next_oc") <= fixed.DUMP, 1.0).otherwise(0.0))
    best = F.struct(-F.col("prob_dump"), F.col("symbol"))
    days = rows.groupBy("size", "session").agg(
        F.count("*").alias("names"), dumped.alias("base"),
        F.min_by(F.struct(
            F.col("next_oc").alias("oc"), sizing.cost_law("size", "c10", "spread").alias("cost"),
            sizing.impact_cost("size", "vol20", "exp_dvol", tick).alias("tight")), best).alias("one"))
    oc = F.col("one.oc")
    return days.groupBy("size").agg(
        F.count("*").alias("n_days"), F.avg("names").alias("names_per_day"), F.avg("base").alias("base_dump"),
        F.avg(F.when(oc <= fixed.DUMP, 1.0).otherwise(0.0)).alias("top1_hit"), F.avg(oc).alias("top1_mean_oc"),
        F.avg("one.cost").alias("cost"), F.avg(-oc - F.col("one.cost")).alias("net"),
        F.avg(-oc - F.col("one.tight")).alias("net_tight"))
