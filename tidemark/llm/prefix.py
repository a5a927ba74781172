"""Running totals over numbered cells, in two levels: no task sees more than the cells of one block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def offsets(cells: DataFrame, cell: str, amount: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`cells` with `name`: the sum of `amount` over all lower `cell` numbers (of the same `by` columns).

    `cells` has one row per `by` and `cell`; missing cells count as zero.
    """
    by_cols = [F.col(c) for c in by]
    block = F.floor(F.col(cell) / BLOCK)
    cells = cells.withColumn("__block", block)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*by, "__block").agg(F.sum(amount).alias("__sum")).withColumn(
        "__base", F.coalesce(F.sum("__sum").over(up_to(Window.partitionBy(*by_cols).orderBy("__block"))), F.lit(0))).drop("__sum")
    inner = F.coalesce(F.sum(amount).over(up_to(Window.partitionBy(*by_cols, "__block").orderBy(cell))), F.lit(0))
    on = F.col("l.__block") == F.col("r.__block")
    for c in by:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return cells.withColumn("__inner", inner).alias("l").join(blocks.alias("r"), on).select(
        *[F.col(f"l.{c}") for c in cells.columns if c != "__block"],
        (F.col("l.__inner") + F.col("r.__base")).alias(name))
