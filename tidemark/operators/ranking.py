"""Ranks, percentiles, running totals and ordered boards.

A window over a group runs in one task, so it is used only where the meaning of
the group bounds it (`small=True`: a board of 100, a plan's k names, the calendar).
No row count decides. Everywhere else the result comes from
`running_total`: a range-partitioned sort, totals per slice, and the totals of
the earlier slices added on. Both ways give the same rows: a missing group key
is a group, a missing value has no rank and is not counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, predicates
from ..functions.scalars import finite
from ..session import cut


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def beside(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner", known: Sequence[str] = ()) -> DataFrame:
    """`df` with the columns of `other` that it has not, joined on `on`; missing keys match, but for `known` ones, never missing."""
    same = F.lit(True)
    for c in on:
        left, right = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        same = same & (left == right if c in known else left.eqNullSafe(right))
    return df.alias("_l").join(other.alias("_r"), same, how).select(
        *[F.col(f"_l.`{c}`") for c in df.columns], *[F.col(f"_r.`{c}`") for c in other.columns if c not in on])


def running_total(df: DataFrame, by, order: Sequence[Column], totals: Mapping[str, Column],
                  small: bool = False, slices: int | None = None, whole: Mapping[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums per group; `order` must be a total order in the group.

    `whole` names further columns that hold the group's full sum of one of the `totals`.
    """
    by, whole = _keys(by), dict(whole or {})
    if small:
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in totals.items()],
                         *[F.sum(totals[t]).over(W.partitionBy(*by)).alias(n) for n, t in whole.items()])

    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.select("*", *[c.alias(f"_x_{n}") for n, c in totals.items()])
    held = cut(held.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # one row per group and slice: at most (groups + slices) rows
    base = held.groupBy(*by, "_slice").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in totals])
    base = base.select(*by, "_slice", *[
        F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals], *[
        F.sum(f"_s_{t}").over(W.partitionBy(*by)).alias(n) for n, t in whole.items()])
    held = held.select("*", *[F.sum(f"_x_{n}").over(inside).alias(f"_w_{n}") for n in totals])
    joined = beside(held, F.broadcast(base), [*by, "_slice"], known=["_slice"])
    return joined.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in totals], *whole)


def running_extreme(df: DataFrame, by, order: Sequence[Column], col: str, name: str, largest: bool, itself: bool,
                    slices: int | None = None) -> DataFrame:
    """Add the largest (or smallest) `col` of the rows before each row in the group, of the row `itself` too if asked.

    Range-partitioned like `running_total`: extremes inside a slice, and those of the earlier slices.
    """
    by = _keys(by)
    pick = F.max if largest else F.min
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()))
    inside = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if itself else -1)
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = held.groupBy(*by, "_slice").agg(pick(col).alias("_s")).select(*by, "_slice", pick("_s").over(earlier).alias("_b"))
    joined = beside(held.withColumn("_w", pick(col).over(inside)), base, [*by, "_slice"])
    both = F.greatest("_w", "_b") if largest else F.least("_w", "_b")
    return joined.select(*df.columns, both.alias(name))


def with_row_number(df: DataFrame, by, order: Sequence[Column], name: str = "rank",
                    small: bool = False) -> DataFrame:
    """1-based position in the group; `order` must end in a unique key."""
    by = _keys(by)
    if small:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return running_total(df, by, order, {name: F.lit(1).cast("bigint")}, small)


def row_numbers(df: DataFrame, by, key, orders: Mapping[str, Column]) -> DataFrame:
    """(by, key) with the 1-based position under each of `orders`: largest number first, missing last, ties by `key`.

    All orders are stacked and placed in one sort. `df` is read once; (by, key) must name its rows.
    """
    by, key = _keys(by), _keys(key)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_part"), c.cast("double").alias("_value")) for i, c in enumerate(orders.values())]))
    long = df.select(*by, *key, pairs.alias("_e")).select(*by, *key, "_e.*")
    placed = with_row_number(long, [*by, "_part"], [F.col("_value").desc_nulls_last(), *[F.col(k) for k in key]], "_pos")
    return _widened(placed, [*by, *key], "_pos", list(orders))


def _widened(long: DataFrame, key: list[str], value: str, parts: Sequence[str], suffix: str = "") -> DataFrame:
    """One row per key with a column per part, by its number. Plain aggregates: unlike a pivot they are combined before the shuffle."""
    return long.groupBy(*key).agg(*[F.max(F.when(F.col("_part") == i, F.col(value))).alias(p + suffix) for i, p in enumerate(parts)])


def _value_places(df: DataFrame, by: list[str], key: list[str], cols: Sequence[str]) -> DataFrame:
    """Long rows (by, key, part, value) with counts below / up to the value and of all values; `df` is read twice.

    Equal values are counted before the sort, so a value shared by a third of
    the rows is one row there.
    """
    pairs = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(cols))
    long = df.select(*by, *key, F.expr(f"stack({len(cols)}, {pairs}) AS (_part, _value)"))
    long = long.filter(F.col("_value").isNotNull())
    counts = long.groupBy(*by, "_part", "_value").agg(F.count("*").alias("_n"))
    placed = running_total(counts, [*by, "_part"], [F.col("_value")], {"_upto": F.col("_n")}, whole={"_all": "_upto"})
    return beside(long, placed, [*by, "_part", "_value"], known=["_part", "_value"])


def percent_ranks(df: DataFrame, by, key, cols: Sequence[str], suffix: str = "_pr") -> DataFrame:
    """(by, key) with (rank - 1) / (n - 1) of each column; rows without any value are left out. `df` is read twice."""
    by, key = _keys(by), _keys(key)
    long = _value_places(df, by, key, cols).withColumn(
        "_pr", F.when(F.col("_all") > 1, (F.col("_upto") - F.col("_n")) / (F.col("_all") - 1)).otherwise(0.0))
    return _widened(long, [*by, *key], "_pr", cols, suffix)


def with_percent_rank(df: DataFrame, by, key, cols: Sequence[str], suffix: str = "_pr",
                      small: bool = False) -> DataFrame:
    """(rank - 1) / (n - 1) of each column among its non-missing values in the group."""
    by, key = _keys(by), _keys(key)
    if small:
        out = []
        for c in cols:
            n = F.count(c).over(W.partitionBy(*by))
            r = F.rank().over(W.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
            out.append(F.when(F.col(c).isNotNull(), F.when(n > 1, (r - 1) / (n - 1)).otherwise(0.0)).alias(c + suffix))
        return df.select("*", *out)
    df = cut(df)
    return beside(df, percent_ranks(df, by, key, cols, suffix), [*by, *key], "left")


def with_cume_dist(df: DataFrame, by, key, col: str, name: str, small: bool = False) -> DataFrame:
    """Share of the group's known values that are at or below this one; missing for a missing value."""
    by, key = _keys(by), _keys(key)
    if small:
        known = F.col(col).isNotNull()
        return df.withColumn(name, F.when(known, F.cume_dist().over(W.partitionBy(*by, known).orderBy(col))))
    df = cut(df)
    long = _value_places(df, by, key, [col]).select(*by, *key, (F.col("_upto") / F.col("_all")).alias(name))
    return beside(df, long, [*by, *key], "left")


def with_rank_desc(df: DataFrame, by, key, cols: Sequence[str], suffix: str = "_rank",
                   small: bool = False) -> DataFrame:
    """1 + number of strictly larger values in the group, per column."""
    by, key = _keys(by), _keys(key)
    if small:
        rank = lambda c: F.rank().over(W.partitionBy(*by).orderBy(F.col(c).desc_nulls_last())).cast("bigint")
        return df.select("*", *[F.when(F.col(c).isNotNull(), rank(c)).alias(c + suffix) for c in cols])
    df = cut(df)
    return beside(df, ranks_desc(df, by, key, cols, suffix), [*by, *key], "left")


def ranks_desc(df: DataFrame, by, key, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    """(by, key) with 1 + number of strictly larger values, per column; rows without any value are left out."""
    by, key = _keys(by), _keys(key)
    long = _value_places(df, by, key, cols).withColumn("_r", F.col("_all") - F.col("_upto") + 1)
    return _widened(long, [*by, *key], "_r", cols, suffix)


def with_group_agg(df: DataFrame, by, aggs: Mapping[str, Column], small: bool = False) -> DataFrame:
    """Aggregates of the row's group, on every row.

    Small groups share the exchange of the windows around; large ones are
    aggregated before the shuffle and joined back.
    """
    by = _keys(by)
    if small:
        return df.select("*", *[c.over(W.partitionBy(*by)).alias(n) for n, c in aggs.items()])
    return beside(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), by)


def place_in_ties(rows: DataFrame, by, value: str, name: str, session: str = "session", key: str = "symbol") -> DataFrame:
    """Add the 1-based place of each row among the rows of its group and value, by (session, key).

    Counts per session come first, so a window holds the calendar, or the names of one session.
    """
    by = [*_keys(by), value]
    earlier = W.partitionBy(*by).orderBy(session).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*by, session).agg(F.count("*").alias("_n")).select(
        *by, session, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*by, session).orderBy(key))
    placed = beside(rows.withColumn("_inside", inside), before, [*by, session])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def top_k(df: DataFrame, by, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k per group. Each task keeps at most k rows of a group before the shuffle."""
    w = W.partitionBy(*_keys(by)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint"))


# ── boards ──────────────────────────────────────────────────────────────────

def order_missing_last(col: str, ascending: bool, tie: str = "rank") -> list[Column]:
    """Missing last in both directions, ties by `tie`."""
    key = F.col(col) if col in ("symbol", "rank") else finite(col)
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.col(tie).asc()]


def board_order(key: str = "rank", flipped: bool = False) -> list[Column]:
    col, ascending = fixed.BOARD_SORTS.get(key, fixed.BOARD_SORTS["rank"])
    return order_missing_last(col, ascending != flipped)


def paginate(df: DataFrame, order: Sequence[Column], page: int, per_page: int = 50) -> DataFrame:
    """One page of the ordered rows; a page past the end is the last page. `order` must be total.

    The rows are dealt to slices by range and counted there; only the slices that hold the page are sorted,
    for as many rows as end with it.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = held.groupBy("_slice").count().orderBy("_slice").collect()        # one row per slice
    pages = max(1, -(-sum(n for _, n in sizes) // per_page))
    first = max(0, min(page, pages - 1)) * per_page
    before, skipped, holding = 0, 0, []
    for i, n in sizes:
        if before + n <= first:
            skipped += n
        elif before < first + per_page:
            holding.append(i)
        before += n
    shown = held.filter(F.col("_slice").isin(holding)).orderBy(*order).offset(first - skipped).limit(per_page)
    return shown.select(*df.columns)


def lookup_order(key: str, flipped: bool = False) -> list[Column]:
    """One of the lookup table's orders: missing last both ways, ties by symbol."""
    col, ascending = fixed.LOOKUP_SORTS[key]
    return order_missing_last(col, ascending != flipped, "symbol")


def lookup_page(rows: DataFrame, filters: Sequence[Column] = (), query: str = "", key: str = "prob", flipped: bool = False,
                page: int = 0, per_page: int = 50) -> DataFrame:
    """The lookup table: filters, then search, then order, then page. While searching, an exact symbol comes
    first and the others by symbol; the chosen order rests."""
    for test in filters:
        rows = rows.filter(test)
    if query.strip():
        rows = rows.filter(predicates.search_match(query))
        return paginate(rows, predicates.search_order(query, "symbol"), page, per_page)
    return paginate(rows, lookup_order(key, flipped), page, per_page)


def newest_first(ts: Column, pos: str) -> list[Column]:
    """Instants newest first, undated last, then feed order."""
    return [ts.desc_nulls_last(), F.col(pos).asc()]


def top_reasons(reasons: str, n: int = 3) -> Column:
    """The n strongest of array<struct(text, strength)>, ties in feed order."""
    numbered = F.transform(F.col(reasons), lambda r, i: F.struct(
        (-F.coalesce(r["strength"], F.lit(0))).alias("s"), i.alias("i"), r.alias("r")))
    return F.transform(F.slice(F.array_sort(numbered), 1, n), lambda x: x["r"])


def top_attribution(shares: str, n: int = 6) -> Column:
    """The n largest positive finite shares of map<string,double>, ties in map order."""
    pairs = F.transform(F.map_entries(F.col(shares)), lambda e, i: F.struct(
        (-e["value"]).alias("neg"), i.alias("i"), e["key"].alias("family")))
    held = F.filter(pairs, lambda e: (e["neg"] < 0) & ~F.isnan(e["neg"]) & (e["neg"] != float("-inf")))
    return F.transform(F.slice(F.array_sort(held), 1, n), lambda e: F.struct(
        e["family"].alias("family"), (-e["neg"]).alias("share")))


def live_order(oc: str = "oc", pos: str = "symbol") -> list[Column]:
    """Deepest fall first; a missing move sorts as +9."""
    return [F.coalesce(finite(oc), F.lit(9.0)).asc(), F.col(pos).asc()]


def exact_median(df: DataFrame, by, value: str, name: str, small: bool = False) -> DataFrame:
    """Median per group, missing if all values are. The built-in one holds a group's values in one task; others are placed by rank."""
    return agg_with_median(df, by, {}, [], value, name, small)


def agg_with_median(df: DataFrame, by, sums: Mapping[str, Column], finals: Sequence[Column], value: str, name: str,
                    small: bool = False) -> DataFrame:
    """Grouped sums, what `finals` makes of them, and one exact median, from one pass over the rows.

    Rows are summed per group and value before anything is sorted, and the same sums serve both.
    """
    by = _keys(by)
    if small:
        out = df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.median(value).alias(name))
        return out.select(*by, *finals, name)
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(
        F.count(value).alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()])      # _n is 0 where the value is missing
    placed = running_total(counts, by, [F.col("_v")], {"_upto": F.col("_n")}, whole={"_all": "_upto"})
    below, upto, n = F.col("_upto") - F.col("_n"), F.col("_upto"), F.col("_all")
    lower, upper = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)      # 1-based middle places
    holds = lambda place: (below < place) & (upto >= place)
    out = placed.groupBy(*by).agg(
        *[F.sum(s).alias(s) for s in sums],
        ((F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2).alias(name))
    return out.select(*by, *finals, name)
