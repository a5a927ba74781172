"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words its source has sent up to and including it,
in a seeded random order, divided by the source's target. Second copies follow the first pass of
their source. All copies are sorted by finish time over all sources, and the mix is the prefix
of that order that fits the total budget. A source's words so come near its target.

Targets: sources in code-point order, null last, weigh `weights` in turn and share `share` times
all words; a target stops at `copies` times the words its source has, and the excess is shared
again by weight among the others (the closed form of filling until none is above).

Rows: a null text has no words; documents without words are never taken; a null source is a
source; equal rows are numbered, so each is a document of its own; an empty table gives no rows.
Added columns replace input columns of their names. The random order is by md5 of the id, the text's md5 and the
number among equal rows, so runs agree, and rows without an id, of one id or all equal spread over the slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, text_key, without, written
from .prefix import offsets

WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2
#: Documents a slice of the order holds on average; slices are what a task sorts.
SLICE_ROWS = 2_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, source_size); one row a source, so windows suffice."""
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = ranked.withColumns({"__w": weight, "__cap": copies * F.col("source_size").cast("double")}).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__ratio", "__rank")
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything).cast("double")
    filled = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("__level", (total - filled) / left)
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__rank", "__level"))).over(everything)
    return t.withColumn("__fill", level["__level"]).select(
        "source", "source_size",
        F.when(F.col("__fill").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__fill") * F.col("__w"))).alias("target"))


def _cell(digest: Column, n: int) -> Column:
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * n / F.lit(2.0**32)).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, copies counted), and
    what names the row: __key (of its text) and __dup (number among equal rows)."""
    keyed = numbered(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_key(F.col("text")).alias("__key"),
                                 F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__digest")), "__no")
    keyed = keyed.withColumn("__order", F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__digest", "__no")))
    keyed = written(keyed.drop("__digest", "__no"), "mix-sizes")
    rows = keyed.count()
    n = max(1, -(-rows // SLICE_ROWS))
    aim = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies)
    keyed = keyed.withColumn("__slice", _cell(F.col("__order"), n))
    # running words of each source: of the slices before, and inside the slice
    starts = offsets(keyed.groupBy("source", "__slice").agg(F.sum("size").alias("__n")), "__slice", "__n", "__start", ("source",))
    inside = Window.partitionBy("source", "__slice").orderBy("__order", "doc_id", "__key")
    run = keyed.withColumns({
        "__dup": F.row_number().over(inside),
        "__run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    on = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    run = run.alias("a").join(starts.alias("b"), on("a", "b") & (F.col("a.__slice") == F.col("b.__slice"))).select(
        "a.*", (F.col("a.__run") + F.col("b.__start")).alias("__sent"))
    # one row a source, written: Spark knows its size and broadcasts it only while it is small
    run = run.alias("a").join(written(aim, "mix-targets").alias("b"), on("a", "b")).select("a.*", "b.source_size", "b.target")
    run = written(run, "mix-order")
    budget = F.floor(F.lit(share) * F.sum("size")).cast("long")
    total = run.agg(budget.alias("b")).first()["b"] or 0

    each = run.filter("size > 0").select(
        "source", "doc_id", "__order", "__slice", "__dup", "size", "target",
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__copy"), "__sent", "source_size")
    each = each.withColumn("__finish", (F.col("__sent") + F.col("__copy") * F.col("source_size")).cast("double") / F.col("target"))
    each = each.withColumn("__cell", F.floor(F.col("__finish") * n).cast("long"))
    before = offsets(each.groupBy("__cell").agg(F.sum("size").alias("__n")), "__cell", "__n", "__base")
    served = Window.partitionBy("__cell").orderBy("__finish", F.col("source").asc_nulls_last(), "__copy", "__order", "doc_id", "__dup")
    each = each.withColumn("__in", F.sum("size").over(served.rowsBetween(Window.unboundedPreceding, 0)))
    taken = each.join(before.select("__cell", "__base"), "__cell").filter(F.col("__base") + F.col("__in") <= total)
    taken = taken.groupBy("source", "__slice", "__dup").agg(F.sum("size").alias("taken"))
    return run.alias("a").join(
        taken.alias("b"), on("a", "b") & (F.col("a.__slice") == F.col("b.__slice")) & (F.col("a.__dup") == F.col("b.__dup")), "left").select(
        "a.doc_id", "a.source", "a.size", "a.source_size", "a.target", F.coalesce("b.taken", F.lit(0)).cast("long").alias("taken"), "a.__key", "a.__order", "a.__dup")


def _name() -> Column:
    """With the text's key, the name of a row's document: of its id and source."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("source", F.lit("\0")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; rows of one id, source and text share what is taken of them evenly."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    chosen = plan(docs, **options).withColumn("__times", F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0))
    chosen = chosen.groupBy(_name().alias("__name"), "__key").agg(F.sum("__times").alias("__times"), F.count(F.lit(1)).alias("__rows")).filter("__times > 0")
    chosen = written(chosen, "mix-chosen")
    named = docs.withColumns({"__name": _name(), "__key": text_key(F.col("text"))})
    alone = named.join(chosen.filter("__rows = 1").hint("merge"), ["__name", "__key"]).withColumn("__n", F.col("__times").cast("int"))
    several = chosen.filter("__rows > 1")
    out = alone
    if not several.isEmpty():
        # rows that differ in further columns follow one another; equal ones are numbered
        again = numbered(named.join(several.hint("merge"), ["__name", "__key"]), "__no")
        kind = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and "map<" not in t])
        again = again.withColumn("__kind", kind)
        kinds = again.groupBy("__name", "__key", "__kind").agg(F.count(F.lit(1)).alias("__m"))
        earlier = Window.partitionBy("__name", "__key").orderBy("__kind").rowsBetween(Window.unboundedPreceding, -1)
        kinds = kinds.withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0)))
        dealt = again.join(kinds.drop("__m"), ["__name", "__key", "__kind"])
        times = F.expr("int(__times div __rows + if(__before + __no < __times % __rows, 1, 0))")
        out = alone.unionByName(dealt.withColumn("__n", times).select(alone.columns))
    return out.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)


#: The rows of `plan` with its defaults, in DuckDB SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix/' || coalesce(doc_id::VARCHAR, 'null') || '/' || md5(coalesce(text, '')) || '/' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)) AS o
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (rnk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2 * source_size::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
         ((1.5::DOUBLE * sum(source_size) OVER ())
          - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
fill AS (SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
aims AS (SELECT source, source_size, coalesce(least(cap, (SELECT lvl FROM fill) * w), cap) AS target FROM levels),
sent AS (
  SELECT row_number() OVER () AS r, s.*, a.source_size, a.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id, text ROWS UNBOUNDED PRECEDING) AS run
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
copies AS (SELECT *, (run + c * source_size)::DOUBLE / target AS finish FROM sent, (VALUES (0), (1)) v(c) WHERE size > 0),
served AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, c, o, doc_id, text ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT r, sum(size)::BIGINT AS taken FROM served
          WHERE total <= floor(1.5 * (SELECT sum(size) FROM sized)) GROUP BY r)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken FROM sent s LEFT JOIN taken t USING (r)"""
