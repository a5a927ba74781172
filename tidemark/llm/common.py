"""What the corpus operators share: column handling, written intermediates, Arrow batches, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: The white space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns an operator is about to add (names compare without case, as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage where rows are read more than once; the copy survives a lost executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """64 bits of the text; with the document's id it names a document, equal rows sharing one name."""
    return F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")))


def n_words(text: Column) -> Column:
    """Number of words of the contracts; null text: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def batches(source: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `limit` bytes at most (one row at least)."""
    for b in source:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, s in enumerate(sizes):
            if i > start and held + s > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(s)
        if start < b.num_rows:
            yield b.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text",
              limit: int = 1 << 20) -> DataFrame:
    """`fn` over slices of bounded text size; None adds nothing."""
    def run(source):
        for piece in batches(source, column, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


#: Equal rows that one task deals out.
EQUAL_ROWS = 10_000


def numbered(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """`df` with `name` (long): the number of each row among its equals, from 0.

    Equal rows are counted first and dealt out again in blocks, so a third of the table may be equal without meeting in a task.
    """
    block = block or EQUAL_ROWS
    maps = [c for c, t in df.dtypes if t.startswith("map<")]                  # cannot be grouped as they are
    keys = [F.sort_array(F.map_entries(f"`{c}`")).alias(c) if c in maps else F.col(f"`{c}`") for c in df.columns]
    counted = df.select(keys).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__m"))
    blocks = counted.withColumn("__b", F.explode(F.expr(f"sequence(0L, (__m - 1) div {block})"))).hint("rebalance")
    back = [F.map_from_entries(f"`{c}`").alias(c) if c in maps else F.col(f"`{c}`") for c in df.columns]
    return blocks.select(*back, F.explode(F.expr(f"sequence(__b * {block}, least(__m, (__b + 1) * {block}) - 1)")).alias(name))
