"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets small enough for memory, by a seeded hash of
document id and text. Pass two permutes each bucket with a seeded Fisher-Yates shuffle. The
buckets, one after another, are then one random order of all rows; cut into equal runs, they are
the shards, whose row counts differ by one at most (law `rows`).

Rows: a null id or text hashes as such; equal ids with different texts go apart; rows of one id and text are
numbered among their equals, and the number goes into the hash, so they go apart too; an empty table
gives no rows. Columns of the input named like an added one (`shard`, `slot`) are replaced.
The order depends on seed and rows alone, not on their partitions: each bucket is sorted by its
rows' hashes before it is permuted, so a task that runs again writes the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import numbered, text_key, without, written
from .prefix import offsets

BUCKET_BYTES = 16 << 20


def _apart(docs: DataFrame) -> DataFrame:
    """`docs` with other places for rows that share theirs: by all their columns and their number among equal rows."""
    shared = written(docs.groupBy("__place").agg(F.count(F.lit(1)).alias("__m")).filter("__m > 1").select("__place"), "equal-places")
    if shared.isEmpty():
        return docs
    again = numbered(docs.join(shared, "__place", "left_semi").select(docs.columns), "__no")
    others = [F.col(f"`{c}`") for c, t in docs.dtypes if c != "text" and "map<" not in t]
    again = again.withColumn("__place", F.xxhash64(*others, "__no")).select(docs.columns)
    return docs.join(shared, "__place", "left_anti").select(docs.columns).unionByName(again)


def shard(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of `docs` and `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in its shard)."""
    docs = without(docs, "shard", "slot")
    total, rows = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.count(F.lit(1))).first()
    n = max(1, -(-int(total or 0) // bucket_bytes))
    placed = _apart(docs.withColumn("__place", F.xxhash64(F.lit(seed), "doc_id", text_key(F.col("text")))))
    dealt = placed.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__place"), F.lit(n)))
    # one row a bucket, written: Spark knows its size and broadcasts it only while it is small
    starts = written(offsets(dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")), "__bucket", "__n", "__start"), "bucket-starts")

    kinds = StructType([*dealt.schema, StructField("__at", LongType())])
    order = [("__place", "ascending"), *[(c, "ascending") for c, t in docs.dtypes if t in ("bigint", "int", "string", "double", "date")]]

    def permuted(bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket, order))
        key = int(bucket.column("__bucket")[0].as_py())
        at = np.random.Generator(np.random.PCG64([seed, key])).permutation(bucket.num_rows)   # Fisher-Yates
        return bucket.append_column("__at", pa.array(at))

    mixed = dealt.groupBy("__bucket").applyInArrow(permuted, kinds).join(starts.select("__bucket", "__start"), "__bucket")
    position = F.col("__start") + F.col("__at")
    exact = F.expr(f"int((__start + __at) * {shards} div {max(rows, 1)})")
    return mixed.withColumns({"shard": exact}).withColumns({
        "slot": position - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")}).drop("__place", "__bucket", "__at", "__start")
