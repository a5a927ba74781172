"""Tables derived from published files, kept up to date by re-reading only what changed.

A derived table is partitioned by session. Beside it lies a manifest: of each published file the
version that was read and the sessions it holds rows of. A refresh compares the published index with the
manifest, and rebuilds the sessions that a file added, changed or removed has rows in, in the old version or the new one,
from the files that hold rows of these sessions. Only those partitions are written (dynamic
partition overwrite). The manifest is written last, as a new version: a refresh that breaks off is
simply done again, and rebuilds the same partitions. With nothing changed, nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .feeds import manifest_diff

MANIFEST = "name string, seq bigint, sha256 string, sessions array<date>"


@dataclass
class Refreshed:
    """What a refresh did: its run number (0: nothing to do), files read again or gone, sessions rebuilt."""

    run: int
    files: int
    sessions: int


def latest_run(spark: SparkSession, home: str) -> int:
    """Number of the newest manifest, 0 without any."""
    try:
        runs = spark.read.parquet(f"{home}/manifest").select("run")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return runs.agg(F.max("run")).first()[0] or 0


def manifest(spark: SparkSession, home: str, run: int) -> DataFrame:
    """The files read up to a run, with the sessions each holds rows of."""
    if not run:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{home}/manifest/run={run}")


def refresh(index: DataFrame, home: str, read: Callable[[Sequence[tuple[str, int]]], DataFrame],
            derive: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Brings the table in `home` up to the published `index` (name, seq, sha256).

    `read` gives the rows of file versions (name, seq), with the columns `name` and `session`; `derive` makes the
    table's rows from them, session by session, with the column `session`. File names go through the
    driver, as the paths of any scan do; sessions are bounded by the calendar.
    """
    spark = index.sparkSession
    run = latest_run(spark, home)
    held = manifest(spark, home, run)
    diff = cut(manifest_diff(held, index).filter("status <> 'same'"))
    moved = diff.collect()
    if not moved:
        return Refreshed(0, 0, 0)
    again = [(m.name, m.new_seq) for m in moved if m.reread]
    gone = spark.createDataFrame([(m.name,) for m in moved], "name string")
    if again:
        found = read(again).filter(F.col("session").isNotNull()).select("name", "session").distinct().groupBy("name").agg(F.sort_array(F.collect_list("session")).alias("sessions"))
    else:
        found = spark.createDataFrame([], "name string, sessions array<date>")
    fresh = index.join(diff.filter("reread").select("name"), "name", "left_semi").join(found, "name", "left").select(
        "name", "seq", "sha256", F.coalesce("sessions", F.array().cast("array<date>")).alias("sessions"))
    kept = held.join(gone, "name", "left_anti")
    now = cut(kept.unionByName(fresh))
    was = held.join(gone, "name", "left_semi").select(F.explode("sessions").alias("session"))
    touched = [r.session for r in was.unionByName(fresh.select(F.explode("sessions").alias("session"))).distinct().collect()]
    sources = now.filter(F.arrays_overlap("sessions", F.lit(touched).cast("array<date>"))).select("name", "seq").collect() if touched else []
    if sources:
        rows = read([(s.name, s.seq) for s in sources]).filter(F.col("session").isin(touched))
        built = derive(rows).withColumn("built", F.lit(run + 1))
        # rebalanced: a large session is split over tasks, small ones share one
        built.hint("rebalance", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "session").parquet(f"{home}/table")
    now.write.mode("overwrite").parquet(f"{home}/manifest/run={run + 1}")
    return Refreshed(run + 1, len(moved), len(touched))


def current(spark: SparkSession, home: str, schema: str | StructType) -> DataFrame:
    """The table as of its newest manifest; `built` is the run a row's session was rebuilt in.

    A session without any file left keeps its old partition on disk, which is not read.
    """
    run = latest_run(spark, home)
    if not run:
        return spark.createDataFrame([], schema)
    live = manifest(spark, home, run).select(F.explode("sessions").alias("session")).distinct()      # the calendar
    return spark.read.schema(schema).parquet(f"{home}/table").join(F.broadcast(live), "session", "left_semi")
