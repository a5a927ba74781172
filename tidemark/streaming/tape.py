"""Live tape, bars, dedup and monitors on Structured Streaming.

Every transformation takes and returns a DataFrame, streaming or not, so the
batch result on the same rows is the reference for the tests. State is keyed by
(window, symbol), closed by the watermark, and never holds raw ticks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import et_date, market_phase, move_from_open
from ..operators.records import live_summary
from ..session import fresh_path

LATE = "30 minutes"
# 05:00 UTC lies outside every Eastern session in both halves of the year
SESSION_WINDOW = dict(windowDuration="1 day", startTime="5 hours")


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A landed table as a file stream; new files of that name pattern are picked up."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def durable_state(spark: SparkSession) -> None:
    """Keep stream state in RocksDB with changelog checkpoints: state larger than a task's heap, and a checkpoint that writes what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def run(stream: DataFrame, path: str, state: str, mode: str = "append",
        each: Callable[[DataFrame, int], None] | None = None) -> list[dict]:
    """Run a stream over what has arrived since the last run with the same `state` folder; returns the progress of its batches.

    Micro-batches land in `path` as `batch=<id>` folders, each overwritten as a whole: a batch that is run again after
    a failure leaves one copy. A run goes on where the checkpoint in `state` ends, with the state it holds.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each or land).option("checkpointLocation", state)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def state_rows(progress: Sequence[dict]) -> list[int]:
    """Rows of state after each batch, all stateful operators together."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


def drain(stream: DataFrame, name: str, mode: str = "append",
          each: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a stream from its beginning over what has arrived, in folders of its own. Returns the folder its batches land in."""
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    run(stream, path, state, mode, each)
    return path


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All micro-batches of a drained stream."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last update per key of a stream drained in update mode."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_u")).select(*keys, "_u.*")


def live_tape(ticks: DataFrame) -> DataFrame:
    """Open, last, high, low and moves since the open per session and symbol; the event id orders prints of one instant."""
    day = F.window("ts", **SESSION_WINDOW)
    agg = ticks.withWatermark("ts", LATE).filter(market_phase("ts") == "open").groupBy(day.alias("w"), "symbol").agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max_by("price", F.struct("ts", "event_id")).alias("last"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))
    return agg.select(
        et_date(F.col("w.start") + F.expr("INTERVAL 12 HOURS")).alias("session"), "symbol", "open", "last", "high", "low", "n",
        move_from_open("last", "open").alias("oc_now"), move_from_open("high", "open").alias("oh_now"),
        move_from_open("low", "open").alias("ol_now"))


def live_board(ticks: DataFrame, board: DataFrame, name: str = "live-board") -> str:
    """The live tape against a published board (symbol, rank; at most 100 names), summed up after every micro-batch.

    Lands one row per session a batch touched: names down 5% and mean move of the top 25 and of
    ranks 26-100, and how many board names have no quote yet. An update carries the whole state of
    its session and name, so only the quotes of the newest session are held from batch to batch
    (earlier windows are closed by the watermark); they are versioned by batch, so a batch that is
    run again starts from the same version. Returns the folder.
    """
    spark = ticks.sparkSession
    names = board.count()
    quotes = live_tape(ticks).join(F.broadcast(board), "symbol").select("session", "symbol", "rank", "oc_now")
    path, held = fresh_path(spark, name), fresh_path(spark, f"{name}-held")

    def merge(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.schema(batch.schema).parquet(f"{held}/v={batch_id - 1}") if batch_id else spark.createDataFrame([], batch.schema)
        known = old.join(batch, ["session", "symbol"], "left_anti").unionByName(batch).persist()
        summary = live_summary(known, "oc_now").withColumn("unquoted", F.lit(names) - F.col("top_n") - F.col("ext_n"))
        summary.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        newest = known.agg(F.max("session").alias("session"))
        known.join(F.broadcast(newest), "session", "left_semi").write.mode("overwrite").parquet(f"{held}/v={batch_id}")
        known.unpersist()

    drain(quotes, name, "update", each=merge)
    return path


def intraday_bars(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    """OHLCV per symbol and tumbling window (hourly for the outer ranks)."""
    agg = ticks.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("size").alias("volume"))
    return agg.select(F.col("w.start").alias("start"), "symbol", "open", "high", "low", "close", "volume")


def snapshot_dedup(snapshots: DataFrame, keys: Sequence[str] = ("symbol", "asof")) -> DataFrame:
    """A snapshot seen before (same keys) is ignored."""
    watched = snapshots.withWatermark("asof", LATE)
    return watched.dropDuplicatesWithinWatermark(list(keys)) if snapshots.isStreaming else watched.dropDuplicates(list(keys))


def late_exclusion(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """T4: stream-static join with each session's open; `counted` marks runs confirmed public before it.

    `sessions` has one row per session of the calendar: (session, open_ts).
    """
    met = runs.join(F.broadcast(sessions), "session", "left")
    status = F.when(F.col("published_at") >= F.col("open_ts"), "late").when(~F.col("confirmed"), "unverified").otherwise("counted")
    return met.withColumn("status", F.when(F.col("open_ts").isNull(), "no session").otherwise(status))


def route_late(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch target: counted runs and excluded runs to their own tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counted = F.col("status") == "counted"
        batch.filter(counted).write.mode("overwrite").parquet(f"{path}/main/batch={batch_id}")
        batch.filter(~counted).write.mode("overwrite").parquet(f"{path}/side/batch={batch_id}")
    return write


def spread_stream(quotes: DataFrame) -> DataFrame:
    """T5: median relative quoted spread per symbol and day."""
    mid = (F.col("ask") + F.col("bid")) / 2
    rel = F.try_divide(F.col("ask") - F.col("bid"), mid)
    agg = quotes.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(
        F.percentile_approx(rel, 0.5, 10000).alias("spread"), F.count("*").alias("n"))
    return agg.select(F.to_date("w.start").alias("day"), "symbol", "spread", "n")


def wire_item(rows: DataFrame, kind: str, ts: Column, headline: Column, severity: Column) -> DataFrame:
    """One source of the wire, each item once. Severity 1-3 by kind (our rule)."""
    items = rows.select("symbol", ts.alias("time"), F.lit(kind).alias("kind"), headline.alias("headline"), severity.cast("int").alias("severity"))
    keys = ["symbol", "time", "kind", "headline", "severity"]
    watched = items.withWatermark("time", LATE)
    return watched.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else watched.dropDuplicates(keys)


def filing_severity(category: str = "category") -> Column:
    c = F.col(category)
    return F.when(c.isin("offering", "toxic_financing"), 3).when(c.isin("atm", "unregistered_sale", "reverse_split"), 2).otherwise(1)


def wire_stream(sources: Sequence[DataFrame]) -> DataFrame:
    """One severity-tagged wire. Each source is deduplicated under its own watermark before the union."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def freshness_monitor(index_stream: DataFrame, name: str = "freshness") -> tuple[str, str]:
    """Which files moved since last seen, per published index.

    The held manifest is a table of one row per published file, versioned by
    batch, so a batch that is run again compares with the same version.
    """
    from ..sources.feeds import manifest_diff, manifest_rows
    spark = index_stream.sparkSession
    moved, held = fresh_path(spark, f"{name}-moved"), fresh_path(spark, f"{name}-held")

    def compare(batch: DataFrame, batch_id: int) -> None:
        # several indexes may arrive together: the newest seq of a file counts
        new = manifest_rows(batch).groupBy("name").agg(F.max("seq").alias("seq"), F.max_by("sha256", "seq").alias("sha256"))
        old = spark.read.schema(new.schema).parquet(f"{held}/v={batch_id - 1}") if batch_id else spark.createDataFrame([], new.schema)
        diff = manifest_diff(old, new).filter("reread").select("name", "new_seq", "status")
        diff.write.mode("overwrite").parquet(f"{moved}/batch={batch_id}")
        keep = old.join(new, "name", "left_anti").unionByName(
            new.alias("n").join(old.alias("o"), "name", "left").filter(
                F.col("o.seq").isNull() | (F.col("n.seq") >= F.col("o.seq"))).select("name", "n.seq", "n.sha256"))
        stale = old.alias("o").join(new.alias("n"), "name").filter(F.col("n.seq") < F.col("o.seq")).select("name", "o.seq", "o.sha256")
        keep.unionByName(stale).write.mode("overwrite").parquet(f"{held}/v={batch_id}")

    drain(index_stream, name, each=compare)
    return moved, held
