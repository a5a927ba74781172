"""Feed documents: load, unfold, verify, compare, append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import days_between, et_date, et_hhmm
from ..schemas import FEEDS
from ..session import cut


def load_feed(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Documents of one feed under an explicit schema; an absent feed is an empty frame."""
    try:
        return spark.read.schema(schema).json(path, multiLine=multi_line, mode="PERMISSIVE")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_checked(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """S1 with quarantine: the documents that can be used, and (name, reason, document) of those that cannot.

    A document that is no JSON, or has a field of another type than the schema's, is broken as a whole, and so is
    one without a `required` field: no part of it is used. Both come from one reading of the files. `name` is the
    document's folder, as `write_documents` lays it down; an absent feed has no documents of either kind.
    """
    fields = StructType.fromDDL(schema).fieldNames()
    whole = StructType.fromDDL(f"{schema}, _broken STRING, name STRING")
    try:
        docs = spark.read.schema(whole).option("columnNameOfCorruptRecord", "_broken").option("basePath", path).json(path, mode="PERMISSIVE")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], whole)
    reason = F.when(F.col("_broken").isNotNull(), "broken")
    for f in required:
        reason = reason.when(F.col(f"`{f}`").isNull(), f"no {f}")
    docs = cut(docs.select("name", reason.alias("_reason"), "_broken", *[F.col(f"`{f}`") for f in fields]))
    good, bad = docs.filter("_reason is null"), docs.filter("_reason is not null")
    kept = F.coalesce("_broken", F.to_json(F.struct(*[F.col(f"`{f}`") for f in fields])))
    return good.select("name", *[F.col(f"`{f}`") for f in fields]), bad.select("name", F.col("_reason").alias("reason"), kept.alias("document"))


#: Fields without which a document of a feed says nothing.
REQUIRED = {"index": ["seq", "files"], "today": ["session_date", "run"], "model": ["base_rate"], "evidence": ["studies"], "scorecard": ["days"],
            "live": ["session_date"], "universe": ["columns", "rows"], "unified": ["lists"], "size_research": ["intraday"]}


def load_feeds(spark: SparkSession, folder: str, names: Sequence[str] = tuple(FEEDS)) -> tuple[dict[str, DataFrame], DataFrame]:
    """All feeds below `folder`, and the quarantine of all of them: (feed, name, reason, document)."""
    loaded = {n: load_checked(spark, f"{folder}/{n}", FEEDS[n], REQUIRED[n]) for n in names}
    aside = [bad.select(F.lit(n).alias("feed"), "*") for n, (_, bad) in loaded.items()]
    out = aside[0]
    for a in aside[1:]:
        out = out.unionByName(a)
    return {n: good for n, (good, _) in loaded.items()}, out


def write_documents(docs: DataFrame, path: str, name: str = "name", body: str = "json") -> None:
    """One text file per document below `path/name=<name>`; each row is one document."""
    docs.select(F.col(name).cast("string").alias("name"), F.col(body).alias("value")).repartition("name").write.partitionBy(
        "name").text(path)


def columnar_to_rows(docs: DataFrame, types: Mapping[str, str], columns: str = "columns", rows: str = "rows",
                     keep: Sequence[str] = ()) -> DataFrame:
    """`{columns, rows[][]}` to one typed row per record; a column the document lacks is missing."""
    record = docs.select(*keep, columns, F.explode(rows).alias("_r")).select(
        *keep, F.map_from_arrays(columns, "_r").alias("_m"))
    return record.select(*keep, *[F.try_element_at("_m", F.lit(c)).try_cast(t).alias(c) for c, t in types.items()])


def explode_bars(picks: DataFrame, keep: Sequence[str], chart: str = "chart", strict: bool = False) -> DataFrame:
    """S3: nested `[date, o, h, l, c, v]` bars to long rows, in chart order.

    Bars without a finite close are dropped; `strict` asks for all four prices.
    """
    long = picks.select(*keep, F.posexplode(chart).alias("bar", "_b"))
    num = lambda i: F.get("_b", F.lit(i)).try_cast("double")
    fields = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}
    out = long.select(*keep, F.col("bar").cast("bigint").alias("bar"), F.get("_b", F.lit(0)).try_cast("date").alias("session"),
                      *[F.when(~F.isnan(num(i)) & (F.abs(num(i)) != float("inf")), num(i)).alias(n) for n, i in fields.items()])
    need = ["open", "high", "low", "close"] if strict else ["close"]
    return out.dropna(subset=need)


def manifest_rows(index: DataFrame) -> DataFrame:
    """Index documents to (name, seq, sha256) rows."""
    return index.select(F.explode("files").alias("name", "_f")).select("name", "_f.seq", "_f.sha256")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by what happened to them; only added and changed ones are read again.

    A file has changed when its own seq is newer than the one held; the index's
    own seq does not count.
    """
    o = old.select("name", F.col("seq").alias("old_seq"))
    n = new.select("name", F.col("seq").alias("new_seq"))
    status = (
        F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed")
        .when(F.col("new_seq") > F.col("old_seq"), "changed").otherwise("same")
    )
    return o.join(n, "name", "full").select("name", "old_seq", "new_seq", status.alias("status"),
                                            status.isin("added", "changed").alias("reread"))


def monotonic(log: DataFrame, by: Sequence[str], ts: str, seq: str, grain: str = "DAY") -> DataFrame:
    """An index older than the newest one seen before it is refused.

    Running maximum per key, taken inside time buckets and carried across them,
    so one busy key is spread over its buckets. Adds `held` (the newest seq
    before) and `accepted`; refused rows go to quarantine by that flag.
    """
    rows = log.withColumn("_bucket", F.date_trunc(grain, F.col(ts)))
    inside = W.partitionBy(*by, "_bucket").orderBy(ts, seq).rowsBetween(W.unboundedPreceding, -1)
    peak = rows.groupBy(*by, "_bucket").agg(F.max(seq).alias("_peak"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = peak.select(*by, "_bucket", F.max("_peak").over(earlier).alias("_carried"))
    met = rows.withColumn("_in", F.max(seq).over(inside)).join(carried, [*by, "_bucket"])
    held = F.greatest("_in", "_carried")
    return met.select(*log.columns, held.alias("held"), F.coalesce(F.col(seq) >= held, F.lit(True)).alias("accepted"))


def integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SHA-256 of every file against its manifest entry; mismatches are for the audit table."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("name").cast("string").alias("name"), F.sha2("content", 256).alias("actual"), "length")
    want = manifest.select(F.col("name").cast("string").alias("name"), "sha256")
    return want.join(files, "name", "full").select(
        "name", "sha256", "actual", F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)).alias("ok"))


def append_history(snapshot: DataFrame, path: str, keys: Sequence[str] = ("session", "symbol")) -> int:
    """Append the keys the history does not have yet; a stored session is never rewritten.

    Only the partitions of the snapshot's own sessions are looked at.
    """
    spark = snapshot.sparkSession
    sessions = F.broadcast(snapshot.select("session").distinct())      # the calendar bounds it
    held = load_history(spark, path, snapshot.schema).join(sessions, "session", "left_semi")
    fresh = snapshot.join(held.select(*keys), list(keys), "left_anti")
    fresh = cut(fresh)
    fresh.repartition("session", *[k for k in keys if k != "session"]).write.mode("append").partitionBy("session").parquet(path)
    return fresh.count()


def load_history(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def history_series(history: DataFrame, value: str) -> DataFrame:
    """Ordered (session, value) series per symbol; as long as the calendar."""
    return history.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("session", value))).alias("series"))


def source_health(sources: DataFrame, run: str, ok: Column) -> DataFrame:
    """Ok k of n per run."""
    return sources.groupBy(run).agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n_sources"),
                                    (F.count_if(ok) == F.count("*")).alias("all_ok"))


def staleness(feeds: DataFrame, now: str = "now") -> DataFrame:
    """One row per feed run with the flags a reader must see.

    Columns read: late, withheld_reason, withheld_at, generated_at, session_date, run, layer_session,
    live_session, sample. Sample feeds raise no staleness.
    """
    today, real = et_date(now), ~F.coalesce("sample", F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return feeds.select(
        "*", flag(F.col("late")).alias("is_late"),
        flag((F.col("withheld_reason") != "") & (
            F.col("generated_at").isNull() | F.col("withheld_at").isNull() | (F.col("withheld_at") > F.col("generated_at")))).alias("newer_withheld"),
        flag(real & (F.col("session_date") < today)).alias("stale_session"),
        flag(real & (F.col("run") == "evening") & (F.col("session_date") == today) & (et_hhmm(now) >= "08:45")).alias("morning_missing"),
        flag(days_between("layer_session", "session_date") > 4).alias("layer_stale"),
        flag(F.col("live_session").isNotNull() & (F.col("live_session") != F.col("session_date"))).alias("live_other_session"),
        flag(F.col("sample")).alias("is_sample"))


def funnel(rows: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """How many names pass each step, per session."""
    return rows.groupBy("session").agg(*[F.count_if(c).alias(n) for n, c in steps.items()])
