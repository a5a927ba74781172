"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

State, in the shared folder: `postings`, one row per line key and document that holds it, and
`shards`, which holds per shard of the key space the exact reference counts (documents holding a
key, the largest of them) and two cuckoo filters, of the keys seen and of the keys held by
`min_docs` documents, whose lines go. Inserting documents probes the first: a key it doesn't know
is new without a look-up. Removing documents lowers counts and takes keys out of both. Deciding
probes the second: most lines end there; the rest are looked up exactly.

A document is named by its id. Rows of one id are one document. A row without an id is named by its
text: equal ones are one document, all of them below every id, in the order of the text's md5; ids are
taken to be -2^62 or more. Null and empty texts have one empty line. Equal lines of one text count
once. Added columns replace input columns of their names; an empty table gives no rows. A shard is sized by the number
of distinct keys; a shard whose lines are many (one line may be in a third of all texts) is probed
in several parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, map_arrow, without, written
from .cuckoo import Cuckoo

MIN_DOCS = 3
MIN_POINTS = 20
#: Rows of a shard, or of a part of one, that a task has on average.
SHARD_ROWS = 200_000
NO_ID = -(2**63)
STATE = "shard int, kind int, a long, b long, refs long, top long, filter binary"
ROW, SEEN, DROPS = 0, 1, 2


@dataclass
class State:
    postings: DataFrame
    shards: DataFrame
    n_shards: int
    min_docs: int
    min_points: int


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def _name() -> Column:
    """A document's name: its id, or 60 bits of its text above the least long."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).otherwise(F.lit(NO_ID) + F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def _postings(docs: DataFrame, n_shards: int, min_points: int) -> DataFrame:
    keys = F.array_distinct(F.filter(F.transform(_lines(), _key), lambda k: F.length(k) >= min_points))
    rows = docs.select(_name().alias("doc"), F.explode(keys).alias("key"))
    a = F.xxhash64(F.lit(1), F.col("key"))
    return rows.select(F.pmod(a, F.lit(n_shards)).cast("int").alias("shard"), a.alias("a"), F.xxhash64(F.lit(2), F.col("key")).alias("b"), "doc").distinct()


def empty(spark, n_shards: int, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> State:
    return State(spark.createDataFrame([], "shard int, a long, b long, doc long"), spark.createDataFrame([], STATE), n_shards, min_docs, min_points)


def shards_for(docs: DataFrame, min_points: int = MIN_POINTS) -> int:
    n = docs.select(F.size(_lines()).alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(1, -(-n // SHARD_ROWS))


def _apply(min_docs: int):
    """New rows and filters of one shard from the old ones and the keys that change."""
    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        shard = int((new if new.num_rows else old).column("shard")[0].as_py())
        blobs = {r["kind"]: r["filter"] for r in old.filter(pa.compute.not_equal(old["kind"], ROW)).select(["kind", "filter"]).to_pylist()}
        have = old.filter(pa.compute.equal(old["kind"], ROW)).select(["a", "b", "refs", "top"]).to_pandas()
        seen, drops = (Cuckoo.load(blobs[k]) if k in blobs else Cuckoo() for k in (SEEN, DROPS))
        change = new.select(["a", "b", "refs", "top"]).to_pandas()
        maybe = seen.contains(change["a"].to_numpy())
        fresh, known = change[~maybe], change[maybe]                    # what the filter doesn't know is new
        both = known.merge(have, on=["a", "b"], how="left", suffixes=("", "_old"))
        refs = both["refs"] + both["refs_old"].fillna(0).astype("int64")
        top = np.where(both["refs"] > 0, np.maximum(both["top"], both["top_old"].fillna(NO_ID).astype("int64")), both["top"])
        moved = pd.DataFrame({"a": both["a"], "b": both["b"], "refs": refs, "top": top, "old": both["refs_old"].fillna(0).astype("int64")})
        moved = pd.concat([moved, fresh.assign(old=0)])
        rest = have.merge(moved[["a", "b"]], on=["a", "b"], how="left", indicator=True)
        rest = rest[rest["_merge"] == "left_only"].drop(columns="_merge")
        after = pd.concat([rest, moved.loc[moved["refs"] > 0, ["a", "b", "refs", "top"]]])
        gone = lambda low: moved.loc[(moved["old"] >= low) & (moved["refs"] < low), "a"].to_numpy()
        came = lambda low: moved.loc[(moved["old"] < low) & (moved["refs"] >= low), "a"].to_numpy()
        out = [pa.table({"shard": pa.array(np.full(len(after), shard, np.int32)), "kind": pa.array(np.full(len(after), ROW, np.int32)),
                         **{c: pa.array(after[c].to_numpy(np.int64)) for c in ("a", "b", "refs", "top")},
                         "filter": pa.nulls(len(after), pa.binary())})]
        for kind, f, low in ((SEEN, seen, 1), (DROPS, drops, min_docs)):
            f.delete(gone(low))
            size = int((after["refs"] >= low).sum())
            if size > 0.8 * f.table.size or not f.insert(came(low)):
                f = Cuckoo.of(after.loc[after["refs"] >= low, "a"].to_numpy())
            out.append(pa.table({"shard": pa.array([shard], pa.int32()), "kind": pa.array([kind], pa.int32()),
                                 **{c: pa.array([0], pa.int64()) for c in ("a", "b", "refs", "top")}, "filter": pa.array([f.dump()], pa.binary())}))
        return pa.concat_tables(out)

    return run


def _changed(state: State, postings: DataFrame, delta: DataFrame) -> State:
    shards = state.shards.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(_apply(state.min_docs), STATE)
    return State(postings, written(shards, "line-shards"), state.n_shards, state.min_docs, state.min_points)


def insert(state: State, docs: DataFrame) -> State:
    """The state with `docs` in it too; a document that is there already gains the lines it hasn't."""
    key = ["shard", "a", "b", "doc"]
    new = _postings(docs, state.n_shards, state.min_points)
    if not state.postings.isEmpty():
        new = new.join(state.postings, key, "left_anti")
    new = written(new, "line-postings")
    delta = new.groupBy("shard", "a", "b").agg(F.count(F.lit(1)).alias("refs"), F.max("doc").alias("top"))
    return _changed(state, state.postings.unionByName(new), delta)


def remove(state: State, ids: DataFrame) -> State:
    """The state as if the documents named in `ids` (doc_id, and text for those without an id) had never been there."""
    named = ids if "text" in ids.columns else ids.filter(F.col("doc_id").isNotNull()).withColumn("text", F.lit(None).cast("string"))
    names = named.select(_name().alias("doc")).distinct()
    gone = state.postings.join(names, "doc", "left_semi")
    left = written(state.postings.join(names, "doc", "left_anti").select("shard", "a", "b", "doc"), "line-postings")
    delta = gone.groupBy("shard", "a", "b").agg((-F.count(F.lit(1))).alias("refs"))
    tops = left.join(delta.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.max("doc").alias("top"))
    delta = delta.join(tops, ["a", "b"], "left").select("shard", "a", "b", "refs", F.coalesce("top", F.lit(NO_ID)).alias("top"))
    return _changed(state, left, delta)


def _probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """Lines of one part of a shard that go: known to the filter, then to the exact table, and not in the last document."""
    out = pa.schema([("doc", pa.int64()), ("a", pa.int64())])
    blob = [r["filter"] for r in shard.filter(pa.compute.equal(shard["kind"], DROPS)).select(["filter"]).to_pylist()]
    if not lines.num_rows or not blob:
        return out.empty_table()
    lines = lines.filter(pa.array(Cuckoo.load(blob[0]).contains(lines["a"].to_numpy())))
    exact = shard.filter(pa.compute.equal(shard["kind"], ROW)).select(["a", "b", "top"]).to_pandas()
    hit = lines.select(["a", "b", "doc"]).to_pandas().merge(exact, on=["a", "b"])
    hit = hit[hit["doc"] != hit["top"]]
    return pa.table({"doc": pa.array(hit["doc"].to_numpy(np.int64)), "a": pa.array(hit["a"].to_numpy(np.int64))})


def dropped(state: State, postings: DataFrame) -> DataFrame:
    """(doc, a) of the lines that go, of the documents in `postings`."""
    # one row a shard, written: Spark knows its size and broadcasts it only while it is small
    parts = written(postings.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts")), "line-parts")
    lines = postings.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "a", "b", "doc")
    tables = state.shards.filter((F.col("kind") == DROPS) | (F.col("kind") == ROW) & (F.col("refs") >= state.min_docs))
    tables = tables.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return lines.groupBy("shard", "part").cogroup(tables.groupBy("shard", "part")).applyInArrow(_probe, "doc long, a long")


def _strip(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, counts, drops = [], [], []
    rows = zip(batch["__lines"].to_pylist(), batch["__keys"], batch["__drop"], strict=True)
    for lines, keys, drop in rows:
        n = len(lines)
        if drop.is_valid:
            keep = ~np.isin(keys.values.to_numpy(zero_copy_only=False), drop.values.to_numpy())
            lines = [x for x, k in zip(lines, keep, strict=True) if k]
        texts.append("\n".join(lines))
        counts.append(n)
        drops.append(n - len(lines))
    out = batch.drop_columns(["__lines", "__keys", "__drop", "__text"])
    cols = {**{c: out[c] for c in out.schema.names}, "text": pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(drops, pa.int64())}
    return pa.RecordBatch.from_pydict(cols)


def deduplicated(state: State, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """`docs` without the lines that go: `text` is what stays, and `n_lines` and `n_dropped` (long) are added."""
    docs = without(docs, "n_lines", "n_dropped")
    if postings is None:
        postings = _postings(docs, state.n_shards, state.min_points)
    drop = dropped(state, postings).groupBy("doc").agg(F.collect_set("a").alias("__drop"))     # at most a text's own lines
    named = docs.withColumn("__doc", _name())
    joined = named.join(drop, named["__doc"] == drop["doc"], "left").drop("doc", "__doc")
    key = lambda x: F.when(F.length(_key(x)) >= state.min_points, F.xxhash64(F.lit(1), _key(x))).otherwise(F.lit(0))
    joined = joined.withColumns({"__lines": _lines(), "__text": F.col("text")}).withColumn(
        "__keys", F.when(F.col("__drop").isNotNull(), F.transform("__lines", key))).drop("text")
    kept = [c for c in docs.columns if c.lower() != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema = (fields + ", " if fields else "") + "text string, n_lines long, n_dropped long"
    out = map_arrow(joined, _strip, schema, column="__text")
    return out.select(*[F.col(f"`{c}`") if c.lower() != "text" else F.col("text") for c in docs.columns], "n_lines", "n_dropped")


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """All of `docs` put into an empty state, then deduplicated by it."""
    state = insert(empty(docs.sparkSession, shards_for(docs), min_docs, min_points), docs)
    return deduplicated(state, docs, state.postings)


#: The query's rows in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(doc_id, (-9223372036854775807 - 1) + ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT) AS name, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, name, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(name) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT name) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.name <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
