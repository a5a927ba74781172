"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the matrix are documents with equal sets taken as one, known by their sets; columns are five-word shingles.
Two sets of sizes m and n are 0.8 similar only if they share 4 (m + n) / 9 shingles or more, so
with shingles in one global order, frequent ones last, a similar pair meets in the first fifth
of both rows: only those columns are multiplied. Entries are discarded by what sizes and places
allow at most. Overlaps of the pairs left are accumulated over their whole rows and decided
exactly, in integers.

The order is by a count sketch over all documents, of fixed size, and then by hash. It only decides how much
is multiplied, never the result.

A column that m documents share is not multiplied out to m^2 pairs. First each document of it
meets only the column's pivot, the one with the fewest rarer shingles; the links found give
components. Then columns that still hold several components are multiplied out between
components. There a column is cut into blocks of one size and place, and two blocks are multiplied only if a
pair of such sizes and places can still be similar: the many documents that share a notice and little
else have it at a place that rules them out against each other, and are never paired. Pairs left out are in one component already.

Rows: null and texts without words have an empty set and link with nothing; fewer than five
words are one shingle; documents with equal sets are linked; rows of one doc_id are taken as
documents of one component; a null doc_id is a component (null) of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, written
from .components import components
from .grams import distinct, mix, shingles, signed, word_hashes

SLOTS = 1 << 22
CHUNKS = 16
U = np.uint64


def least_overlap(m: Column, n: Column) -> Column:
    return F.ceil(4 * (m + n) / 9)


def _sets(column: pa.Array):
    """Distinct shingle hashes, their rows, and where each row's begin."""
    h, row = word_hashes(column)
    s, at_row, _ = shingles(h, row, len(column))
    s, at_row = distinct(s, at_row)
    return s, at_row, np.searchsorted(at_row, np.arange(len(column) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _measure(source):
    """Name and size of each row's set, and the task's part of the sketch in pieces."""
    sketch = np.zeros(SLOTS, dtype=np.uint32)
    for b in batches(source, "text", 1 << 20):
        s, _, first = _sets(b["text"])
        np.add.at(sketch, (s & U(SLOTS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict({
            "doc_id": b["doc_id"], "n": pa.array(np.diff(first).astype(np.int64)), "a": signed(_sums(mix(s), first)), "b": signed(_sums(mix(s ^ U(0x5DEECE66D)), first)),
            "chunk": pa.nulls(b.num_rows, pa.int32()), "sketch": pa.nulls(b.num_rows, pa.binary())})
    step = SLOTS // CHUNKS
    parts = [zlib.compress(sketch[i * step:(i + 1) * step].tobytes(), 1) for i in range(CHUNKS)]
    yield pa.RecordBatch.from_pydict({
        **{c: pa.nulls(CHUNKS, pa.int64()) for c in ("doc_id", "n", "a", "b")}, "chunk": pa.array(range(CHUNKS), pa.int32()), "sketch": pa.array(parts, pa.binary())})


def _add_up(source):
    """Sums of the pieces of each chunk in a partition; holds one array a chunk."""
    held: dict[int, np.ndarray] = {}
    for b in source:
        for k, blob in zip(b["chunk"].to_pylist(), b["sketch"], strict=True):
            part = np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
            held[k] = held[k] + part if k in held else part.astype(np.int64)
    for k, total in held.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "total": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _levels(measured: DataFrame) -> np.ndarray:
    """For each slot of the sketch, how often its shingles occur, in quarter powers of two over the mean (0: up to it)."""
    pieces = measured.filter(F.col("chunk").isNotNull()).select("chunk", "sketch").repartition(CHUNKS, "chunk")
    total = np.zeros(SLOTS, dtype=np.int64)
    step = SLOTS // CHUNKS
    for r in pieces.mapInArrow(_add_up, "chunk int, total binary").collect():             # CHUNKS arrays, of SLOTS numbers together
        total[r["chunk"] * step:(r["chunk"] + 1) * step] += np.frombuffer(zlib.decompress(r["total"]), dtype=np.int64)
    mean = max(total.mean(), 1.0)
    return np.floor(4 * np.log2(np.maximum(total / mean, 1.0))).astype(np.uint8)


def _prefixes(levels):
    """(g, a, n, place) of the columns of each row's set that are multiplied."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s, row, first = _sets(b["text"])
        n = np.diff(first)
        a = _sums(mix(s), first)
        level = levels.value[(s & U(SLOTS - 1)).astype(np.int64)]
        order = np.lexsort((s, level, row))
        place = np.arange(len(s)) - first[row]
        keep = np.flatnonzero(place < (n - (4 * n + 4) // 5 + 1)[row])
        row = row[keep]
        return pa.RecordBatch.from_pydict({"g": signed(s[order[keep]]), "a": signed(a[row]), "n": pa.array(n[row].astype(np.int32)), "place": pa.array(place[keep].astype(np.int32))})

    return run


def _bodies(b: pa.RecordBatch) -> pa.RecordBatch:
    """Key (n, a, b) and shingles of each row's set."""
    s, _, first = _sets(b["text"])
    blobs = [s[first[i]:first[i + 1]].tobytes() for i in range(b.num_rows)]
    return pa.RecordBatch.from_pydict({
        "n": pa.array(np.diff(first).astype(np.int64)), "a": signed(_sums(mix(s), first)), "b": signed(_sums(mix(s ^ U(0x5DEECE66D)), first)), "body": pa.array(blobs, pa.binary())})


def _linked(b: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for x, y in zip(b["x_body"], b["y_body"], strict=True):
        x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * both >= 80 * (len(x) + len(y) - both))
    return pa.RecordBatch.from_pydict({"u": b["x_id"], "v": b["y_id"]}).filter(pa.array(keep, pa.bool_()))


def _read_sets(pairs: DataFrame, docs: DataFrame, rows: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(id, tag, body) of the sets in `pairs`, besides those read already; an id may have several."""
    keys = pairs.select("x.*").unionByName(pairs.select("y.*")).distinct()
    if have is not None:
        keys = keys.join(have.select("id", "tag"), ["id", "tag"], "left_anti")
    keys = written(rows.join(keys.hint("merge"), ["id", "tag"], "left_semi"), "keys")
    if have is not None and keys.isEmpty():
        return have
    # the ids grow with the corpus: texts and ids meet by a shuffle at every size
    once = docs.select("doc_id", "text").join(keys.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    read = map_arrow(once, _bodies, "n long, a long, b long, body binary").dropDuplicates(["n", "a", "b"])
    bodies = written(read.join(keys.hint("merge"), ["n", "a", "b"]).select("id", "tag", "body"), "sets")
    return bodies if have is None else have.unionByName(bodies)


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (u, v: ids) among `pairs` (x, y: sets), by whole sets."""
    side = lambda x: bodies.select(F.struct("id", "tag").alias(x), F.col("body").alias(f"{x}_body"))
    full = pairs.join(side("x"), "x").join(side("y"), "y")
    return map_arrow(full.select(F.col("x.id").alias("x_id"), F.col("y.id").alias("y_id"), "x_body", "y_body"), _linked, "u long, v long", column="x_body")


def _pairs(x: str, y: str) -> list[Column]:
    u, v = (F.struct(f"{side}.id", f"{side}.tag") for side in (x, y))
    return [F.least(u, v).alias("x"), F.greatest(u, v).alias("y")]


def _may(x: str, y: str) -> Column:
    """What sizes and places allow: the pair's first common column is at these places."""
    m, n = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = 1 + F.least(m - F.col(f"{x}.place") - 1, n - F.col(f"{y}.place") - 1)
    return (5 * F.least(m, n) >= 4 * F.greatest(m, n)) & (most >= least_overlap(m, n))


def _blocks(cells: DataFrame) -> DataFrame:
    """(g, n, place, n2, place2): which blocks of a column are multiplied. A block is its cells of one size and place;
    two blocks whose sizes and places rule a pair out, or that lie in one component, are left out as a whole."""
    block = cells.groupBy("g", "n", "place").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    one = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))
    met = block.alias("x").join(block.alias("y"), "g").filter(_may("x", "y") & ~one)
    return met.select("g", "x.n", "x.place", F.col("y.n").alias("n2"), F.col("y.place").alias("place2"))


def _product(cells: DataFrame) -> DataFrame:
    """Entries (x, y) of the product between components, block by block; lower components first."""
    left = cells.join(_blocks(cells), ["g", "n", "place"])
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.n2") == F.col("y.n")) & (F.col("x.place2") == F.col("y.place")) & (F.col("x.component") < F.col("y.component"))
    return left.alias("x").join(cells.alias("y"), on)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set and the smallest id it reaches by links."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = written(docs.mapInArrow(_measure, "doc_id long, n long, a long, b long, chunk int, sketch binary"), "sizes")
    levels = spark.sparkContext.broadcast(_levels(measured))                 # SLOTS bytes
    sizes = measured.filter(F.col("chunk").isNull()).select("doc_id", "n", "a", "b")
    # equal sets are one row of the matrix, named after their smallest id and, if that names several sets, by `a` too (else 0, which packs)
    named = sizes.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    rows = written(named.groupBy("n", "a", "b").agg(F.min("doc_id").alias("id")), "rows")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id", F.lit(True).alias("twice"))
    rows = written(rows.join(twice, "id", "left").select("n", "a", "b", "id", F.when(F.col("twice"), F.col("a")).otherwise(F.lit(0).cast("long")).alias("tag")), "rows")

    cells = map_arrow(docs.filter(F.col("doc_id").isNotNull()), _prefixes(levels), "g long, a long, n int, place int")
    shared = cells.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
    active = cells.join(shared, "g").distinct()
    active = active.join(rows.select("n", "a", "id", "tag"), ["n", "a"]).select("g", "id", "tag", "n", "place")
    active = written(active, "columns")

    pivot = active.groupBy("g").agg(F.min(F.struct("place", "n", "id", "tag")).alias("p")).select("g", F.col("p.id").alias("id"), F.col("p.tag").alias("tag"), F.col("p.n").alias("n"), F.col("p.place").alias("place"))
    star = active.alias("x").join(pivot.alias("y"), "g").filter(((F.col("x.id") != F.col("y.id")) | (F.col("x.tag") != F.col("y.tag"))) & _may("x", "y"))
    star = written(star.select(*_pairs("x", "y")).distinct(), "pairs")
    bodies = _read_sets(star, docs, rows)
    links = written(_verified(star, bodies), "links")

    found = written(components(links), "components")
    of = active.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = of.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("g")
    of = written(of.join(several, "g"), "open-columns")
    across = _product(of)
    across = written(across.select(*_pairs("x", "y")).distinct().join(star, ["x", "y"], "left_anti"), "pairs")
    more = written(_verified(across, _read_sets(across, docs, rows, bodies)), "links")
    if not more.isEmpty():
        found = components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    # rows of one id with different sets belong together
    ids = named.join(rows, ["n", "a", "b"]).select("doc_id", "id")
    whole = ids.filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    found = components(whole.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    out = sizes.alias("s").join(found.alias("c"), F.col("s.doc_id") == F.col("c.node"), "left")
    return out.select("s.doc_id", F.col("s.n").alias("n_shingles"), F.coalesce("c.component", "s.doc_id").alias("component_id"))


#: The query's rows in DuckDB SQL, by all pairs of distinct sets that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) END AS sh FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS id, md5(array_to_string(sh, '|')) AS k, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY k),
g AS MATERIALIZED (SELECT id, len(sh) AS n, unnest(sh) AS x FROM c),
f AS (SELECT x FROM g GROUP BY x HAVING count(*) > 1),
h AS MATERIALIZED (SELECT g.* FROM g SEMI JOIN f ON g.x = f.x),
p AS (SELECT a.id AS u, b.id AS v FROM h a JOIN h b ON a.x = b.x AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(node, reach) AS (SELECT id, id FROM c UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u),
m AS (SELECT node, min(reach) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id
FROM s LEFT JOIN c ON md5(array_to_string(s.sh, '|')) = c.k AND len(s.sh) > 0 LEFT JOIN m ON c.id = m.node"""
