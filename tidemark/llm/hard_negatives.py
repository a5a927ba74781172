"""Hard negatives by inner product, found in an R-tree packed by sort-tile-recursive (STR).

Vectors are integers (`floor(SCALE * x)`), so scores are exact. Spark packs the top of the tree: rows
are range-partitioned by their first coordinate into slabs and each slab by its second, ties broken by a hash,
so equal vectors spread; each range is a tile of about `TILE_ROWS` rows. A tile is packed further
by the coordinates after those into leaves of `LEAF` rows, each node with the bounding box of what it
holds. A box and an anchor give an interval of inner products, coordinate by coordinate:
max(a*lo, a*hi) above and min(a*lo, a*hi) below.

The anchors of a tile form a block and ask together. A block goes to every tile; there a queue holds nodes by the
largest score any of its queries may still find in them. A query leaves a node out if its interval lies outside the
query's score window or strictly below the query's k-th score so far (equal scores may still win
by their id). Two visits: the first finds each anchor's positives, its k-th score begun in its own tile;
the second finds the negatives in the window each positive gives. What a block finds in a tile is one packed row;
packed rows of a block are merged two by two in one pass over sorted rows. So a task holds one tile and one block, and
the work is anchors x rows at most; vectors without structure prune little, clustered ones much.

Rows: those with a null id, label or vector, or a null or non-finite component, take no part; empty
vectors do, and score 0; shorter vectors count as padded with zeros; equal rows (id, label, vector) count once; rows of one id
that differ are rows of their own, each an anchor if the id is one, and no row of the anchor's id is its partner; equal scores go to the
smaller id, then to the smaller label. Scores beyond a long are held at its limits; components are exact up to 2^53.
An anchor without positives, or a positive without negatives, returns no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256
TILE_ROWS = 4096
LEAF = 64
FAN = 8
POSITIVES = 5
NEGATIVES = 3
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ── one tile ────────────────────────────────────────────────────────────────


def packed(vectors: np.ndarray, size: int, axis: int = 0) -> list[np.ndarray]:
    """Sort-tile-recursive: rows of each leaf. Slabs along one coordinate, each cut along the next."""
    parts = [np.arange(len(vectors))]
    while len(parts[0]) > size and vectors.shape[1]:
        slabs = FAN if len(parts[0]) > size * FAN else -(-len(parts[0]) // size)
        parts = [x for p in parts for x in np.array_split(p[np.argsort(vectors[p, axis % vectors.shape[1]], kind="stable")], slabs) if len(x)]
        axis += 1
    return parts if vectors.shape[1] else np.array_split(parts[0], -(-len(vectors) // size))


def scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of v (whole numbers held in doubles) as longs."""
    if not a.shape[1] or not len(a) or not len(v):
        return np.zeros((len(a), len(v)), dtype=np.int64)
    if np.abs(a).max() * np.abs(v).max() * a.shape[1] < EXACT:
        return (a @ v.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in row] for row in x], dtype=object)
    return np.clip(whole(a) @ whole(v).T, LEAST, MOST).astype(np.int64)


class Tile:
    """Rows of one tile and the tree over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        order = lambda p: p[np.lexsort((labels[p], ids[p]))]
        self.leaves = [order(p) for p in packed(vectors, LEAF, 2)]
        # children of each node; nodes below len(leaves) are leaves, the last one is the root
        self.children: list[list[int]] = [[] for _ in self.leaves]
        level = list(range(len(self.leaves)))
        while len(level) > 1:
            groups = [level[i:i + FAN] for i in range(0, len(level), FAN)]
            level = list(range(len(self.children), len(self.children) + len(groups)))
            self.children.extend(groups)
        lo, hi = [vectors[p].min(axis=0) for p in self.leaves], [vectors[p].max(axis=0) for p in self.leaves]
        for c in self.children[len(self.leaves):]:
            lo.append(np.min([lo[i] for i in c], axis=0))
            hi.append(np.max([hi[i] for i in c], axis=0))
        self.lo, self.hi = np.array(lo), np.array(hi)

    def intervals(self, a: np.ndarray, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each row of a with anything in each node."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        lo, hi = self.lo[nodes], self.hi[nodes]
        if a.size and np.abs(a).max() * max(np.abs(self.lo).max(), np.abs(self.hi).max()) * a.shape[1] >= EXACT:
            return np.full((len(a), len(nodes)), -np.inf), np.full((len(a), len(nodes)), np.inf)
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T

    def visit(self, asked: Asked, same: bool) -> Found:
        """The best k rows of each query: of its anchor's label (`same`) or another, in its window, not of its anchor's id."""
        found = Found.none(len(asked.ids), asked.k)
        root = len(self.children) - 1
        below, above = self.intervals(asked.vectors, [root])
        queue = [(0.0, root, np.arange(len(asked.ids)), below[:, 0], above[:, 0])]
        while queue:
            _, node, who, below, above = heapq.heappop(queue)
            kth = np.maximum(found.kth(), asked.kth)[who]
            keep = (above >= asked.low[who]) & (below <= asked.high[who]) & (np.minimum(above, asked.high[who]) >= kth)
            who = who[keep]
            if not len(who):
                continue
            if node >= len(self.leaves):
                nodes = self.children[node]
                below, above = self.intervals(asked.vectors[who], nodes)
                first = np.minimum(above, asked.high[who][:, None]).max(axis=0)
                for i, c in enumerate(nodes):
                    heapq.heappush(queue, (-float(first[i]), c, who, below[:, i], above[:, i]))
                continue
            rows = self.leaves[node]
            got = scores(asked.vectors[who], self.vectors[rows])
            fits = (self.labels[rows][None, :] == asked.labels[who][:, None]) == same
            fits &= (self.ids[rows][None, :] != asked.ids[who][:, None]) & (got >= asked.low[who][:, None]) & (got <= asked.high[who][:, None])
            fits &= got >= np.maximum(found.kth(), asked.kth)[who][:, None]
            some = np.flatnonzero(fits.any(axis=1))
            if len(some):
                shape = (len(some), len(rows))
                found.take(who[some], np.where(fits[some], got[some], LEAST), np.broadcast_to(self.ids[rows], shape),
                           np.broadcast_to(self.labels[rows], shape), fits[some])
        return found


class Asked:
    """Queries: anchor's id, label and vector, score window, and a score that at least k rows are known to reach."""

    def __init__(self, ids, labels, vectors, low, high, kth, k):
        self.ids, self.labels, self.vectors, self.low, self.high, self.kth, self.k = ids, labels, vectors, low, high, kth, k


class Found:
    """The best k rows of each query: score, id, label, and whether the place is taken."""

    def __init__(self, score, ids, labels, taken):
        self.score, self.ids, self.labels, self.taken = score, ids, labels, taken

    @classmethod
    def none(cls, n: int, k: int) -> Found:
        return cls(np.full((n, k), LEAST), np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=bool))

    def kth(self) -> np.ndarray:
        return np.where(self.taken[:, -1], self.score[:, -1], LEAST) if self.taken.shape[1] else np.zeros(len(self.taken), dtype=np.int64)

    def take(self, who, score, ids, labels, taken) -> None:
        """Merges candidates of the queries `who` (in any order) into their places."""
        k = self.score.shape[1]
        score, ids = np.concatenate([self.score[who], score], axis=1), np.concatenate([self.ids[who], ids], axis=1)
        labels, taken = np.concatenate([self.labels[who], labels], axis=1), np.concatenate([self.taken[who], taken], axis=1)
        best = np.lexsort((labels, ids, ~score, ~taken), axis=1)[:, :k]          # ~x turns a long's order without overflow
        pick = lambda x: np.take_along_axis(x, best, axis=1)
        self.score[who], self.ids[who], self.labels[who], self.taken[who] = pick(score), pick(ids), pick(labels), pick(taken)

    def pack(self) -> bytes:
        return np.stack([self.score, self.ids, self.labels, self.taken.astype(np.int64)]).tobytes()

    @classmethod
    def unpack(cls, data: bytes, k: int) -> Found:
        score, ids, labels, taken = np.frombuffer(data, dtype=np.int64).reshape(4, -1, k).copy()
        return cls(score, ids, labels, taken.astype(bool))


def _tile(r: dict) -> Tile:
    return Tile(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), _vectors(r))


def _vectors(r: dict) -> np.ndarray:
    return np.frombuffer(r["vectors"], np.float64).reshape(r["rows"], r["width"])


def _positives(r: dict) -> Asked:
    """The rows of a block as queries for their positives."""
    n = r["rows"]
    return Asked(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), _vectors(r), np.full(n, LEAST), np.full(n, MOST),
                 np.frombuffer(r["kth"], np.int64) if r["kth"] else np.full(n, LEAST), POSITIVES)


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores s with low * score <= 100 * s <= high * score, as the least and the largest whole s."""
    at = [(-((-low * int(s)) // 100), (high * int(s)) // 100) for s in score]
    return tuple(np.array([x[i] for x in at], dtype=np.int64) for i in (0, 1))


def _negatives(r: dict, low: int, high: int) -> tuple[Asked, np.ndarray, np.ndarray]:
    """A query for each row and positive of a block; the positives' ids and scores."""
    asked, got = _positives(r), Found.unpack(r["found"], POSITIVES)
    at, place = np.nonzero(got.taken)
    score = got.score[at, place]
    least, most = window(score, low, high)
    return Asked(asked.ids[at], asked.labels[at], asked.vectors[at], least, most, np.full(len(at), LEAST), NEGATIVES), got.ids[at, place], score


# ── Spark ───────────────────────────────────────────────────────────────────


def whole(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, v: whole numbers as doubles) of the rows that take part, equal rows once."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() gives a long; a double beyond 2^53 is whole already
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) * scale >= EXACT, x.cast("double") * scale).otherwise(
        F.floor(x.cast("double") * float(scale)).cast("double")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).distinct()


def tiles(rows: DataFrame, anchor: Column, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of (id, label, v): the tiles, and the blocks of rows that ask (`anchor`, a condition on `id`), one packed row each."""
    at = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    width, count = at["w"] or 0, max(1, -(-at["n"] // tile_rows))
    axis = lambda i: F.coalesce(F.try_element_at("v", F.lit(i)), F.lit(0.0))
    rows = rows.withColumns({"ask": F.coalesce(anchor, F.lit(False)), "h": F.xxhash64("id", "label", "v"), "x": axis(1), "y": axis(2)})
    slabs = rows.repartitionByRange(max(1, round(count ** 0.5)), "x", "h").withColumn("slab", F.spark_partition_id())
    dealt = slabs.repartitionByRange(count, "slab", "y", "h").select(F.spark_partition_id().alias("tile"), "id", "label", "v", "ask")

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one range: a tile, and its rows that ask with the k-th score they have within it."""
        held = [b for b in source if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        vectors, col = np.zeros((t.num_rows, width)), t["v"].combine_chunks()
        sizes = col.value_lengths().to_numpy().astype(np.int64)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        vectors[np.repeat(np.arange(len(sizes)), sizes), inner] = col.flatten().to_numpy(zero_copy_only=False)
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        r = _packed(t["tile"][0].as_py(), False, ids, labels, vectors)
        yield _batch(r)
        ask = t["ask"].to_numpy()
        if ask.any():
            block = _packed(r["tile"], True, ids[ask], labels[ask], vectors[ask])
            yield _batch(block | {"kth": _tile(r).visit(_positives(block), True).kth().tobytes()})

    made = written(dealt.mapInArrow(pack, PACKED), "tiles")
    return made.filter("not asks"), made.filter("asks").withColumnRenamed("tile", "block")


PACKED = "tile int, asks boolean, rows int, width int, ids binary, labels binary, vectors binary, kth binary"
CELL = "block int, found binary"


def _packed(tile: int, asks: bool, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    return {"tile": tile, "asks": asks, "rows": len(ids), "width": vectors.shape[1], "ids": ids.astype(np.int64).tobytes(),
            "labels": labels.astype(np.int64).tobytes(), "vectors": vectors.tobytes(), "kth": b""}


def _batch(r: dict) -> pa.RecordBatch:
    kind = {bool: pa.bool_(), int: pa.int32(), bytes: pa.binary()}
    return pa.RecordBatch.from_pylist([r], schema=pa.schema([(c, kind[type(v)]) for c, v in r.items()]))


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: packed rows are large, so no batch of them is turned into Python at once."""
    for b in source:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _cells(trees: DataFrame, blocks: DataFrame, ask, same: bool) -> DataFrame:
    """(block, found) of every block in every tile; `ask` gives the queries of a block.

    The stated query set against all rows, in blocks: a task reads a tile, and the blocks pass by it.
    """
    last = trees.agg(F.max("tile").alias("t")).first()["t"]
    if last is None:
        return trees.sparkSession.createDataFrame([], CELL)
    columns = ["rows", "width", "ids", "labels", "vectors"]
    more = [c for c in blocks.columns if c in ("kth", "found")]
    left = trees.select("tile", F.lit(-1).alias("block"), *columns, *[F.lit(None).cast("binary").alias(c) for c in more])
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tile"), "block", *columns, *more)
    dealt = left.unionByName(right).repartitionByRange(last + 1, "tile").sortWithinPartitions("tile", "block")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = at = None
        for r in _rows(source):
            if r["block"] < 0:
                tree, at = _tile(r), r["tile"]
            elif at == r["tile"]:                              # a range without rows made no tile
                yield _batch({"block": r["block"], "found": tree.visit(ask(r), same).pack()})

    return dealt.mapInArrow(run, CELL)


def _merged(cells: DataFrame, k: int) -> DataFrame:
    """(block, found): all packed rows of a block merged, two at a time."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for r in _rows(source):
            got = Found.unpack(r["found"], k)
            if r["block"] == at:
                held.take(np.arange(len(got.score)), got.score, got.ids, got.labels, got.taken)
                continue
            if held is not None:
                yield _batch({"block": at, "found": held.pack()})
            at, held = r["block"], got
        if held is not None:
            yield _batch({"block": at, "found": held.pack()})

    return cells.repartition("block").sortWithinPartitions("block").mapInArrow(run, CELL)


def mine(embeddings: DataFrame, anchor: Column, tile_rows: int = TILE_ROWS, low: int = 50, high: int = 95) -> DataFrame:
    """Negatives of each anchor and positive: rows of another label with `low` to `high` % of the positive's score.

    `embeddings` has vec_id, label and embedding; `anchor` is a condition on `id`. Columns: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.
    """
    trees, blocks = tiles(whole(embeddings), anchor, tile_rows)
    found = written(_merged(_cells(trees, blocks, _positives, True), POSITIVES), "positives")
    blocks = blocks.drop("kth").withColumn("kth", F.lit(b"")).join(found, "block")
    ended = _merged(_cells(trees, blocks, lambda r: _negatives(r, low, high)[0], False), NEGATIVES)

    def result(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(source):
            asked, ids, score = _negatives(r, low, high)
            got = Found.unpack(r["ended"], NEGATIVES)
            at, rank = np.nonzero(got.taken)
            cols = [asked.ids[at], ids[at], (rank + 1).astype(np.int32), got.ids[at, rank], score[at], got.score[at, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in RESULT.split(", ")])

    return blocks.join(ended.withColumnRenamed("found", "ended"), "block").mapInArrow(result, RESULT)


SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, a.v, a.label = b.label AS same, b.id, b.label, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END::BIGINT AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 50 = 0),
positives AS (
  SELECT anchor_id, v, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, v ORDER BY score DESC, id, label) <= 5),
found AS (
  SELECT p.anchor_id, positive_id, positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.v, positive_id, positive_score ORDER BY n.score DESC, n.id, n.label)::INTEGER AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND p.v = n.v AND NOT n.same
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3"""
