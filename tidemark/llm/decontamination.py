"""Benchmark decontamination by SimHash over item-sized windows.

Items and documents are words (lower case, split at white space and ASCII signs) and five-word
shingles; a shingle weighs its bytes, and an item of fewer words is one shingle. Every window of
as many words as an item gets a 64-bit SimHash of its weighted shingles. A multi-index finds the
items within `RADIUS` of a window: fingerprints that differ in at most 23 of 64 bits differ in at
most two bits in one of eight bytes, so looking up each byte with up to two bits changed misses
none. Candidates are verified by the exact weighted Jaccard similarity of their shingles.

Only windows holding a shingle of some item are fingerprinted: any other has similarity 0.

The benchmark is a stated query set: it goes over the documents in blocks of at most about
`BLOCK_BYTES` of text, one pass over the documents per block.

Rows: null and empty texts and items match nothing; equal rows are found each; an empty benchmark
or corpus gives no rows. Columns besides ids and texts are not looked at.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .grams import LOWER, prefix_sums, shingles, spans, text_bytes, word_spans

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCK_BYTES = 4 << 20
FOUND = "item_id long, similarity double, first_word long, n_words long, distance int"
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
U = np.uint64


def _words(column: pa.Array):
    """Hash, row and size in bytes of every word."""
    raw, off = text_bytes(column)
    raw = LOWER[raw]
    start, end, row = word_spans(raw, off, SIGNS)
    h = spans(prefix_sums(raw, 0), start, end, 0) if len(start) else np.empty(0, U)
    return h, row, end - start


def _weights(size: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the k words from each word on."""
    total = np.concatenate([[0], np.cumsum(size)])
    return (total[k:] - total[:-k]).astype(np.float64)


def fingerprints(h: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every run of `length` shingles: a bit is set where the weights of shingles with it are the larger half."""
    signs = ((h[:, None] >> np.arange(64, dtype=U)) & U(1)).astype(np.float64) * 2 - 1
    total = np.concatenate([np.zeros((1, 64)), np.cumsum(signs * w[:, None], axis=0)])
    on = (total[length:] - total[:-length]) > 0
    return np.packbits(on, axis=1, bitorder="little")


class Items:
    """One block of the benchmark, with its inverted shingles and the multi-index of its fingerprints."""

    def __init__(self, rows: list[tuple[int, str]]):
        h, row, size = _words(pa.array([t for _, t in rows], pa.string()))
        self.ids, self.length, self.sets, prints, self.keys = [], [], [], [], {}
        for i, (item, _) in enumerate(rows):
            mine = row == i
            n = int(mine.sum())
            if not n:
                continue
            k = min(WORDS, n)
            s = shingles(h[mine], np.zeros(n, np.int64), 1, k)[0]
            w = _weights(size[mine], k)
            at = len(self.ids)
            self.ids.append(item)
            self.length.append(n)
            self.sets.append(dict(zip(s.tolist(), w.tolist(), strict=True)))
            prints.append(fingerprints(s, w, len(s))[0])
            for x in s.tolist():
                self.keys.setdefault((k, x), set()).add(at)
        self.prints = np.array(prints, dtype=np.uint8).reshape(len(self.ids), 8)
        self.length = np.array(self.length, dtype=np.int64)
        self.widths = sorted({k for k, _ in self.keys})
        self.sorted = {k: np.sort(np.array([x for j, x in self.keys if j == k], dtype=U)) for k in self.widths}

    @cached_property
    def index(self) -> np.ndarray:
        """[byte number, byte value, item]: the item's byte differs in two bits at most."""
        values = np.arange(256, dtype=np.uint8)
        return np.stack([BITS[values[:, None] ^ self.prints[None, :, b]] <= RADIUS // 8 for b in range(8)])

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of all pairs within the radius."""
        may = np.zeros((len(prints), len(items)), dtype=bool)
        for b in range(8):
            may |= self.index[b][prints[:, b]][:, items]
        window, which = np.nonzero(may)
        away = BITS[prints[window] ^ self.prints[items[which]]].sum(1)
        close = away <= RADIUS
        return window[close], items[which[close]], away[close]

    def similarity(self, item: int, h: np.ndarray, w: np.ndarray) -> float:
        mine, theirs = self.sets[item], dict(zip(h.tolist(), w.tolist(), strict=True))
        common = sum(v for x, v in mine.items() if x in theirs)
        return common / (sum(mine.values()) + sum(theirs.values()) - common)


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True))


def _search(items: Items, h: np.ndarray, size: np.ndarray, hits: dict[int, np.ndarray]) -> list[tuple]:
    """Best window of each item found in one document; hits: places of known shingles by shingle width."""
    best: dict[int, tuple] = {}
    for k, places in hits.items():
        s = shingles(h, np.zeros(len(h), np.int64), 1, k)[0]
        w = _weights(size, k)
        near: dict[int, list] = {}
        for p in places.tolist():
            for i in items.keys.get((k, int(s[p])), ()):
                near.setdefault(int(items.length[i]), []).append((p, i))
        for n, found in near.items():
            length = n - k + 1
            which = np.array(sorted({i for _, i in found}))
            starts = np.unique(np.concatenate([np.arange(max(0, p - length + 1), min(p, len(s) - length) + 1) for p, _ in found]))
            for a, z in _runs(starts) if len(starts) else []:
                prints = fingerprints(s[a:z + length], w[a:z + length], length)
                for j, i, away in zip(*items.near(prints, which), strict=True):
                    at = a + int(j)
                    sim = items.similarity(int(i), s[at:at + length], w[at:at + length])
                    if sim >= SIMILARITY and (i not in best or (-sim, at) < (-best[i][1], best[i][2])):
                        best[int(i)] = (items.ids[int(i)], sim, at, n, int(away))
    return list(best.values())


def _finder(rows: list[tuple[int, str]]):
    """What a task does with a slice of documents."""
    held: dict[str, Items] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held:
            held["items"] = Items(rows)
        items = held["items"]
        h, row, size = _words(batch["text"])
        hits: dict[int, dict[int, np.ndarray]] = {}
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for k in items.widths:
            s, at_row, at = shingles(h, row, batch.num_rows, k)
            long = first[at_row + 1] - first[at_row] >= k
            known = items.sorted[k]
            place = np.minimum(np.searchsorted(known, s), len(known) - 1)
            hit = np.flatnonzero((known[place] == s) & long)
            for r in np.unique(at_row[hit]).tolist():
                mine = hit[at_row[hit] == r]
                hits.setdefault(r, {})[k] = at[mine]
        out = [(r, *x) for r, places in hits.items() for x in _search(items, h[first[r]:first[r + 1]], size[first[r]:first[r + 1]], places)]
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["item_id", "similarity", "first_word", "n_words", "distance"]
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(pa.array(cols[0])), "key": batch["key"].take(pa.array(cols[0])),
                                           **{c: pa.array(v, t) for c, v, t in zip(names, cols[1:], kinds, strict=True)}})

    return run


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key of the text, item_id, similarity, first_word, n_words, distance): the best window of each item in each document."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", F.lower("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))).alias("key"), F.lower("text").alias("text"))
    found = None
    for b in range(n):
        block = [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]
        part = map_arrow(rows, _finder(block), "doc_id long, key long, " + FOUND) if block else None
        found = part if found is None else found.unionByName(part) if part is not None else found
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id long, key long, " + FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key")).distinct()
    key = F.xxhash64(F.lit("text"), F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__doc"]) & (key == bad["__key"]), "left_anti")
