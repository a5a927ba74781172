"""Removal of repeated byte strings by minimiser anchors and fingerprints; prefix doubling was replaced by them.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere else. In a suffix
array such strings share a rank for that length. Ranks for growing lengths are what prefix
doubling finds: Spark groups positions by rank, those whose rank is theirs alone leave, and the
others are ranked anew with the rank further on. Here ranks are hashes of bytes, which a task takes from its
own text, so no round fetches ranks of other positions.

Ranking every byte would shuffle many times the corpus. The first round ranks sampled positions
only: of the `SEED`-byte strings inside each window of `LENGTH` bytes, the one with the least
hash is the window's anchor. Equal windows have equal anchors at equal places, so nothing is
lost, and neighbouring windows mostly share theirs: there is one run of windows for about
LENGTH - SEED bytes / 2.

1. Length `SEED`: runs are grouped by the rank of their anchor; a rank of one position only ends there.
2. Length of the run: runs are grouped by the rank of all bytes their windows cover; windows of
   runs that occur twice are settled, copies of long passages in whole runs.
3. Length `LENGTH`: where an anchor has several kinds of runs, one run of each kind sends its
   bytes to the anchor's group, which ranks their windows one by one. A group of very many kinds
   (one passage in a third of all documents, each time in other company) is split into parts;
   each part ranks its own windows, and the distinct ones of all parts are then ranked by Spark.

Ranks are 64 bits within the rank of the anchor, so two of them must agree by chance.

Rows: null and empty texts have no bytes; equal rows are repeats of each other; matches do not
cross documents but may lie in one; any id will do, null or repeated, as id and text together
name a document, and equal names have equal results. Added columns replace input columns of
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_key, without, written
from .grams import mix, prefix_sums, signed, spans, text_bytes

LENGTH = 200
SEED = 40
PIECE = 1 << 20
#: Kinds of runs of one anchor that a task compares at most, on average.
PART_RUNS = 20_000
U = np.uint64
LOW = U((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbouring ones, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~U(0), dtype=U)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of windows with one anchor: first window, number of windows, anchor (places in `raw`), row, rank of the
    anchor, rank of all bytes covered. Long texts are cut into pieces of windows, which only makes more runs."""
    out = []
    width = length - seed + 1
    last_window = np.repeat(off[1:] - length, np.diff(off)) if len(raw) else np.empty(0, np.int64)
    for a in range(0, max(len(raw) - length + 1, 0), PIECE):
        part = raw[a:a + PIECE + length - 1]
        n = len(part) - length + 1
        p = prefix_sums(part, 0)
        at = np.arange(len(part) - seed + 1)
        rank = spans(p, at, at + seed, 0)
        anchor = (_least((rank & ~LOW) | at.astype(U), width) & LOW).astype(np.int64)
        whole = np.arange(n) + a <= last_window[a:a + n]
        row = np.searchsorted(off, np.arange(n) + a, side="right") - 1
        new = np.ones(n, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        keep = whole[first]
        first, count = first[keep], count[keep]
        q = prefix_sums(part, 1)
        out.append((first + a, count, anchor[first] + a, row[first], rank[anchor[first]], spans(q, first, first + count + length - 1, 1)))
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, e, e.astype(U), e.astype(U)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _found(b: pa.RecordBatch):
    return runs(*text_bytes(b["text"]))


def _ranks(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": signed(_found(b)[4])})


def _rows(b: pa.RecordBatch) -> pa.RecordBatch:
    first, count, _, row, h, whole = _found(b)
    _, off = text_bytes(b["text"])
    at = pa.array(row)
    return pa.RecordBatch.from_pydict({"h": signed(h), "ra": signed(whole), "doc": b["doc"].take(at), "key": b["key"].take(at),
                                       "run": pa.array((first - off[row]) << 20 | count)})


def _bodies(b: pa.RecordBatch) -> pa.RecordBatch:
    """The bytes of the wanted runs of each text."""
    raw, off = text_bytes(b["text"])
    out = {c: [] for c in ("h", "part", "parts", "single", "doc", "key", "first", "body")}
    for i, wanted in enumerate(b["wanted"].to_pylist()):
        for w in wanted:
            first, count = w["run"] >> 20, w["run"] & 0xFFFFF
            for c in ("h", "part", "parts", "single"):
                out[c].append(w[c])
            out["first"].append(first)
            out["body"].append(raw[off[i] + first:off[i] + first + count + LENGTH - 1].tobytes())
            for c in ("doc", "key"):
                out[c].append(b[c][i].as_py())
    kinds = {"part": pa.int32(), "parts": pa.int32(), "single": pa.bool_(), "body": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


SHARED = "doc long, key long, first long, n long, h long, w long, single boolean"


def _compared(rows: pa.Table) -> pa.RecordBatch:
    """Runs of shared windows of the runs that are alone of their kind; and of groups in parts, every distinct window."""
    raw, off = text_bytes(rows["body"].combine_chunks().cast(pa.binary()))
    count = np.diff(off) - LENGTH + 1
    at_row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(at_row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[at_row] + inside
    w = spans(prefix_sums(raw, 1), at, at + LENGTH, 1)
    h = rows["h"].to_numpy().view(U)
    _, first, which, times = np.unique(mix(h[at_row] * U(0x9E3779B97F4A7C15) + w), return_index=True, return_inverse=True, return_counts=True)
    shared = times[which] > 1
    single = rows["single"].combine_chunks().to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(shared & single[at_row])
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (at_row[hit[1:]] != at_row[hit[:-1]])
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(hit)))
    start = hit[start]
    split = rows["parts"].to_numpy() > 1
    one = np.zeros(len(at_row), dtype=bool)
    one[first] = True
    more = np.flatnonzero(one & split[at_row])
    doc, key, lo = rows["doc"].combine_chunks(), rows["key"].combine_chunks(), rows["first"].to_numpy()
    take = np.concatenate([start, more])
    r = at_row[take]
    kind = np.arange(len(take)) < len(start)
    return pa.RecordBatch.from_pydict({
        "doc": doc.take(pa.array(r)), "key": key.take(pa.array(r)), "first": pa.array(lo[r] + inside[take]),
        "n": pa.array(np.concatenate([n, np.ones(len(more), np.int64)])), "h": pa.array(h[r].view(np.int64), mask=kind),
        "w": pa.array(w[take].view(np.int64), mask=kind), "single": pa.array(single[r] & ~shared[take], pa.bool_())})


def _groups(source):
    """`_compared` over whole groups, a few MB at a time; rows come sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in source:
        for a in range(0, b.num_rows, 4096):
            held.append(b.slice(a, 4096))
            rows = pa.Table.from_batches(held)
            if rows["body"].nbytes < 4 << 20:
                held = [rows.combine_chunks().to_batches()[0]]
                continue
            h, p = rows["h"].to_numpy(), rows["part"].to_numpy()
            cut = np.flatnonzero((h[1:] != h[:-1]) | (p[1:] != p[:-1]))
            if len(cut):
                yield _compared(rows.slice(0, int(cut[-1]) + 1))
                rows = rows.slice(int(cut[-1]) + 1)
            held = rows.combine_chunks().to_batches() if rows.num_rows else []
    if held and sum(x.num_rows for x in held):
        yield _compared(pa.Table.from_batches(held))


def _on(left: str, right: str):
    """One document: ids and texts equal, null ids too."""
    return F.col(f"{left}.doc").eqNullSafe(F.col(f"{right}.doc")) & (F.col(f"{left}.key") == F.col(f"{right}.key"))


def shared_windows(docs: DataFrame) -> DataFrame:
    """(doc, key, windows): for each document with repeated windows, runs (first, n) of them; one row a document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text")).alias("key"), "text")
    # written, so that both sides of the join are dealt anew and a rank in very many texts can be split
    several = map_arrow(named, _ranks, "h long", limit=PIECE).groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    several = written(several, "shared-ranks")
    rows = written(map_arrow(named, _rows, "h long, ra long, doc long, key long, run long", limit=PIECE).join(several, "h"), "runs")

    kinds = written(rows.groupBy("h", "ra").agg(F.count(F.lit(1)).alias("m"), F.first("doc").alias("doc"), F.first("key").alias("key"), F.first("run").alias("run")), "kinds")
    settled = rows.join(kinds.filter("m > 1").select("h", "ra"), ["h", "ra"]).select(
        "doc", "key", F.shiftright("run", 20).alias("first"), F.col("run").bitwiseAND(0xFFFFF).alias("n"))

    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h", F.ceil(F.col("kinds") / PART_RUNS).cast("int").alias("parts"))
    wanted = kinds.join(groups, "h").withColumn("part", F.pmod("ra", "parts").cast("int"))
    wanted = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("h", "part", "parts", (F.col("m") == 1).alias("single"), "run")).alias("wanted"))
    # the documents asked for grow with the corpus: they meet their texts by a shuffle at every size
    texts = named.alias("d").join(wanted.hint("merge").alias("w"), _on("d", "w")).select("d.doc", "d.key", "d.text", "w.wanted")
    bodies = map_arrow(texts, _bodies, "h long, part int, parts int, single boolean, doc long, key long, first long, body binary", limit=PIECE)
    bodies = bodies.repartition("h", "part").sortWithinPartitions("h", "part")
    found = written(bodies.mapInArrow(_groups, SHARED), "shared-windows")

    apart = found.filter(F.col("h").isNotNull())
    again = apart.groupBy("h", "w").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", "w")
    across = apart.filter("single").join(again, ["h", "w"]).select("doc", "key", "first", "n")
    every = settled.unionByName(found.filter(F.col("h").isNull()).select("doc", "key", "first", "n")).unionByName(across)
    return every.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "n")).alias("windows"))     # at most a text's own windows


def _cut(b: pa.RecordBatch) -> pa.RecordBatch:
    raw, off = text_bytes(b["__text"])
    size, removed, spans_, kept = np.diff(off), [], [], []
    for i, windows in enumerate(b["__windows"]):
        mine = raw[off[i]:off[i + 1]]
        if not windows.is_valid:
            removed.append(0)
            spans_.append(0)
            kept.append(mine.tobytes())
            continue
        w = windows.values
        start = w.field("first").to_numpy()
        end = start + w.field("n").to_numpy() + LENGTH - 1
        edge = np.zeros(len(mine) + 1, dtype=np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed.append(int(gone.sum()))
        spans_.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        kept.append(mine[~gone].tobytes())
    out = {c: b[c] for c in b.schema.names if c not in ("__text", "__windows")}
    return pa.RecordBatch.from_pydict({**out, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                                       "n_spans": pa.array(spans_, pa.int64()), "kept": pa.array(kept, pa.binary())})


def cut(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but `text`, and `n_bytes`, `n_removed`, `n_spans` (long) and `kept` (binary: the bytes that stay,
    which may split a character)."""
    docs = without(docs, "n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in docs.columns if c.lower() != "text"]
    windows = shared_windows(docs)
    named = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"), F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text")).alias("key"))
    joined = named.alias("d").join(windows.hint("merge").alias("w"), _on("d", "w"), "left").select(
        *[F.col(f"d.`{c}`") for c in keep], "d.__text", F.col("w.windows").alias("__windows"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return map_arrow(joined, _cut, ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept binary"]), column="__text", limit=PIECE)
