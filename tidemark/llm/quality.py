"""Text quality by a linear-chain conditional random field (CRF) over lines.

Every line of a text is good or bad. Its evidence is what kinds of characters follow each other in it,
how often it repeats a word at once, and the same of the line before and the line after; neighbouring labels lean on each other through a 2 x 2
table. Forward and backward messages give each line's marginal probability of being good; a text's score is
their mean weighted by length (bytes, and one for the line's end).

Trained on documents: all lines of a labelled document bear its label, each document weighs the same. Training reads
at most `FIT_ROWS` labelled documents and `FIT_LINES` lines of whole documents, chosen by a hash of the id, and learns in pieces of
`PIECE` lines; scoring reads every text whole, in bounded pieces of bytes, and
runs over its whole chain.

Rows: a null text is one empty line, as an empty one is; texts without labels of both kinds to learn from
all score 0.5; several labels of one id count as bad if one is; null ids learn nothing and are scored; repeated rows are
scored alike; a very long text takes memory in proportion to its own lines; columns of the input called
like a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, without, written

#: Labelled documents and lines the model is fitted on at most.
FIT_ROWS = 4_000
FIT_LINES = 60_000
#: Lines of one training chain; bytes whose pairs are counted at once.
PIECE = 64
BYTES = 1 << 16
GOOD = 0.7
STEPS, RATE, RIDGE = 250, 0.05, 2e-4

#: Kinds of characters; the last is the line feed.
KINDS = ("a-z", "A-Z", "0-9", "blank", ".!?", "other marks of prose", "other signs", "beyond ASCII", "line feed")
K = len(KINDS)
N_FEATURES = K * K + 5


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, dtype=np.int64)
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b".!?", b",;:'\"()-")):
        kind[list(chars)] = i
    kind[128:], kind[10] = 7, 8
    return kind


KIND = _kinds()
BLANK = (KIND == 3) | (KIND == 8)
#: Multipliers of the bytes of a word in its hash (odd numbers to the power of the place, modulo 2^64).
POWERS = np.cumprod(np.full(BYTES + 2, 6364136223846793005, dtype=np.uint64), dtype=np.uint64)


def _pieces(data: np.ndarray):
    """(first, last) of pieces of about BYTES: each begins where the one before ended, at a blank or line feed if there is one."""
    at = 0
    while at < len(data) - 1:
        end = min(at + BYTES, len(data) - 1)
        blank = np.flatnonzero(BLANK[data[at + 1:end + 1]])
        if len(blank):
            end = at + 1 + int(blank[-1])
        yield at, end
        at = end


def _repeats(piece: np.ndarray, line: np.ndarray, lines: int, before: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Words and words equal to the one before in their line, for each line; `before` is the hash of the word before the piece.

    `piece` begins at a boundary and ends with one; line[i] is the line of byte i + 1.
    """
    blank = BLANK[piece]
    blank[0] = blank[-1] = True
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(begin):
        return np.zeros(lines), np.zeros(lines), before if not line[-1] else 0
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    place = np.arange(len(piece)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(piece)]])))
    mixed = np.where(blank, 0, (piece.astype(np.uint64) + np.uint64(1)) * POWERS[place])
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    code = total[end] - total[begin]
    row = line[begin - 1]
    same = np.zeros(len(code), dtype=bool)
    same[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    same[0] = row[0] == 0 and int(code[0]) == before
    return np.bincount(row, minlength=lines).astype(float), np.bincount(row, weights=same, minlength=lines), int(code[-1]) if row[-1] == line[-1] else 0


def line_features(data: np.ndarray):
    """(features, bytes) of the lines of `data`, piece by piece; data begins and ends with a line feed.

    Features of a line: for each two kinds the root of the share of its neighbouring characters of these kinds (line
    feeds at both ends included); its length on a log scale; whether it is empty; the share of its words that repeat the word before,
    and the root of that; bytes a word on a log scale. A word of more than `BYTES` counts as several.
    """
    carry, before = np.zeros(K * K + 2), 0
    for at, end in _pieces(data):
        piece = data[at:end + 1]
        kind = KIND[piece]
        ends = piece[1:] == 10
        line = np.cumsum(ends) - ends
        done = int(ends.sum())
        pairs = np.bincount(line * (K * K) + kind[:-1] * K + kind[1:], minlength=(done + 1) * K * K).reshape(-1, K * K)
        words, same, before = _repeats(piece, line, done + 1, before)
        if ends[-1]:
            before = 0
        counts = np.column_stack([pairs, words, same])
        counts[0] += carry
        carry, counts = counts[done], counts[:done]
        if done:
            total = counts[:, :-2].sum(axis=1)
            words = np.maximum(counts[:, -2], 1)
            again = counts[:, -1] / words
            yield np.column_stack([np.sqrt(counts[:, :-2] / total[:, None]), np.log(total) / 8, total == 1, again, np.sqrt(again),
                                   np.log(total / words) / 4]).astype(np.float32), total - 1


def _joined(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch as lines one after another, and each text's number of lines."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
    return np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8), np.array([t.count(b"\n") + 1 for t in texts])


# ── the chain ───────────────────────────────────────────────────────────────


class Chains:
    """Chains of lines, run through side by side: line t of all chains that are so long at once."""

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.counts = counts[self.order]
        self.starts = (np.cumsum(counts) - counts)[self.order]
        self.length = int(self.counts[0]) if len(counts) else 0
        self.lines = int(counts.sum())
        self.active = np.searchsorted(-self.counts, -np.arange(1, self.length + 1), side="right")   # chains with a line t

    def at(self, t: int) -> np.ndarray:
        return self.starts[:self.active[t]] + t

    def messages(self, odds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Evidence, forward and backward messages of each line (n x 2: bad, good), each scaled to sum 1."""
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        seen = np.stack([1 - good, good], axis=1) + 1e-18
        step = np.exp(table)
        forward, backward = np.empty((self.lines, 2)), np.full((self.lines, 2), 0.5)
        for t in range(self.length):
            rows = self.at(t)
            m = seen[rows] if t == 0 else seen[rows] * (forward[rows - 1] @ step)
            forward[rows] = m / m.sum(axis=1, keepdims=True)
        for t in range(self.length - 1, 0, -1):
            rows = self.at(t)
            m = (seen[rows] * backward[rows]) @ step.T
            backward[rows - 1] = m / m.sum(axis=1, keepdims=True)
        return seen, forward, backward

    def marginals(self, odds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        _, forward, backward = self.messages(odds, table)
        m = forward * backward
        return m[:, 1] / m.sum(axis=1)


def _beside(counts: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line is the first, the last of its text."""
    first, last = np.zeros(lines, dtype=bool), np.zeros(lines, dtype=bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last[ends - 1] = True
    return first, last


@dataclass
class Model:
    """Weights (features + 1) x 3 of a line, the line before and the line after (the last row: whether it is there), and the table of neighbours."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES + 1, 3)))
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def odds(self, parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of each line from its three products (n x 3)."""
        first, last = _beside(counts, len(parts))
        parts = parts + self.weights[-1]
        before, after = np.roll(parts[:, 1], 1), np.roll(parts[:, 2], -1)
        return parts[:, 0] + np.where(first, 0, before) + np.where(last, 0, after)

    def lines(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good and bytes of each line, and lines of each text."""
        data, counts = _joined(b)
        parts, sizes = [], []
        for x, n in line_features(data):
            parts.append(x @ self.weights[:-1])
            sizes.append(n)
        return Chains(counts).marginals(self.odds(np.concatenate(parts), counts), self.table), np.concatenate(sizes), counts


def fit(x: np.ndarray, sizes: np.ndarray, counts: np.ndarray, good: np.ndarray) -> Model:
    """A model of lines `x` (n x features) of `sizes` in documents with `counts` lines and labels `good`.

    Gradient steps (Adam) push the marginals of lines and of neighbouring pairs to the label; a line weighs by its share
    of the document, as in the score, and documents weigh the same.
    """
    model = Model()
    if not len(good) or good.min() == good.max():
        return model
    n, d = len(x), x.shape[1] + 1
    first, last = _beside(counts, n)
    with_one = np.column_stack([x, np.ones(n)])
    before, after = np.roll(with_one, 1, axis=0), np.roll(with_one, -1, axis=0)
    before[first], after[last] = 0, 0
    whole = np.concatenate([with_one, before, after], axis=1)
    y = np.repeat(good, counts).astype(float)
    weight = sizes / np.repeat(np.add.reduceat(sizes, np.cumsum(counts) - counts), counts) / len(counts)
    pieces = np.array([min(PIECE, int(c) - at) for c in counts for at in range(0, int(c), PIECE)])
    chains = Chains(pieces)
    inside = np.ones(n, dtype=bool)
    inside[np.cumsum(pieces) - pieces] = False                    # lines with a line before them in their chain
    inside = np.flatnonzero(inside)
    theta, mean, square = np.zeros(3 * d + 4), np.zeros(3 * d + 4), np.zeros(3 * d + 4)
    for i in range(1, STEPS + 1):
        table = theta[3 * d:].reshape(2, 2)
        seen, forward, backward = chains.messages(whole @ theta[:3 * d], table)
        m = forward * backward
        grad = np.zeros_like(theta)
        grad[:3 * d] = whole.T @ (weight * (y - m[:, 1] / m.sum(axis=1)))
        both = forward[inside - 1][:, :, None] * np.exp(table) * (seen[inside] * backward[inside])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        expected = (weight[inside][:, None, None] * both).sum(axis=0)
        alike = np.bincount(y[inside].astype(int), weights=weight[inside], minlength=2)
        grad[3 * d:] = (np.diag(alike) - expected).ravel()
        grad -= RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad ** 2
        theta = theta + RATE * (mean / (1 - 0.9 ** i)) / (np.sqrt(square / (1 - 0.99 ** i)) + 1e-8)
    return Model(theta[:3 * d].reshape(3, d).T.copy(), theta[3 * d:].reshape(2, 2).copy())


# ── Spark ───────────────────────────────────────────────────────────────────


def trained(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, lines: int = FIT_LINES) -> Model:
    """A model from `rows` labelled documents and `lines` lines at most; labels has doc_id and quality. Equal texts of an id count once."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")       # `rows` ids at most
    sample = sample.dropDuplicates(["doc_id", "text"]).withColumn("lines", F.size(F.split("text", "\n")).cast("long"))
    sample = written(sample, "quality-sample")
    so_far = F.sum("lines").over(Window.orderBy("h", "doc_id", F.xxhash64("text")))                                    # over the sample alone
    sample = sample.withColumn("upto", so_far).filter(F.col("upto") <= lines)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, counts = _joined(b)
        x = np.concatenate([np.column_stack([f, n + 1]) for f, n in line_features(data)]).astype(np.float32)
        cut = np.split(x, np.cumsum(counts)[:-1])
        return pa.RecordBatch.from_pydict({"upto": b["upto"], "quality": b["quality"], "x": pa.array([c.tobytes() for c in cut], pa.binary())})

    got = sorted(map_arrow(sample.select("upto", "quality", "text"), run, "upto long, quality int, x binary").collect())
    if not got:
        return Model()
    x = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES + 1) for r in got]
    lines_of = np.concatenate(x)
    return fit(lines_of[:, :-1], lines_of[:, -1].astype(float), np.array([len(f) for f in x]), np.array([r["quality"] for r in got]))


def _kept(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str], str]:
    inner = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], "text")
    return rows, inner, ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(keep, inner, strict=True))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or only the columns in `keep`) with `score` (double, 0 to 1), `predicted` (int, 1 from 0.7 on), `n_lines` and
    `n_bad_lines` (long: lines rather bad than good)."""
    docs = without(docs, "score", "predicted", "n_lines", "n_bad_lines")
    keep = docs.columns if keep is None else keep
    rows, inner, schema = _kept(docs, keep)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        good, size, counts = model.lines(b)
        starts = np.cumsum(counts) - counts
        weight = size + 1
        score = np.clip(np.add.reduceat(weight * good, starts) / np.add.reduceat(weight, starts), 0, 1)
        bad = np.add.reduceat((good < 0.5).astype(np.int64), starts)
        return pa.RecordBatch.from_pydict({**{c: b[c] for c in inner}, "score": score, "predicted": (score >= GOOD).astype(np.int32),
                                           "n_lines": counts.astype(np.int64), "n_bad_lines": bad})

    made = map_arrow(rows, run, ", ".join(filter(None, [schema, "score double, predicted int, n_lines long, n_bad_lines long"])))
    return made.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], "score", "predicted", "n_lines", "n_bad_lines")


def labelled_lines(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """One row per line: the columns in `keep`, `line` (int, from 0), `n_bytes` (long), `good` (double: its marginal) and `is_good` (boolean)."""
    rows, inner, schema = _kept(docs, keep)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        good, size, counts = model.lines(b)
        at = pa.array(np.repeat(np.arange(len(counts)), counts))
        line = np.arange(len(good)) - np.repeat(np.cumsum(counts) - counts, counts)
        return pa.RecordBatch.from_pydict({**{c: b[c].take(at) for c in inner}, "line": line.astype(np.int32), "n_bytes": size.astype(np.int64),
                                           "good": good, "is_good": good >= 0.5})

    made = map_arrow(rows, run, ", ".join(filter(None, [schema, "line int, n_bytes long, good double, is_good boolean"])))
    return made.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], "line", "n_bytes", "good", "is_good")
