"""Gradient-boosted trees of several 0/1 labels in the same passes.

The method is that of `pyspark.ml.classification.GBTClassifier` (log loss, variance, histograms of bins), which fits one
label at a time over a cached object per row. Here the inputs are binned once and written as small integers, in blocks of
the rows of an Arrow batch (a value a row would cost more to hand to Python than to count), and every level of a round is
one pass over the blocks for all labels. A task adds up its blocks; the sums, labels x nodes x inputs x bins of them, are
added by Spark, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SUMS = "label int, key long, n long, s double"


def thresholds(values: np.ndarray, bins: int, expected: float) -> np.ndarray:
    """Candidate splits of an input, by the rule of pyspark.ml: all midpoints, or those nearest to equal shares.

    Rows that a sample lacks of the number expected count as zeros, as they do there.
    """
    v, n = np.unique(values[values != 0], return_counts=True)
    zeros = expected - n.sum()
    if zeros > np.finfo(float).eps * n.sum() * 100:
        at = np.searchsorted(v, 0.0)
        v, n = np.insert(v, at, 0.0), np.insert(n.astype(float), at, zeros)
    between, upto = (v[1:] + v[:-1]) / 2, np.cumsum(n)
    if len(between) < max(bins, 1):
        return between
    stride = target = expected / bins
    out = []
    for i, t in enumerate(between):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(t)
            target += stride
    return np.array(out)


def sampled(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The sample that pyspark.ml draws of the same rows with the same seed (`DataFrame.sample` draws others)."""
    spark = rows.sparkSession
    own = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, share, own), rows._jdf.schema()), spark)


def candidates(rows: DataFrame, n_inputs: int, n_labels: int, bins: int, seed: int) -> tuple[list[list[np.ndarray]], list[int]]:
    """Thresholds by set and input, and the set of each label; labels that the same rows know share a set.

    As in pyspark.ml they come from about 10,000 of a label's rows (`bins` squared, if more), or from all where there are
    fewer; this only places the candidates, and every row is counted for every split.
    """
    inputs, labels = [f"x{i}" for i in range(n_inputs)], [f"y{i}" for i in range(n_labels)]
    known = rows.groupBy(*[F.col(c).isNotNull().alias(c) for c in labels]).count().collect()
    sets, met, of = [], {}, []
    for c in labels:
        same = tuple(r[c] for r in known)
        if same not in met:
            n, wanted = sum(r["count"] for r in known if r[c]), max(bins * bins, 10_000)
            own = rows.filter(F.col(c).isNotNull()).select(inputs)
            held = np.array([tuple(r) for r in (sampled(own, wanted / n, seed) if n > wanted else own).collect()], float).reshape(-1, n_inputs)
            met[same] = len(sets)
            sets.append([thresholds(held[:, f], min(bins, n), min(n, wanted)) for f in range(n_inputs)])
        of.append(met[same])
    return sets, of


UNKNOWN = 2


def _binned(sets: list[list[np.ndarray]], n_inputs: int, small: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block a batch: a line of each label, 0, 1 or `UNKNOWN`, and per set and input one of the number of thresholds below the value."""
    def run(source):
        for b in source:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            labels = [np.where(np.isnan(y), UNKNOWN, y) for y in cols[n_inputs:]]
            places = [np.searchsorted(t, x) for s in sets for t, x in zip(s, cols, strict=False)]
            yield pa.record_batch([pa.array([np.array(labels + places).astype(small).tobytes()], pa.binary())], names=["block"])

    return run


def _leaf(levels: list[list[tuple[int, int] | None]], binned: Sequence[np.ndarray]) -> np.ndarray:
    """Node of each row below the levels there are; rows of a node without a split go left."""
    at = np.zeros(len(binned[0]), np.uint8 if len(levels) <= 8 else np.int64)
    for splits in levels:
        right = np.zeros(len(at), bool)
        for j, split in enumerate(splits):
            if split is not None:
                right |= (at == j) & (binned[split[0]] > split[1])
        at = (at << 1) | right
    return at


def _sums(of: list[int], n_inputs: int, small: type, width: int, grown: list[list[tuple]], growing: list[list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows and residuals of each label by node, input and bin."""
    def run(source):
        size = width << len(growing[0])
        n, s = (np.zeros((len(of), n_inputs, size), t) for t in (np.int64, float))
        for block in (x.as_buffer() for b in source for x in b.column(0)):
            lines = np.frombuffer(block, small).reshape(len(of) + (max(of) + 1) * n_inputs, -1)
            for i, k in enumerate(of):
                first = len(of) + k * n_inputs
                y, binned = lines[i], lines[first:first + n_inputs]
                there = y != UNKNOWN
                if not there.all():
                    binned, y = binned[:, there], y[there]
                residual = sign = 2.0 * y - 1
                if grown[i]:
                    margin = sum(w * values[_leaf(levels, binned)] for w, levels, values in grown[i])
                    with np.errstate(over="ignore"):
                        residual = 4 * sign / (1 + np.exp(2 * sign * margin))
                node = _leaf(growing[i], binned).astype(np.intp) * width
                for f, x in enumerate(binned):
                    n[i, f] += np.bincount(node + x, minlength=size)
                    s[i, f] += np.bincount(node + x, residual, minlength=size)
        label, f, place = np.nonzero(n)
        if len(label):
            yield pa.record_batch([label.astype(np.int32), f * size + place, n[label, f, place], s[label, f, place]], names=["label", "key", "n", "s"])

    return run


ROUNDING = 1e-12


def best_split(n: np.ndarray, s: np.ndarray) -> tuple[tuple[int, int] | None, float, float]:
    """(input, bin) after which a node is split, if anything is gained, and the means of both sides. Sums by input and bin.

    Splits that differ by rounding alone are ties, taken by the first, so the order in which rows were added decides nothing.
    """
    all_n, all_s = n[0].sum(), s[0].sum()
    if not all_n:
        return None, 0.0, 0.0
    left_n, left_s = n.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
    right_n, right_s = all_n - left_n, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = np.where((left_n > 0) & (right_n > 0), left_s ** 2 / left_n + right_s ** 2 / right_n, 0.0)
    f, k = np.unravel_index((kept >= kept.max() * (1 - ROUNDING)).argmax(), kept.shape)
    if not kept[f, k] * (1 - ROUNDING) > all_s ** 2 / all_n:
        return None, float(all_s / all_n), float(all_s / all_n)
    return (int(f), int(k)), float(left_s[f, k] / left_n[f, k]), float(right_s[f, k] / right_n[f, k])


def boost(rows: DataFrame, features: Sequence[str], labels: Sequence[str], rounds: int, depth: int, bins: int, step: float, seed: int) -> list[list[tuple[float, tuple | float]]]:
    """Per label its (weight, tree), as `models.Trees` takes them. Rows must have all inputs; a label may be missing."""
    n_inputs = len(features)
    rows = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
                       *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)])
    sets, of = candidates(rows, n_inputs, len(labels), bins, seed)
    width = 1 + max(len(t) for s in sets for t in s)          # a sample larger than expected gives a few bins more
    small = np.uint8 if width <= 256 else np.int64
    binned = cut(rows.mapInArrow(_binned(sets, n_inputs, small), "block binary"))
    grown: list[list[tuple]] = [[] for _ in labels]
    for m in range(rounds):
        growing: list[list] = [[] for _ in labels]
        for level in range(depth):
            n, s = (np.zeros((len(labels), n_inputs * (width << level)), t) for t in (np.int64, float))
            added = binned.mapInArrow(_sums(of, n_inputs, small, width, grown, growing), SUMS).groupBy("label", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            for r in added.collect():
                n[r.label, r.key], s[r.label, r.key] = r.n, r.s
            shape = (len(labels), n_inputs, 1 << level, width)
            n, s = n.reshape(shape), s.reshape(shape)
            if not n.any(axis=(1, 2, 3)).all():
                raise ValueError(f"no row knows one of {', '.join(labels)}")
            found = [[best_split(n[i, :, j], s[i, :, j]) for j in range(1 << level)] for i in range(len(labels))]
            for i, nodes in enumerate(found):
                growing[i].append([split for split, _, _ in nodes])
        for i, nodes in enumerate(found):
            values = np.array([v for _, left, right in nodes for v in (left, right)])
            grown[i].append((step if m else 1.0, growing[i], values))

    def node(i, levels, values, level=0, j=0):
        if level == depth:
            return float(values[j])
        left = node(i, levels, values, level + 1, 2 * j)
        if levels[level][j] is None:
            return left
        f, k = levels[level][j]
        return (features[f], float(sets[of[i]][f][k]), left, node(i, levels, values, level + 1, 2 * j + 1))

    return [[(w, node(i, levels, values)) for w, levels, values in trees] for i, trees in enumerate(grown)]
