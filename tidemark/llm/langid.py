"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams, most frequent first, of a language's training texts or
of one document. A document's distance to a language is the sum, over its own list, of how far
out of place each n-gram stands in the language's list; one that isn't listed costs the length of
the list. The nearest language is predicted. N-grams are runs of one to three bytes of the
lower-cased letters (UTF-8), other characters being one space.

Training counts cover all training documents: tasks count n-grams of their rows, Spark adds them
up and keeps each language's list; the lists (languages x `SIZE` rows) go to all tasks.

Rows: null texts and texts without a letter are `und` with score 0, and so is every text if no language was
learned; a null language teaches nothing; equal distances go to the first language by code point.
Added columns replace input columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, map_arrow, without
from .grams import text_bytes

SIZE = 400
ORDERS = (1, 2, 3)
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters, with one space for every run of anything else."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def codes(raw: np.ndarray) -> np.ndarray:
    """Every n-gram as a number, its bytes in order; a lone space is none."""
    wide = raw.astype(np.uint32)
    out, run = [], None
    for n in ORDERS:
        run = wide if run is None else (run[:-1] << np.uint32(8)) | wide[n - 1:]
        out.append(run[run != 32] if n == 1 else run)
    return np.concatenate(out)


def _merge(held, codes_, counts):
    if held is None:
        return codes_, counts
    both = np.concatenate([held[0], codes_])
    u, at = np.unique(both, return_inverse=True)
    return u, np.bincount(at, np.concatenate([held[1], counts])).astype(np.int64)


def _within(found: np.ndarray) -> np.ndarray:
    """N-grams of single texts: where two meet stand two spaces, which no text has inside."""
    return found[(found >> np.uint32(8) != 0x2020) & (found & np.uint32(0xFFFF) != 0x2020)]


def _counts(source):
    """N-gram counts of each language over a whole partition; rows out: distinct n-grams, whatever rows came in."""
    held: dict[str, tuple] = {}
    for b in batches(source, "__letters", 1 << 20):
        raw, off = text_bytes(b["__letters"])
        by: dict[str, list] = {}
        for i, lang in enumerate(b["__lang"].to_pylist()):
            by.setdefault(lang, []).append(raw[off[i]:off[i + 1]])
        for lang, parts in by.items():
            held[lang] = _merge(held.get(lang), *np.unique(_within(codes(np.concatenate(parts))), return_counts=True))
    for lang, (c, n) in held.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c)), "code": pa.array(c.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def profiles(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, code, place): each language's `size` most frequent n-grams; ties go to the lower code."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("__lang"), letters(F.col("text")).alias("__letters"))
    n = rows.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("place") <= size).select("lang", "code", "place")


def _predictor(rows: list, size: int):
    langs = sorted({r["lang"] for r in rows})
    listed = np.array(sorted({r["code"] for r in rows}), dtype=np.uint32)
    place = np.full((len(listed) + 1, len(langs)), -1, dtype=np.int32)
    for r in rows:
        place[np.searchsorted(listed, r["code"]), langs.index(r["lang"])] = r["place"] - 1

    def predict(raw: np.ndarray) -> tuple[str, float]:
        c, n = np.unique(codes(raw), return_counts=True)
        top = np.lexsort((c, -n))[:size]
        mine = c[top]
        at = np.searchsorted(listed, mine)
        at[(at == len(listed)) | (listed[np.minimum(at, len(listed) - 1)] != mine)] = len(listed)
        theirs = place[at]
        away = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(np.argmin(away))
        return langs[best], float(1 - away[best] / (size * len(mine)))

    return predict if langs else None


def identify(docs: DataFrame, training: DataFrame, size: int = SIZE) -> DataFrame:
    """All columns of `docs`, `lang_pred` (string) and `score` (double, 0 to 1: 1 - distance / largest distance)."""
    docs = without(docs, "lang_pred", "score")
    predict = _predictor(profiles(training, size).collect(), size)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_bytes(b["__letters"])
        got = [predict(raw[off[i]:off[i + 1]]) if predict and off[i + 1] - off[i] > 2 else (UNKNOWN, 0.0) for i in range(b.num_rows)]
        out = {c: b[c] for c in b.schema.names if c != "__letters"}
        return pa.RecordBatch.from_pydict({**out, "lang_pred": pa.array([x[0] for x in got], pa.string()), "score": pa.array([x[1] for x in got], pa.float64())})

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns] + ["lang_pred string", "score double"])
    return map_arrow(docs.withColumn("__letters", letters(F.col("text"))), run, schema, column="__letters")
