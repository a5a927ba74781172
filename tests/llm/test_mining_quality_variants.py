"""Hard negatives, quality and spelling variants against brute force on awkward rows; spark comes from tests/conftest.py."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, quality, queries, variants
from tools.compare import compare

EMB = "vec_id long, embedding array<float>, label int"
TEXTS = "doc_id long, text string"


# ── hard negatives ──────────────────────────────────────────────────────────


def brute_negatives(rows, step, low=50, high=95):
    rows = {(i, l, tuple(math.floor(256 * x) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, l, v in rows:
        if i % step:
            continue
        others = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for s, j, _ in [o for o in others if o[2] == l][:5]:
            fits = [o for o in others if o[2] != l and low * -s <= 100 * -o[0] <= high * -s][:3]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fits, 1)]
    return Counter(out)


def vectors(n, width, seed, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, width))
    v = (centre[rng.integers(0, 4, n)] + 0.5 * rng.normal(size=(n, width))).astype(np.float32) * 0.3
    return [(int(i), [float(x) for x in r], int(k)) for i, r, k in zip(range(n), v, rng.integers(0, labels, n))]


def mined(spark, rows, step, **kw):
    d = spark.createDataFrame(rows, EMB).withColumn("rank", F.lit("mine")).withColumn("id", F.lit(0)).withColumn("tile", F.lit(0))
    return Counter(map(tuple, hard_negatives.mine(d, F.col("id") % step == 0, **kw).collect()))


@pytest.mark.parametrize("tile_rows", [37, 4096])
def test_negatives_against_brute_force(spark, tile_rows):
    rows = vectors(400, 6, 3)
    rows += [(7, rows[7][1], rows[7][2]), (8, rows[9][1], 1), (None, [1.0] * 6, 1), (20, None, 1), (21, [1.0] * 6, None), (22, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
             (23, [float("nan")] * 6, 1), (24, [float("inf")] * 6, 1), (1000, [], 1), (1010, [0.5, 0.25], 1), (1020, [0.0] * 6, 0)]
    rows += [(2000 + i, rows[5][1], i % 3) for i in range(150)]                     # one vector many times: ties of score
    assert mined(spark, rows, 10, tile_rows=tile_rows) == brute_negatives(rows, 10)


def test_negatives_of_one_hot_vector_and_of_few(spark):
    hot = [(i, [0.5, 0.5], i % 2) for i in range(300)]
    assert mined(spark, hot, 50, tile_rows=40) == brute_negatives(hot, 50)
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.6, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [-0.7, 0.0], 2)]
    assert mined(spark, few, 1) == brute_negatives(few, 1)
    assert mined(spark, [], 1) == Counter() and mined(spark, [(1, None, None)], 1) == Counter()


def test_negatives_of_huge_components_are_exact(spark):
    rows = [(i, [float(2 ** 30 + i * 64), float(3 * i)], i % 2) for i in range(12)]
    assert mined(spark, rows, 3) == brute_negatives(rows, 3)
    held = mined(spark, [(0, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [1.0, 1.0], 2)], 1)
    assert all(k[4] == (1 << 63) - 1 for k in held)


def test_boxes_hold_the_scores_of_their_rows():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(500, 5)))
    tree = hard_negatives.Tile(np.arange(500), np.zeros(500, dtype=np.int64), v)
    assert sorted(np.concatenate(tree.leaves)) == list(range(500)) and max(map(len, tree.leaves)) <= hard_negatives.LEAF
    a = np.floor(256 * rng.normal(size=(20, 5)))
    low, high = tree.intervals(a, list(range(len(tree.leaves))))
    for k, p in enumerate(tree.leaves):
        s = hard_negatives.scores(a, v[p])
        assert (s >= low[:, [k]]).all() and (s <= high[:, [k]]).all()
    assert (low > -1e7).all()


def test_negatives_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert compare(queries.QUERIES["op11_hard_negatives"](spark, sf).toPandas(), con.sql(queries.ORACLES["op11_hard_negatives"]).df()) == "ok"


# ── quality ─────────────────────────────────────────────────────────────────


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(2)
    counts = np.array([1, 5, 3])
    odds, table = rng.normal(size=9) * 2, rng.normal(size=(2, 2))
    got = quality.Chains(counts).marginals(odds, table)
    at = 0
    for c in counts:
        total, good = 0.0, np.zeros(c)
        for y in itertools.product((0, 1), repeat=int(c)):
            w = math.exp(sum(o * k for o, k in zip(odds[at:at + c], y)) + sum(table[a, b] for a, b in itertools.pairwise(y)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(got[at:at + c], good / total)
        at += c


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_line_features_do_not_depend_on_pieces(monkeypatch, size):
    rng = random.Random(4)
    text = "\n".join(" ".join(rng.choice(["aa", "aa", "B!", "ünd", "7"]) for _ in range(rng.randint(0, 9))) for _ in range(60)).encode()
    data = np.frombuffer(b"\n" + text + b"\n", dtype=np.uint8)
    whole = list(quality.line_features(data))
    monkeypatch.setattr(quality, "BYTES", size)
    pieces = list(quality.line_features(data))
    assert np.allclose(np.concatenate([f for f, _ in pieces]), np.concatenate([f for f, _ in whole]))
    lines = text.split(b"\n")
    assert [int(x) for _, n in pieces for x in n] == [len(x) for x in lines]
    again = np.concatenate([f for f, _ in pieces])[:, -3]
    for x, a in zip(lines, again):
        w = x.split()
        assert a == pytest.approx(sum(p == q for p, q in itertools.pairwise(w)) / max(len(w), 1), abs=1e-6)


def good_and_bad(n):
    rng = random.Random(6)
    words = ["the", "of", "harbour", "letters", "and", "river", "stone", "with", "morning", "paper"]
    line = lambda: " ".join(rng.choice(words) for _ in range(12)).capitalize() + "."
    bad = [lambda: line().upper().replace(" ", "!! "), lambda: " | ".join(line().split()), lambda: " ".join([rng.choice(words)] * 12)]
    out = []
    for i in range(n):
        k = rng.choice(bad) if i % 4 == 0 else line
        out.append((i, "\n".join(k() for _ in range(rng.randint(1, 9))), i % 4 != 0))
    return out


def test_quality_on_awkward_rows(spark):
    rows = good_and_bad(200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, rows[0][1]), (901, None), (902, ""), (903, "\n\n"), (904, rows[1][1] + "\n" + "word " * 60_000), rows[3][:2]], TEXTS)
    docs = docs.withColumn("score", F.lit("mine")).withColumn("N_LINES", F.lit(1)).withColumn("c0", F.array(F.lit(1)))
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows if i < 120] + [(4, 1), (5, None), (None, 0), (6, 7), (9999, 0)], "doc_id long, quality int")
    model = quality.trained(docs, labels)
    out = quality.scored(docs, model)
    assert out.columns == ["doc_id", "text", "c0", "score", "predicted", "n_lines", "n_bad_lines"]
    got = out.collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.n_lines == (r.text or "").count("\n") + 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == g for i, _, g in rows if i >= 120]) > 0.95
    assert by[None].score == by[0].score and by[901].score == by[902].score
    lines = quality.labelled_lines(docs, model, ["doc_id"])
    assert lines.count() == sum(r.n_lines for r in got)
    mean = lines.filter("doc_id = 8").agg((F.sum((F.col("n_bytes") + 1) * F.col("good")) / F.sum(F.col("n_bytes") + 1)).alias("m")).first().m
    assert mean == pytest.approx(by[8].score)
    assert lines.filter("doc_id = 8 and not is_good").count() == by[8].n_bad_lines
    assert quality.scored(spark.createDataFrame([], TEXTS), model).count() == 0


def test_quality_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], TEXTS)
    for labels in ([], [(1, 1)], [(None, 0)]):
        model = quality.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}


def test_quality_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op12_quality"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.85
    rows = queries.QUERIES["op12_quality"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# ── spelling variants ───────────────────────────────────────────────────────


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k + 1:]


def words_of(rng, n):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    hot = ["common" + "".join(rng.choice("abcdefgh") for _ in range(4)) + "ending" for _ in range(n)]
    doubled = ["a" * k for k in range(1, 9)] + ["ab" * k for k in range(1, 6)] + ["b" + "ab" * k for k in range(1, 6)] + ["x" * 3000, "x" * 2999 + "y", "x" * 3001]
    return sorted({*base, *hot, *doubled})


@pytest.mark.parametrize("group", [30, 100_000])
def test_near_words_against_brute_force(spark, group):
    """Also with groups so small that windows are cut again and again."""
    words = words_of(random.Random(7), 150)
    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.near) for r in variants.near(vocabulary, group).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_scan_reuses_prefixes_and_small_chunks(spark, monkeypatch):
    words = words_of(random.Random(8), 60)
    monkeypatch.setattr(variants, "CHUNK", 10)
    rows = [(len(w), w) for w in words if 4 <= len(w) <= 9]
    vocabulary = spark.createDataFrame([(w, n) for n, w in rows], "word string, n long")
    got = {(r.word, r.n, r.near, r.near_n) for r in variants.near(vocabulary).collect()}
    assert got == {(a, m, b, n) for m, a in rows for n, b in rows if one_edit(a, b)}


def brute_variants(rows, least=6, times=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= times}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n) if n else []


def test_variants_against_brute_force_and_sql(spark):
    rng = random.Random(9)
    stems = ["harbour", "harbours", "harbor", "Señora", "señora", "senora", "ÀÉÎõü×÷", "àéîõü×÷", "letters", "lettres", "lettters", "paper", "papers", "papper", "morning", "letterss", "lettersss"]
    weights = [900, 150, 20, 300, 10, 40, 60, 5, 700, 100, 15, 800, 120, 20, 300, 60, 8]
    texts = [" ".join(rng.choices(stems, weights, k=60)) for _ in range(300)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None), (700, ""), (701, "harbour" * 9_000), (702, "x1harbour_Morning\nHARBOUR")]
    d = spark.createDataFrame(rows, TEXTS).withColumn("word", F.lit("mine")).withColumn("n", F.lit(3))
    made = variants.grouped(variants.vocabulary(variants.typed(variants.runs(d, variants.LEAST)), variants.TIMES))
    got = sorted(tuple(r) for r in made.select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert sorted(map(repr, got)) == sorted(map(repr, brute_variants(rows)))
    assert any(w != f != r for w, f, r, *_ in got if f) and any(f is None for _, f, *_ in got)
    duck = duckdb.connect()
    duck.register("docs", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert compare(made.toPandas(), duck.sql(variants.sql("docs")).df()) == "ok"
    none = spark.createDataFrame([], TEXTS)
    assert variants.grouped(variants.vocabulary(variants.typed(variants.runs(none, 6)), 5)).count() == 0


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("a", "w3"), ("b", "z")], "word string, form string")
    got = dict(tuple(r) for r in variants.roots(forms).collect())
    assert got == {**{f"w{i}": "w21" for i in range(21)}, "a": "w21", "b": "z"}
