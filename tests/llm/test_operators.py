"""Each corpus operator on awkward rows, against brute force or SQL; spark comes from tests/conftest.py."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import cuckoo, decontamination, jaccard, langid, licenses, lines, mixing, neighbours, queries, repeats, sharding, toxicity
from tidemark.llm.components import components
from tools.compare import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abdeghilmnorstu") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empty and blank texts, copies, near copies, repeated rows, a long text, a hot source and a hot line."""
    RNG.seed(8)
    base = [prose(60) for _ in range(8)]
    texts = [*base, base[0], base[0], base[1].upper(), base[2] + " tail", None, "", " \n\t ", "one two", "one  TWO", prose(4000)]
    near = base[3].split()
    texts += [" ".join([*near[:i], "xx", *near[i + 1:]]) for i in (0, 58, 59)]
    texts += [f"A line that very many of the texts hold\n{prose(12)}\r\n  a LINE that very many of the texts hold " for _ in range(9)]
    texts += [prose(20) + " " + base[4] + " " + prose(15), "äöü ñ " + base[5][:230] + " ça", "x" * 700, "ab" * 300]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src0", "src1", None, "ß"][i % 5], 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[6], "en", "src0", 2), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    frame = pd.DataFrame(corpus(), columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("documents", frame)
    return con


def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


# ── sharding ────────────────────────────────────────────────────────────────


def test_shards_hold_all_rows_and_differ_by_one(spark, docs):
    clash = docs.withColumn("Shard", F.lit("mine"))
    one = sharding.shard(clash, 5, bucket_bytes=3000).toPandas()
    assert len(one) == docs.count() and Counter(map(repr, one.text)) == Counter(repr(r.text) for r in docs.collect())
    sizes = one.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in one.groupby("shard"))
    again = sharding.shard(docs.repartition(7), 5, bucket_bytes=3000).toPandas()
    at = lambda p: sorted(map(repr, zip(p.doc_id, p.text, p.shard, p.slot, strict=True)))
    assert at(one) == at(again)
    assert sharding.shard(empty(spark), 5).count() == 0


# ── mixing ──────────────────────────────────────────────────────────────────


def test_mix_against_sql(docs, duck):
    got = mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    want = duck.sql(mixing.SQL).df()
    assert compare(got.astype({"doc_id": "Int64"}), want.astype({"doc_id": "Int64"})) == "ok"


def test_mix_repeats_rows_and_keeps_within_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 3)                   # many slices: the same result
    sliced = mixing.plan(docs).select("doc_id", "size", "target", "taken").toPandas()
    monkeypatch.undo()
    whole = mixing.plan(docs).select("doc_id", "size", "target", "taken").toPandas()
    assert sorted(map(repr, sliced.itertuples(index=False))) == sorted(map(repr, whole.itertuples(index=False)))
    out = mixing.mix(docs.withColumn("taken", F.lit(1)))
    assert out.columns[-1] == "taken"
    assert out.select(F.sum(F.size(F.array_compact(F.array(F.lit(1)))))).first()[0] == int((whole.taken / whole["size"].clip(lower=1)).sum())
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# ── lines ───────────────────────────────────────────────────────────────────


def test_lines_against_sql(spark, docs, duck, monkeypatch):
    known = docs.filter("doc_id is not null")
    want = duck.sql(lines.SQL.replace("FROM documents", "FROM documents WHERE doc_id IS NOT NULL")).df()
    for rows in (lines.SHARD_ROWS, 4):                              # one shard in one part, many shards in parts
        monkeypatch.setattr(lines, "SHARD_ROWS", rows)
        out = lines.dedup(known).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
        assert compare(out.toPandas(), want) == "ok"
    assert lines.dedup(docs.withColumn("N_lines", F.lit(0))).count() == docs.count()
    assert lines.dedup(empty(spark)).count() == 0


def test_line_state_is_reversible(docs):
    text = lambda d: sorted(map(repr, d.select("doc_id", "text", "n_dropped").collect()))
    known = docs.filter("doc_id is not null")
    half, rest = known.filter("doc_id < 25"), known.filter("doc_id >= 25")
    first = lines.insert(lines.empty(docs.sparkSession, 3), half)
    both = lines.insert(first, rest)
    assert text(lines.deduplicated(both, known)) == text(lines.dedup(known))
    back = lines.remove(both, rest.select("doc_id"))
    assert text(lines.deduplicated(back, half)) == text(lines.deduplicated(first, half))
    table = lambda s: sorted(map(repr, s.shards.filter("kind = 0").select("shard", "a", "b", "refs", "top").collect()))
    assert table(back) == table(first)


def test_cuckoo_filter_keeps_and_forgets():
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 20_000)
    f = cuckoo.Cuckoo.of(keys)
    assert f.contains(keys).all()
    assert cuckoo.Cuckoo.load(f.dump()).contains(keys + 1).mean() < 0.01
    f.delete(keys[:15_000])
    assert f.contains(keys[15_000:]).all() and f.contains(keys[:15_000]).mean() < 0.01


# ── Jaccard join ────────────────────────────────────────────────────────────


def brute_components(rows):
    def grams(t):
        w = words(t)
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def test_jaccard_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    # a chain of near copies, each linked with the next only, and many copies of one text
    chain = prose(120).split()
    for i in range(100, 130):
        chain = [*chain[:3], WORDS[i], *chain[3:-1]]
        rows.append((i, " ".join(chain)))
    rows += [(i, "the same few words in each of them") for i in range(200, 240)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("g", F.lit(1))
    got = {tuple(r) for r in jaccard.join(d).collect()}
    assert got == brute_components(rows)


def test_jaccard_without_ids_or_rows(spark, docs):
    out = jaccard.join(docs).toPandas()
    assert len(out) == docs.count()
    assert out[out.doc_id.isna()].component_id.isna().all()
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_of_one_id_with_several_texts(spark):
    """Near copies of each of them reach the id, whichever text comes first."""
    rng = random.Random(9)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(5, a), (5, b), (5, c), (8, a + " tail"), (9, b + " tail"), (10, c + " tail"), (11, prose(60, rng))]
    for order in (rows, rows[::-1]):
        got = jaccard.join(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (8, 5), (9, 5), (10, 5), (11, 11)} and len(got) == 7


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "u long, v long")
    got = dict(components(links).collect())
    assert set(got.values()) == {0, 100} and len(got) == 63


# ── repeated bytes ──────────────────────────────────────────────────────────


def brute_repeats(texts, length=repeats.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("part", "piece"), [(20_000, 1 << 20), (2, 500)])
def test_repeats_against_brute_force(docs, monkeypatch, part, piece):
    """Also with groups in parts and texts in pieces, which must not change anything."""
    monkeypatch.setattr(repeats, "PART_RUNS", part)
    monkeypatch.setattr(repeats, "PIECE", piece)
    got = repeats.cut(docs.withColumn("kept", F.lit("mine")))
    got = [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()]
    assert sorted(got) == sorted(brute_repeats([r.text for r in docs.collect()]))


def test_repeats_of_nothing(spark):
    assert repeats.cut(empty(spark)).count() == 0


# ── decontamination ─────────────────────────────────────────────────────────


def test_decontamination_against_brute_force(spark, docs):
    base = [r.text for r in docs.collect() if r.text and 50 < len(r.text.split()) < 70]
    items = [(1, base[0][:200]), (2, " ".join(base[1].split()[5:45])), (3, None), (4, ""), (5, "one two"), (6, prose(30)), (7, "Völlig unbekannt, ganz und gar nicht da!")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def grams(w):
        k = min(5, len(w))
        return {tuple(w[i:i + k]): sum(len(x.encode()) for x in w[i:i + k]) for i in range(len(w) - k + 1)} if w else {}

    want = set()
    for r in docs.collect():
        w = norm(r.text)
        for i, t in items:
            g = grams(norm(t))
            n = len(norm(t))
            for a in range(len(w) - n + 1) if n else ():
                k = min(5, n)
                h = {tuple(w[j:j + k]): sum(len(x.encode()) for x in w[j:j + k]) for j in range(a, a + n - k + 1)}
                common = sum(v for x, v in g.items() if x in h)
                if common >= 0.8 * (sum(g.values()) + sum(h.values()) - common):
                    want.add((r.doc_id, i))
    found = decontamination.matches(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 3
    small = decontamination.matches(docs, bench, block_bytes=200)      # the benchmark in blocks
    assert {(r.doc_id, r.item_id) for r in small.collect()} == want
    assert decontamination.clean(docs, bench).count() == sum(all((r.doc_id, i) not in want for i, _ in items) for r in docs.collect())
    assert decontamination.matches(empty(spark), bench).count() == 0
    assert decontamination.matches(docs, bench.filter("false")).count() == 0


# ── nearest neighbours ──────────────────────────────────────────────────────


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = neighbours.hilbert(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1).max() == 1


def test_neighbours_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    rows += [(i, [1.0] * 8) for i in range(150, 260)] + [(260, None), (261, []), (262, [0.0] * 8), (263, [1.0, None] + [0.0] * 6), (264, [float("nan")] * 8), (265, [2.0, 1.0]), (0, rows[0][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = neighbours.nearest(v, F.col("vec_id") % 50 == 0).toPandas()
    good = [(i, np.array(x + [0.0] * (8 - len(x)))) for i, x in rows if x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    for q in {i for i, _ in good if i % 50 == 0}:
        mine = next(x for i, x in good if i == q)
        score = {i: float(x @ mine / np.sqrt(x @ x) / np.sqrt(mine @ mine)) for i, x in good if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want
    assert neighbours.nearest(v.filter("vec_id > 259 and vec_id < 265"), F.lit(True)).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32)).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(v, F.col("vec_id") % 200 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::200] @ u.T
    s[np.arange(30), np.arange(0, 6000, 200)] = -2
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(b) & set(got[got.query_id == 200 * i].vec_id)) / 5 for i, b in enumerate(best)]) >= 0.9


def test_neighbours_recall_at_one_reach(spark):
    """More than 12,500 vectors, and the same reach for few and for many."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(13_000, 32)).astype("float32")
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(v, F.col("vec_id") % 500 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::500] @ u.T
    s[np.arange(26), np.arange(0, 13_000, 500)] = -2
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(b) & set(got[got.query_id == 500 * i].vec_id)) / 5 for i, b in enumerate(best)]) >= 0.9
    few = v.filter("vec_id < 1000")
    rows = lambda **o: sorted(map(tuple, neighbours.nearest(few, F.col("vec_id") % 10 == 0, curves=1, **o).collect()))
    assert rows() == rows(reach=neighbours.REACH) != rows(reach=neighbours.CELLS)


def test_neighbours_of_repeated_ids_and_rows(spark):
    """Many equal rows, a query id with many near vectors of its own, a candidate id with many near ones."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    near = lambda e: [float(x) for x in base + e * rng.normal(size=8)]
    rows = [(7, [float(x) for x in base])] * 25 + [(i, [float(x) for x in base]) for i in (8, 9)]
    rows += [(50, near(1e-4)) for _ in range(12)] + [(3, near(1e-3)) for _ in range(40)] + [(i, near(0.3)) for i in range(20, 40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(v, F.col("vec_id") == 50).toPandas().sort_values("rank")
    cosine = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    score = {i: max(cosine(x, y) for j, x in rows if j == i for k, y in rows if k == 50) for i in {i for i, _ in rows} - {50}}
    assert got.vec_id.tolist() == sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]


def test_neighbours_of_one_key_in_parts(spark, monkeypatch):
    """Vectors that share one key on every curve: no part holds many more rows than it should, and nothing is lost."""
    rng = np.random.default_rng(6)
    x = np.ones(8) + 1e-6 * rng.normal(size=(600, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK", (5, 7))
    top = neighbours._top

    def watched(k, width):
        fn = top(k, width)

        def run(vectors, queries):
            assert max(vectors.num_rows, queries.num_rows) <= 80
            return fn(vectors, queries)

        return run

    monkeypatch.setattr(neighbours, "_top", watched)
    got = neighbours.nearest(v, F.col("vec_id") % 50 == 0, curves=2).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 600, 50):
        gap = ((u - u[q]) ** 2).sum(1)
        gap[q] = 9
        want = got[got.query_id == q].vec_id.to_numpy()
        assert len(set(want)) == 5 and np.abs(gap[want] - np.sort(gap)[:5]).max() < 1e-14


# ── learned scores ──────────────────────────────────────────────────────────


def test_toxicity_grammar_reads_clauses():
    g = toxicity.Grammar()
    weigh = lambda *read: g.clause(list(read), list(range(len(read))), [1.0] * len(read))
    assert weigh("target", "insult") > weigh("insult") > weigh("negation", "insult") > 0
    assert weigh("insult") > weigh("report", "insult")
    assert weigh("threat") == 0 and weigh("threat", "target") > 0
    assert g.clause(["negation", "insult"], [0, 7], [1.0, 1.0]) == weigh("insult")      # out of the negation's reach


def test_toxicity_on_awkward_rows(spark, docs):
    bad = [(500 + i, prose(30) + " you idiot. " + prose(9) + " you are stupid trash!", "en", "s", 1) for i in range(12)]
    more = docs.unionByName(spark.createDataFrame(bad, DOC)).withColumn("SCORE", F.lit("mine"))
    labels = spark.createDataFrame([(i, 0) for i in range(30)] + [(500 + i, 1) for i in range(8)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.scored(more, toxicity.trained(more, labels)).toPandas()
    assert len(out) == docs.count() + 12 and out.score.between(0, 1).all()
    assert (out[out.doc_id >= 500].predicted == 1).all() and (out[~(out.doc_id >= 500)].predicted == 0).all()
    blank = toxicity.trained(docs, labels.filter("false"))
    assert blank.weights == toxicity.PRIOR and toxicity.scored(empty(spark), blank).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95


def test_language_on_awkward_rows(spark, docs):
    out = langid.identify(docs.withColumn("lang_pred", F.lit("mine")), docs).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    blank = out[out.text.fillna("").str.strip() == ""]
    assert len(blank) and (blank.lang_pred == "und").all() and set(out.lang_pred) <= {"en", "de", "und"}
    assert set(langid.identify(docs, docs.filter("false")).toPandas().lang_pred) == {"und"}
    assert langid.identify(empty(spark), docs).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_profiles_count_all_training_text(spark):
    d = spark.createDataFrame([(1, "ab ab", "x"), (2, "ab", "x"), (3, "Ä1b", "y"), (4, "zz", None)], "doc_id long, text string, lang string")
    got = {(r.lang, r.place): r.code for r in langid.profiles(d, 3).collect()}
    assert got["x", 1] == ord("a") and got["x", 2] == ord("b") and {k[0] for k in got} == {"x", "y"}


# ── licences ────────────────────────────────────────────────────────────────


def test_licences_against_sql(spark, duck):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "junk line\nLicensed under CC BY-NC 4.0.\nmore"), (3, "This Work is licensed under the GNU General Public License, version 3."), (4, None), (5, ""),
            (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (6, "no licence here"), (7, "software " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("mine"))
    out = licenses.scan(d).select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_license_sentences"), F.array_join("licenses", ",").alias("licenses"))
    duck.register("lic", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert compare(out.toPandas(), duck.sql(licenses.sql("lic")).df()) == "ok"
    got = {(r.doc_id, r.licenses) for r in out.collect()}
    assert {(1, "MIT"), (2, "CC-BY-NC-4.0"), (3, "GPL-3.0-notice"), (6, "Apache-2.0,MIT-notice"), (6, "")} <= got
    assert licenses.scan(empty(spark)).count() == 0


def test_licence_sentences_are_normal_and_hold_a_cue():
    texts = [t for ts in licenses.SENTENCES.values() for t in ts]
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", t) and re.search(licenses.CUE.replace("(?i)", ""), t) for t in texts)
    assert {s.rstrip("?") for _, rule in licenses.RULES for s in rule} == set(licenses.SENTENCES)


# ── queries and pipeline ────────────────────────────────────────────────────


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()) == "ok"


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on its own input: what goes and what stays."""
    bad = [(500 + i, prose(30) + " you idiot. " + prose(9) + " you are stupid trash!", "en", "s", 1) for i in range(10)]
    rows = [r for r in corpus() if r[0] is not None] + bad
    folder = str(tmp_path)
    spark.createDataFrame([(i, 0) for i in range(30)] + [(500 + i, 1) for i in range(10)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = next(t for i, t, *_ in rows if i == 7)
    spark.createDataFrame([(1, " ".join(item.split()[3:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.createDataFrame(rows, DOC)
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, kept, folder).checkpoint()
    assert ids(kept) == sorted(i for i, *_ in rows if i < 500)
    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept = stages[1](spark, kept, folder).checkpoint()
    first = {i for i, n, c in brute_components(before) if i == c}
    assert ids(kept) == sorted(first)
    before = ids(kept)
    kept = stages[2](spark, kept, folder).checkpoint()
    assert ids(kept) == [i for i in before if i != 7]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    plan = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.plan(kept).collect()}
    kept = stages[3](spark, kept, folder).checkpoint()
    assert Counter(ids(kept)) == Counter({i: n for i, n in plan.items() if n})
    last = stages[4](spark, kept, folder)
    assert ids(last) == ids(kept) and last.columns[-2:] == ["shard", "slot"]


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    """Colliding ids: each text without a near copy stays, of equal rows the first by the other columns."""
    rng = random.Random(10)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, "", "en", "s", 1), (9, b + " tail", "en", "s", 1), (6, c, "en", "t", 2), (6, c, "en", "r", 2), (None, a, "en", "s", 1)]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, DOC).coalesce(1), "").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [r for r in rows if r[0] != 9 and r[3] != "t"]))
