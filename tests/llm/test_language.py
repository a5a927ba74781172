"""Language profiles and distances against a plain computation, and independence of how rows are dealt."""

import random
import re
from collections import Counter

import regex

from tidemark.llm import langid

ROWS = "doc_id long, text string, lang string"


def grams(text):
    """Counts of runs of one to three bytes, a lone space left out."""
    raw = (" " + regex.sub(r"[^\p{L}]+", " ", text.lower()).strip() + " ").encode()
    found = Counter(raw[i:i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1))
    return Counter({g: c for g, c in found.items() if g != b" " and b"  " not in g})


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], int.from_bytes(x[0], "big")))][:size]


def brute(docs, training, size):
    by = {}
    for _, text, lang in training:
        if text is not None and lang is not None:
            by.setdefault(lang, Counter()).update(grams(text))
    lists = {lang: {g: i for i, g in enumerate(ranked(c, size))} for lang, c in by.items()}
    out = {}
    for i, text, _ in docs:
        if text is None or not regex.search(r"\p{L}", text):
            out[i] = ("und", 0.0)
            continue
        mine = ranked(grams(text), size)
        away = {lang: sum(abs(held[g] - k) if g in held else size for k, g in enumerate(mine)) for lang, held in lists.items()}
        best = min(sorted(away), key=away.get)
        out[i] = (best, round(1 - away[best] / (size * len(mine)), 9))
    return out


def corpus():
    rng = random.Random(12)
    words = {"x": ["ab", "abba", "cab", "Äb", "bac"], "y": ["zu", "uz", "zuß", "quz", "u"], "z": ["ñoño", "on", "no", "noon"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", " 12", "!?"]), lang) for i, lang in enumerate(rng.choices("xyz", k=120))]
    return rows + [(900, None, "x"), (901, "", "y"), (902, "12 -- 7", "z"), (903, "abba on zu", None), (904, "q", "x"), (905, "ab " * 20_000, "x")]


def test_predictions_against_a_plain_computation(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, ROWS)
    for size in (8, 400):
        got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, docs, size).collect()}
        assert got == brute(rows, rows, size)


def test_profiles_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.createDataFrame(corpus(), ROWS)
    one, many = (sorted(map(tuple, langid.profiles(d, 400).collect())) for d in (docs.coalesce(1), docs.repartition(13)))
    assert one == many and re.fullmatch("[xyz]", one[0][0])
