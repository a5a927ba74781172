"""Search by postings: same rows as the scan, and only the query's own postings are read."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tidemark.functions.predicates import search_match
from tidemark.sources import search_index

SCHEMA = "id long, ticker string, name string"


def names():
    rng = random.Random(4)
    syllables = ["ala", "ber", "co", "dé", "Étu", "Fo", "o'", "x ", "99", "\n", "ß"]
    rows = [(i, "".join(rng.choice("ABCD9") for _ in range(rng.randint(1, 5))), "".join(rng.choice(syllables) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    rows += [(500, None, "Alabaster"), (501, "ALAB", None), (502, "", ""), (503, "x", "shared " * 3000 + "needle"), (504, "ab", "İstanbul")]
    return rows + [(600 + i, "HOT", "shared fund of the many") for i in range(300)]


@pytest.fixture(scope="module")
def index(spark):
    return search_index.build(spark.createDataFrame(names(), SCHEMA), "id", "ticker", "name")


@pytest.mark.parametrize("query", ["ala", " ALAber ", "étu", "alaala", "shared fund", "needle", "hot", "HOT", "abcd", "x", "", "a9", "o'o'", "ber\nco", "nothing at all", "stan"])
def test_same_rows_as_the_scan(index, query):
    scan = index.rows.filter(search_match(query, "ticker", "name"))
    got, want = sorted(r.id for r in index.search(query).collect()), sorted(r.id for r in scan.collect())
    assert got == want


def test_only_the_querys_postings_are_read(index):
    plan = plan_of(index.lookup(search_index.of_query("needle")))
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:80]
    assert "PushedFilters: [In(gram, [dle,edl,eed,nee])]" in plan
    read = {r.gram for r in index.lookup(["nee", "edl"]).collect()}
    assert read == {"nee", "edl"}


def test_the_rarest_grams_are_looked_up(index, monkeypatch):
    asked = []
    real = search_index.SearchIndex.lookup
    monkeypatch.setattr(search_index.SearchIndex, "lookup", lambda self, wanted: (asked.append(list(wanted)), real(self, wanted))[1])
    assert [r.id for r in index.search("shared needle").collect()] == [503]
    assert len(asked) == 1 and len(asked[0]) == search_index.LOOKED_UP and "sha" not in asked[0]


def test_a_gram_no_text_holds_reads_no_postings(index, monkeypatch):
    monkeypatch.setattr(search_index.SearchIndex, "lookup", lambda self, wanted: pytest.fail("read"))
    assert index.search("qqq").count() == 0


def test_dictionary_counts_texts(index):
    held = {(r.field, r.gram): r.n for r in index.dictionary.collect()}
    assert held["name", "sha"] == 301 and held["name", "nee"] == 1 and held["symbol", "hot"] == 300


def test_empty_rows(spark):
    none = search_index.build(spark.createDataFrame([], SCHEMA), "id", "ticker", "name")
    assert none.search("abc").count() == 0 and none.search("a").count() == 0


def test_texts_are_cut_into_grams_once(spark, monkeypatch):
    """Postings are not dealt by ranges: their bounds come from a run of its own over all texts."""
    kind, ranged = type(spark.range(1)), []
    real = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *a: ranged.append(df.columns) or real(df, *a))
    docs = spark.createDataFrame([(i, f"T{i}", f"the name of {i}") for i in range(50)], SCHEMA)
    index = search_index.build(docs, "id", "ticker", "name")
    assert ranged == [["part", "gram", "field", "n"]]             # the dictionary alone, one row per gram
    assert index.postings.count() == index.postings.distinct().count()
    assert index.search("name of 4").count() == 11
