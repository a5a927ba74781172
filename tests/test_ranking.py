"""The distributed forms must equal the window forms, also under ties, gaps and a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    data = []
    for i in range(900):
        group = "hot" if i % 3 else f"g{i % 7}"
        value = 1.0 if rnd.random() < 0.35 else None if rnd.random() < 0.1 else round(rnd.random(), 2)
        data.append((group, i, value, float(rnd.randint(0, 5))))
    data += [(None, 900 + i, float(i % 3) if i % 2 else None, 1.0) for i in range(9)]         # no key
    data += [("unknown", 950 + i, None, 2.0) for i in range(4)]                               # no value
    return spark.createDataFrame(data, "g string, id long, x double, y double").cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


@pytest.mark.parametrize("order", [lambda: [F.col("x").desc_nulls_last(), F.col("id")], lambda: [F.col("id")]])
def test_row_number(skewed, order):
    same(R.with_row_number(skewed, "g", order(), "n", small=True), R.with_row_number(skewed, "g", order(), "n"))


def test_running_total(skewed):
    tot = lambda: {"s": F.col("y"), "n": F.lit(1)}
    same(R.running_total(skewed, "g", [F.col("y"), F.col("id")], tot(), small=True),
         R.running_total(skewed, "g", [F.col("y"), F.col("id")], tot(), slices=7))


def test_percent_rank(skewed):
    same(R.with_percent_rank(skewed, "g", "id", ["x", "y"], small=True), R.with_percent_rank(skewed, "g", "id", ["x", "y"]))


def test_rank_desc(skewed):
    same(R.with_rank_desc(skewed, "g", "id", ["x", "y"], small=True), R.with_rank_desc(skewed, "g", "id", ["x", "y"]))


def test_cume_dist(skewed):
    same(R.with_cume_dist(skewed, "g", "id", "x", "c", small=True), R.with_cume_dist(skewed, "g", "id", "x", "c"))
    assert R.with_cume_dist(skewed, "g", "id", "x", "c").filter("x is null and c is not null").count() == 0


def test_median(skewed):
    same(R.exact_median(skewed, "g", "x", "m", small=True), R.exact_median(skewed, "g", "x", "m"))
    sums, finals = {"n": F.lit(1), "_y": F.col("y"), "_known": F.when(F.col("x").isNotNull(), 1)}, lambda: ["n", "_known", (F.col("_y") / F.col("n")).alias("mean")]
    same(R.agg_with_median(skewed, "g", sums, finals(), "x", "m", small=True), R.agg_with_median(skewed, "g", sums, finals(), "x", "m"))
    assert R.agg_with_median(skewed.limit(0), "g", sums, finals(), "x", "m").count() == 0


def test_whole_totals(skewed):
    tot, whole = lambda: {"s": F.col("y")}, {"all": "s"}
    same(R.running_total(skewed, "g", [F.col("y"), F.col("id")], tot(), small=True, whole=whole),
         R.running_total(skewed, "g", [F.col("y"), F.col("id")], tot(), slices=5, whole=whole))


def test_several_orders_at_once(skewed):
    got = R.row_numbers(skewed, "g", "id", {"up": -F.col("x"), "down": F.col("x"), "by_y": F.col("y")})
    want = skewed
    for name, col in (("up", F.col("x").asc_nulls_last()), ("down", F.col("x").desc_nulls_last()), ("by_y", F.col("y").desc_nulls_last())):
        want = R.with_row_number(want, "g", [col, F.col("id")], name, small=True)
    same(got, want)


def test_group_agg(skewed):
    aggs = {"n": F.count("x"), "a": F.max("y")}
    same(R.with_group_agg(skewed, "g", aggs, small=True), R.with_group_agg(skewed, "g", aggs))


def test_sort_missing_last_both_ways(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("b", float("nan"), 2), ("c", None, 3), ("d", 1.0, 5), ("e", 1.0, 4)],
                               "symbol string, fee_rate double, rank int")
    up = [r.symbol for r in df.orderBy(*R.board_order("fee")).collect()]
    down = [r.symbol for r in df.orderBy(*R.board_order("fee", flipped=True)).collect()]
    assert up == ["e", "d", "a", "b", "c"] and down == ["a", "e", "d", "b", "c"]


def test_page_is_clamped(spark):
    df = spark.range(120)
    page = lambda p: [r.id for r in R.paginate(df, [F.col("id")], p).collect()]
    assert page(0) == list(range(50)) and page(2) == list(range(100, 120)) and page(99) == page(2)
    assert R.paginate(df.filter("id < 0"), [F.col("id")], 3).count() == 0


def test_top_reasons_and_shares(spark):
    df = spark.sql("""SELECT array(named_struct('text','a','strength',1), named_struct('text','b','strength',3),
        named_struct('text','c','strength',CAST(NULL AS INT)), named_struct('text','d','strength',3)) AS reasons,
        map('p', 0.2D, 'q', CAST('NaN' AS DOUBLE), 'r', -1D, 's', 0.5D, 't', 0.2D) AS shares""")
    got = df.select(R.top_reasons("reasons", 3).alias("r"), R.top_attribution("shares", 2).alias("a")).first()
    assert [x.text for x in got.r] == ["b", "d", "a"]
    assert [x.family for x in got.a] == ["s", "p"]


def test_lookup_searches_filters_and_sorts(spark):
    df = spark.createDataFrame([("AB", "Abacus", 2.0, None), ("A", "Alpha", None, 1.0), ("XA", "Ab works", 5.0, 2.0), ("C", "Cee", 3.0, 3.0)],
                               "symbol string, name string, price double, capacity double")
    shown = lambda **o: [r.symbol for r in R.lookup_page(df, **o).collect()]
    assert shown(key="price") == ["XA", "C", "AB", "A"] and shown(key="price", flipped=True) == ["AB", "C", "XA", "A"]
    assert shown(query=" a ", key="price") == ["A", "AB", "XA"] and shown(query="ab") == ["AB", "XA"]
    assert shown(filters=[F.col("capacity") > 1], key="symbol", page=1, per_page=1) == ["XA"]
