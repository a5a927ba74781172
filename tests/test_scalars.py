import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.functions import sizing as Z


def one(spark, col, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, TYPES(values))))
    return df.select(col.alias("x")).first().x


def TYPES(values):
    return ["string" if isinstance(v, str) or v is None else "double" if isinstance(v, float) else "boolean" if isinstance(v, bool)
            else "timestamp" if isinstance(v, dt.datetime) else "bigint" for v in values.values()]


@pytest.mark.parametrize("text,day", [
    ("2024-01-05", dt.date(2024, 1, 5)), ("2024-01-05T23:59:00-05:00", dt.date(2024, 1, 5)),
    ("2024-02-31", dt.date(2024, 3, 2)), ("2023-13-01", dt.date(2024, 1, 1)), ("0099-01-01", dt.date(1999, 1, 1)),
    ("n/a", None), ("5 Jan 2024", None)])
def test_parse_day(spark, text, day):
    assert one(spark, S.parse_day("s"), s=text) == day


@pytest.mark.parametrize("text,utc", [
    ("2024-01-05", None), ("2024-01-05T07:42:00-05:00", "12:42"), ("2024-01-05T07:42:00Z", "07:42"),
    ("2024-01-05T07:42Z", "07:42"), ("2024-01-05T07:42:00.123456+00:00", "07:42"), ("junk", None), ("", None)])
def test_parse_ts(spark, text, utc):
    assert one(spark, F.date_format(S.parse_ts("s"), "HH:mm"), s=text) == utc


@pytest.mark.parametrize("utc,phase", [
    ("2026-03-02 08:59:59", "closed"), ("2026-03-02 09:00:00", "pre-market"), ("2026-03-02 14:29:59", "pre-market"),
    ("2026-03-02 14:30:00", "open"), ("2026-03-02 20:59:59", "open"), ("2026-03-02 21:00:00", "after-hours"),
    ("2026-03-03 00:59:59", "after-hours"), ("2026-03-03 01:00:00", "closed"), ("2026-03-07 15:00:00", "closed"),
    ("2026-07-03 15:00:00", "closed"), ("2026-07-02 13:30:00", "open"), ("2026-07-02 13:29:00", "pre-market")])
def test_market_phase(spark, utc, phase):
    got = spark.sql(f"SELECT TIMESTAMP '{utc}' AS t").select(S.market_phase("t").alias("p")).first().p
    assert got == phase


@pytest.mark.parametrize("seconds,unit,amount", [(-5, "just now", 0), (89, "just now", 0), (90, "min", 2), (3599, "min", 60),
                                                 (3600, "h", 1), (36 * 3600 - 1, "h", 36), (36 * 3600, "days", 2)])
def test_age(spark, seconds, unit, amount):
    df = spark.sql(f"SELECT TIMESTAMP '2024-01-05 12:00:00' AS now, TIMESTAMP '2024-01-05 12:00:00' - INTERVAL {seconds} SECONDS AS t")
    got = df.select(S.age("t", "now").alias("a")).first().a
    assert (got.unit, got.amount) == (unit, amount)


@pytest.mark.parametrize("url,host", [
    ("https://www.Example.com/a?b", "example.com"), ("HTTP://user:pw@sub.example.org:8080", "sub.example.org"),
    ("javascript:alert(1)", None), ("data:text/html,x", None), ("", None), (" https://a.b ", "a.b"), ("https://[::1]:80/x", "[::1]")])
def test_host(spark, url, host):
    assert one(spark, S.url_host("u"), u=url) == host


def test_flags_and_words(spark):
    df = spark.createDataFrame([("OFFERING 24H",), ("OFFERINGS",), ("NO BORROW",), ("NO BORROWS",), ("GAP UP",), ("ASIA",)], "f string")
    assert [r.k for r in df.select(S.flag_class("f").alias("k")).collect()] == ["red", "plain", "solid", "plain", "red", "plain"]
    lv = spark.createDataFrame([(44.9,), (45.0,), (70.0,), (None,), (float("nan"),)], "v double")
    assert [r.w for r in lv.select(S.danger_word("v").alias("w")).collect()] == ["low", "elevated", "high", "unknown", "unknown"]
    cells = spark.createDataFrame([(-3.0,), (4.9,), (5.0,), (104.0,), (None,)], "v double").select(S.danger_cells("v").alias("c"))
    assert [r.c for r in cells.collect()] == [0, 0, 1, 10, None]


def test_half_up_goes_to_plus_infinity(spark):
    got = spark.createDataFrame([(2.5,), (-2.5,), (-0.4,)], "x double").select(S.half_up("x").alias("y"))
    assert [r.y for r in got.collect()] == [3, -2, 0]


def test_cap_marker(spark):
    df = spark.createDataFrame([(0.39995, "m0"), (0.3998, "m0"), (0.9, "mx"), (None, "m0")], "p double, m string")
    assert [r.c for r in df.select(S.at_cap("p", F.col("m"), {"m0": 0.4}).alias("c")).collect()] == [True, False, False, False]


def test_outcomes(spark):
    df = spark.createDataFrame([(True, None, None), (None, True, True), (None, False, True), (None, False, False), (None, None, None)],
                               "m boolean, d boolean, s boolean")
    assert [r.o for r in df.select(S.outcome_label("m", "d", "s").alias("o")).collect()] == [
        "no data", "dumped", "squeezed", "no dump", None]
    w = spark.createDataFrame([(0.0004,), (-0.0005,), (0.2,), (None,)], "n double").select(S.short_word("n").alias("w"))
    assert [r.w for r in w.collect()] == ["broke even", "lost", "made", None]


def test_times_and_labels(spark):
    df = spark.createDataFrame([("time-pre-market",), ("after-hours",), ("during_market",), (None,), ("",)], "t string")
    got = rows(df.select(S.report_time("t"), S.calendar_time("t")))
    assert got == [("before the open", "before the open"), ("after the close", "after the close"),
                   ("time n/a", "During market"), ("time n/a", None), ("time n/a", None)]


def test_division_by_zero_is_missing(spark):
    assert one(spark, S.lift("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, S.move_from_open("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, S.down_skew("a", "b"), a=0.3, b=0.1) == pytest.approx(0.75)


def test_three_valued_filters(spark):
    df = spark.createDataFrame([("ETB", 5.0), ("HTB", 0.0), ("HTB", None), (None, 5.0), ("NONE", 5.0), ("ETB", float("nan"))],
                               "status string, available double")
    assert [r.s for r in df.select(P.shortable().alias("s")).collect()] == [True, False, True, False, False, True]


def test_search(spark):
    df = spark.createDataFrame([("ABCD", "x", 0), ("QQ", "The abc Co", 1), ("ABC", "y", 2), ("XABC", "z", 3)], "symbol string, name string, pos int")
    hit = df.filter(P.search_match(" abc ")).orderBy(*P.search_order(" abc ", "pos"))
    assert [r.symbol for r in hit.collect()] == ["ABC", "ABCD", "QQ"]
    assert df.filter(P.search_match("  ")).count() == 4


@pytest.mark.parametrize("accepted,day,hit", [
    ("2024-01-04 13:00:00", None, True), ("2024-01-04 11:59:59", None, False), ("2024-01-05 13:00:00", None, True),
    ("2024-01-05 13:00:01", None, False), (None, "2024-01-04", True), (None, "2024-01-03", False)])
def test_fresh_supply(spark, accepted, day, hit):
    ts = f"TIMESTAMP '{accepted}'" if accepted else "CAST(NULL AS TIMESTAMP)"
    d = f"DATE '{day}'" if day else "CAST(NULL AS DATE)"
    df = spark.sql(f"SELECT 'atm' AS c, {ts} AS a, {d} AS d, TIMESTAMP '2024-01-05 12:00:00' AS p")
    assert df.select(P.fresh_supply("c", "a", "d", "p").alias("x")).first().x is hit
    assert not df.select(P.fresh_supply(F.lit("other"), "a", "d", "p").alias("x")).first().x


def test_cost_laws(spark):
    df = spark.createDataFrame([(0.02, 0.01), (0.005, 0.01), (None, 0.01), (0.02, None), (0.02, 0.0)], "c10 double, spread double")
    got = [r.c for r in df.select(Z.cost_law(F.lit(40000.0), "c10", "spread").alias("c")).collect()]
    assert got[:2] == pytest.approx([0.03, 0.01]) and got[2:4] == [None, None] and got[4] == pytest.approx(0.001 + 0.019 * 2)
    be = df.select(Z.breakeven(F.lit(0.04), "c10", "spread").alias("b")).first().b
    assert be == pytest.approx(((0.04 - 0.01) / 0.0001) ** 2)
    ladder = spark.range(1, 200).select(Z.cost_law(F.col("id") * 1000.0, F.lit(0.02), F.lit(0.01)).alias("c")).collect()
    assert all(a.c <= b.c for a, b in zip(ladder, ladder[1:]))


def test_published_cost_wins(spark):
    df = spark.sql("SELECT map('30000', 0.5D, '10000', 0.02D) AS costs, 0.02D AS c10, 0.01D AS spread")
    got = df.select(Z.cost_at("costs", 30000, "c10", "spread").alias("a"), Z.cost_at("costs", 40000, "c10", "spread").alias("b")).first()
    assert got.a == 0.5 and got.b == pytest.approx(0.03)
