import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import plan_of, rows
from tidemark.operators import joins as J
from tidemark.operators import market
from tidemark.sources import feeds

DAY0 = dt.date(2020, 1, 1)
day = lambda n: DAY0 + dt.timedelta(days=n)


def test_asof_against_brute_force(spark):
    rnd = random.Random(5)
    right = sorted({("h" if rnd.random() < 0.5 else f"s{rnd.randint(0, 3)}", rnd.randint(0, 700)) for _ in range(160)})
    left = [(i, rnd.choice(["h", "s0", "s1", "s9"]), rnd.randint(0, 800)) for i in range(200)]
    l = spark.createDataFrame([(i, s, day(n)) for i, s, n in left], "id long, symbol string, d date")
    r = spark.createDataFrame([(s, day(n), float(n)) for s, n in right], "symbol string, day date, v double")
    for grain in ("DAY", "MONTH", "YEAR"):
        got = dict(rows(J.asof_join(l, r, ["symbol"], "d", "day", ["v"], grain).select("id", "v")))
        for i, s, n in left:
            before = [m for t, m in right if t == s and m <= n]
            assert got[i] == (float(max(before)) if before else None)


def test_bands_fall_back_to_the_last(spark):
    bands = spark.createDataFrame([(1, 1, .5), (2, 10, .4), (11, 100, .3)], "lo int, hi int, hit double")
    got = rows(J.band_join(spark.createDataFrame([(1,), (7,), (150,)], "u int"), bands, "u").select("u", "lo"), "u")
    assert got == [(1, 1), (7, 2), (150, 11)]


def test_summary_bands_are_dropped(spark):
    rep = spark.createDataFrame([("m", 1, 1), ("m", 2, 10), ("m", 1, 10), ("m", 1, 100), ("n", 1, 100)], "k string, lo int, hi int")
    assert rows(J.disjoint_bands(rep, ["k"]), "k", "lo") == [("m", 1, 1), ("m", 2, 10), ("n", 1, 100)]


def test_record_precedence(spark):
    data = [("A", "twin", 1), ("A", "swing", 3), ("A", "board", 2), ("A", "classic", 1), ("B", "swing", 1), ("B", "twin", 2),
            ("C", "zone", 1), ("C", "one", 9), ("D", "top", 1), ("D", "classic", 1), ("E", "classic", 1)]
    lists = spark.createDataFrame(data, "symbol string, list string, pos int")
    out = J.merge_records(lists, ["symbol"], ["one", "board", "top", "zone", "classic", "swing", "twin"], ["twin", "classic", "swing"])
    got = {r.symbol: r for r in out.collect()}
    assert {s: r.where for s, r in got.items()} == {"A": "board", "B": "swing", "C": "one", "D": "board", "E": "classic"}
    assert (got["A"].as_twin.pos, got["A"].as_classic.pos, got["A"].as_swing.pos) == (1, 1, 3)
    assert got["B"].as_swing is None and got["B"].as_twin.pos == 2 and got["E"].as_classic is None
    assert out.count() == 5


def test_first_passing_lists_the_names_passed_over(spark):
    df = spark.createDataFrame([("s", 1, False), ("s", 2, False), ("s", 3, True), ("s", 4, True), ("t", 1, False)], "session string, rank int, ok boolean")
    for bound in (10, 10**9):
        got = rows(J.first_passing(df, "session", "rank", F.col("ok"), bound).select("session", "rank", "role"), "rank")
        assert got == [("s", 1, "passed over"), ("s", 2, "passed over"), ("s", 3, "picked")]


def test_lookalikes_both_forms(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([("s", i, [rnd.gauss(0, 1) for _ in range(4)], i) for i in range(60)],
                               "g string, id long, v array<double>, rank long")
    a, b = [rows(J.lookalikes(df, "g", "id", F.col("v"), F.col("rank"), 5, 0.1, n).select("id", "similarity", "twin_rank"), "twin_rank")
            for n in (100, 10**9)]
    assert a == b and len(a) == 5 and all(x[1] >= 0.1 for x in a)


def test_upcoming_events(spark):
    sessions = spark.createDataFrame([(day(n),) for n in range(0, 70, 7)], "session date")
    events = spark.createDataFrame([(i, day(i)) for i in range(-40, 80, 3)], "id int, d date")
    got = set(rows(J.upcoming_events(events, sessions, "d", 3).select("id", "session", "sessions_ahead")))
    marks = [day(n) for n in range(0, 70, 7)]
    later = [*marks, day(64), day(65), day(68)]         # a Thursday, a Friday, a Monday
    want = set()
    for i in range(-40, 80, 3):
        closing = next((k for k, s in enumerate(later) if day(i) <= s), None)
        if closing is not None:
            want |= {(i, marks[k], closing - k) for k in range(max(0, closing - 3), min(closing, len(marks))) if marks[k] < day(i)}
    assert got == want


def test_event_between(spark):
    rnd = random.Random(2)
    picks = [(rnd.choice("ab"), n, day(n), day(n + 6)) for n in range(0, 200, 9)]
    ev = [(rnd.choice("aaab"), day(rnd.randint(0, 220))) for _ in range(60)]
    got = rows(J.has_event_between(spark.createDataFrame(picks, "symbol string, id int, lo date, hi date"),
                                   spark.createDataFrame(ev, "symbol string, day date"), ["symbol"], "lo", "hi", "day").select("id"), "id")
    assert [g[0] for g in got] == [i for s, i, lo, hi in picks if any(t == s and lo < e <= hi for t, e in ev)]


def test_trailing_counts(spark):
    ev = [("a", day(n), "x" if n % 2 else "y") for n in (0, 1, 5, 89, 90, 91, 400)] + [("a", day(90), "x")]
    df = spark.createDataFrame(ev, "symbol string, day date, kind string")
    got = rows(J.trailing_counts(df, ["symbol"], "day", {"n": (F.col("kind") == "x", 90)}, {"last": F.col("kind") == "y"}), "day")
    for _, d, n, last in got:
        assert n == sum(1 for _, e, k in ev if k == "x" and 0 <= (d - e).days <= 89)
        ys = [e for _, e, k in ev if k == "y" and e <= d]
        assert last == (max(ys) if ys else None)


def test_monotonic_index(spark):
    rnd = random.Random(4)
    log = [("f", dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), 10 * i - rnd.randint(0, 60)) for i in range(80)]
    got = rows(feeds.monotonic(spark.createDataFrame(log, "feed string, ts timestamp, seq long"), ["feed"], "ts", "seq"), "ts")
    peak = None
    for _, _, seq, held, ok in got:
        assert held == peak and ok == (peak is None or seq >= peak)
        peak = seq if peak is None else max(peak, seq)


def test_manifest_status(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 9)], "name string, seq long")
    new = spark.createDataFrame([("b", 2), ("c", 4), ("d", 8), ("e", 1)], "name string, seq long")
    got = {r.name: (r.status, r.reread) for r in feeds.manifest_diff(old, new).collect()}
    assert got == {"a": ("removed", False), "b": ("same", False), "c": ("changed", True), "d": ("same", False), "e": ("added", True)}


def test_absent_feed_is_empty(spark, tmp_path):
    df = feeds.load_feed(spark, str(tmp_path / "none"), "a BIGINT, b STRING")
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_columnar_rows_are_typed(spark):
    docs = spark.sql("SELECT array('symbol', 'p') AS columns, array(array('A', '0.5'), array('B', NULL), array('C', 'x')) AS rows")
    got = rows(feeds.columnar_to_rows(docs, {"symbol": "string", "p": "double", "q": "long"}), "symbol")
    assert got == [("A", 0.5, None), ("B", None, None), ("C", None, None)]


def test_bars_strict_and_loose(spark):
    docs = spark.sql("""SELECT 'A' AS symbol, array(array('2024-01-02','1','2','1','NaN','5'), array('2024-01-03','NaN','2','1','1.5','5'),
        array('2024-01-04','1','2','1','1.5','5')) AS chart""")
    assert feeds.explode_bars(docs, ["symbol"]).count() == 2
    assert feeds.explode_bars(docs, ["symbol"], strict=True).count() == 1


def test_every_feed_schema_parses(spark):
    from tidemark.schemas import FEEDS
    for name, ddl in FEEDS.items():
        assert spark.createDataFrame([], ddl).columns, name


def test_history_is_never_rewritten(spark, tmp_path):
    path = str(tmp_path / "history")
    snap = lambda n, v: spark.createDataFrame([(1, v, day(n)), (2, v, day(n))], "symbol long, p double, session date")
    assert feeds.append_history(snap(0, 0.1), path) == 2
    assert feeds.append_history(snap(0, 0.9).unionByName(snap(1, 0.2)), path) == 2
    held = feeds.load_history(spark, path, "symbol long, p double, session date")
    assert sorted(r.p for r in held.collect()) == [0.1, 0.1, 0.2, 0.2]


def test_event_after_the_last_session(spark):
    """Friday 2025-12-19 is the last session: the next five are 22, 23, 24, 26 and 29 December (25th: holiday)."""
    sessions = spark.sql("SELECT explode(array(DATE'2025-12-18', DATE'2025-12-19')) AS session")
    events = spark.sql("SELECT * FROM VALUES (1, DATE'2025-12-19'), (2, DATE'2025-12-24'), (3, DATE'2025-12-29'), (4, DATE'2025-12-30') AS t(id, date)")
    got = {(r.id, str(r.session), r.sessions_ahead) for r in J.upcoming_events(events, sessions, "date", 5).collect()}
    assert got == {(1, "2025-12-18", 1), (2, "2025-12-18", 4), (2, "2025-12-19", 3), (3, "2025-12-19", 5)}


def test_unknown_list_comes_last(spark):
    rows = spark.createDataFrame([("A", "mystery", 1), ("A", "board", 9)], "symbol string, list string, pos long")
    assert J.merge_records(rows, ["symbol"], ["one", "board"], []).first()["where"] == "board"


def test_asof_of_a_hot_key(spark):
    """Nine rows in ten share one key and instant; all of them get the same match."""
    left = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'b', 'a') AS k", "timestamp'2024-03-05 10:00:00' + make_interval(0,0,0,0,0,0,if(id % 10 = 0, id, 0)) AS t")
    right = spark.sql("SELECT 'a' AS k, timestamp'2024-01-31 09:00:00' AS at, 7 AS v UNION ALL SELECT 'b', timestamp'2024-03-05 10:05:00', 8")
    got = J.asof_join(left, right, ["k"], "t", "at", ["v"]).collect()
    assert len(got) == 1000 and all(r.v == 7 for r in got if r.k == "a")
    assert all(r.v == (8 if r.id >= 300 else None) for r in got if r.k == "b")


def test_asof_holds_instants_alone_until_the_columns_are_met(spark):
    """Sorts and aggregates of the as-of join see no column that is taken; null keys and instants meet as they did."""
    left = spark.createDataFrame([(1, 1, 5), (2, 1, 40), (3, None, 5), (4, 1, None), (5, 2, 5), (6, 1, -400)], "id int, k int, d int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 7, "b"), (None, 4, "c"), (1, None, "d"), (2, 6, "e")], "k int, d int, text string")
    day = F.expr("date_add(date'2024-03-01', d)").alias("day")
    met = J.asof_join(left.select("id", "k", day), right.select("k", day, "text"), ["k"], "day", "day", ["text"])
    assert rows(met.select("id", "text"), "id") == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None), (6, None)]
    plan = plan_of(met)
    assert "max_by" not in plan and "SortAggregate" not in plan
    for window in [line for line in plan.splitlines() if " Window [" in line]:
        assert "struct" not in window and "text" not in window


def test_scan_tasks_are_bounded(spark):
    from tidemark.session import SCAN_BYTES, bound_scans
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, want in (("1m", "1m"), ("1g", str(SCAN_BYTES)), ("134217728b", str(SCAN_BYTES))):
            spark.conf.set(name, given)
            bound_scans(spark)
            assert spark.conf.get(name).startswith(want[:2])
            assert spark.conf.get(name) in (given, want)
    finally:
        spark.conf.set(name, before)
