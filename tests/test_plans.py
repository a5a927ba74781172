"""Shapes of the physical plans, and every query family against its SQL twin."""

import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import plan_of
from tidemark import plans
from tidemark.operators.features import session_features
from tidemark.plans import board
from tidemark.sources import derived
from tools.compare import TABLES, compare

ORACLE_CHECKED = [
    "flagship_top10_vs_base", "w3_rsi14", "w12_regime_percentile", "w16_spread_ar", "w18_family_scores", "w19_squeeze_danger", "p2_parse_time",
    "p7_url_host", "f1_board_filters", "f10_stand_aside", "o1_board_sort", "o3_wire_sort", "j1_record_merge", "j6_premarket_asof", "j7_borrow_asof",
    "j12_lookalikes", "j14_calendar_earnings", "x7_plan_basket", "a2_band_blend", "a8_auc", "a12_event_study", "a33_survivorship_gap", "a25_event_counts",
    "u4_unified_lists", "s3_explode_bars", "s7_history_append", "t1_live_tape", "t6_wire_stream", "t7_freshness_monitor", "l3_prob_cap",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLE_CHECKED)
def test_against_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, duck.sql(entry.oracle_sql()[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registration():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140


def test_features_share_one_exchange(spark, sf):
    plan = plan_of(session_features(derived.bars(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+L?, \d+\)", plan)) == 1
    assert plan.count("Exchange ") == 2                       # the bars' own aggregation, then symbol


def test_bars_aggregate_before_the_shuffle_without_sorting(spark, sf):
    plan = plan_of(derived.bars(spark, sf))
    assert "partial_min_by" in plan and "SortAggregate" not in plan


def test_scan_reads_only_what_is_used(spark, sf):
    plan = plan_of(derived.bars(spark, sf).select("symbol", "session", "high"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_partkey" not in schema and "l_returnflag" not in schema


def test_filing_filter_is_pushed_down(spark, sf):
    assert "EqualTo(l_returnflag,R)" in plan_of(derived.filings(spark, sf))


@pytest.mark.parametrize("name", ["j1_record_merge", "j3_band_join", "j4_disjoint_bands", "j12_lookalikes", "x7_plan_basket", "a20_binomial_tail"])
def test_no_cartesian_product(spark, sf, name):
    assert "CartesianProduct" not in plan_of(entry.queries()[name](spark, sf))


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan_of(entry.queries()["o4_topk_per_session"](spark, sf))


@pytest.mark.parametrize("name", ["w11_score_percentile", "w17_consensus_rank", "w18_family_scores", "w19_squeeze_danger", "w21_dual_rank", "u1_union_lists",
                                  "u4_unified_lists", "j1_record_merge", "j11_first_passing", "j12_lookalikes", "a7_topn_hit_rates", "a33_survivorship_gap"])
def test_no_task_holds_a_session(spark, sf, monkeypatch, name):
    """No window over all names of a session, in the query or in what it writes on its way; top-k windows see at most k rows a task,
    and windows over `_s_` columns the totals of slices."""
    from tidemark import session
    seen = []

    def watched(df):
        seen.append(df)
        return session.cut(df)

    for module in [m for n, m in sys.modules.items() if n.startswith("tidemark.") and getattr(m, "cut", None) is session.cut and m is not session]:
        monkeypatch.setattr(module, "cut", watched)
    seen.append(plans.load()[0][name](spark, sf))
    assert len(seen) > 1 or name == "a33_survivorship_gap"
    for df in seen:
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for line, below in zip(lines, [*lines[1:], ""]):
            if "sum(_s_" not in line and re.search(r"\bWindow \[.*\], \[(list#\d+, |model#\d+, )?session#\d+\]", line):
                assert "WindowGroupLimit" in below, line[:300]


def test_board_rows_are_written_with_the_wanted_columns_only(spark, sf, monkeypatch):
    """`keep` bounds what is computed and written; the columns kept have the same values as in whole rows."""
    from tidemark.session import cut
    seen = []

    def watched(df):
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(board, "cut", watched)
    kept = ["zone_reason", "urank", "board_rank", "lift"]
    few = board.picks(spark, sf, keep=kept)
    assert set(few.columns) == {"session", "symbol", *kept}
    assert all(not {"rsi14", "dd_52w", "flags", "name", "next_oc"} & set(df.columns) for df in seen)
    assert "252" not in "".join(df._jdf.queryExecution().optimizedPlan().toString() for df in seen)
    whole = board.picks(spark, sf).select(few.columns)
    assert few.exceptAll(whole).isEmpty() and whole.exceptAll(few).isEmpty()


@pytest.mark.parametrize("name", ["w21_dual_rank", "f4_lookup_filters", "f9_do_not_short", "j1_record_merge", "j2_has_record", "a4_live_summary", "a31_basket_backtest",
                                  "a32_size_tier_table", "u4_unified_lists", "feed_unified", "feed_universe", "s1_quarantine", "s6_feed_integrity", "o1_board_sort"])
def test_board_queries_compute_only_what_they_use(spark, sf, monkeypatch, name):
    from tidemark.session import cut
    seen = []

    def watched(df):
        seen.append(df)
        return cut(df)

    monkeypatch.setattr(board, "cut", watched)
    entry.queries()[name](spark, sf)
    assert all("rsi14" not in df.columns and len(df.columns) < 40 for df in seen)
