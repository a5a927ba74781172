"""Features over bars stored by symbol: no exchange, and every W row green from that store."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import plan_of
from tidemark.operators.features import session_features
from tidemark.sources import derived, store
from tools.compare import TABLES, compare

FROM_STORE = ["w1_returns", "w2_rel_volume", "w3_rsi14", "w4_ma_distance", "w5_drawdown_52w", "w6_volatility20", "w7_dollar_volume20", "w8_short_metrics",
              "w9_series_change", "w10_window_extremes", "w12_regime_percentile", "w13_realised_rate20", "w14_forward_labels", "w15_prior_state", "w16_spread_ar"]


@pytest.fixture(scope="module")
def stored(spark, sf):
    made = {grain: store.write_bars(derived.bars(spark, sf, grain), 4) for grain in ("month", "week")}
    return lambda grain: spark.table(made[grain])


def test_features_need_no_exchange(stored):
    plan = plan_of(session_features(stored("month")))
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_each_bucket_is_one_file(spark, stored):
    files = stored("month").inputFiles()
    assert 0 < len(files) <= 4


def test_attached_bars_are_the_same(spark, sf, tmp_path):
    path = str(tmp_path / "bars")
    name = store.write_bars(derived.bars(spark, sf), 4, path)
    again = spark.table(store.attach_bars(spark, path, 4))
    assert "Exchange" not in plan_of(session_features(again))
    assert again.exceptAll(spark.table(name)).count() == 0 and again.count() == spark.table(name).count() > 0


@pytest.mark.parametrize("name", FROM_STORE)
def test_feature_queries_from_the_store(spark, sf, stored, monkeypatch, name):
    monkeypatch.setattr(derived, "bars", lambda s, d, grain="month": stored(grain))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()) == "ok"
