"""Query catalogue: contract, plans and SQL agreement on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.verify import TABLES, rows_of

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
SAMPLE = ["wn_11_baseline_panel", "jn_02_events_per_bar", "jn_05_story_clusters", "wn_56_information_features", "pf_01_decile_book",
          "pf_03_magnitude_book", "bt_03_minimum_hold", "sx_01_block_bootstrap", "lg_01_final_positions", "val_13_missing_bar_report"]


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 230


def test_flagship_runs(spark):
    df = entry_points.entry(spark)
    assert "sharpe" in df.columns and df.count() == 6


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["wn_11_baseline_panel", "wn_52_volatility_shock_panel", "jn_02_events_per_bar", "jn_11_fold_labels",
                                  "rb_01_cost_stress", "sx_01_block_bootstrap", "pf_03_magnitude_book", "jn_14_scenario_grid"])
def test_no_nested_loop_or_cartesian_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bars_are_hash_aggregated(spark, sf):
    from barwise.sources import views
    for view in (views.bars, views.cross_section_bars, views.hourly_bars):
        plan = view(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
