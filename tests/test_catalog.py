import pytest
from oracle import database, differences

import __spark_entry__ as entry
from paneltide.operators import panel_model
from paneltide.plans.catalog import ORACLES, QUERIES, learning

SF = "/root/testdata/sf0.001"
CHECKED = (
    "dedup_keep_last",
    "impute_missing",
    "flag_outliers",
    "build_features",
    "grain_report",
    "seasonal_cycle",
    "continent_comparison",
    "weather_pollutant_correlation",
    "box_by_month",
    "detect_univariate",
    "backtest_baselines",
    "final_forecasts",
    "direct_frame",
)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_statement(spark, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert differences(rows, database(SF).execute(ORACLES[name]).df()) == []


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registered_panel_models_are_the_full_ones(spark):
    boosted, forest = (learning._MODELS[k]() for k in ("boosted_trees", "random_forest"))
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (400, 6, 0.05)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 8)


def test_queries_let_methods_be_compiled(spark):
    """HotSpot interprets methods of more than 8000 bytes; stages of many columns had 20 kB and more."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["coerce_types"](spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("name", ["zero_inflation", "monthly_band", "stacked_pair", "fold_sizes"])
def test_rows_are_read_once_and_then_what_was_written(spark, name):
    files = QUERIES[name](spark, SF).inputFiles()
    assert files and not [f for f in files if f.endswith("lineitem.parquet")]


def test_small_training_tables_are_fitted_in_few_tasks(spark):
    class Counting:
        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    assert panel_model._fitted(spark.range(1000).repartition(16), Counting) == 1
    assert panel_model._fitted(spark.range(3 * panel_model.TASK_ROWS).repartition(16), Counting) == 3
    assert panel_model._fitted(spark.range(0), Counting) == 1


@pytest.mark.parametrize("name", ["build_features", "build_features_in_blocks"])
def test_features_carry_only_what_they_are_made_from(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "air_quality" not in plan and "gust_kph" not in plan
