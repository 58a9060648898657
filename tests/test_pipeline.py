from paneltide.operators.panel_model import boosted_trees, random_forest
from paneltide.plans.bindings import PANEL, country_regions, panel
from paneltide.plans.pipeline import run_all

SF = "/root/testdata/sf0.001"


def test_whole_run_writes_every_result(spark, tmp_path):
    factories = {
        "boosted_trees": boosted_trees(rounds=2, step=0.3, depth=3),
        "random_forest": random_forest(trees=3, depth=4),
    }
    spec = PANEL.but(
        metrics=("temperature_celsius", "humidity", "precip_mm", "wind_kph"),
        concentrations=("air_quality_pm2_5",),
        indices=("air_quality_us_epa_index",),
        exogenous=("humidity",),
    )
    paths = run_all(
        panel(spark, SF),
        str(tmp_path),
        spec,
        country_regions(spark, SF),
        factories,
        n_series=3,
        trees=20,
        repeats=1,
    )
    assert {"clean", "features", "anomalies", "predictions", "model_comparison"} <= set(paths)
    predictions = spark.read.parquet(paths["predictions"])
    assert predictions.groupBy("country", "location_name").count().where("count != 7").isEmpty()
    models = {r["model"] for r in spark.read.parquet(paths["model_comparison"]).collect()}
    assert {"naive", "damped_smoothing", "seasonal_arma"} <= models
    header = spark.read.option("header", True).csv(paths["series_coverage"]).columns
    assert header[:3] == ["country", "location_name", "n_obs"]
