"""The whole run: clean, build features, profile, find anomalies, forecast, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.operators import (
    air_quality,
    anomaly,
    climate,
    cleaning,
    correlation,
    ensemble,
    features,
    forecast,
    panel_model,
    profiling,
    spatial,
)
from paneltide.operators.regions import add_region_columns
from paneltide.sources.sinks import write_anomalies, write_parquet, write_table, write_weights
from paneltide.spec import LEAKY, WEATHER, PanelSpec, present


def run_all(
    raw: DataFrame,
    out: str,
    spec: PanelSpec = WEATHER,
    dimension: DataFrame | None = None,
    factories: Mapping[str, panel_model.Factory] | None = None,
    n_series: int = 6,
    trees: int = 200,
    repeats: int = 10,
) -> dict[str, str]:
    """Write every result under ``out`` and return where each one is.

    The clean and the feature table are written first and read back, because
    every later step reads them.
    """
    spark = raw.sparkSession
    paths: dict[str, str] = {}

    def table(name: str, df: DataFrame) -> None:
        written = write_table(df, f"{out}/metrics/{name}")
        if written:
            paths[name] = written

    paths["clean"] = write_parquet(cleaning.clean(raw, spec), f"{out}/clean.parquet")
    clean = spark.read.parquet(paths["clean"])
    paths["features"] = write_parquet(features.build_features(clean, spec), f"{out}/features.parquet")
    feats = spark.read.parquet(paths["features"])
    regional = add_region_columns(feats, spec, dimension)
    chosen = profiling.representative_series(clean, spec, n_series)
    paths["representative"] = write_parquet(chosen, f"{out}/representative.parquet")
    chosen = spark.read.parquet(paths["representative"])

    columns = present(clean, spec.metrics + spec.pollutants)
    table("correlations", correlation.correlations(clean, columns))
    table("series_coverage", profiling.series_coverage(clean, spec))
    if "precip_mm" in clean.columns:
        table("precip_zero_inflation", profiling.zero_inflation(clean, spec))

    paths["anomalies"] = write_anomalies(
        anomaly.detect_anomalies(regional, spec, trees=trees), out, spec
    )
    found = spark.read.parquet(paths["anomalies"])
    if "condition_text" in found.columns:
        table("anomaly_condition_lift", anomaly.condition_lift(found, regional))
    table("anomaly_by_time", anomaly.anomalies_by_day(found, spec))

    paths.update(
        _forecasts(clean, feats, chosen, out, spec, factories or panel_model.model_factories(), table)
    )

    table("climate_seasonal_cycle", climate.seasonal_cycle(regional, spec=spec))
    pollutants = present(regional, spec.concentrations)
    if pollutants:
        drivers = present(regional, correlation.WEATHER_DRIVERS)
        table(
            "air_quality_weather_correlation",
            correlation.weather_pollutant_correlation(regional, drivers, pollutants),
        )
    if "air_quality_us_epa_index" in regional.columns:
        table("air_quality_epa_summary", air_quality.category_share(regional, spec=spec))
    table("geo_country_summary", spatial.country_summary(regional, spec))
    table("geo_continent_comparison", spatial.continent_comparison(regional, spec, dimension=dimension))

    factory = next(iter((factories or panel_model.model_factories()).values()))
    for name, lens in _importances(feats, spec, factory, repeats).items():
        table(f"feature_importance_{name}", lens)
    return paths


def _forecasts(
    clean: DataFrame,
    feats: DataFrame,
    chosen: DataFrame,
    out: str,
    spec: PanelSpec,
    factories: Mapping[str, panel_model.Factory],
    table,
) -> dict[str, str]:
    folds = forecast.make_time_folds(clean, spec.time)
    if not folds:
        return {}
    keys = list(spec.keys)
    daily = forecast.daily_series(clean, spec)
    represented = profiling.keep_series(daily, chosen, keys)
    per_series = forecast.backtest_series(represented, forecast.default_models(), folds, spec)

    names = features.feature_columns(feats.columns, spec)
    frame = panel_model.direct_frame(
        panel_model.daily_panel(feats, names, spec), names, folds[0].horizon, spec
    )
    oof = panel_model.backtest_panel(frame, names, factories, folds, spec)
    paths = {"oof": write_parquet(oof, f"{out}/oof.parquet")}
    oof = clean.sparkSession.read.parquet(paths["oof"])
    panel_scores = panel_model.score_panel(oof, daily, folds, spec)
    shared = profiling.keep_series(panel_scores, chosen, keys)
    comparison = forecast.summarize(per_series.unionByName(shared, allowMissingColumns=True))
    paths["model_comparison"] = write_parquet(comparison, f"{out}/model_comparison.parquet")
    comparison = clean.sparkSession.read.parquet(paths["model_comparison"])
    table("model_comparison", comparison.orderBy(F.asc_nulls_last("mase")))
    table("model_comparison_global_fullpanel", forecast.summarize(panel_scores))

    weights = ensemble.inverse_error_weights(comparison, drop_above=1.0)
    paths["ensemble_weights"] = write_weights(weights, f"{out}/metrics/ensemble_weights")
    models = list(factories)
    if len(models) > 1:
        matrix = ensemble.oof_matrix(oof, models, [*keys, "date"])
        stacked = ensemble.fit_stacker(matrix, models)
        rows = clean.sparkSession.createDataFrame(
            list(stacked.items()), "model string, weight double"
        )
        paths["stacking_weights"] = write_weights(rows, f"{out}/metrics/stacking_weights")
    final = ensemble.final_forecasts(represented, comparison, spec)
    paths["predictions"] = write_parquet(final, f"{out}/predictions.parquet")
    return paths


def _importances(
    feats: DataFrame, spec: PanelSpec, factory: panel_model.Factory, repeats: int
) -> dict[str, DataFrame]:
    names = [c for c in features.feature_columns(feats.columns, spec) if c not in LEAKY]
    known = panel_model.as_doubles(feats.where(F.col(spec.value).isNotNull()), names)
    known = known.withColumn("label", F.col(spec.value))
    if known.count() < 100:
        return {}
    train, valid = panel_model.chronological_split(known, spec.time)
    model = panel_model.fit(train, names, factory)
    return {
        "native": panel_model.native_importance(model),
        "permutation": panel_model.permutation_importance(
            model, valid, spec.grain, repeats=repeats
        ),
    }
