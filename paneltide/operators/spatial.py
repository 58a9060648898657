"""Latest snapshots, peer comparison and country or continent summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.functions.joins import attach
from paneltide.functions.quantiles import quantiles
from paneltide.functions.scalar import air_quality_label
from paneltide.operators.cleaning import last_rows
from paneltide.operators.profiling import top_and_bottom
from paneltide.operators.regions import add_continent, ensure_region
from paneltide.spec import WEATHER, PanelSpec, present


def latest_snapshot(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """The most recent row of each series; combined on the map side, no sort."""
    timed = df.where(F.col(spec.time).isNotNull())
    return last_rows(timed, spec.keys, [spec.time, *spec.order])


def valid_geo(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Rows with real coordinates; (0, 0) stands for missing."""
    if not {spec.latitude, spec.longitude} <= set(df.columns):
        return df
    lat, lon = F.col(spec.latitude), F.col(spec.longitude)
    return df.where(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)))


def peer_anomaly(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    zone: str = "climate_zone",
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Each place's latest value against its zone: mean, difference and z-score."""
    value = value or spec.value
    places = ensure_region(valid_geo(latest_snapshot(df, spec), spec), zone, spec, dimension)
    peers = places.groupBy(zone).agg(
        F.avg(value).alias("zone_mean"), F.stddev_samp(value).alias("_std")
    )
    away = F.col(value) - F.col("zone_mean")
    return (
        attach(places, peers, [zone], spread=spec.keys)
        .withColumn("anomaly", away)
        .withColumn("anomaly_z", F.coalesce(F.when(F.col("_std") != 0, away / F.col("_std")), F.lit(0.0)))
        .drop("_std")
    )


def anomaly_color_bound(peers: DataFrame) -> DataFrame:
    """Symmetric bound for drawing: 98 % point of the absolute z, at least one half."""
    size = peers.select(F.abs("anomaly_z").alias("z"))
    return quantiles(size, [], ["z"], {"p98": 0.98}).select(
        F.greatest(F.col("z__p98"), F.lit(0.5)).alias("bound")
    )


def latest_air_quality(
    df: DataFrame, spec: PanelSpec = WEATHER, index: str = "air_quality_us_epa_index"
) -> DataFrame:
    """Air-quality category of each place's latest snapshot."""
    return (
        valid_geo(latest_snapshot(df, spec), spec)
        .withColumn("epa_label", air_quality_label(F.col(index)))
        .where(F.col("epa_label").isNotNull())
        .select(*spec.keys, spec.latitude, spec.longitude, "epa_label")
    )


def country_summary(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    values: Sequence[str] = ("temperature_celsius", "humidity", "wind_kph", "air_quality_pm2_5"),
) -> DataFrame:
    """Per country: mean of place means, places, distinct snapshots and distinct days.

    Snapshots and days are distinct per place and summed over places.
    """
    values = present(df, values)
    per_time = df.groupBy(*spec.keys, spec.time).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in values],
        *[F.count(c).alias(f"_n_{c}") for c in values],
    )
    per_day = per_time.groupBy(*spec.keys, F.to_date(spec.time).alias("_day")).agg(
        *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in values],
        *[F.sum(f"_n_{c}").alias(f"_n_{c}") for c in values],
        F.count(spec.time).alias("n_snapshots"),
    )
    places = per_day.groupBy(*spec.keys).agg(
        *[(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_n_{c}"), F.lit(0))).alias(c) for c in values],
        F.sum("n_snapshots").alias("n_snapshots"),
        F.count("_day").alias("n_days"),
    )
    return places.groupBy(spec.country).agg(
        *[F.avg(c).alias(c) for c in values],
        F.count(F.lit(1)).alias("n_cities"),
        F.sum("n_snapshots").alias("n_snapshots"),
        F.sum("n_days").alias("n_days"),
    )


def continent_comparison(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Per continent over country means: mean, spread, 10/50/90 % points and counts."""
    value = value or spec.value
    countries = add_continent(country_summary(df, spec, [value]), spec.country, dimension)
    moments = countries.groupBy("continent").agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count(spec.country).alias("n_countries"),
        F.sum("n_cities").alias("n_cities"),
    )
    points = quantiles(countries, ["continent"], [value], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return moments.join(points, "continent").select(
        "continent",
        "mean",
        "std",
        F.col(f"{value}__p10").alias("p10"),
        F.col(f"{value}__p50").alias("p50"),
        F.col(f"{value}__p90").alias("p90"),
        "n_countries",
        "n_cities",
    )


def extreme_countries(
    summary: DataFrame, value: str, country: str = "country", k: int = 15
) -> DataFrame:
    """The ``k`` lowest and highest countries and their distance from the mean of all."""
    center = summary.agg(F.avg(value)).scalar()
    return top_and_bottom(summary, country, value, k).select(
        country, value, (F.col(value) - center).alias("deviation")
    )


def robust_range(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentile range for drawing; a degenerate one becomes mean plus or minus one."""
    stats = df.agg(F.avg(value).alias("_mean"))
    ends = quantiles(df, [], [value], {"lo": low, "hi": high}).select(
        F.struct(F.col(f"{value}__lo").alias("lo"), F.col(f"{value}__hi").alias("hi"))
    )
    both = stats.withColumn("_ends", ends.scalar())
    lo, hi, mean = F.col("_ends")["lo"], F.col("_ends")["hi"], F.col("_mean")
    flat = lo.isNull() | (lo == hi)
    return both.select(
        F.coalesce(F.when(flat, mean - 1).otherwise(lo), F.lit(0.0)).alias("lo"),
        F.coalesce(F.when(flat, mean + 1).otherwise(hi), F.lit(1.0)).alias("hi"),
    )
