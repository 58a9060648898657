"""Two-stage regional aggregates: every place has one vote per period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.quantiles import quantiles
from paneltide.functions.scalar import UNKNOWN
from paneltide.operators.regions import ensure_region
from paneltide.spec import WEATHER, PanelSpec


def place_period_means(
    df: DataFrame,
    region: str,
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    period: str = "month",
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Stage one: mean per (region, place, period); unknown regions and nulls drop out."""
    value = value or spec.value
    return (
        ensure_region(df, region, spec, dimension)
        .where(F.col(region).isNotNull() & (F.col(region) != UNKNOWN))
        .where(F.col(value).isNotNull() & F.col(spec.time).isNotNull())
        .groupBy(region, *spec.keys, F.to_date(F.date_trunc(period, spec.time)).alias("period"))
        .agg(F.avg(value).alias("place_mean"))
    )


def seasonal_cycle(
    df: DataFrame,
    region: str = "climate_zone",
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Per region and month: mean, spread and 10/90 % points over place means."""
    places = place_period_means(df, region, spec, value, "month", dimension)
    moments = places.groupBy(region, "period").agg(
        F.avg("place_mean").alias("mean"),
        F.stddev_samp("place_mean").alias("std"),
        F.count("place_mean").alias("n_cities"),
    )
    tails = quantiles(places, [region, "period"], ["place_mean"], {"p10": 0.1, "p90": 0.9})
    return moments.join(tails, [region, "period"]).select(
        region,
        F.col("period").alias("year_month"),
        "mean",
        "std",
        F.col("place_mean__p10").alias("p10"),
        F.col("place_mean__p90").alias("p90"),
        "n_cities",
    )


def period_over_period(
    df: DataFrame,
    region: str = "climate_zone",
    spec: PanelSpec = WEATHER,
    value: str | None = None,
    period: str = "week",
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Change of the regional mean against the previous period that has data.

    The window runs over periods of one region, at most one row per calendar period.
    """
    places = place_period_means(df, region, spec, value, period, dimension)
    regional = places.groupBy(region, "period").agg(
        F.avg("place_mean").alias("mean"), F.count("place_mean").alias("n_cities")
    )
    before = F.lag("mean").over(Window.partitionBy(region).orderBy("period"))
    return regional.withColumn("delta", F.col("mean") - before)


def sample_span(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """First and last day and the length of the sample in days and months."""
    span = df.agg(F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi"))
    seconds = F.unix_timestamp("_hi") - F.unix_timestamp("_lo")
    return span.select(
        F.to_date("_lo").alias("first_date"),
        F.to_date("_hi").alias("last_date"),
        F.datediff("_hi", "_lo").alias("span_days"),
        (F.floor(seconds / 86400) / 30.44).alias("months"),
    )


def month_grid(cycle: DataFrame) -> DataFrame:
    """Region by calendar month, all twelve columns, from a seasonal cycle."""
    region = cycle.columns[0]
    return (
        cycle.groupBy(region, F.month("year_month").alias("_m"))
        .agg(F.avg("mean").alias("_v"))
        .groupBy(region)
        .pivot("_m", list(range(1, 13)))
        .agg(F.first("_v"))
        .withColumnsRenamed({str(m): f"m{m:02d}" for m in range(1, 13)})
    )
