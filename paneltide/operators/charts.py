"""Aggregates sized for drawing; the drawing itself is left to the reader's tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.joins import attach, attach_written
from paneltide.functions.quantiles import quantiles, value_counts
from paneltide.functions.scalar import bucket
from paneltide.session import materialized
from paneltide.spec import WEATHER, PanelSpec


def histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between each group's extremes: edges, count and density.

    Groups and values are written once; extremes and bins combine before their shuffles.
    """
    every = list(groups) or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(0))
    known = materialized(base.select(*every, F.col(value).cast("double").alias("v")).where("v is not null"))
    ends = materialized(
        known.groupBy(*every).agg(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("total")
        )
    )
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (
        attach_written(known, ends, every, spread=["v"], how="inner")
        .withColumn("bin", bucket(F.col("v"), F.col("lo"), F.col("hi"), bins))
        .groupBy(*every, "bin", "lo", "hi", "total")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return binned.select(
        *groups,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        "count",
        F.when(width > 0, F.col("count") / (F.col("total") * width)).alias("density"),
    )


def wet_histogram(df: DataFrame, amount: str = "precip_mm", bins: int = 40) -> DataFrame:
    wet = df.where(F.col(amount) > 0).select(F.log1p(amount).alias("log_amount"))
    return histogram(wet, "log_amount", bins)


def kernel_density(df: DataFrame, value: str, group: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on a grid between the extremes, Scott bandwidth.

    Every distinct value contributes to every grid point; equal values are
    combined first and the sums combine on the map side.
    """
    counts = value_counts(df, [group], [value]).drop("column")
    n, v = F.col("n"), F.col("v")
    total = F.sum("n")
    mean = F.sum(n * v) / total
    stats = counts.groupBy(group).agg(
        total.alias("_total"),
        mean.alias("_mean"),
        F.min("v").alias("_lo"),
        F.max("v").alias("_hi"),
    )
    spread = attach(counts, stats, [group], spread=["v"], how="inner")
    variance = spread.groupBy(group).agg(
        (
            F.sum(n * (v - F.col("_mean")) ** 2) / F.nullif(F.max("_total") - 1, F.lit(0))
        ).alias("_var")
    )
    shape = stats.join(variance, group).where("_var > 0").withColumn(
        "_h", F.sqrt("_var") * F.pow(F.col("_total"), F.lit(-0.2))
    )
    at = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    z = (at - v) / F.col("_h")
    height = n * F.exp(-z * z / 2) / (F.col("_total") * F.col("_h") * F.sqrt(F.lit(2) * F.pi()))
    return (
        attach(counts, shape, [group], spread=["v"], how="inner")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(group, "point")
        .agg(F.max(at).alias("grid_value"), F.sum(height).alias("density"))
    )


def monthly_trend(
    df: DataFrame, spec: PanelSpec = WEATHER, value: str | None = None, rolling: int = 3
) -> DataFrame:
    """Per series and month: mean and trailing mean of the last months that have data.

    At most one row per calendar month and series reaches the window.
    """
    value = value or spec.value
    months = (
        df.where(F.col(value).isNotNull() & F.col(spec.time).isNotNull())
        .groupBy(*spec.keys, F.to_date(F.date_trunc("month", spec.time)).alias("month"))
        .agg(F.avg(value).alias("mean"))
    )
    series = Window.partitionBy(*spec.keys)
    recent = series.orderBy("month").rowsBetween(-(rolling - 1), 0)
    enough = F.count(F.lit(1)).over(series) >= rolling
    return months.withColumn("rolling_mean", F.when(enough, F.avg("mean").over(recent)))


def trend_slope(trend: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Least-squares slope per year of the monthly means; null below two months."""
    first = F.min("month").over(Window.partitionBy(*spec.keys))
    years = F.datediff("month", first) / F.lit(365.25)
    return (
        trend.select(*spec.keys, "mean", years.alias("_x"))
        .groupBy(*spec.keys)
        .agg(
            F.count(F.lit(1)).alias("n_months"),
            F.when(F.count(F.lit(1)) >= 2, F.regr_slope("mean", "_x")).alias("slope_per_year"),
        )
    )


def density_grid(
    df: DataFrame, x: str, y: str, bins: int = 40, min_pairs: int = 10
) -> DataFrame:
    """Counts on a rectangular grid, with log10; empty below ``min_pairs`` pairs."""
    pairs = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    ends = pairs.agg(
        F.struct(
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
            F.count(F.lit(1)).alias("n"),
        )
    ).scalar()
    placed = pairs.withColumn("_e", ends).where(F.col("_e")["n"] >= min_pairs)
    return (
        placed.groupBy(
            bucket(F.col("x"), F.col("_e")["x0"], F.col("_e")["x1"], bins).alias("x_bin"),
            bucket(F.col("y"), F.col("_e")["y0"], F.col("_e")["y1"], bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("log10_count", F.log10("count"))
    )


def box_stats(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 IQR of the box."""
    groups = list(groups)
    df = materialized(df.select(*groups, value))
    box = materialized(
        quantiles(df, groups, [value], {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(
            *groups,
            F.col(f"{value}__n").alias("n"),
            *[F.col(f"{value}__{q}").alias(q) for q in ("q1", "median", "q3")],
        )
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(value)
    inside = F.when((v >= F.col("q1") - reach) & (v <= F.col("q3") + reach), v)
    ends = (
        attach_written(df.where(v.isNotNull()), box, groups, spread=[value], how="inner")
        .groupBy(*groups)
        .agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
    )
    return box.join(ends, groups)


def monthly_band(df: DataFrame, spec: PanelSpec = WEATHER, value: str | None = None) -> DataFrame:
    """Median and quartiles over all rows of each month."""
    value = value or spec.value
    month = F.to_date(F.date_trunc("month", spec.time)).alias("month")
    dated = materialized(df.select(month, value))  # read for the sizes of groups and for the quantiles
    points = quantiles(dated, ["month"], [value], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return points.where(F.col(f"{value}__n") > 0).select(
        "month", *[F.col(f"{value}__{q}").alias(q) for q in ("q1", "median", "q3")]
    )


def score_cut(df: DataFrame, score: str, contamination: float) -> DataFrame:
    """Lower contamination quantile of a score and how many rows do not exceed it."""
    cut = quantiles(df, [], [score], {"cut": contamination}).select(f"{score}__cut").scalar()
    known = df.where(F.col(score).isNotNull()).select(F.col(score), cut.alias("cut"))
    return known.groupBy("cut").agg(
        F.count_if(F.col(score) <= F.col("cut")).alias("n_flagged"),
        F.count(F.lit(1)).alias("n_scores"),
    )


def model_ranking(summary: DataFrame, metric: str = "mase") -> DataFrame:
    """Rank of each model, best first, and whether it beats the seasonal baseline.

    One row per model reaches the window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last(metric), "model")
    return summary.select(
        "model",
        metric,
        F.coalesce(F.col(metric) < 1, F.lit(False)).alias("beats_baseline"),
        F.row_number().over(order).alias("rank"),
    )
