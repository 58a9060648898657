"""Air-quality categories and binned pollutant medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.quantiles import quantiles_of_counts, value_counts
from paneltide.functions.scalar import AIR_QUALITY_LABELS, air_quality_label
from paneltide.operators.regions import ensure_region
from paneltide.session import materialized
from paneltide.spec import WEATHER, PanelSpec


def category_share(
    df: DataFrame,
    group: str = "continent",
    spec: PanelSpec = WEATHER,
    index: str = "air_quality_us_epa_index",
    dimension: DataFrame | None = None,
) -> DataFrame:
    """Count and share of each air-quality category within a group.

    A group column that can be neither found nor derived becomes one ``All`` bucket.
    """
    try:
        grouped = ensure_region(df, group, spec, dimension)
    except KeyError:
        grouped = df.withColumn(group, F.lit("All"))
    counts = (
        grouped.withColumn("epa_label", air_quality_label(F.col(index)))
        .where(F.col("epa_label").isNotNull() & F.col(group).isNotNull())
        .groupBy(group, "epa_label")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # At most six rows per group.
    total = F.sum("count").over(Window.partitionBy(group))
    return counts.withColumn("share", F.col("count") / total)


def share_grid(shares: DataFrame) -> DataFrame:
    """Group by category, zero where a category does not occur."""
    group = shares.columns[0]
    return (
        shares.groupBy(group)
        .pivot("epa_label", list(AIR_QUALITY_LABELS))
        .agg(F.first("share"))
        .fillna(0.0)
    )


def binned_median(
    df: DataFrame,
    pollutant: str = "air_quality_pm2_5",
    drivers: Sequence[str] = ("wind_kph", "precip_mm"),
    bins: int = 5,
) -> DataFrame:
    """Median pollutant per quantile bin of each driver, lowest bin first.

    Bins are closed on the right and cut at exact linear quantiles; equal cuts merge.
    """
    drivers = [d for d in drivers if d in df.columns]
    # Rows are written once, not once for each driver, and read twice: both times they become counts of
    # values before the shuffle, from which sizes, cuts and medians follow.
    rows = materialized(
        df.select(F.col(pollutant).alias("y"), *drivers).where(F.col("y").isNotNull())
    )
    cuts = {f"c{i}": i / bins for i in range(bins + 1)}
    values = materialized(value_counts(rows, [], drivers))
    edges = quantiles_of_counts(values, ["column"], cuts).select(
        F.col("column").alias("driver"), F.array_distinct(F.array(*cuts)).alias("edges")
    )
    edges = materialized(edges)
    pairs = rows.select(
        "y",
        F.inline(
            F.array(*[F.struct(F.lit(d).alias("driver"), F.col(d).cast("double").alias("x")) for d in drivers])
        ),
    ).where(F.col("x").isNotNull())
    # One row per driver: a lookup table of a few rows by construction.
    placed = pairs.join(F.broadcast(edges), "driver").where(F.size("edges") > 1)
    above = F.size(F.filter("edges", lambda e: e < F.col("x")))
    placed = placed.select(
        "driver", F.greatest(above, F.lit(1)).alias("bin_rank"), F.col("y").cast("double").alias("v")
    )
    by_bin = ["driver", "bin_rank"]
    counts = materialized(placed.groupBy(*by_bin, "v").agg(F.count(F.lit(1)).alias("n")))
    known = ~F.isnan("v")
    sizes = counts.groupBy(*by_bin).agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("y__n"))
    found = quantiles_of_counts(counts.where(known), by_bin, {"y__median": 0.5}).drop("total")
    medians = sizes.join(found, by_bin, "left")
    lookup = medians.join(F.broadcast(edges), "driver")
    present_rank = F.row_number().over(Window.partitionBy("driver").orderBy("bin_rank"))
    return lookup.select(
        "driver",
        F.get("edges", F.col("bin_rank") - 1).alias("bin_low"),
        F.get("edges", F.col("bin_rank")).alias("bin_high"),
        present_rank.alias("bin_rank"),
        F.col("y__n").alias("n"),
        F.col("y__median").alias("pm_median"),
    )
