"""What the panel holds: columns, grain, coverage, dry days, representative series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.quantiles import quantiles
from paneltide.functions.scalar import hemisphere_zone
from paneltide.session import materialized
from paneltide.spec import WEATHER, PanelSpec


def _identity(field: T.StructField) -> Column:
    """A text that two values of the column share exactly if they are equal."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        c = F.unix_micros(c)  # local times can be the same for two instants
    elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # zeros of both signs are one value
    elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
        c = F.to_json(c)
    return c.cast("string")


def profile_schema(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, distinct values, percent null and the smallest value as example.

    Distinct values are exact: each row gives one (column, value) pair for each known value, and equal
    pairs are combined before the shuffle. A pair is narrow whatever the number of columns, where one
    aggregate with several distinct counts copies the key columns of all of them for each column.
    ``approximate`` keeps a sketch for each column instead and reads the rows once. A table
    without rows has 0 distinct values, 0 percent null and no example.
    """
    fields = df.schema.fields
    own = {f.name: F.col(f"`{f.name}`") for f in fields}
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("dtype"),
                    F.count(own[f.name]).alias("known"),
                    F.min(own[f.name]).cast("string").alias("example"),
                    (F.approx_count_distinct(own[f.name]) if approximate else F.lit(None).cast("long")).alias("sketched"),
                )
                for f in fields
            ]
        ).alias("cells"),
    ).select("rows", F.inline("cells"))
    if approximate:
        counted = totals.withColumn("n_unique", F.col("sketched"))
    else:
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), _identity(f).alias("value")) for f in fields])
        distinct = (
            df.select(F.inline(pairs))
            .where(F.col("value").isNotNull())
            .distinct()
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("n_unique"))
        )
        counted = totals.join(distinct, "column", "left")
    missing = F.coalesce((F.col("rows") - F.col("known")) / F.nullif(F.col("rows"), F.lit(0)) * 100, F.lit(0.0))
    return counted.select(
        "column",
        "dtype",
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.round(missing, 4).alias("pct_null"),
        "example",
    )


def grain_report(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """One row: rows, series, rows sharing a grain key, rows per series, time span."""
    per_grain = df.groupBy(*spec.grain).agg(F.count(F.lit(1)).alias("n"))
    per_series = per_grain.groupBy(*spec.keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup"),
        F.min(spec.time).alias("start"),
        F.max(spec.time).alias("end"),
    )
    totals = per_series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_series"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_key_rows"),
        F.coalesce(F.min("n"), F.lit(0)).alias("rows_per_series_min"),
        F.coalesce(F.max("n"), F.lit(0)).alias("rows_per_series_max"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
    )
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    middle = quantiles(sizes, [], ["n"], {"median": 0.5}).agg(F.max("n__median"))
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    return totals.withColumns(
        {
            "rows_per_series_median": F.coalesce(middle.scalar(), F.lit(0.0)),
            "span_days": F.coalesce(F.floor(seconds / 86400), F.lit(0)),
        }
    )


def series_coverage(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Per series: rows, first and last day, span and missing days."""
    daily = (
        df.where(F.col(spec.time).isNotNull())
        .groupBy(*spec.keys, F.to_date(spec.time).alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        daily.groupBy(*spec.keys)
        .agg(
            F.sum("_n").alias("n_obs"),
            F.min("_day").alias("first_date"),
            F.max("_day").alias("last_date"),
            F.count(F.lit(1)).alias("_days"),
        )
        .withColumn("span_days", F.datediff("last_date", "first_date"))
        .withColumn("n_gaps", F.greatest(F.lit(0), F.col("span_days") + 1 - F.col("_days")))
        .drop("_days")
    )


def zero_inflation(
    df: DataFrame, spec: PanelSpec = WEATHER, amount: str = "precip_mm"
) -> DataFrame:
    """Per country: share of dry rows, and a summary of the wet ones."""
    # Read for the sizes of groups, the quantiles and the rest.
    known = materialized(df.where(F.col(amount).isNotNull()).select(spec.country, amount)).withColumn(
        "wet", F.when(F.col(amount) > 0, F.col(amount))
    )
    base = known.groupBy(spec.country).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.round(F.count_if(F.col(amount) <= 0) / F.count(F.lit(1)) * 100, 4).alias("pct_dry_days"),
        F.count("wet").alias("wet_count"),
        F.avg("wet").alias("wet_mean"),
        F.stddev_samp("wet").alias("wet_std"),
        F.min("wet").alias("wet_min"),
        F.max("wet").alias("wet_max"),
    )
    quartiles = quantiles(
        known, [spec.country], ["wet"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    ).select(
        spec.country,
        F.col("wet__p25").alias("wet_p25"),
        F.col("wet__p50").alias("wet_p50"),
        F.col("wet__p75").alias("wet_p75"),
    )
    return base.join(quartiles, spec.country, "left")


def dry_extremes(
    df: DataFrame, spec: PanelSpec = WEATHER, amount: str = "precip_mm", k: int = 10
) -> DataFrame:
    """The ``k`` wettest and ``k`` driest countries; a missing amount counts as dry here."""
    share = (
        df.groupBy(spec.country)
        .agg(F.avg(F.when(F.coalesce(amount, F.lit(0.0)) <= 0, 1.0).otherwise(0.0)).alias("_dry"))
        .where(F.col(spec.country).isNotNull())
        .select(spec.country, (F.col("_dry") * 100).alias("pct_dry"))
    )
    return top_and_bottom(share, spec.country, "pct_dry", k)


def top_and_bottom(df: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The ``k`` smallest and ``k`` largest rows by ``value``, each once."""
    known = df.where(F.col(value).isNotNull())
    low = known.orderBy(F.asc(value), F.asc(name)).limit(k)
    high = known.orderBy(F.desc(value), F.desc(name)).limit(k)
    return low.unionByName(high).dropDuplicates([name])


def representative_series(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    n: int = 6,
    preferred: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """``n`` well covered series from different zones: ``(*keys, n_obs, zone, stage)``.

    Stage 1 takes preferred names, stage 2 the best covered series of each zone
    not seen yet, stage 3 fills up by coverage. ``n`` rows at most.
    """
    keys = list(spec.keys)
    name = name or keys[-1]
    middle = quantiles(df, keys, [spec.latitude], {"mid": 0.5})
    cover = (
        series_coverage(df, spec)
        .select(*keys, "n_obs")
        .join(middle, keys, "left")
        .select(*keys, "n_obs", hemisphere_zone(F.col(f"{spec.latitude}__mid")).alias("zone"))
    )
    order = [F.desc("n_obs"), *[F.asc(k) for k in keys]]
    named = cover.where(F.col(name).isin(*preferred)).orderBy(*order).limit(n)
    best = F.struct(-F.col("n_obs"), *keys)
    per_zone = cover.groupBy("zone").agg(F.min(best).alias("_best"))
    fresh = per_zone.join(F.broadcast(named.select("zone")), "zone", "left_anti").select(
        *[F.col("_best")[k].alias(k) for k in keys]
    )
    staged = (
        cover.join(
            F.broadcast(named.select(*keys, F.lit(1).alias("_named"))), keys, "left"
        )
        .join(fresh.select(*keys, F.lit(2).alias("_fresh")), keys, "left")
        .withColumn("stage", F.coalesce("_named", "_fresh", F.lit(3)))
        .drop("_named", "_fresh")
    )
    return staged.orderBy("stage", *order).limit(n)


def keep_series(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the chosen series only."""
    return df.join(chosen.select(*keys).distinct(), list(keys), "left_semi")
