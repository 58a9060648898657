"""Exact ranks and quantiles that never gather one group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one hash map. A
group that holds a third of a very large table does not fit, so the quantiles
here come from ranks instead (groups counted to be small are simply sorted):

1. ``value_counts`` collapses rows to (group, value, count) with map-side
   combining, which also absorbs values that repeat a lot;
2. ``order_bucket`` cuts the value axis into fixed, order-preserving buckets and each
   of those into finer ones, so (group, bucket, part) is a unit of work even when the
   group is huge and its values lie close together;
3. totals give each bucket's first rank and then each part's, and only the parts a
   wanted rank falls in are sorted.

The bucket of a value depends on the value alone, so recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneltide.functions.joins import attach
from paneltide.functions.skew import GROUP_LIMIT, by_group_size
from paneltide.session import materialized

# Buckets per factor of e in magnitude: values within 0.1 % share a bucket, within one in a million a part of it.
RESOLUTION = 1024
FINE = RESOLUTION * 1024


def order_bucket(value: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone bucket number: b(x) < b(y) implies x < y."""
    shift = 800 * resolution
    endless = F.abs(value) == float("inf")
    magnitude = F.when(endless, F.lit(2 * shift)).otherwise(
        F.floor(F.log(F.when(~endless, F.abs(value))) * resolution) + F.lit(shift)
    )
    return (
        F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("long")
    )


def value_counts(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long counts ``(*groups, column, v, n)`` of the non-null values."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
            for c in values
        ]
    )
    long = df.select(*groups, F.inline(cells)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    for g in groups:
        long = long.where(F.col(g).isNotNull())
    return long.groupBy(*groups, "column", "v").agg(F.count(F.lit(1)).alias("n"))


def _bucketed(counts: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts with bucket and part, the totals of the parts, and per bucket its first rank and the group total."""
    bucketed = counts.withColumns(
        {"_b": order_bucket(F.col("v")), "_f": order_bucket(F.col("v"), FINE)}
    )
    parts = bucketed.groupBy(*groups, "_b", "_f").agg(F.sum("n").alias("_fn"))
    by_group = Window.partitionBy(*groups)
    starts = (
        bucketed.groupBy(*groups, "_b")
        .agg(F.sum("n").alias("_bn"))
        .withColumn("_start", F.sum("_bn").over(by_group.orderBy("_b")) - F.col("_bn"))
        .withColumn("total", F.sum("_bn").over(by_group))
    )
    return bucketed, parts, starts


def _placed(parts: DataFrame, starts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The parts of the buckets in ``starts`` with their own first rank."""
    within = Window.partitionBy(*groups, "_b").orderBy("_f")
    return (
        parts.join(starts, [*groups, "_b"])
        .withColumn("_start", F.col("_start") + F.sum("_fn").over(within) - F.col("_fn"))
        .drop("_bn")
    )


def _ranked(bucketed: DataFrame, placed: DataFrame, groups: Sequence[str]) -> DataFrame:
    within = Window.partitionBy(*groups, "_b", "_f").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        bucketed.join(placed, [*groups, "_b", "_f"])
        .withColumn("before", F.col("_start") + F.sum("n").over(within) - F.col("n"))
        .drop("_b", "_f", "_fn", "_start")
    )


def ranks_of_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Add ``before`` (rows with a smaller value), ``total`` and the average ``rank``."""
    bucketed, parts, starts = _bucketed(counts, groups)
    ranked = _ranked(bucketed, _placed(parts, starts, groups), groups)
    return ranked.withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def quantiles_of_counts(
    counts: DataFrame, groups: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group: ``(*groups, total, *probs)``."""
    bucketed, parts, starts = _bucketed(counts, groups)
    last = F.col("total") - 1

    def lower(p: float) -> Column:
        return F.floor(F.lit(float(p)) * last).cast("long")

    def upper(p: float) -> Column:
        return F.least(lower(p) + 1, last)

    wanted = [rank(p) for p in probs.values() for rank in (lower, upper)]

    def holds(start: Column, size: Column, rank: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    def any_of(start: Column, size: Column) -> Column:
        hit = F.lit(False)
        for rank in wanted:
            hit = hit | holds(start, size, rank)
        return hit

    needed = starts.where(any_of(F.col("_start"), F.col("_bn")))
    fine = _placed(parts, needed, groups).where(any_of(F.col("_start"), F.col("_fn")))
    ranked = _ranked(bucketed, fine, groups).where(any_of(F.col("before"), F.col("n")))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(F.col("before"), F.col("n"), rank), F.col("v")))

    def interpolated(p: float) -> Column:
        lo, hi = at(lower(p)), at(upper(p))
        return _between(lo, hi, F.max(F.lit(float(p)) * last - lower(p)))

    return ranked.groupBy(*groups).agg(
        F.max("total").alias("total"),
        *[interpolated(p).alias(name) for name, p in probs.items()],
    )


def _interpolated(ordered: Column, p: float) -> Column:
    """Quantile of a sorted array."""
    last = F.size(ordered) - 1
    spot = F.lit(float(p)) * last
    low = F.floor(spot).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, last))
    return _between(a, b, spot - low)


def _between(low: Column, high: Column, fraction: Column) -> Column:
    """The value a fraction of the way up; equal ends, also infinite ones, are their own middle."""
    return F.when((low == high) | (fraction == 0), low).otherwise(low + (high - low) * fraction)


def known(c: str) -> Column:
    """The values of a column that quantiles are made of: neither null nor NaN."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def middle_of_sorted(ordered: Column) -> Column:
    """Median of a sorted array."""
    return _interpolated(ordered, 0.5)


def _gathered(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    probs: Mapping[str, float],
    mad: bool,
) -> DataFrame:
    """Quantiles of groups known to be small: one shuffle, sorted arrays."""

    def distances(c: str) -> Column:
        return F.sort_array(F.transform(c, lambda x: F.abs(x - F.col(f"_med_{c}"))))

    out = df.groupBy(*groups).agg(*[F.collect_list(known(c)).alias(c) for c in values])
    out = out.withColumns({c: F.sort_array(c) for c in values})
    named = {f"{c}__n": F.size(c).cast("long") for c in values}
    named |= {f"{c}__{k}": _interpolated(F.col(c), p) for c in values for k, p in probs.items()}
    if mad:
        out = out.withColumns({f"_med_{c}": _interpolated(F.col(c), 0.5) for c in values})
        named |= {f"{c}__mad": _interpolated(distances(c), 0.5) for c in values}
    return out.select(*groups, *[e.alias(k) for k, e in named.items()])


def _by_rank(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    probs: Mapping[str, float],
    mad: bool,
) -> DataFrame:
    """Quantiles of groups of any size, through ranks."""
    cells = [*groups, "column"]
    # Read several times below, and only large groups come here.
    counts = materialized(value_counts(df, groups, values))
    wanted = dict(probs) | ({"_med": 0.5} if mad else {})
    long = quantiles_of_counts(counts, cells, wanted).drop("total")
    stats = list(probs)
    if mad:
        deviations = (
            attach(counts, long.select(*cells, "_med"), cells, spread=["v"], how="inner")
            .select(*cells, F.abs(F.col("v") - F.col("_med")).alias("v"), "n")
            .groupBy(*cells, "v")
            .agg(F.sum("n").alias("n"))
        )
        mads = quantiles_of_counts(deviations, cells, {"mad": 0.5}).drop("total")
        long = long.join(mads, cells)
        stats.append("mad")
    found = long.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{c}__{k}")
            for c in values
            for k in stats
        ]
    )
    # every group, also one whose values are all null
    known = [F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{c}__n") for c in values]
    every = df.groupBy(*groups).agg(*known).join(found, list(groups), "left")
    return every.select(*groups, *[f"{c}__{k}" for c in values for k in ["n", *stats]])


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    values: Sequence[str],
    probs: Mapping[str, float],
    mad: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per group with ``<value>__n``, ``<value>__<prob>`` and on request ``<value>__mad``.

    Groups of at most ``limit`` rows are gathered and sorted in one task, the
    others go through ranks. Rows with a null in ``groups`` belong to no group.
    """
    every = list(groups)
    values = list(values)
    if not every:
        df, every = df.withColumn("_all", F.lit(0)), ["_all"]
    df = df.select(*every, *[v for v in values if v not in every])
    for g in every:
        df = df.where(F.col(g).isNotNull())
    out = by_group_size(
        df,
        every,
        small=lambda rows: _gathered(rows, every, values, probs, mad),
        large=lambda rows: _by_rank(rows, every, values, probs, mad),
        limit=limit,
    )
    return out if groups else out.drop("_all")
