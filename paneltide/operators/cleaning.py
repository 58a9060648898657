"""Cleaning: duplicates, physical bounds, gap filling, outlier flags, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paneltide.functions.joins import attach
from paneltide.functions.positions import BLOCK_ROWS, in_time, positions_by_range, with_blocks
from paneltide.functions.quantiles import known, middle_of_sorted, quantiles
from paneltide.functions.skew import GROUP_LIMIT, by_group_size
from paneltide.session import materialized
from paneltide.spec import MAD_SCALE, WEATHER, Z_THRESHOLD, PanelSpec, present

MAX_STEPS = 2
#: Rows of a place and month that are gathered whole, to be judged where their median is found.
TOGETHER = 1 << 14
#: Hashes of keys that rows are counted by.
HASHES = 1 << 18


def collisions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows share their key with another row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_collision_rows")
    )


def last_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Sequence[str] | None = None,
    total: bool = False,
    rare: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The row of each key that comes last by ``order``, then by its other columns.

    The result never depends on the order of files or tasks. It returns the keys and the ``wanted``
    columns. Where ``order`` is ``total``, no other column is read; otherwise all take part in the
    comparison. One aggregate, combined on the map side. Where repeated keys are ``rare``, rows go to
    their key's task as they are, since sorting them by key before that, which combining takes, spills
    more than it saves; only rows whose key, or another of the same hash, has more than ``limit``
    rows are then combined first.
    """
    wanted = [c for c in df.columns if wanted is None or c in wanted or c in keys]
    rest = [c for c in (wanted if total else df.columns) if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    shown = [c if c in keys else F.col("_last")[c].alias(c) for c in wanted]
    if not rare:
        return df.groupBy(*keys).agg(last).select(*shown)
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(HASHES)))
    chosen = by_group_size(
        hashed,
        ["_hash"],
        # the last key, a time, first: rows are sorted by it faster than by texts that are often equal
        small=lambda rows: rows.repartition(*keys).groupBy(*reversed(keys)).agg(last).select(*keys, "_last"),
        large=lambda rows: rows.groupBy(*keys).agg(last),
        limit=limit,
    )
    return chosen.select(*shown)


def dedup(df: DataFrame, spec: PanelSpec = WEATHER, wanted: Sequence[str] | None = None) -> DataFrame:
    """Drop exact copies, then keep the last row of each key and time, or its ``wanted`` columns.

    "Last" follows ``spec.order``. Without one, all other columns decide, so the
    result never depends on file or task order. One heavily repeated key stays
    cheap because its rows combine before the shuffle.
    """
    return last_rows(df, spec.grain, spec.order, wanted, spec.total, rare=True)


def gate_bounds(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Null out physically impossible readings; nothing is clipped."""
    gates = {
        c: F.when(F.col(c).between(lo, hi), F.col(c))
        for c, (lo, hi) in spec.bounds.items()
        if c in df.columns
    }
    return df.withColumns(gates) if gates else df


def _known_position(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.col("_pos"))


def _near(c: str, upto: WindowSpec, onward: WindowSpec) -> dict[str, Column]:
    """Position and value of the nearest known reading at or before, and at or after."""
    return {
        f"_pi_{c}": F.last(_known_position(c), ignorenulls=True).over(upto),
        f"_pv_{c}": F.last(c, ignorenulls=True).over(upto),
        f"_qi_{c}": F.last(_known_position(c), ignorenulls=True).over(onward),
        f"_qv_{c}": F.last(c, ignorenulls=True).over(onward),
    }


def _neighbours_in_series(
    df: DataFrame, columns: Sequence[str], spec: PanelSpec
) -> DataFrame:
    series = Window.partitionBy(*spec.keys)
    number = F.row_number().over(series.orderBy(*in_time(spec)))
    placed = df.withColumn("_pos", number.cast("long") - 1)
    upto = series.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    onward = series.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    near = {k: e for c in columns for k, e in _near(c, upto, onward).items()}
    return placed.withColumns(near)


def _neighbours_in_blocks(
    df: DataFrame, columns: Sequence[str], spec: PanelSpec, block_rows: int
) -> DataFrame:
    """Same columns for series of any length: what lies outside a row's block is
    carried in from per-block first and last known readings."""
    blocks = with_blocks(positions_by_range(df, spec).drop("_len"), block_rows)
    block = ["_series", "_block"]  # never null, so rows stay in the task of their window when they are joined

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("i"), F.col(c).alias("v")))

    edges = blocks.groupBy(*block).agg(
        *[F.max(known(c)).alias(f"_last_{c}") for c in columns],
        *[F.min(known(c)).alias(f"_first_{c}") for c in columns],
    )
    series = Window.partitionBy("_series")
    earlier = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = series.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *block,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_out_{c}") for c in columns],
    )
    inside = Window.partitionBy(*block)
    upto = inside.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    near = {k: e for c in columns for k, e in _near(c, upto, onward).items()}
    joined = blocks.withColumns(near).join(carried, block, "left")
    sides = [("p", "in"), ("q", "out")]
    return joined.withColumns(
        {
            f"_{s}{f}_{c}": F.coalesce(f"_{s}{f}_{c}", F.col(f"_{carry}_{c}")[f])
            for c in columns
            for s, carry in sides
            for f in "iv"
        }
    ).drop("_series", "_block", "_own", *[f"_{carry}_{c}" for c in columns for _, carry in sides])


def _parts(c: str) -> tuple[Column, Column, Column, Column, Column]:
    """Previous position and value, next value, steps since the previous, slope."""
    pi, pv, qi, qv = (F.col(f"_{part}_{c}") for part in ("pi", "pv", "qi", "qv"))
    return pi, pv, qi, qv, (qv - pv) / (qi - pi)


def _filled_both_ways(c: str) -> Column:
    """Linear over row positions, at most two rows from either side, then edge values."""
    pi, pv, qi, qv, step = _parts(c)
    i = F.col("_pos")
    near = (i - pi <= MAX_STEPS) | (qi - i <= MAX_STEPS)
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(pi.isNull(), qv)
        .when(qi.isNull(), pv)
        .otherwise(pv + step * F.when(near, i - pi).otherwise(F.lit(MAX_STEPS)))
    )


def _filled_forward(c: str) -> Column:
    """Linear for two rows after a known value, then held; nothing before the first."""
    pi, pv, qi, qv, step = _parts(c)
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(qi.isNull(), pv)
        .otherwise(pv + step * F.least(F.col("_pos") - pi, F.lit(MAX_STEPS)))
    )


def impute_missing(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    limit: int = GROUP_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill gaps per series; the target is never invented.

    Structural zeros become 0, continuous readings are interpolated over row
    positions from both sides, pollutants only forward with a
    ``_was_missing`` flag, categories get an explicit ``unknown``.
    """
    zero = present(df, spec.structural_zero)
    continuous = [
        c for c in present(df, spec.metrics) if c != spec.value and c not in spec.structural_zero
    ]
    pollutants = present(df, spec.pollutants)
    gappy = [*continuous, *pollutants]
    numeric = df.withColumns({c: F.col(c).cast("double") for c in gappy})
    filled = by_group_size(
        numeric,
        spec.keys,
        small=lambda rows: _neighbours_in_series(rows, gappy, spec),
        large=lambda rows: _neighbours_in_blocks(rows, gappy, spec, block_rows),
        limit=limit,
    )
    changes = {c: F.coalesce(c, F.lit(0.0)) for c in zero}
    changes |= {c: _filled_both_ways(c) for c in continuous}
    for c in pollutants:
        changes[f"{c}_was_missing"] = F.col(c).isNull().cast("tinyint")
        value = _filled_forward(c)
        changes[c] = F.bround(value).cast("smallint") if c in spec.indices else value
    changes |= {c: F.coalesce(c, F.lit("unknown")) for c in present(df, spec.categorical)}
    helpers = [f"_{part}_{c}" for part in ("pi", "pv", "qi", "qv") for c in gappy]
    return filled.withColumns(changes).drop("_pos", *helpers)


def flag_outliers(
    df: DataFrame,
    spec: PanelSpec = WEATHER,
    columns: Sequence[str] | None = None,
    threshold: float = Z_THRESHOLD,
    limit: int = TOGETHER,
) -> DataFrame:
    """Add ``<column>_is_outlier``: robust z within (series, calendar month) beyond the threshold.

    Rows of groups of at most ``limit`` rows are sent once and judged where their medians are found;
    the medians of larger groups are joined to their rows. Reads ``df`` twice; pass a written table.
    """
    columns = list(columns) if columns else present(df, spec.metrics)
    groups = [*spec.keys, "_month"]
    shown = df.columns

    def judged(rows: DataFrame, middle: str, mad: str) -> DataFrame:
        def is_outlier(c: str) -> Column:
            spread = F.col(mad.format(c))
            z = F.lit(MAD_SCALE) * (F.col(c) - F.col(middle.format(c))) / spread
            return F.coalesce(F.when(spread > 0, F.abs(z) > threshold), F.lit(False))

        return rows.select(*[F.col(f"`{c}`") for c in shown], *[is_outlier(c).alias(f"{c}_is_outlier") for c in columns])

    def far(c: str) -> Column:
        return F.transform(f"_all_{c}", lambda v: F.abs(v - F.col(f"_mid_{c}")))

    def gathered(rows: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in shown])
        sent = rows.repartition(*groups).groupBy(*groups).agg(
            F.collect_list(row).alias("_rows"), *[F.sort_array(F.collect_list(known(c))).alias(f"_all_{c}") for c in columns]
        )
        whole = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups])  # others have no median
        sent = sent.withColumns({f"_mid_{c}": middle_of_sorted(F.col(f"_all_{c}")) for c in columns})
        mads = {f"_mad_{c}": F.when(whole, middle_of_sorted(F.sort_array(far(c)))) for c in columns}
        sent = sent.select("_rows", *[f"_mid_{c}" for c in columns], *[e.alias(k) for k, e in mads.items()])
        each = sent.select(F.explode("_rows").alias("_row"), *[c for c in sent.columns if c != "_rows"])
        return judged(each.select("_row.*", *[c for c in each.columns if c != "_row"]), "_mid_{}", "_mad_{}")

    def joined(rows: DataFrame) -> DataFrame:
        stats = quantiles(rows, groups, columns, {"median": 0.5}, mad=True)
        return judged(attach(rows, stats, groups, spread=[spec.time]), "{}__median", "{}__mad")

    monthly = df.withColumn("_month", F.month(spec.time))
    return by_group_size(monthly, groups, small=gathered, large=joined, limit=limit)


# Ranges a clean panel must keep.
CLEAN_RANGES = {
    "humidity": (0.0, 100.0),
    "cloud": (0.0, 100.0),
    "wind_degree": (0.0, 360.0),
    "precip_mm": (0.0, None),
}
TARGET_RANGE = (-90.0, 60.0)


def clean_violations(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """``(check, n_violations)`` for every range check and the grain."""
    ranges = {spec.value: TARGET_RANGE} | {
        c: r for c, r in CLEAN_RANGES.items() if c in df.columns
    }

    def outside(c: str, lo: float, hi: float | None) -> Column:
        bad = F.col(c) < lo
        return bad if hi is None else bad | (F.col(c) > hi)

    per_key = df.groupBy(*spec.grain).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(outside(c, lo, hi)).alias(c) for c, (lo, hi) in ranges.items()],
    )
    totals = per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("grain"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ranges],
    )
    return totals.unpivot([], totals.columns, "check", "n_violations")


def validate_clean(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Return ``df``; raise listing every failed check."""
    failed = clean_violations(df, spec).where("n_violations > 0").collect()
    if failed:
        raise ValueError(
            "clean panel violates: " + ", ".join(f"{r['check']}={r['n_violations']}" for r in failed)
        )
    return df


def clean(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Deduplicate, gate, impute, flag and check.

    The gated, the imputed and the flagged panel are each read several times, so
    they are written once to the session's checkpoint folder.
    """
    gated = materialized(df.transform(dedup, spec).transform(gate_bounds, spec))
    filled = materialized(impute_missing(gated, spec))
    return validate_clean(materialized(flag_outliers(filled, spec)), spec)
