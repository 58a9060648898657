"""Telling large groups from small ones before choosing how to process them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest group, in rows, that one task may hold.
GROUP_LIMIT = 250_000


def by_group_size(
    df: DataFrame,
    groups: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Apply ``small`` to rows of groups of at most ``limit`` rows, ``large`` to the rest.

    Group sizes are counted first, with map-side combining, over the group
    columns only. The list of large groups cannot be longer than ``rows / limit``,
    so it is safe to broadcast; when it is empty the plan has no second branch.
    A null in ``groups`` is a group value like any other.
    """
    oversized = (
        df.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*groups)
    )
    if oversized.isEmpty():
        return small(df)
    listed = F.broadcast(oversized.select(*[F.col(g).alias(f"_large_{g}") for g in groups]))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_large_{g}"))
    few = small(df.join(listed, same, "left_anti"))
    return few.unionByName(large(df.join(listed, same, "left_semi")))
