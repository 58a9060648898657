"""Joining per-group statistics back to rows without trusting the key distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Rows of a table of statistics that are sent to every task at most.
FEW = 20_000


def attach(
    rows: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``stats`` (one row per ``on``) to ``rows``, splitting hot keys.

    A key that holds a large share of ``rows`` would put all of them in one join
    task, so each key is cut into ``salts`` pieces by a hash of the ``spread``
    columns and ``stats`` is repeated once per piece. The hash depends on row
    content only, so a recomputed task lands its rows in the same piece. When
    ``stats`` turns out small, adaptive execution replaces this by a broadcast.
    """
    on = list(on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def attach_written(
    rows: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    few: int = FEW,
) -> DataFrame:
    """As ``attach``, for ``stats`` that are a written table: counted first, and sent to every task
    while they have at most ``few`` rows, so that ``rows`` are not shuffled."""
    if stats.limit(few + 1).count() > few:
        return attach(rows, stats, on, spread, how)
    return rows.join(F.broadcast(stats), list(on), how)


def join_null_safe(rows: DataFrame, stats: DataFrame, on: Sequence[str], *, few: bool = False) -> DataFrame:
    """Left join by ``on`` in which a null key is a key like any other; ``few``: ``stats`` was counted
    and may be sent to every task."""
    named = stats.withColumnsRenamed({k: f"_of_{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(F.broadcast(named) if few else named, same, "left").drop(*[f"_of_{k}" for k in on])
