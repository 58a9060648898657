"""Shared pieces of the query catalog: registration, portable output, common SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.functions.scalar import rounded
from paneltide.operators.cleaning import dedup, gate_bounds
from paneltide.plans.bindings import PANEL, PANEL_SQL, panel
from paneltide.session import limit_methods
from paneltide.spec import BOUNDS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is made comparable across engines."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            limit_methods(spark)
            return portable(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def portable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain strings, 64-bit integers and rounded doubles only.

    The small offset keeps values that land exactly on a rounding tie from
    falling on different sides in two engines.
    """

    def plain(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.IntegralType):
            c = c.cast("long")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            c = rounded(c.cast("double") + 1e-9, digits) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def gated(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The panel, or its ``wanted`` columns, with one row per grain key and impossible readings nulled."""
    return gate_bounds(dedup(panel(spark, sf_dir), PANEL, wanted or None), PANEL)


_GATES = ", ".join(
    f"case when {c} between {lo} and {hi} then {c} end as {c}" for c, (lo, hi) in BOUNDS.items()
)
BASE = f"""with panel as ({PANEL_SQL.format(
    hours="to_hours(l_linenumber)", lineitem="lineitem", supplier="supplier",
    nation="nation", region="region")}),
deduped as (select * from panel qualify row_number() over (
  partition by country, location_name, last_updated
  order by l_orderkey desc, l_linenumber desc, l_partkey desc) = 1),
gated as (select * replace ({_GATES}) from deduped)"""

_CASTS = {
    "s": "cast({0} as varchar)",
    "i": "cast({0} as bigint)",
    "f": "round(cast({0} as double) + 1e-9, 6) + 0.0",
    "d": "cast(cast({0} as date) as varchar)",
    "t": "cast(cast({0} as timestamp) as varchar)",
    "b": "cast({0} as boolean)",
}


def sql(ctes: str, columns: str, source: str, base: str = BASE) -> str:
    """A full statement: the shared CTEs, more of them, and typed output columns.

    ``columns`` lists ``name:kind`` with kind one of s, i, f, d, t, b.
    """
    shown = []
    for item in columns.split():
        name, kind = item.rsplit(":", 1)
        shown.append(f'{_CASTS[kind].format(name)} as {name}')
    parts = [base] + ([ctes] if ctes else [])
    return ",\n".join(parts) + "\nselect " + ", ".join(shown) + f" from {source}"
