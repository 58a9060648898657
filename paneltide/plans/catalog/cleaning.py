"""Sources and cleaning."""

from pyspark.sql import functions as F

from paneltide.operators import cleaning as op
from paneltide.plans.bindings import PANEL, panel
from paneltide.plans.catalog.base import ORACLES, gated, query, sql
from paneltide.session import materialized
from paneltide.sources import raw
from paneltide.spec import BOUNDS, CONCENTRATIONS, INDICES, METRICS

_ID = "country:s location_name:s last_updated:t"
_KEYS = ["country", "location_name", "last_updated"]


def _kinds(columns, kind):
    return " ".join(f"{c}:{kind}" for c in columns)


@query(
    "coerce_types",
    sql(
        "",
        f"{_ID} {_kinds(METRICS + CONCENTRATIONS, 'f')} {_kinds(INDICES, 'f')} condition_text:s",
        "panel",
    ),
)
def coerce_types(spark, sf):
    text = panel(spark, sf).withColumn(
        "last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm")
    )
    wanted = [*_KEYS, *METRICS, *CONCENTRATIONS, *INDICES, "condition_text"]
    raw_text = text.select(*[F.col(c).cast("string") for c in wanted])
    shouted = raw_text.toDF(*[c.upper().replace("_", " ") for c in wanted])
    typed = raw.validate(raw.coerce_types(raw.normalize_columns(shouted), PANEL), PANEL)
    return _wide_indices(typed)


@query(
    "structure_report",
    sql(
        """k as (select last_updated, count(*) as n from panel
             group by country, location_name, last_updated),
r as (select sum(n) as n_rows, coalesce(sum(n) filter (last_updated is null), 0) as n_missing_time,
        coalesce(sum(n) filter (n > 1), 0) as n_duplicate_key_rows from k)""",
        "n_rows:i n_missing_time:i n_duplicate_key_rows:i",
        "r",
    ),
)
def structure_report(spark, sf):
    return raw.structure_report(panel(spark, sf), PANEL)


@query(
    "dedup_keep_last",
    sql(
        "",
        f"{_ID} {_kinds(METRICS, 'f')} l_orderkey:i l_linenumber:i l_partkey:i",
        "deduped",
    ),
)
def dedup_keep_last(spark, sf):
    twice = panel(spark, sf).unionByName(panel(spark, sf))
    return op.dedup(twice, PANEL, [*METRICS, *PANEL.order]).select(
        *_KEYS, *METRICS, "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "key_collisions",
    sql(
        """k as (select count(*) as n from panel group by country, location_name, last_updated),
r as (select coalesce(sum(n) filter (n > 1), 0) as n_collision_rows from k)""",
        "n_collision_rows:i",
        "r",
    ),
)
def key_collisions(spark, sf):
    return op.collisions(panel(spark, sf), PANEL.grain)


@query("gate_physical_bounds", sql("", f"{_ID} {_kinds(BOUNDS, 'f')}", "gated"))
def gate_physical_bounds(spark, sf):
    return gated(spark, sf).select(*_KEYS, *BOUNDS)


_BOTH_WAYS = [c for c in METRICS if c not in ("temperature_celsius", "precip_mm")]


def _near_sql(c):
    up = "over (partition by country, location_name order by i rows between unbounded preceding and current row)"
    on = "over (partition by country, location_name order by i rows between current row and unbounded following)"
    known = f"case when {c} is not null then i end"
    return (
        f"last_value({known} ignore nulls) {up} as pi_{c}, last_value({c} ignore nulls) {up} as pv_{c}, "
        f"first_value({known} ignore nulls) {on} as qi_{c}, first_value({c} ignore nulls) {on} as qv_{c}"
    )


def _both_sql(c):
    return (
        f"case when {c} is not null then {c} when pi_{c} is null then qv_{c} when qi_{c} is null then pv_{c} "
        f"when i-pi_{c} <= 2 or qi_{c}-i <= 2 then pv_{c} + (qv_{c}-pv_{c})/(qi_{c}-pi_{c})*(i-pi_{c}) "
        f"else pv_{c} + (qv_{c}-pv_{c})/(qi_{c}-pi_{c})*2 end"
    )


def _forward_sql(c):
    filled = (
        f"case when {c} is not null then {c} when pi_{c} is null then null when qi_{c} is null then pv_{c} "
        f"else pv_{c} + (qv_{c}-pv_{c})*1.0/(qi_{c}-pi_{c})*least(i-pi_{c}, 2) end"
    )
    return f"round_even({filled}, 0)" if c in INDICES else filled


IMPUTED = f"""placed as (select *, row_number() over (partition by country, location_name
    order by last_updated, l_orderkey, l_linenumber, l_partkey) as i from gated),
near as (select *, {", ".join(_near_sql(c) for c in [*_BOTH_WAYS, *CONCENTRATIONS, *INDICES])} from placed),
imputed as (select country, location_name, last_updated, region_name, latitude, longitude, temperature_celsius,
  coalesce(precip_mm, 0) as precip_mm, coalesce(condition_text, 'unknown') as condition_text,
  {", ".join(f"{_both_sql(c)} as {c}" for c in _BOTH_WAYS)},
  {", ".join(f"{_forward_sql(c)} as {c}" for c in CONCENTRATIONS + INDICES)},
  {", ".join(f"cast({c} is null as int) as {c}_was_missing" for c in CONCENTRATIONS + INDICES)} from near)"""

_IMPUTED_OUT = (
    f"{_ID} {_kinds(METRICS + CONCENTRATIONS, 'f')} {_kinds(INDICES, 'f')} "
    f"{_kinds([c + '_was_missing' for c in CONCENTRATIONS + INDICES], 'i')} condition_text:s"
)


def _wide_indices(df):
    """Nullable integers compare most simply as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in INDICES})


def _names(columns):
    return [item.rsplit(":", 1)[0] for item in columns.split()]


#: The columns that are filled, and the order of rows.
_SOURCES = (*PANEL.order, *METRICS, *CONCENTRATIONS, *INDICES, "condition_text")


def _rows(spark, sf):
    """Written once: series are counted, then long and short ones read, ranges drawn and filled."""
    return materialized(gated(spark, sf, *_SOURCES), release=True)


@query("impute_missing", sql(IMPUTED, _IMPUTED_OUT, "imputed"))
def impute_missing(spark, sf):
    filled = op.impute_missing(_rows(spark, sf), PANEL)
    return _wide_indices(filled).select(*_names(_IMPUTED_OUT))


@query("impute_missing_in_blocks", ORACLES["impute_missing"])
def impute_missing_in_blocks(spark, sf):
    """The way of series too long for a task, taken by all of them, in blocks short enough for several a series."""
    filled = op.impute_missing(_rows(spark, sf), PANEL, limit=0, block_rows=128)
    return _wide_indices(filled).select(*_names(_IMPUTED_OUT))


def _flag_ctes(source):
    return f"""med as (select country, location_name, month(last_updated) as m,
  {", ".join(f"median({c}) as {c}" for c in METRICS)} from {source} group by all),
mad as (select s.country, s.location_name, med.m,
  {", ".join(f"median(abs(s.{c} - med.{c})) as {c}" for c in METRICS)}
  from {source} s join med on s.country = med.country and s.location_name = med.location_name
    and month(s.last_updated) = med.m group by all),
flagged as (select s.*,
  {", ".join(f"coalesce(mad.{c} > 0 and abs(0.6745*(s.{c}-med.{c})/mad.{c}) > 3.5, false) as {c}_is_outlier" for c in METRICS)}
  from {source} s join med on s.country = med.country and s.location_name = med.location_name
    and month(s.last_updated) = med.m
  join mad on s.country = mad.country and s.location_name = mad.location_name and med.m = mad.m)"""


_FLAGS = [f"{c}_is_outlier" for c in METRICS]


@query("flag_outliers", sql(_flag_ctes("gated"), f"{_ID} {_kinds(_FLAGS, 'b')}", "flagged"))
def flag_outliers(spark, sf):
    return op.flag_outliers(materialized(gated(spark, sf, *METRICS), release=True), PANEL).select(*_KEYS, *_FLAGS)


@query(
    "clean_panel",
    sql(f"{IMPUTED}, {_flag_ctes('imputed')}", f"{_IMPUTED_OUT} {_kinds(_FLAGS, 'b')}", "flagged"),
)
def clean_panel(spark, sf):
    done = op.clean(panel(spark, sf), PANEL)
    return _wide_indices(done).select(*_names(_IMPUTED_OUT), *_FLAGS)


_RANGES = [
    ("grain", "0"),
    ("temperature_celsius", "count_if(temperature_celsius < -90 or temperature_celsius > 60)"),
    ("humidity", "count_if(humidity < 0 or humidity > 100)"),
    ("cloud", "count_if(cloud < 0 or cloud > 100)"),
    ("wind_degree", "count_if(wind_degree < 0 or wind_degree > 360)"),
    ("precip_mm", "count_if(precip_mm < 0)"),
]


@query(
    "clean_violations",
    sql(
        """k as (select count(*) as n from panel group by country, location_name, last_updated),
v as ("""
        + " union all ".join(
            f"select '{name}' as \"check\", {expr} as n_violations from panel"
            if name != "grain"
            else "select 'grain' as \"check\", coalesce(sum(n) filter (n > 1), 0) as n_violations from k"
            for name, expr in _RANGES
        )
        + """), r as (select "check" as check_name, n_violations from v)""",
        "check_name:s n_violations:i",
        "r",
    ),
)
def clean_violations(spark, sf):
    return op.clean_violations(panel(spark, sf), PANEL).withColumnRenamed("check", "check_name")
