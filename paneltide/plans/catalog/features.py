"""Features and region columns."""

from pyspark.sql import functions as F

from paneltide.operators import features as op
from paneltide.operators import profiling, regions
from paneltide.plans.bindings import PANEL, country_regions, table
from paneltide.plans.catalog.base import ORACLES, gated, query, sql
from paneltide.session import materialized
from paneltide.spec import LAGGED_EXOGENOUS, LAGS, WINDOWS

_ID = "country:s location_name:s last_updated:t"
_W = "(partition by country, location_name order by last_updated, l_orderkey, l_linenumber, l_partkey"
_Y = "temperature_celsius"

CALENDAR_SQL = """cal as (select *, cast(last_updated as date) as date, year(last_updated) as year,
  month(last_updated) as month, dayofyear(last_updated) as day_of_year, weekofyear(last_updated) as week,
  isodow(last_updated) - 1 as dayofweek, quarter(last_updated) as quarter,
  cast(isodow(last_updated) >= 6 as int) as is_weekend, abs(latitude) as abs_latitude,
  case when latitude < 0 then 'S' else 'N' end as hemisphere,
  case when latitude < 0 then (month(last_updated)+5)%12+1 else month(last_updated) end as eff,
  case when eff in (12,1,2) then 'Winter' when eff <= 5 then 'Spring' when eff <= 8 then 'Summer'
    else 'Autumn' end as season from gated)"""
_CAL = (
    "date:d year:i month:i day_of_year:i week:i dayofweek:i quarter:i is_weekend:i"
    " abs_latitude:f hemisphere:s season:s"
)


def _names(columns):
    return [item.rsplit(":", 1)[0] for item in columns.split()]


@query("calendar_features", sql(CALENDAR_SQL, f"{_ID} {_CAL}", "cal"))
def calendar_features(spark, sf):
    return op.add_calendar(gated(spark, sf), PANEL).select(*_names(f"{_ID} {_CAL}"))


_CYCLE = ", ".join(
    f"{fn}(2*pi()*{c}/{p}) as {c}_{fn}" for c, p in op.PERIODS.items() for fn in ("sin", "cos")
)
_CYCLE_OUT = " ".join(f"{c}_{fn}:f" for c in op.PERIODS for fn in ("sin", "cos"))


@query(
    "cyclical_features",
    sql(f"{CALENDAR_SQL}, cyc as (select *, {_CYCLE} from cal)", f"{_ID} {_CYCLE_OUT}", "cyc"),
)
def cyclical_features(spark, sf):
    dated = op.add_calendar(gated(spark, sf), PANEL)
    return op.add_calendar_cyclical(dated).select(*_names(f"{_ID} {_CYCLE_OUT}"))


_LAGS = ", ".join(f"lag({_Y}, {k}) over {_W}) as {_Y}_lag{k}" for k in LAGS)
_LAGS_OUT = " ".join(f"{_Y}_lag{k}:f" for k in LAGS)


@query("lag_features", sql(f"x as (select *, {_LAGS} from gated)", f"{_ID} {_LAGS_OUT}", "x"))
def lag_features(spark, sf):
    return op.add_lags(gated(spark, sf), PANEL).select(*_names(f"{_ID} {_LAGS_OUT}"))


_FNS = (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))


def _roll(w, fn):
    past = f"over {_W} rows between {w} preceding and 1 preceding)"
    return f"case when count({_Y}) {past} >= {max(2, w // 2)} then {fn}({_Y}) {past} end"


_ROLLS = ", ".join(f"{_roll(w, fn)} as {_Y}_roll{n}{w}" for w in WINDOWS for n, fn in _FNS)
_ROLLS_OUT = " ".join(f"{_Y}_roll{n}{w}:f" for w in WINDOWS for n, _ in _FNS)


@query("rolling_features", sql(f"x as (select *, {_ROLLS} from gated)", f"{_ID} {_ROLLS_OUT}", "x"))
def rolling_features(spark, sf):
    return op.add_rollings(gated(spark, sf, _Y, *PANEL.order), PANEL).select(*_names(f"{_ID} {_ROLLS_OUT}"))


_EXOG = ", ".join(f"lag({c}, 1) over {_W}) as {c}_lag1" for c in LAGGED_EXOGENOUS)
_EXOG_OUT = " ".join(f"{c}_lag1:f" for c in LAGGED_EXOGENOUS)


@query(
    "lagged_exogenous", sql(f"x as (select *, {_EXOG} from gated)", f"{_ID} {_EXOG_OUT}", "x")
)
def lagged_exogenous(spark, sf):
    return op.add_lagged_exogenous(gated(spark, sf), PANEL).select(*_names(f"{_ID} {_EXOG_OUT}"))


#: What features are made from; no other column is carried.
_SOURCES = (*PANEL.order, PANEL.latitude, _Y, *LAGGED_EXOGENOUS, "wind_degree")
_ALL_OUT = f"{_ID} {_CAL} {_CYCLE_OUT} {_LAGS_OUT} {_ROLLS_OUT} {_EXOG_OUT}"


def _rows(spark, sf):
    """Written once: series are counted, then long and short ones read, ranges drawn and filled."""
    return materialized(gated(spark, sf, *_SOURCES))


@query(
    "build_features",
    sql(
        f"{CALENDAR_SQL}, x as (select *, {_CYCLE}, {_LAGS}, {_ROLLS}, {_EXOG} from cal)",
        _ALL_OUT,
        "x",
    ),
)
def build_features(spark, sf):
    return op.build_features(_rows(spark, sf), PANEL).select(*_names(_ALL_OUT))


@query("build_features_in_blocks", ORACLES["build_features"])
def build_features_in_blocks(spark, sf):
    """The way of series too long for a task, taken by all of them, in blocks short enough for several a series."""
    made = op.build_features(_rows(spark, sf), PANEL, limit=0, block_rows=128)
    return made.select(*_names(_ALL_OUT))


ZONE_SQL = """case when abs(latitude) <= 23.5 then 'Tropical' when abs(latitude) <= 35 then 'Subtropical'
  when abs(latitude) <= 55 then 'Temperate' when latitude is not null then 'Polar' else 'Unknown' end"""


@query(
    "region_columns",
    sql(
        f"""x as (select *, {ZONE_SQL} as climate_zone, region_name as continent,
  case when latitude < 0 then 'S' when latitude is null then 'Unknown' else 'N' end as hemisphere from gated)""",
        f"{_ID} continent:s climate_zone:s hemisphere:s",
        "x",
    ),
)
def region_columns(spark, sf):
    out = regions.add_region_columns(gated(spark, sf), PANEL, country_regions(spark, sf))
    return out.select(*_names(f"{_ID} continent:s climate_zone:s hemisphere:s"))


# A dimension of codes, names and continents over the nations.
_COUNTRIES = """select upper(substr(r_name, 1, 1)) || chr(65 + n_nationkey % 26) as country_code,
  initcap(n_name) as country_name, r_name as continent from {nation} join {region} on n_regionkey = r_regionkey"""


def _countries(spark, sf):
    return spark.sql(_COUNTRIES, nation=table(spark, sf, "nation"), region=table(spark, sf, "region"))


@query(
    "continent_by_name",
    sql(
        """r as (select p.country, min(upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))) as country_name,
  min(r_name) as continent, count(*) as n
  from gated p join nation on p.country = n_name join region on n_regionkey = r_regionkey group by p.country)""",
        "country:s country_name:s continent:s n:i",
        "r",
    ),
)
def continent_by_name(spark, sf):
    """Names resolved through a dimension of codes, names and continents."""
    dimension = _countries(spark, sf)
    named = regions.add_continent(gated(spark, sf), "country", dimension)
    named = regions.canonical_country(named, dimension)
    return named.groupBy("country", "country_name", "continent").agg(F.count(F.lit(1)).alias("n"))


@query(
    "country_resolution",
    sql(
        """r as (select avg(case when region_name is null or trim(region_name) in ('', 'Unknown', 'nan')
  then 0.0 else 1.0 end) as resolved from panel)""",
        "resolved:f",
        "r",
    ),
)
def country_resolution(spark, sf):
    return regions.resolution_rate(
        regions.add_continent(gated(spark, sf), "country", country_regions(spark, sf)), "continent"
    )


_REP = f"""cov as (select country, location_name, count(*) as n_obs from panel group by all),
lat as (select country, location_name, median(latitude) as latitude from panel group by all),
z as (select c.*, case when latitude is null then 'Unknown' else ({ZONE_SQL}) || '-' ||
  case when latitude < 0 then 'S' else 'N' end end as zone from cov c join lat using (country, location_name)),
named as (select * from z where location_name in ('Supplier#000000007', 'Supplier#000000003')
  order by n_obs desc, country, location_name limit 6),
best as (select * from z where zone not in (select zone from named)
  qualify row_number() over (partition by zone order by n_obs desc, country, location_name) = 1),
staged as (select z.*, case when n.country is not null then 1 when b.country is not null then 2 else 3 end as stage
  from z left join named n using (country, location_name) left join best b using (country, location_name)),
r as (select country, location_name, z2.n_obs, z2.zone, stage from staged z2
  order by stage, z2.n_obs desc, country, location_name limit 6)"""


@query(
    "representative_series",
    sql(_REP.replace("z.*, case", "z.country, z.location_name, z.n_obs, z.zone, case"),
        "country:s location_name:s n_obs:i zone:s stage:i", "r"),
)
def representative_series(spark, sf):
    from paneltide.plans.bindings import panel

    return profiling.representative_series(
        panel(spark, sf), PANEL, preferred=("Supplier#000000007", "Supplier#000000003")
    )


@query(
    "keep_representative",
    sql(
        _REP.replace("z.*, case", "z.country, z.location_name, z.n_obs, z.zone, case")
        + ", k as (select g.* from gated g semi join r using (country, location_name))",
        f"{_ID} temperature_celsius:f",
        "k",
    ),
)
def keep_representative(spark, sf):
    rows = gated(spark, sf).select("country", "location_name", "last_updated", _Y)
    return profiling.keep_series(rows, representative_series(spark, sf), PANEL.keys)
