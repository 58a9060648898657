"""Profiles and correlations."""

from paneltide.functions.positions import with_positions
from paneltide.functions.quantiles import ranks_of_counts, value_counts
from paneltide.operators import correlation, profiling
from paneltide.plans.bindings import PANEL, panel
from paneltide.plans.catalog.base import ORACLES, gated, query, sql
from paneltide.spec import CONCENTRATIONS, INDICES, METRICS

_KINDS = (
    dict.fromkeys(("country", "location_name", "region_name", "condition_text"), "string")
    | {"last_updated": "timestamp_ntz", "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint"}
    | dict.fromkeys(("latitude", "longitude", *METRICS, *CONCENTRATIONS), "double")
    | dict.fromkeys(INDICES, "smallint")
)


@query(
    "profile_schema",
    sql(
        "p as ("
        + " union all ".join(
            f"""select '{c}' as column_name, '{kind}' as dtype, count(distinct {c}) as n_unique,
  round((count(*) - count({c})) * 100.0 / count(*), 4) as pct_null, cast(min({c}) as varchar) as example from panel"""
            for c, kind in _KINDS.items()
        )
        + ")",
        "column_name:s dtype:s n_unique:i pct_null:f example:s",
        "p",
    ),
)
def profile_schema(spark, sf):
    return profiling.profile_schema(panel(spark, sf)).withColumnRenamed("column", "column_name")


@query(
    "grain_report",
    sql(
        """k as (select country, location_name, last_updated, count(*) as n from panel group by all),
s as (select count(*) as n from panel group by country, location_name),
r as (select (select count(*) from panel) as n_rows, (select count(*) from s) as n_series,
  (select coalesce(sum(n) filter (n > 1), 0) from k) as duplicate_key_rows,
  (select min(n) from s) as rows_per_series_min, (select max(n) from s) as rows_per_series_max,
  (select median(n) from s) as rows_per_series_median,
  (select min(last_updated) from panel) as start_time, (select max(last_updated) from panel) as end_time,
  (select floor(epoch(max(last_updated) - min(last_updated)) / 86400) from panel) as span_days)""",
        "n_rows:i n_series:i duplicate_key_rows:i rows_per_series_min:i rows_per_series_max:i"
        " rows_per_series_median:f start_time:t end_time:t span_days:i",
        "r",
    ),
)
def grain_report(spark, sf):
    out = profiling.grain_report(panel(spark, sf), PANEL)
    return out.withColumnsRenamed({"start": "start_time", "end": "end_time"})


@query(
    "series_coverage",
    sql(
        """c as (select country, location_name, count(*) as n_obs, min(cast(last_updated as date)) as first_date,
  max(cast(last_updated as date)) as last_date, count(distinct cast(last_updated as date)) as days
  from panel group by all),
r as (select *, last_date - first_date as span_days,
  greatest(0, last_date - first_date + 1 - days) as n_gaps from c)""",
        "country:s location_name:s n_obs:i first_date:d last_date:d span_days:i n_gaps:i",
        "r",
    ),
)
def series_coverage(spark, sf):
    return profiling.series_coverage(panel(spark, sf), PANEL)


@query(
    "zero_inflation",
    sql(
        """w as (select country, precip_mm, case when precip_mm > 0 then precip_mm end as wet
  from gated where precip_mm is not null),
r as (select country, count(*) as n_days, round(count_if(precip_mm <= 0) * 100.0 / count(*), 4) as pct_dry_days,
  count(wet) as wet_count, avg(wet) as wet_mean, stddev_samp(wet) as wet_std, min(wet) as wet_min,
  max(wet) as wet_max, quantile_cont(wet, 0.25) as wet_p25, quantile_cont(wet, 0.5) as wet_p50,
  quantile_cont(wet, 0.75) as wet_p75 from w group by country)""",
        "country:s n_days:i pct_dry_days:f wet_count:i wet_mean:f wet_std:f wet_min:f wet_max:f"
        " wet_p25:f wet_p50:f wet_p75:f",
        "r",
    ),
)
def zero_inflation(spark, sf):
    return profiling.zero_inflation(gated(spark, sf, "precip_mm"), PANEL)


@query(
    "dry_extremes",
    sql(
        """d as (select country, avg(case when coalesce(precip_mm, 0) <= 0 then 1.0 else 0.0 end) * 100 as pct_dry
  from gated group by country),
r as (select * from (select * from d order by pct_dry, country limit 5)
  union select * from (select * from d order by pct_dry desc, country desc limit 5))""",
        "country:s pct_dry:f",
        "r",
    ),
)
def dry_extremes(spark, sf):
    return profiling.dry_extremes(gated(spark, sf, "precip_mm"), PANEL, k=5)


@query(
    "series_positions",
    sql(
        """r as (select country, location_name, last_updated, row_number() over (
  partition by country, location_name order by last_updated, l_orderkey, l_linenumber, l_partkey) - 1 as pos,
  count(*) over (partition by country, location_name) as len from gated)""",
        "country:s location_name:s last_updated:t pos:i len:i",
        "r",
    ),
)
def series_positions(spark, sf):
    placed = with_positions(gated(spark, sf, *PANEL.order), PANEL)
    return placed.select(
        *PANEL.grain, placed["_pos"].alias("pos"), placed["_len"].alias("len")
    )


@query("series_positions_by_range", ORACLES["series_positions"])
def series_positions_by_range(spark, sf):
    """The way of series too long for a task, taken by all of them."""
    placed = with_positions(gated(spark, sf, *PANEL.order), PANEL, limit=0)
    return placed.select(
        *PANEL.grain, placed["_pos"].alias("pos"), placed["_len"].alias("len")
    )


@query(
    "average_ranks",
    sql(
        """r as (select distinct country, humidity as v,
  rank() over (partition by country order by humidity) + (count(*) over (partition by country, humidity) - 1) / 2.0
  as avg_rank from gated where humidity is not null)""",
        "country:s v:f avg_rank:f",
        "r",
    ),
)
def average_ranks(spark, sf):
    counts = value_counts(gated(spark, sf, "humidity"), ["country"], ["humidity"])
    ranked = ranks_of_counts(counts, ["country"])
    return ranked.select("country", "v", ranked["rank"].alias("avg_rank"))


_COLUMNS = [*METRICS, *CONCENTRATIONS, *INDICES]
_PAIRS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]


def _pair_rows(pairs):
    return "j as (" + " union all ".join(
        f"select '{a}' as x, '{b}' as y, cast({a} as double) as a, cast({b} as double) as b from gated"
        f" where {a} is not null and {b} is not null"
        for a, b in pairs
    ) + """),
k as (select *, rank() over (partition by x, y order by a) + (count(*) over (partition by x, y, a) - 1) / 2.0 as ra,
  rank() over (partition by x, y order by b) + (count(*) over (partition by x, y, b) - 1) / 2.0 as rb from j),
c as (select x, y, count(*) as n, corr(a, b) as pearson, corr(ra, rb) as spearman from k group by x, y)"""


@query(
    "correlations",
    sql(
        f"{_pair_rows(_PAIRS)}, r as (select x, y, n, pearson, spearman, abs(spearman - pearson) as abs_diff from c)",
        "x:s y:s n:i pearson:f spearman:f abs_diff:f",
        "r",
    ),
)
def correlations(spark, sf):
    return correlation.correlations(gated(spark, sf, *_COLUMNS), _COLUMNS)


_SQUARE = ", ".join(f"max(v) filter (y = '{c}') as {c}" for c in _COLUMNS)


@query(
    "correlation_matrix",
    sql(
        f"""{_pair_rows(_PAIRS)}, f as (select x, y, pearson as v from c union all select y, x, pearson from c
  union all select distinct x, x, 1.0 from c union select distinct y, y, 1.0 from c),
r as (select x as variable, {_SQUARE} from f group by x)""",
        "variable:s " + " ".join(f"{c}:f" for c in _COLUMNS),
        "r",
    ),
)
def correlation_matrix(spark, sf):
    return correlation.square(correlation.pearson(gated(spark, sf, *_COLUMNS), _PAIRS), "pearson", _COLUMNS)


_WEATHER = list(correlation.WEATHER_DRIVERS)
_POLLUTANTS = [*CONCENTRATIONS, *INDICES]
_CROSS = [(w, p) for w in _WEATHER for p in _POLLUTANTS]


@query(
    "weather_pollutant_correlation",
    sql(
        f"""{_pair_rows(_CROSS)}, r as (select x as weather, y as pollutant,
  case when n >= 30 then spearman end as corr, n from c)""",
        "weather:s pollutant:s corr:f n:i",
        "r",
    ),
)
def weather_pollutant_correlation(spark, sf):
    return correlation.weather_pollutant_correlation(gated(spark, sf, *_WEATHER, *_POLLUTANTS), _WEATHER, _POLLUTANTS)


_GRID = ", ".join(f"max(corr) filter (pollutant = '{p}') as {p}" for p in _POLLUTANTS)


@query(
    "correlation_grid",
    sql(
        f"""{_pair_rows(_CROSS)}, l as (select x as weather, y as pollutant,
  case when n >= 30 then pearson end as corr, n from c),
r as (select weather, {_GRID} from l group by weather)""",
        "weather:s " + " ".join(f"{p}:f" for p in _POLLUTANTS),
        "r",
    ),
)
def correlation_grid(spark, sf):
    long = correlation.weather_pollutant_correlation(
        gated(spark, sf, *_WEATHER, *_POLLUTANTS), _WEATHER, _POLLUTANTS, method="pearson"
    )
    return correlation.correlation_grid(long, _POLLUTANTS)
