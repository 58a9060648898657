"""Climate, spatial and air-quality aggregates."""

from pyspark.sql import functions as F

from paneltide.functions.scalar import AIR_QUALITY_LABELS, latitude_band
from paneltide.operators import air_quality, climate, spatial
from paneltide.operators.regions import add_region_columns
from paneltide.plans.bindings import PANEL, country_regions
from paneltide.plans.catalog.base import gated, query, sql
from paneltide.plans.catalog.features import ZONE_SQL

_Y = "temperature_celsius"
ZONED = f"zoned as (select *, {ZONE_SQL} as climate_zone, region_name as continent from gated)"


def zoned(spark, sf):
    return add_region_columns(gated(spark, sf), PANEL, country_regions(spark, sf))


PLACES = f"""{ZONED}, places as (select climate_zone, country, location_name,
  date_trunc('month', last_updated) as period, avg({_Y}) as place_mean from zoned
  where {_Y} is not null group by all)"""
CYCLE = f"""{PLACES}, cycle as (select climate_zone, period as year_month, avg(place_mean) as mean,
  stddev_samp(place_mean) as std, quantile_cont(place_mean, 0.1) as p10, quantile_cont(place_mean, 0.9) as p90,
  count(*) as n_cities from places group by all)"""


@query(
    "seasonal_cycle",
    sql(CYCLE, "climate_zone:s year_month:d mean:f std:f p10:f p90:f n_cities:i", "cycle"),
)
def seasonal_cycle(spark, sf):
    return climate.seasonal_cycle(gated(spark, sf, _Y, "latitude"), spec=PANEL)


@query(
    "place_period_means",
    sql(PLACES, "climate_zone:s country:s location_name:s period:d place_mean:f", "places"),
)
def place_period_means(spark, sf):
    return climate.place_period_means(gated(spark, sf, _Y, "latitude"), "climate_zone", PANEL)


@query(
    "period_over_period",
    sql(
        f"""{ZONED}, p as (select continent, country, location_name, date_trunc('week', last_updated) as period,
  avg({_Y}) as v from zoned where {_Y} is not null group by all),
q as (select continent, period, avg(v) as mean, count(*) as n_cities from p group by all),
r as (select *, mean - lag(mean) over (partition by continent order by period) as delta from q)""",
        "continent:s period:d mean:f n_cities:i delta:f",
        "r",
    ),
)
def period_over_period(spark, sf):
    return climate.period_over_period(
        gated(spark, sf, _Y, "latitude"), "continent", PANEL, dimension=country_regions(spark, sf)
    )


@query(
    "sample_span",
    sql(
        """r as (select min(last_updated)::date as first_date, max(last_updated)::date as last_date,
  max(last_updated)::date - min(last_updated)::date as span_days,
  floor(epoch(max(last_updated) - min(last_updated)) / 86400) / 30.44 as months from panel)""",
        "first_date:d last_date:d span_days:i months:f",
        "r",
    ),
)
def sample_span(spark, sf):
    from paneltide.plans.bindings import panel

    return climate.sample_span(panel(spark, sf), PANEL)


_MONTHS = ", ".join(f"max(v) filter (m = {i}) as m{i:02d}" for i in range(1, 13))


@query(
    "month_grid",
    sql(
        f"""{CYCLE}, g as (select climate_zone, month(year_month) as m, avg(mean) as v from cycle group by all),
r as (select climate_zone, {_MONTHS} from g group by climate_zone)""",
        "climate_zone:s " + " ".join(f"m{i:02d}:f" for i in range(1, 13)),
        "r",
    ),
)
def month_grid(spark, sf):
    return climate.month_grid(climate.seasonal_cycle(gated(spark, sf, _Y, "latitude"), spec=PANEL))


LATEST = """latest as (select * from gated qualify row_number() over (
  partition by country, location_name order by last_updated desc, l_orderkey desc) = 1)"""
_LATEST_OUT = "country:s location_name:s last_updated:t latitude:f longitude:f temperature_celsius:f"


_PLACED = [_Y, "latitude", "longitude", *PANEL.order]


@query("latest_snapshot", sql(LATEST, _LATEST_OUT, "latest"))
def latest_snapshot(spark, sf):
    return spatial.latest_snapshot(gated(spark, sf, *_PLACED), PANEL).select(
        "country", "location_name", "last_updated", "latitude", "longitude", _Y
    )


@query(
    "valid_geo",
    sql(
        """r as (select * from gated where latitude is not null and longitude is not null
  and not (latitude = 0 and longitude = 0))""",
        _LATEST_OUT,
        "r",
    ),
)
def valid_geo(spark, sf):
    return spatial.valid_geo(gated(spark, sf), PANEL).select(
        "country", "location_name", "last_updated", "latitude", "longitude", _Y
    )


PEERS = f"""{LATEST}, g as (select *, {ZONE_SQL} as climate_zone from latest
  where not (latitude = 0 and longitude = 0)),
w as (select *, avg({_Y}) over (partition by climate_zone) as zone_mean,
  stddev_samp({_Y}) over (partition by climate_zone) as sd from g),
peers as (select *, {_Y} - zone_mean as anomaly,
  coalesce(case when sd <> 0 then ({_Y} - zone_mean) / sd end, 0) as anomaly_z from w)"""
_PEERS_OUT = "country:s location_name:s climate_zone:s zone_mean:f anomaly:f anomaly_z:f"


@query("peer_anomaly", sql(PEERS, _PEERS_OUT, "peers"))
def peer_anomaly(spark, sf):
    return spatial.peer_anomaly(gated(spark, sf, *_PLACED), PANEL).select(
        "country", "location_name", "climate_zone", "zone_mean", "anomaly", "anomaly_z"
    )


@query(
    "anomaly_color_bound",
    sql(
        f"{PEERS}, r as (select greatest(quantile_cont(abs(anomaly_z), 0.98), 0.5) as bound from peers)",
        "bound:f",
        "r",
    ),
)
def anomaly_color_bound(spark, sf):
    return spatial.anomaly_color_bound(spatial.peer_anomaly(gated(spark, sf, *_PLACED), PANEL))


_LABEL = (
    "case air_quality_us_epa_index "
    + " ".join(f"when {i} then '{x}'" for i, x in enumerate(AIR_QUALITY_LABELS, 1))
    + " end"
)


@query(
    "latest_air_quality",
    sql(
        f"""{LATEST}, r as (select *, {_LABEL} as epa_label from latest
  where not (latitude = 0 and longitude = 0) and {_LABEL} is not null)""",
        "country:s location_name:s latitude:f longitude:f epa_label:s",
        "r",
    ),
)
def latest_air_quality(spark, sf):
    return spatial.latest_air_quality(gated(spark, sf), PANEL)


_VALUES = ("temperature_celsius", "humidity", "wind_kph", "air_quality_pm2_5")
SUMMARY = f"""city as (select country, location_name, {", ".join(f"avg({c}) as {c}" for c in _VALUES)},
  count(distinct last_updated) as n_snapshots, count(distinct last_updated::date) as n_days from gated group by all),
summary as (select country, {", ".join(f"avg({c}) as {c}" for c in _VALUES)}, count(*) as n_cities,
  sum(n_snapshots) as n_snapshots, sum(n_days) as n_days from city group by country)"""


@query(
    "country_summary",
    sql(
        SUMMARY,
        "country:s " + " ".join(f"{c}:f" for c in _VALUES) + " n_cities:i n_snapshots:i n_days:i",
        "summary",
    ),
)
def country_summary(spark, sf):
    return spatial.country_summary(gated(spark, sf), PANEL)


_CONTINENT = """dim as (select n_name as country, r_name as continent from nation join region on n_regionkey = r_regionkey)"""


@query(
    "continent_comparison",
    sql(
        f"""{SUMMARY}, {_CONTINENT}, r as (select continent, avg({_Y}) as mean, stddev_samp({_Y}) as std,
  quantile_cont({_Y}, 0.1) as p10, quantile_cont({_Y}, 0.5) as p50, quantile_cont({_Y}, 0.9) as p90,
  count(*) as n_countries, sum(n_cities) as n_cities from summary join dim using (country) group by continent)""",
        "continent:s mean:f std:f p10:f p50:f p90:f n_countries:i n_cities:i",
        "r",
    ),
)
def continent_comparison(spark, sf):
    return spatial.continent_comparison(
        gated(spark, sf), PANEL, dimension=country_regions(spark, sf)
    )


@query(
    "extreme_countries",
    sql(
        f"""{SUMMARY}, e as (select * from (select * from summary order by {_Y}, country limit 8)
  union select * from (select * from summary order by {_Y} desc, country desc limit 8)),
r as (select country, {_Y}, {_Y} - (select avg({_Y}) from summary) as deviation from e)""",
        f"country:s {_Y}:f deviation:f",
        "r",
    ),
)
def extreme_countries(spark, sf):
    return spatial.extreme_countries(spatial.country_summary(gated(spark, sf), PANEL), _Y, k=8)


@query(
    "robust_range",
    sql(
        f"""e as (select quantile_cont({_Y}, 0.05) as lo, quantile_cont({_Y}, 0.95) as hi, avg({_Y}) as m from gated),
r as (select case when lo = hi then m - 1 else lo end as lo, case when lo = hi then m + 1 else hi end as hi from e)""",
        "lo:f hi:f",
        "r",
    ),
)
def robust_range(spark, sf):
    return spatial.robust_range(gated(spark, sf, _Y), _Y)


@query(
    "latitude_bands",
    sql(
        """b as (select case when abs(latitude) <= 23.5 then 'Tropical' when abs(latitude) <= 35 then 'Subtropical'
  when abs(latitude) <= 55 then 'Temperate' when abs(latitude) <= 66.5 then 'Boreal'
  when abs(latitude) <= 90.1 then 'Polar' else 'Unknown' end as band from gated),
r as (select band, count(*) as n from b group by band)""",
        "band:s n:i",
        "r",
    ),
)
def latitude_bands(spark, sf):
    bands = gated(spark, sf).select(latitude_band(F.col("latitude")).alias("band"))
    return bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


SHARES = f"""{ZONED}, s as (select continent, {_LABEL} as epa_label, count(*) as "count" from zoned
  where {_LABEL} is not null group by all),
shares as (select continent, epa_label, "count" as n, "count" / sum("count") over (partition by continent) as share from s)"""


@query("category_share", sql(SHARES, "continent:s epa_label:s n:i share:f", "shares"))
def category_share(spark, sf):
    return air_quality.category_share(
        gated(spark, sf, "air_quality_us_epa_index", "latitude"), spec=PANEL, dimension=country_regions(spark, sf)
    ).withColumnRenamed("count", "n")


def _slug(label):
    return label.lower().replace(" (", "_").replace(")", "").replace(" ", "_")


@query(
    "category_share_grid",
    sql(
        SHARES
        + ", r as (select continent, "
        + ", ".join(
            f"coalesce(max(share) filter (epa_label = '{x}'), 0) as {_slug(x)}"
            for x in AIR_QUALITY_LABELS
        )
        + " from shares group by continent)",
        "continent:s " + " ".join(f"{_slug(x)}:f" for x in AIR_QUALITY_LABELS),
        "r",
    ),
)
def category_share_grid(spark, sf):
    shares = air_quality.category_share(
        gated(spark, sf, "air_quality_us_epa_index", "latitude"), spec=PANEL, dimension=country_regions(spark, sf)
    )
    return air_quality.share_grid(shares).withColumnsRenamed(
        {x: _slug(x) for x in AIR_QUALITY_LABELS}
    )


def _bins_sql(driver):
    points = ", ".join(f"quantile_cont(x, {i / 5})" for i in range(6))
    return f"""p_{driver} as (select {driver} as x, air_quality_pm2_5 as y from gated
  where {driver} is not null and air_quality_pm2_5 is not null),
e_{driver} as (select list_sort(list_distinct([{points}])) as edges from p_{driver}),
b_{driver} as (select greatest(1, len(list_filter(edges, lambda e: e < x))) as b, edges, y
  from p_{driver}, e_{driver} where len(edges) > 1),
r_{driver} as (select '{driver}' as driver, any_value(edges)[b] as bin_low, any_value(edges)[b + 1] as bin_high,
  row_number() over (order by b) as bin_rank, count(*) as n, median(y) as pm_median from b_{driver} group by b)"""


@query(
    "binned_median",
    sql(
        f"{_bins_sql('wind_kph')}, {_bins_sql('precip_mm')}, r as (select * from r_wind_kph union all select * from r_precip_mm)",
        "driver:s bin_low:f bin_high:f bin_rank:i n:i pm_median:f",
        "r",
    ),
)
def binned_median(spark, sf):
    return air_quality.binned_median(gated(spark, sf, "wind_kph", "precip_mm", "air_quality_pm2_5"))
