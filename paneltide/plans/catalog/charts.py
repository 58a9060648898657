"""Chart-ready aggregates."""

from paneltide.functions.scalar import hemisphere
from paneltide.operators import charts, climate, spatial
from paneltide.operators.regions import add_continent
from paneltide.plans.bindings import PANEL, country_regions
from paneltide.plans.catalog.base import gated, query, sql
from paneltide.plans.catalog.regional import PLACES, SUMMARY
from pyspark.sql import functions as F

_Y = "temperature_celsius"
_H = f"h as (select *, case when latitude < 0 then 'S' else 'N' end as hemisphere, month(last_updated) as month from gated)"


def halves(spark, sf):
    return gated(spark, sf).withColumns(
        {"hemisphere": hemisphere(F.col("latitude")), "month": F.month("last_updated")}
    )


def _hist(source, value, bins, group):
    by = f"partition by {group}" if group else ""
    lead = f"{group}, " if group else ""
    return f"""x as (select {lead}cast({value} as double) as v, min({value}) over ({by}) as lo, max({value}) over ({by}) as hi,
  count({value}) over ({by}) as total from {source} where {value} is not null),
b as (select *, case when lo = hi then 0 else least(cast(floor((v - lo) / (hi - lo) * {bins}) as int), {bins - 1}) end as bin,
  (hi - lo) / {bins} as width from x),
r as (select {lead}bin, lo + bin * width as bin_low, lo + (bin + 1) * width as bin_high, count(*) as n,
  case when width > 0 then count(*) / (total * width) end as density from b group by {lead}bin, lo, hi, width, total)"""


@query(
    "value_histogram",
    sql(
        f"{_H}, {_hist('h', _Y, 50, 'hemisphere')}",
        "hemisphere:s bin:i bin_low:f bin_high:f n:i density:f",
        "r",
    ),
)
def value_histogram(spark, sf):
    out = charts.histogram(halves(spark, sf), _Y, 50, ["hemisphere"])
    return out.withColumnRenamed("count", "n")


@query(
    "wet_histogram",
    sql(
        f"wet as (select ln(1 + precip_mm) as lp from gated where precip_mm > 0), {_hist('wet', 'lp', 40, '')}",
        "bin:i bin_low:f bin_high:f n:i density:f",
        "r",
    ),
)
def wet_histogram(spark, sf):
    return charts.wet_histogram(gated(spark, sf, "precip_mm")).withColumnRenamed("count", "n")


@query(
    "kernel_density",
    sql(
        f"""{_H}, c as (select hemisphere, {_Y} as v, count(*) as n from h where {_Y} is not null group by all),
s as (select hemisphere, count(*) as total, min({_Y}) as lo, max({_Y}) as hi,
  stddev_samp({_Y}) * power(count(*), -0.2) as bw from h where {_Y} is not null group by all),
g as (select *, unnest(range(200)) as point from s),
r as (select g.hemisphere, point, lo + point * (hi - lo) / 199 as grid_value,
  sum(n * exp(-power((lo + point * (hi - lo) / 199 - v) / bw, 2) / 2)) / any_value(total * bw * sqrt(2 * pi())) as density
  from g join c using (hemisphere) group by g.hemisphere, point, lo, hi)""",
        "hemisphere:s point:i grid_value:f density:f",
        "r",
    ),
)
def kernel_density(spark, sf):
    return charts.kernel_density(halves(spark, sf), _Y, "hemisphere")


_TREND = f"""m as (select country, location_name, date_trunc('month', last_updated) as month, avg({_Y}) as mean
  from gated where {_Y} is not null group by all),
trend as (select *, case when count(*) over (partition by country, location_name) >= 3 then
  avg(mean) over (partition by country, location_name order by month rows between 2 preceding and current row)
  end as rolling_mean from m)"""


@query(
    "monthly_trend",
    sql(_TREND, "country:s location_name:s month:d mean:f rolling_mean:f", "trend"),
)
def monthly_trend(spark, sf):
    return charts.monthly_trend(gated(spark, sf), PANEL)


@query(
    "trend_slope",
    sql(
        f"""{_TREND}, x as (select *, (month::date - min(month::date) over (partition by country, location_name)) / 365.25 as xx from trend),
r as (select country, location_name, count(*) as n_months, case when count(*) >= 2 then regr_slope(mean, xx) end as slope_per_year
  from x group by all)""",
        "country:s location_name:s n_months:i slope_per_year:f",
        "r",
    ),
)
def trend_slope(spark, sf):
    return charts.trend_slope(charts.monthly_trend(gated(spark, sf), PANEL), PANEL)


@query(
    "density_grid",
    sql(
        """p as (select humidity as x, precip_mm as y from gated where humidity is not null and precip_mm is not null),
e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
b as (select least(cast(floor((x - x0) / (x1 - x0) * 40) as int), 39) as x_bin,
  least(cast(floor((y - y0) / (y1 - y0) * 40) as int), 39) as y_bin from p, e),
r as (select x_bin, y_bin, count(*) as n, log10(count(*)) as log10_count from b group by all)""",
        "x_bin:i y_bin:i n:i log10_count:f",
        "r",
    ),
)
def density_grid(spark, sf):
    out = charts.density_grid(gated(spark, sf, "humidity", "precip_mm"), "humidity", "precip_mm")
    return out.withColumnRenamed("count", "n")


def _box(source, groups, value):
    return f"""q as (select {groups}, count({value}) as n, quantile_cont({value}, 0.25) as q1, median({value}) as median,
  quantile_cont({value}, 0.75) as q3 from {source} group by all),
r as (select {groups}, q.n, q1, q.median, q3, min({value}) as whisker_low, max({value}) as whisker_high
  from {source} join q using ({groups}) where {value} between q1 - 1.5*(q3-q1) and q3 + 1.5*(q3-q1) group by all)"""


_BOX_OUT = "n:i q1:f median:f q3:f whisker_low:f whisker_high:f"


@query(
    "box_by_month",
    sql(
        f"{_H}, hh as (select hemisphere, month, {_Y} as v from h where {_Y} is not null), {_box('hh', 'hemisphere, month', 'v')}",
        f"hemisphere:s month:i {_BOX_OUT}",
        "r",
    ),
)
def box_by_month(spark, sf):
    return charts.box_stats(halves(spark, sf), ["hemisphere", "month"], _Y)


@query(
    "box_by_zone",
    sql(
        f"{PLACES}, {_box('places', 'climate_zone', 'place_mean')}",
        f"climate_zone:s {_BOX_OUT}",
        "r",
    ),
)
def box_by_zone(spark, sf):
    places = climate.place_period_means(gated(spark, sf, _Y, "latitude"), "climate_zone", PANEL)
    return charts.box_stats(places, ["climate_zone"], "place_mean")


@query(
    "box_by_continent",
    sql(
        f"""{SUMMARY}, dim as (select n_name as country, r_name as continent from nation join region on n_regionkey = r_regionkey),
c as (select * from summary join dim using (country)), {_box('c', 'continent', _Y)}""",
        f"continent:s {_BOX_OUT}",
        "r",
    ),
)
def box_by_continent(spark, sf):
    summary = spatial.country_summary(gated(spark, sf), PANEL, [_Y])
    placed = add_continent(summary, "country", country_regions(spark, sf))
    return charts.box_stats(placed, ["continent"], _Y)


@query(
    "monthly_band",
    sql(
        f"""r as (select date_trunc('month', last_updated) as month, quantile_cont({_Y}, 0.25) as q1, median({_Y}) as median,
  quantile_cont({_Y}, 0.75) as q3 from gated where {_Y} is not null group by all)""",
        "month:d q1:f median:f q3:f",
        "r",
    ),
)
def monthly_band(spark, sf):
    return charts.monthly_band(gated(spark, sf, _Y), PANEL)


@query(
    "score_cut",
    sql(
        f"""c as (select quantile_cont({_Y}, 0.01) as cut from gated),
r as (select cut, count_if({_Y} <= cut) as n_flagged, count({_Y}) as n_scores from gated, c group by cut)""",
        "cut:f n_flagged:i n_scores:i",
        "r",
    ),
)
def score_cut(spark, sf):
    return charts.score_cut(gated(spark, sf, _Y), _Y, 0.01)
