"""A panel over the benchmark star schema, so every operator has data to run on.

One supplier is one place, one line item is one snapshot. The text is shared by
Spark and the checking database; only the hour arithmetic differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneltide.spec import PanelSpec

PANEL_SQL = """
select n_name as country, s_name as location_name, r_name as region_name,
  cast((s_suppkey*37)%181-90 as double) as latitude,
  cast((s_suppkey*61)%361-180 as double) as longitude,
  l_shipdate + {hours} as last_updated,
  l_quantity*1.55-15 as temperature_celsius,
  l_quantity*1.6-14 as feels_like_celsius,
  case when l_discount=0 then null else l_discount*1000 end as humidity,
  case when month(l_shipdate)=2 then null else nullif(l_tax,0)*5000+900 end as pressure_mb,
  greatest(cast(0 as double), l_extendedprice/1000-60) as precip_mm,
  cast((l_partkey*7)%41 as double) as wind_kph,
  cast((l_partkey*7)%41 as double)*1.3 as gust_kph,
  cast((l_partkey*13)%400 as double) as wind_degree,
  cast((l_orderkey*3)%101 as double) as cloud,
  cast(l_linenumber*2 as double) as uv_index,
  case when l_orderkey%33=0 then null else cast(l_orderkey%11 as double) end as visibility_km,
  case when l_partkey%17=0 then null else 60/((l_partkey*7)%41+2.0)+l_discount*100 end as air_quality_pm2_5,
  case when l_partkey%17=3 then null else 90/((l_partkey*7)%41+2.0)+l_quantity end as air_quality_pm10,
  case when month(l_shipdate)=7 then null else cast(l_quantity*3+(l_partkey%5) as double) end as air_quality_ozone,
  case when l_orderkey%29=0 then null else l_extendedprice/100 end as air_quality_carbon_monoxide,
  case when l_partkey%23=0 then null else l_quantity/2+l_tax*100 end as air_quality_nitrogen_dioxide,
  case when l_orderkey%31=0 then null else cast(l_partkey%37 as double)/4 end as air_quality_sulphur_dioxide,
  cast(case when l_partkey%19=0 then null else l_linenumber%6+1 end as smallint) as air_quality_us_epa_index,
  cast(case when l_orderkey%19=0 then null else l_partkey%10+1 end as smallint) as air_quality_gb_defra_index,
  l_returnflag||l_linestatus as condition_text,
  l_orderkey, l_linenumber, l_partkey
from {lineitem} join {supplier} on l_suppkey=s_suppkey
  join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey
"""

PANEL = PanelSpec(order=("l_orderkey", "l_linenumber", "l_partkey"), total=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole panel as a lazy view."""
    names = ("lineitem", "supplier", "nation", "region")
    text = PANEL_SQL.replace("{hours}", "make_dt_interval(0, l_linenumber)")
    tables = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(text, **tables)


def country_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country to continent dimension of the benchmark schema."""
    return spark.sql(
        "select n_name as country, r_name as continent"
        " from {nation} join {region} on n_regionkey = r_regionkey",
        nation=table(spark, sf_dir, "nation"),
        region=table(spark, sf_dir, "region"),
    )
