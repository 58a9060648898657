"""Sources and sinks: what is written is read back in full."""

import uuid

from pyspark.sql import functions as F

from paneltide.plans.bindings import PANEL, panel
from paneltide.plans.catalog.base import gated, query, sql
from paneltide.plans.catalog.forecasting import ungated, inverse_error_weights_all
from paneltide.session import shared_folder
from paneltide.sources import raw, sinks
from paneltide.spec import CONCENTRATIONS, INDICES, METRICS

_NUMBERS = [*METRICS, *CONCENTRATIONS]
_ID = "country:s location_name:s last_updated:t"


def _folder(spark):
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query(
    "raw_csv",
    sql(
        "r as (select * replace (date_trunc('minute', last_updated) as last_updated) from panel)",
        f"{_ID} condition_text:s " + " ".join(f"{c}:f" for c in [*_NUMBERS, *INDICES]),
        "r",
    ),
)
def raw_csv(spark, sf):
    """The panel written as a raw snapshot file, found among others and loaded."""
    wanted = [*PANEL.grain, "condition_text", *_NUMBERS, *INDICES]
    text = panel(spark, sf).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm"))
    raw_text = text.select(*[F.col(c).alias(c.title().replace("_", " ")) for c in wanted])
    folder = _folder(spark)
    sinks.write_table(raw_text, f"{folder}/{raw.CANDIDATE_NAMES[1]}")
    sinks.write_table(raw_text.where(F.lit(False)), f"{folder}/a_other.csv")
    loaded = raw.load_raw(spark, raw.find_raw_csv(spark, folder), PANEL)
    # Integers with nulls compare as doubles.
    return loaded.select(*wanted).withColumns({c: F.col(c).cast("double") for c in INDICES})


@query(
    "parquet_partitions",
    sql(
        """r as (select region_name, country, count(*) as n, sum(temperature_celsius) as total,
  min(last_updated) as first_seen from gated group by all)""",
        "region_name:s country:s n:i total:f first_seen:t",
        "r",
    ),
)
def parquet_partitions(spark, sf):
    slim = gated(spark, sf).select("region_name", *PANEL.grain, PANEL.value)
    path = sinks.write_parquet(slim, f"{_folder(spark)}/panel", ["region_name"])
    return (
        spark.read.parquet(path)
        .groupBy("region_name", "country")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(PANEL.value).alias("total"),
            F.min(PANEL.time).alias("first_seen"),
        )
    )


@query(
    "csv_table",
    sql(
        """r as (select country, condition_text, count(*) as n, avg(humidity) as humidity from gated group by all)""",
        "country:s condition_text:s n:i humidity:f",
        "r",
    ),
)
def csv_table(spark, sf):
    table = gated(spark, sf).groupBy("country", "condition_text").agg(
        F.count(F.lit(1)).alias("n"), F.avg("humidity").alias("humidity")
    )
    path = sinks.write_table(table, f"{_folder(spark)}/table")
    return spark.read.option("header", True).schema(table.schema).csv(path)


@query("json_weights", sql(ungated(1), "model:s weight:f", "weights"))
def json_weights(spark, sf):
    weights = inverse_error_weights_all(spark, sf)
    path = sinks.write_weights(weights, f"{_folder(spark)}/weights")
    return spark.read.schema(weights.schema).json(path)
