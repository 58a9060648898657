"""Reading raw snapshot files: headers, types and structural checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.spec import IMPERIAL_TWINS, REDUNDANT, WEATHER, PanelSpec, present

# File names tried first, in this order.
CANDIDATE_NAMES = (
    "GlobalWeatherRepository.csv",
    "Global Weather Repository.csv",
    "global_weather_repository.csv",
)


def normalized_name(name: str) -> str:
    words = re.split(r"[.\-\s_]+", str(name).strip().lower())
    return "_".join(w for w in words if w)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Snake-case every header; applying it twice changes nothing."""
    return df.toDF(*[normalized_name(c) for c in df.columns])


def coerce_types(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """Cast to the column contract; what does not parse becomes null.

    Only columns that exist are touched, so a drifting source still loads.
    """
    kinds = dict(df.dtypes)
    dropped = present(df, IMPERIAL_TWINS + REDUNDANT)
    out = df.drop(*dropped)
    if spec.time in kinds and kinds[spec.time] == "string":
        out = out.withColumn(spec.time, F.try_to_timestamp(F.trim(F.col(spec.time))))
    for c in present(out, spec.metrics + spec.concentrations + (spec.latitude, spec.longitude)):
        number = F.col(c).try_cast("double")
        out = out.withColumn(c, F.when(~F.isnan(number), number))
    for c in present(out, spec.indices):
        number = F.col(c).try_cast("double")
        out = out.withColumn(c, F.bround(number).try_cast("smallint"))
    for c in present(out, spec.categorical):
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def structure_report(df: DataFrame, spec: PanelSpec = WEATHER) -> DataFrame:
    """One row of counts: rows, rows without a time, rows sharing a grain key."""
    missing = [c for c in (spec.time, spec.value) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    per_key = df.groupBy(*spec.grain).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(spec.time).isNull(), F.col("_n"))), F.lit(0)).alias(
            "n_missing_time"
        ),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(
            "n_duplicate_key_rows"
        ),
    )


def validate(df: DataFrame, spec: PanelSpec = WEATHER, check_grain: bool = False) -> DataFrame:
    """Return ``df``; raise when a required column is absent or, on request, the grain repeats."""
    missing = [c for c in (spec.time, spec.value) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    if not isinstance(df.schema[spec.time].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{spec.time} must be a timestamp")
    if check_grain:
        n = structure_report(df, spec).first()["n_duplicate_key_rows"]
        if n:
            raise ValueError(f"grain violated: {n} rows share a key")
    return df


def pick_csv(names: Sequence[str]) -> str | None:
    """The file to read among ``names``: a known name, else the first other CSV."""
    by_base = {n.rsplit("/", 1)[-1]: n for n in names}
    for candidate in CANDIDATE_NAMES:
        if candidate in by_base:
            return by_base[candidate]
    usable = sorted(b for b in by_base if b.endswith(".csv") and "synthetic" not in b.lower())
    return by_base[usable[0]] if usable else None


def find_raw_csv(spark: SparkSession, folder: str) -> str | None:
    """Like :func:`pick_csv` over a folder of any file system Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return pick_csv([status.getPath().toString() for status in fs.listStatus(path)])


def read_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as strings: no inference pass over the data."""
    return spark.read.option("header", True).option("inferSchema", False).csv(paths)


def load_raw(
    spark: SparkSession, paths: str | Sequence[str], spec: PanelSpec = WEATHER
) -> DataFrame:
    raw = normalize_columns(read_csv(spark, paths))
    return validate(coerce_types(raw, spec), spec)
