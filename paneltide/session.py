"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paneltide")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: HotSpot never compiles a method of more bytecode than this; it is interpreted, many times slower.
COMPILED_BYTES = 8000


def limit_methods(spark: SparkSession) -> None:
    """Let stages of many columns fall back from one generated method to one for each expression.

    Spark's own limit, 65535 bytes, lets methods through that the JVM then only interprets. A value
    the session already has is kept.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) is None:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def release_shuffles(spark: SparkSession) -> None:
    """Drop the shuffle files of finished jobs whose tables are no longer held.

    Spark keeps them until the driver collects its garbage, which may be never.
    """
    spark.sparkContext._jvm.System.gc()


def materialized(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing
    the branches above, and keeps column pruning for the readers. ``release`` is for
    tables that many rows were shuffled for.
    """
    return materialized_in_turn([df], release)


def materialized_in_turn(parts: Iterable[DataFrame], release: bool = True) -> DataFrame:
    """One table of all ``parts``, each written before the next one is asked for."""
    path = ""
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
        if release:
            release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
