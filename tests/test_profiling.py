import datetime as dt

import pytest

from paneltide.operators.profiling import profile_schema

ROWS = [
    (1, 0.0, "a", b"x", [1, 2], dt.datetime(2024, 10, 27, 0, 30), "k"),
    (1, -0.0, "b", b"x", [1, 2], dt.datetime(2024, 10, 27, 1, 30), "k"),
    (2, float("nan"), "", b"y", [12], dt.datetime(2024, 10, 27, 1, 30), "k"),
    (None, float("nan"), None, None, [], None, "k"),
    (None, None, "null", b"", None, None, "k"),
]
KIND = "n long, x double, text string, raw binary, list array<int>, at timestamp, `odd.name` string"


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])  # in the second two instants share a local time
def test_exact_distinct_values_of_every_column(spark, zone):
    frame = spark.createDataFrame(ROWS, KIND)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.column: r for r in profile_schema(frame).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {c: r.n_unique for c, r in got.items()} == {"n": 2, "x": 2, "text": 4, "raw": 3, "list": 3, "at": 2, "odd.name": 1}
    assert {c: r.pct_null for c, r in got.items()} == {"n": 40.0, "x": 20.0, "text": 20.0, "raw": 20.0, "list": 20.0, "at": 40.0, "odd.name": 0.0}
    assert got["n"].example == "1" and got["n"].dtype == "bigint" and got["text"].example == "" and got["odd.name"].example == "k"


def test_sketches_and_tables_without_rows(spark):
    frame = spark.range(1000).selectExpr("id", "id % 7 as few", "cast(null as string) as none")
    exact = {r.column: r.n_unique for r in profile_schema(frame).collect()}
    sketched = {r.column: r.n_unique for r in profile_schema(frame, approximate=True).collect()}
    assert exact == {"id": 1000, "few": 7, "none": 0}
    assert sketched["few"] == 7 and sketched["none"] == 0 and sketched["id"] == pytest.approx(1000, rel=0.1)
    for approximate in (False, True):
        none = profile_schema(frame.limit(0), approximate).collect()
        assert [(r.n_unique, r.pct_null, r.example) for r in none] == [(0, 0.0, None)] * 3
