import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import cleaning as op
from paneltide.sources import raw
from paneltide.spec import PanelSpec

SPEC = PanelSpec(keys=("k",), time="t", value="temperature_celsius", order=("seq",))
N = None
BOTH = [N, N, N, 1, N, N, N, N, N, N, 8, N, N, N], [1, 1, 1, 1, 2, 3, 3, 3, 6, 7, 8, 8, 8, 8]
FORWARD = BOTH[0], [N, N, N, 1, 2, 3, 3, 3, 3, 3, 8, 8, 8, 8]
SHORT = [N, N, N, 1, N, N, N, N, 6, N, N, N]
SHORT_BOTH = [1, 1, 1, 1, 2, 3, 4, 5, 6, 6, 6, 6]
SHORT_FORWARD = [N, N, N, 1, 2, 3, 3, 3, 6, 6, 6, 6]


def series(spark, key, values):
    rows = [
        (key, f"2024-01-{i + 1:02d}", i, 20.0, v if v is None else float(v), v and float(v), N, "x")
        for i, v in enumerate(values)
    ]
    schema = (
        "k string, t string, seq int, temperature_celsius double, humidity double,"
        " air_quality_pm2_5 double, precip_mm double, condition_text string"
    )
    return spark.createDataFrame(rows, schema).withColumn("t", F.to_timestamp("t"))


@pytest.mark.parametrize("limit, block", [(10**6, 100), (0, 100), (0, 3), (13, 4)])
def test_gap_filling_vectors(spark, limit, block):
    df = series(spark, "a", BOTH[0]).unionByName(series(spark, "b", SHORT))
    got = op.impute_missing(df, SPEC, limit=limit, block_rows=block).orderBy("k", "t").toPandas()
    a, b = got[got.k == "a"], got[got.k == "b"]
    assert a["humidity"].tolist() == BOTH[1]
    assert b["humidity"].tolist() == SHORT_BOTH
    for frame, want in ((a, FORWARD[1]), (b, SHORT_FORWARD)):
        have = [None if v != v else v for v in frame["air_quality_pm2_5"]]
        assert have == want
    assert got["precip_mm"].eq(0).all()
    assert a["air_quality_pm2_5_was_missing"].tolist() == [int(v is None) for v in BOTH[0]]


def test_gap_filling_against_pandas(spark):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.5 else float(rng.integers(0, 50)) for _ in range(31)]
    got = op.impute_missing(series(spark, "a", values), SPEC, limit=0, block_rows=5)
    s = pd.Series(values, dtype=float)
    want = s.interpolate(method="linear", limit=2, limit_direction="both").ffill().bfill()
    assert np.allclose(got.orderBy("t").toPandas()["humidity"], want)


def test_dedup_keeps_last_by_order(spark):
    rows = [("a", 1, 0, 5.0), ("a", 1, 1, 6.0), ("a", 1, 1, 6.0), ("a", 2, 0, 7.0)]
    df = spark.createDataFrame(rows, "k string, t int, seq int, temperature_celsius double")
    got = sorted(tuple(r) for r in op.dedup(df, SPEC).collect())
    assert got == [("a", 1, 1, 6.0), ("a", 2, 0, 7.0)]
    loose = op.dedup(df.drop("seq"), SPEC.but(order=()))
    assert sorted(tuple(r) for r in loose.collect()) == [("a", 1, 6.0), ("a", 2, 7.0)]


def test_gate_keeps_limits_and_nulls_the_rest(spark):
    df = spark.createDataFrame([(60.0,), (60.1,), (None,), (-90.0,)], "temperature_celsius double")
    got = [r[0] for r in op.gate_bounds(df).collect()]
    assert got == [60.0, None, None, -90.0]


def test_outlier_flag_needs_spread(spark):
    rows = [("a", f"2024-01-{d:02d}", d, v) for d, v in enumerate([1.0, 2.0, 3.0, 2.0, 1.0, 40.0], 1)]
    rows += [("b", f"2024-01-{d:02d}", d, v) for d, v in enumerate([5.0, 5.0, 5.0, 5.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "k string, t string, seq int, temperature_celsius double")
    df = df.withColumn("t", F.to_timestamp("t"))
    got = op.flag_outliers(df, SPEC).where("temperature_celsius_is_outlier").collect()
    assert [(r["k"], r["temperature_celsius"]) for r in got] == [("a", 40.0)]


def test_clean_check_reports_every_failure(spark):
    rows = [("a", 1, 100.0, 120.0), ("a", 1, 1.0, 50.0)]
    df = spark.createDataFrame(rows, "k string, t int, temperature_celsius double, humidity double")
    with pytest.raises(ValueError, match="grain=2.*humidity=1"):
        op.validate_clean(df, SPEC)


def test_headers_normalise_and_stay(spark):
    df = spark.createDataFrame(
        [(1, 2, 3)], ["Soil PM0.1", "Read At", "soil_code-b-Index"]
    )
    once = raw.normalize_columns(df)
    assert once.columns == ["soil_pm0_1", "read_at", "soil_code_b_index"]
    assert raw.normalize_columns(once).columns == once.columns


def test_csv_round_trip(spark, tmp_path):
    text = (
        "country,location_name,last_updated,temperature_celsius,temperature_fahrenheit,"
        "air_quality_us-epa-index,humidity\n"
        "A,X,2024-01-01 10:15,12.5,54,2.5,abc\nA,X,nonsense,13,55,3.5,40\n"
    )
    (tmp_path / "other.csv").write_text(text)
    (tmp_path / "synthetic_run.csv").write_text("x\n1\n")
    path = raw.find_raw_csv(spark, str(tmp_path))
    assert path.endswith("other.csv")
    df = raw.load_raw(spark, path)
    assert "temperature_fahrenheit" not in df.columns
    first, second = df.orderBy("temperature_celsius").collect()
    assert (first["air_quality_us_epa_index"], second["air_quality_us_epa_index"]) == (2, 4)
    assert first["humidity"] is None and second["last_updated"] is None
    report = raw.structure_report(df).first()
    assert (report["n_rows"], report["n_missing_time"]) == (2, 1)
    assert raw.pick_csv(["/d/z.csv", "/d/Global Weather Repository.csv"]).startswith("/d/Global")


def test_keep_last_sends_rows_unsorted_but_combines_a_heavy_key(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 0, if(id % 50 = 0, null, id % 700)) as k", "id as seq", "id * 2 as v")
    want = df.toPandas().sort_values("seq").groupby("k", dropna=False)["v"].last()
    for limit in (0, 100, 10**6):
        last = op.last_rows(df.repartition(4), ["k"], ["seq"], rare=True, limit=limit)
        got = last.toPandas().set_index("k")["v"]
        assert len(got) == len(want) and got.sort_index().tolist() == want.sort_index().tolist()
    plan = last._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "Aggregate" not in below
    # places have many rows each: these still combine before the shuffle
    plan = op.last_rows(df, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Exchange hashpartitioning") :]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_windowed_rows_are_not_shuffled_to_be_joined(spark):
    df = series(spark, "a", BOTH[0]).unionByName(series(spark, None, SHORT))
    got = op.impute_missing(df, SPEC, limit=0, block_rows=3).orderBy("t").toPandas()
    assert got[got.k.isna()]["humidity"].tolist() == SHORT_BOTH
    assert got[got.k == "a"]["humidity"].tolist() == BOTH[1]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(op._neighbours_in_blocks(df, ["humidity"], SPEC, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    join = plan[plan.index("SortMergeJoin") :]
    assert "_series" in join.split("\n")[0]
    assert "Window" in join[: join.index("Exchange")]  # nothing between them


def test_outlier_flags_are_the_same_both_ways_and_rows_are_sent_once(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in ("a", "b", None):
        for i in range(60):
            v = None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(rng.integers(0, 6)) + 90.0 * (i % 17 == 1)
            rows.append((k, None if i == 7 else f"2024-0{1 + i % 3}-{1 + i // 3:02d}", i, v, 1.0))
    df = spark.createDataFrame(rows, "k string, t string, seq int, temperature_celsius double, humidity double")
    df = df.withColumn("t", F.to_timestamp("t"))
    one, two = (op.flag_outliers(df, SPEC, limit=limit) for limit in (10**6, 0))
    assert one.columns == two.columns
    got = one.orderBy("seq", "k").collect()
    assert str(got) == str(two.orderBy("seq", "k").collect())
    for r in got:
        same = [x for x in rows if x[0] == r.k and r.t is not None and x[1] and x[1][:7] == f"{r.t:%Y-%m}"]
        known = np.array([x[3] for x in same if x[3] is not None and x[3] == x[3]])
        mad = np.median(np.abs(known - np.median(known))) if len(known) else 0
        v = r.temperature_celsius
        z = 0.6745 * (v - np.median(known)) / mad if mad > 0 and v is not None else 0.0
        want = r.k is not None and mad > 0 and v is not None and (v != v or abs(z) > 3.5)
        assert r.temperature_celsius_is_outlier == want and not r.humidity_is_outlier
    assert any(r.temperature_celsius_is_outlier for r in got)
    plan = plan_of(one)
    assert "Join" not in plan and plan.count("Exchange") == 1
