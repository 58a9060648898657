import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.functions.skew import by_group_size
from paneltide.functions.joins import attach
from paneltide.functions.positions import numbered_ranges, with_positions
from paneltide.functions.quantiles import FINE, order_bucket, quantiles, ranks_of_counts, value_counts
from paneltide.functions.scalar import air_quality_label, band, climate_zone, hemisphere_zone, rounded, season
from paneltide.spec import PanelSpec


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.normal(0, 5, 3000), 1)})
    zero = pd.DataFrame({"g": "zero", "v": np.where(rng.random(500) < 0.6, 0.0, rng.random(500))})
    tiny = pd.DataFrame({"g": "tiny", "v": [1.0, None, -2.0]})
    one = pd.DataFrame({"g": "one", "v": [7.5]})
    return pd.concat([hot, zero, tiny, one], ignore_index=True)


@pytest.mark.parametrize("limit", [0, 100, 10**6])
def test_quantiles_match_pandas_on_every_path(spark, numbers, limit):
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "max": 1.0}
    got = (
        quantiles(spark.createDataFrame(numbers), ["g"], ["v"], probs, mad=True, limit=limit)
        .toPandas()
        .set_index("g")
    )
    for g, v in numbers.groupby("g")["v"]:
        v = v.dropna()
        for name, p in probs.items():
            assert got.loc[g, f"v__{name}"] == pytest.approx(v.quantile(p), abs=1e-9)
        assert got.loc[g, "v__mad"] == pytest.approx((v - v.median()).abs().median(), abs=1e-9)
        assert got.loc[g, "v__n"] == len(v)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_of_the_whole_table(spark, numbers, limit):
    got = quantiles(spark.createDataFrame(numbers), [], ["v"], {"q": 0.37}, limit=limit).first()
    assert got["v__q"] == pytest.approx(numbers["v"].dropna().quantile(0.37))


def test_ranks_are_average_ranks(spark, numbers):
    counts = value_counts(spark.createDataFrame(numbers), ["g"], ["v"])
    got = ranks_of_counts(counts, ["g"]).toPandas().set_index(["g", "v"])["rank"]
    want = numbers.dropna().assign(r=lambda d: d.groupby("g")["v"].rank())
    for g, v, r in want.itertuples(index=False):
        assert got[(g, v)] == r


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_of_values_that_share_a_bucket(spark, limit):
    v = 1000 + np.random.default_rng(3).permutation(4000) * 1e-6
    df = spark.createDataFrame(pd.DataFrame({"v": np.r_[v, np.inf, -np.inf, -v]}))
    got = quantiles(df, [], ["v"], {"a": 0.1, "b": 0.5, "c": 0.73, "d": 1.0}, limit=limit).first()
    every = np.sort(np.r_[v, np.inf, -np.inf, -v])
    for name, p in {"a": 0.1, "b": 0.5, "c": 0.73}.items():
        assert got[f"v__{name}"] == pytest.approx(np.quantile(every, p), abs=1e-9)
    assert got["v__d"] == np.inf


def test_fine_buckets_lie_inside_coarse_ones(spark):
    v = np.r_[np.random.default_rng(4).lognormal(0, 20, 3000), 0.0, 1.0, np.e]
    df = spark.createDataFrame(pd.DataFrame({"v": np.r_[v, -v]}))
    both = df.select("v", order_bucket(F.col("v")).alias("b"), order_bucket(F.col("v"), FINE).alias("f")).orderBy("v").toPandas()
    assert both["b"].is_monotonic_increasing and both["f"].is_monotonic_increasing
    assert both.groupby("f")["b"].nunique().max() == 1


def test_order_bucket_is_monotone(spark):
    values = sorted([-1e9, -3.2, -3.1999, -1e-12, 0.0, 1e-300, 1e-12, 0.5, 0.50001, 7.0, 1e12])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[1] for r in sorted(df.select("v", order_bucket(F.col("v"))).collect())]
    assert buckets == sorted(buckets)


def test_attach_keeps_unmatched_rows_and_splits_keys(spark):
    rows = spark.range(100).select(F.lit("k").alias("k"), "id")
    rows = rows.unionByName(spark.range(1).select(F.lit("none").alias("k"), "id"))
    stats = spark.createDataFrame([("k", 5.0)], "k string, s double")
    got = attach(rows, stats, ["k"], spread=["id"]).groupBy("k").agg(F.sum("s"), F.count("*"))
    assert {tuple(r) for r in got.collect()} == {("k", 500.0, 100), ("none", None, 1)}


@pytest.mark.parametrize("limit", [0, 10**6])
def test_positions_follow_time_then_order(spark, limit):
    rows = [("a", f"2024-01-0{1 + i // 3} 0{i % 3}:00:00", i) for i in range(9)]
    rows += [("a", None, 9), ("b", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:00:00", 0)]
    df = spark.createDataFrame(rows, "k string, t string, o int")
    df = df.withColumn("t", F.to_timestamp("t"))
    spec = PanelSpec(keys=("k",), time="t", order=("o",))
    got = with_positions(df, spec, limit=limit).collect()
    assert all(r["_pos"] == r["o"] for r in got)
    assert {r["_len"] for r in got if r["k"] == "a"} == {10}


def test_labels(spark):
    df = spark.createDataFrame([(10.0,), (-30.0,), (54.9,), (-70.0,), (None,)], "lat double")
    lat = F.col("lat")
    got = df.select(climate_zone(lat), hemisphere_zone(lat), season(F.lit(12), lat)).collect()
    assert [r[0] for r in got] == ["Tropical", "Subtropical", "Temperate", "Polar", "Unknown"]
    assert [r[1] for r in got] == [
        "Tropical-N",
        "Subtropical-S",
        "Temperate-N",
        "Polar-S",
        "Unknown",
    ]
    assert [r[2] for r in got] == ["Winter", "Summer", "Winter", "Summer", "Unknown"]
    one = spark.range(1).select(
        air_quality_label(F.lit(3)), air_quality_label(F.lit(7)), band(F.lit(5.0), ((5.0, "low"),))
    )
    assert tuple(one.first()) == ("Unhealthy (Sensitive)", None, "low")


def test_quantiles_agree_on_both_ways_for_odd_groups(spark):
    inf = float("inf")
    rows = [("a", float(i % 7)) for i in range(40)] + [("nulls", None)] * 3 + [("b", inf), ("b", 1.0), ("b", -inf)]
    rows += [("c", inf), ("c", inf), ("n", float("nan")), ("n", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "mid": 0.5}
    one, other = (
        sorted(map(tuple, quantiles(df, ["k"], ["v"], probs, limit=limit).collect())) for limit in (10**6, 0)
    )
    assert repr(one) == repr(other)  # half way from minus infinity is not a number on both ways
    assert [r[:2] for r in one] == [("a", 40), ("b", 3), ("c", 2), ("n", 1), ("nulls", 0)]


def test_null_keys_count_by_their_number(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("x", i) for i in range(5)], "k string, i int")
    seen = {}

    def noted(name):
        def apply(rows):
            seen[name] = rows.count()
            return rows

        return apply

    assert by_group_size(df, ["k"], noted("small"), noted("large"), limit=10).count() == 55
    assert seen == {"small": 5, "large": 50}


def test_written_statistics_attach_alike_on_both_ways(spark):
    from paneltide.functions.joins import attach_written

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("c", 4.0), (None, 5.0)], "k string, v double")
    stats = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, s long")
    for how in ("left", "inner"):
        sent, salted = (attach_written(rows, stats, ["k"], ["v"], how, few) for few in (10, 2))
        assert sorted(map(str, sent.collect())) == sorted(map(str, salted.collect()))


def hot_rows():
    """A day with most rows of a hot series, a series mostly without times, a null key, and small ones."""
    rows = [("hot", f"2024-01-05 {i % 24:02d}:00:00", i) for i in range(3000)]
    rows += [("hot", f"2024-01-0{1 + i % 4} 00:00:00", 9000 + i) for i in range(40)]
    rows += [("untimed", None if i % 10 else f"2024-02-{1 + i // 100:02d} 00:00:00", i) for i in range(2000)]
    rows += [(None, f"2024-03-{1 + i % 28:02d} 00:00:00", i) for i in range(500)]
    return rows + [(f"s{i % 7}", "2024-01-01 00:00:00", i) for i in range(50)]


@pytest.mark.parametrize("total", [True, False])
def test_positions_of_hot_days_missing_times_and_null_keys(spark, total):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t string, o int").withColumn("t", F.to_timestamp("t")).repartition(5)
    spec = PanelSpec(keys=("k",), time="t", order=("o",), total=total)
    want, seen = {}, {}
    for k, t, o in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or "", r[2])):
        want[k, o] = seen[k] = seen.get(k, -1) + 1
    got = with_positions(df, spec, limit=0).collect()
    assert {(r.k, r.o): r["_pos"] for r in got} == want and len(got) == len(rows)
    assert all(r["_len"] == seen[r.k] + 1 for r in got)


def test_a_hot_day_and_rows_without_time_are_spread_over_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    rows = hot_rows()
    spark.conf.set(key, "false")
    try:
        df = spark.createDataFrame(rows, "k string, t string, o int").withColumn("t", F.to_timestamp("t"))
        parts = numbered_ranges(df, PanelSpec(keys=("k",), time="t")).groupBy(F.shiftright("_at", 33).alias("p")).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(parts) == 4 and max(r["count"] for r in parts) < len(rows) * 0.4


def test_rounding_in_doubles_goes_away_from_zero_at_halves(spark):
    values = [0.5, -0.5, 2.5, -2.5, 1.4999999, 0.0, 3e15 + 0.5, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 0)).collect()]
    assert got[:6] == [1, -1, 3, -3, 1, 0] and got[6] == round(values[6] + 0.25)
    assert got[7] == float("inf") and got[8] != got[8] and got[9] is None
    decimals = np.round(np.random.default_rng(5).normal(0, 1e4, 2000), 6).tolist()
    frame = spark.createDataFrame([(v,) for v in decimals], "v double").select("v", rounded(F.col("v") + 1e-9, 6).alias("r"))
    assert frame.where("v != r").count() == 0
