import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paneltide.operators import anomaly as op
from paneltide.operators import correlation, isolation, panel_model, seasonal
from paneltide.operators import air_quality
from paneltide.operators.air_quality import binned_median
from paneltide.operators import neighbours
from paneltide.operators.neighbours import in_parts, local_outlier_factor
from paneltide.sources.sinks import write_anomalies
from paneltide.spec import PanelSpec

SPEC = PanelSpec(keys=("country", "location_name"))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    n = 300
    rows = pd.DataFrame(
        {
            "country": "A",
            "location_name": np.where(np.arange(n) % 2, "X", "Y"),
            "last_updated": pd.date_range("2024-01-01", periods=n, freq="2h"),
            "latitude": 10.0,
            "longitude": 20.0,
            "temperature_celsius": rng.normal(20, 1, n),
            "humidity": rng.normal(50, 5, n),
            "pressure_mb": rng.normal(1000, 3, n),
            "condition_text": np.where(np.arange(n) % 10 == 0, "rare", "common"),
        }
    )
    rows.loc[150, ["temperature_celsius", "humidity", "pressure_mb"]] = [55.0, 5.0, 900.0]
    return spark.createDataFrame(rows)


def test_planted_outlier_is_found_by_every_method(spark, planted, tmp_path):
    found = op.detect_anomalies(planted, SPEC, trees=40)
    top = found.orderBy("iforest_score").first()
    assert top["temperature_celsius"] == 55.0
    assert top["anomaly_methods"] == "mad|iqr|iforest|lof" and top["is_high_confidence"]
    assert top["latitude"] == 10.0
    path = write_anomalies(found, str(tmp_path), SPEC)
    summary = spark.read.parquet(str(tmp_path / "anomalies_summary.parquet")).collect()
    assert {r["metric"] for r in summary} == {
        "n_anomalies",
        "n_high_confidence",
        "n_cities_with_anomalies",
    }
    assert spark.read.parquet(path).count() == found.count()


def test_isolation_does_not_depend_on_partitions(planted):
    cols = ["temperature_celsius", "humidity", "pressure_mb"]
    scores = [
        op.detect_multivariate(df, SPEC, cols, trees=20)
        .orderBy("last_updated")
        .toPandas()["iforest_score"]
        for df in (planted, planted.repartition(7))
    ]
    assert np.allclose(*scores)


def test_samples_are_whole_where_keys_repeat(spark):
    df = spark.range(3000).selectExpr("'A' as k", "array(double(id)) as x")
    rows = isolation.tree_samples(df, "x", ["k"], 3000, trees=4, sample=16, seed=1).collect()
    assert len(rows) == 64 and len({r._r for r in rows}) == 64
    assert {t: sum(r.tree == t for r in rows) for t in range(4)} == dict.fromkeys(range(4), 16)


def test_depths_follow_each_tree():
    x = np.round(np.random.default_rng(4).normal(size=(64, 3)), 1)
    nodes = isolation.grow(42, 64)(pd.DataFrame({"tree": 7, "x": list(x), "_r": range(64)}))
    by = nodes.set_index("node")

    def walk(row):
        at = 1
        while by.feature[at] >= 0:
            at = 2 * at + int(row[by.feature[at]] >= by.cut[at])
        return by.depth[at] / isolation.UNIT

    assert np.allclose(isolation.depths(x, isolation.table(nodes)), [walk(row) for row in x])


def brute_factors(x, k):
    """The paper's definition over all rows; a tie with the k-th neighbour is a neighbour."""
    n = len(x)
    square = np.round(((x[:, None] - x[None]) ** 2).sum(-1), 8)
    np.fill_diagonal(square, np.inf)
    kth = np.sort(square, axis=1)[:, min(k, n - 1) - 1]
    near = [np.flatnonzero(square[i] <= kth[i]) for i in range(n)]
    lrd = [1 / (np.sqrt(np.maximum(square[i, near[i]], kth[near[i]])).mean() + 1e-10) for i in range(n)]
    return np.array([np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(n)])


@pytest.mark.parametrize(("block", "chunk"), [(1024, 1024), (8, 1), (32, 3)])
def test_factors_of_all_rows(spark, block, chunk):
    rng = np.random.default_rng(block)
    x = np.concatenate([
        rng.normal(size=(150, 3)),
        rng.integers(0, 4, size=(150, 3)).astype(float),  # many ties and equal rows
        np.tile([[1.0, 2.0, 3.0]], (120, 1)),  # one vector in a quarter of all rows
        [[40.0, 0.0, 0.0]],
    ])
    rows = [("A", f"p{i % 130}", i, [float(v) for v in r]) for i, r in enumerate(x)]  # most series have three rows
    df = spark.createDataFrame(rows, "country string, location_name string, last_updated long, _x array<double>")
    got = local_outlier_factor(df.repartition(3), "_x", SPEC, neighbours=6, block=block, chunk=chunk).toPandas()
    have = got.sort_values("last_updated")["lof"].to_numpy()
    assert np.allclose(have, brute_factors(x, 6), rtol=1e-7)


def test_groups_of_points_meet_their_blocks_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(600, 3)), 1e16 * rng.normal(size=(30, 3))])  # some too large for single precision
    points = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "id long, x array<double>, w long")
    rounds, write = [], neighbours.materialized_in_turn
    monkeypatch.setattr(neighbours, "materialized_in_turn", lambda parts: write(rounds.append(p) or p for p in parts))
    got = neighbours.nearest(points, 5, block=16).toPandas()
    assert len(rounds) > 1
    near = (got.groupby("id")["square"].max() ** 0.5).sort_index().to_numpy()
    every = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)
    assert np.allclose(near, every[:, 5]) and (got.groupby("id").size() >= 5).all()
    assert len(set(neighbours._apart(spark, 9))) == 9


def test_factors_of_few_rows(spark):
    kind = "country string, location_name string, last_updated long, _x array<double>"
    one = [("A", "p", 1, [1.0, 2.0])]
    assert local_outlier_factor(spark.createDataFrame([], kind), "_x", SPEC).count() == 0
    assert [r.lof for r in local_outlier_factor(spark.createDataFrame(one, kind), "_x", SPEC).collect()] == [None]
    same = [("A", "p", k, [1.0, 2.0]) for k in range(5)]
    assert [r.lof for r in local_outlier_factor(spark.createDataFrame(same, kind), "_x", SPEC).collect()] == [1.0] * 5
    two = [("A", "p", 1, [0.0, 0.0]), ("A", None, 2, [3.0, 4.0])]
    assert [r.lof for r in local_outlier_factor(spark.createDataFrame(two, kind), "_x", SPEC).collect()] == pytest.approx([1.0, 1.0])


def test_lift_and_days(spark):
    base = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "condition_text string")
    anom = spark.createDataFrame([("b",), ("b",), ("a",), ("new",)], "condition_text string")
    got = {r["condition"]: r["lift"] for r in op.condition_lift(anom, base).collect()}
    assert got == {"b": 2.5, "a": pytest.approx(0.3125), "new": float("inf")}
    times = ["2024-01-01"] * 60 + [f"2024-01-{d:02d}" for d in range(2, 32)]
    days = spark.createDataFrame([(t,) for t in times], "t string").select(
        F.to_timestamp("t").alias("last_updated")
    )
    flagged = op.anomalies_by_day(days, SPEC).where("suspected_ingestion_artifact").collect()
    assert [str(r["date"]) for r in flagged] == ["2024-01-01"]


def test_spearman_uses_each_pairs_complete_rows(spark):
    rng = np.random.default_rng(6)
    df = pd.DataFrame(rng.normal(size=(300, 3)).round(1), columns=list("abc"))
    df.loc[rng.random(300) < 0.3, "b"] = None
    df["flat"] = 1.0
    got = correlation.correlations(spark.createDataFrame(df), ["a", "b", "c", "flat"]).toPandas()
    got = got.set_index(["x", "y"])
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = df[[x, y]].dropna()
        ranks = both.rank().corr().iloc[0, 1]
        assert got.loc[(x, y), "spearman"] == pytest.approx(ranks)
        assert got.loc[(x, y), "pearson"] == pytest.approx(both.corr().iloc[0, 1])
    assert got.loc[("a", "flat")].isna()["spearman"]


@pytest.mark.parametrize("lookup", [0, 100, 1 << 20])
def test_spearman_is_the_same_for_columns_of_few_and_many_values(spark, lookup):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 4, 400) * 1.0, "c": rng.integers(0, 3, 400) * 1.0})
    df["d"] = df["a"] + rng.normal(size=400)
    for c in "bd":
        df.loc[rng.random(400) < 0.3, c] = None
    pairs = [("a", "b"), ("c", "a"), ("a", "d"), ("b", "c"), ("d", "b")]
    got = correlation.spearman(spark.createDataFrame(df).repartition(3), pairs, lookup).toPandas().set_index(["x", "y"])
    assert len(got) == len(pairs)
    for x, y in pairs:
        both = df[[x, y]].dropna()
        assert got.loc[(x, y), "n"] == len(both)
        assert got.loc[(x, y), "spearman"] == pytest.approx(both.rank().corr().iloc[0, 1])


def test_ranks_of_many_values_come_from_pieces_also_of_one_heavy_value(spark, monkeypatch):
    rng = np.random.default_rng(10)
    df = pd.DataFrame({"a": rng.normal(size=900), "b": rng.integers(0, 5, 900) * 1.0, "one": 3.0})
    df.loc[rng.random(900) < 0.5, "a"] = 0.25  # holds several pieces
    df["d"] = np.where(rng.random(900) < 0.4, -7.0, df["a"] + rng.normal(size=900))
    df.loc[3, "d"] = np.inf
    for c in "abd":
        df.loc[rng.random(900) < 0.2, c] = None
    df["e"] = df["b"].where(df["a"].notna(), 2.0)
    table = spark.createDataFrame(df).repartition(3)
    plans, collect = [], correlation._joined_up
    monkeypatch.setattr(correlation, "_joined_up", lambda p, n: plans.append(p._jdf.queryExecution().toString()) or collect(p, n))
    for lookup in (0, 100):
        got = correlation.spearman(table, [(x, y) for x in df for y in df if x < y], lookup, piece=40).toPandas().set_index(["x", "y"])
        for x, y in got.index:
            both = df[[x, y]].dropna()
            want = both.rank().corr().iloc[0, 1]
            assert got.loc[(x, y), "n"] == len(both)
            if np.isnan(want):
                assert np.isnan(got.loc[(x, y), "spearman"])
            else:
                assert got.loc[(x, y), "spearman"] == pytest.approx(want)
    assert plans and not any("Join" in p for p in plans)  # rows meet no table of ranks


def test_pearson_keeps_large_means_apart_from_constant_and_endless_sides(spark):
    rng = np.random.default_rng(9)
    df = pd.DataFrame({"a": 1e9 + rng.normal(size=200), "part": rng.normal(size=200), "end": rng.normal(size=200)})
    df["b"] = df["a"] - 1e9 + rng.normal(size=200)
    df["held"] = np.where(df["part"] > 0, 0.1, df["b"])
    df.loc[df["part"] <= 0, "part"] = None
    df.loc[3, "end"] = np.inf
    df["none"] = np.nan
    table = spark.createDataFrame(df).repartition(4)
    pairs = [("a", "b"), ("held", "part"), ("a", "end"), ("b", "none"), ("part", "b")]
    got = correlation.pearson(table, pairs).toPandas().set_index(["x", "y"])
    for x, y in (("a", "b"), ("part", "b")):
        assert got.loc[(x, y), "pearson"] == pytest.approx(df[[x, y]].dropna().corr().iloc[0, 1])
    rows = {(r.x, r.y): r for r in correlation.pearson(table, pairs).collect()}
    assert rows["held", "part"].pearson is None and rows["b", "none"].pearson is None and rows["b", "none"].n == 0
    assert np.isnan(rows["a", "end"].pearson) and rows["a", "end"].n == 200


def test_binned_median_merges_equal_cuts(spark):
    x = np.r_[np.zeros(60), np.arange(1.0, 41)]
    df = pd.DataFrame({"wind_kph": x, "air_quality_pm2_5": np.arange(100.0)})
    got = binned_median(spark.createDataFrame(df)).orderBy("bin_rank").toPandas()
    cuts = pd.qcut(df["wind_kph"], 5, duplicates="drop")
    want = df.groupby(cuts, observed=True)["air_quality_pm2_5"].agg(["median", "count"])
    assert got["pm_median"].tolist() == want["median"].tolist()
    assert got["n"].tolist() == want["count"].tolist()


def test_binned_median_writes_rows_once(spark, monkeypatch):
    sizes = []
    plain = air_quality.materialized

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(air_quality, "materialized", counted)
    data = [(float(i % 50), float(i % 4), float(i % 7)) for i in range(1000)]
    data += [(60.0, None, float("nan")), (1.0, 2.0, None)]
    names = ["wind_kph", "precip_mm", "air_quality_pm2_5"]
    got = binned_median(spark.createDataFrame(data, names)).orderBy("driver", "bin_rank").collect()
    # the rows once, not once for each driver; after that only counts
    assert sizes[0] == 1001 and max(sizes[1:]) < 100
    known = [r for r in data if r[2] is not None]
    want = []
    for k, driver in ((1, "precip_mm"), (0, "wind_kph")):
        pairs = np.array([(r[k], r[2]) for r in known if r[k] is not None])
        edges = np.unique(np.quantile(pairs[:, 0], np.linspace(0, 1, 6)))
        bins = np.maximum(np.searchsorted(edges, pairs[:, 0]), 1)
        for rank, b in enumerate(np.unique(bins), 1):
            y = pairs[bins == b, 1]
            y = y[~np.isnan(y)]
            want.append((driver, edges[b - 1], edges[b], rank, len(y), np.median(y)))
    assert [tuple(r) for r in got] == want


def test_decomposition_isolates_a_spike():
    t = np.arange(60)
    y = 10 * np.sin(2 * np.pi * t / 12) + 0.1 * t + np.random.default_rng(8).normal(0, 1, 60)
    y[30] += 15
    season, trend, left = seasonal.decompose(y)
    assert np.argmax(np.abs(left)) == 30 and left[30] > 10
    assert np.allclose(season + trend + left, y)


def test_importances(spark):
    rng = np.random.default_rng(7)
    n = 400
    df = pd.DataFrame({"i": np.arange(n), "big": rng.normal(size=n), "none": rng.normal(size=n)})
    df["label"] = 5 * df["big"]
    rows = spark.createDataFrame(df)
    factory = panel_model.boosted_trees(rounds=5, step=0.5, depth=3)
    model = panel_model.fit(rows, ["big", "none"], factory)
    lenses = {
        "native": panel_model.native_importance(model),
        "permutation": panel_model.permutation_importance(model, rows, ["i"], repeats=3),
        "shapley": panel_model.shapley_importance(model, rows, ["i"], max_samples=100),
    }
    got = panel_model.compare_importances(lenses).orderBy("mean_rank").toPandas()
    assert got["feature"].tolist() == ["big", "none"] and got["mean_rank"].iloc[0] == 1
    flagged = panel_model.rank_disagreement(
        panel_model.compare_importances(lenses), "native", "permutation"
    )
    assert not flagged.first()["demoted"]


def test_thousands_of_oversized_cells_are_split(spark):
    # one nested condition for each such cell overflowed the stack of the planner
    cells = np.arange(4096)
    celled = spark.range(4096 * 10).selectExpr("id", "id % 4096 as cell")
    placed = in_parts(celled, cells, np.where(cells == 7, 4, 10), block=2)
    parts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count_distinct("part").alias("n")).collect()}
    assert placed.count() == 4096 * 10 and parts[7] == 1 and max(parts.values()) <= 5 and len(parts) == 4096


def test_series_decomposed_together_are_as_alone(spark):
    rng = np.random.default_rng(4)
    months = np.arange(60)
    y = np.stack([np.sin(months / 12 * 2 * np.pi) + rng.normal(size=60), np.zeros(60), months + rng.standard_t(1, 60)])
    together = seasonal.decompose_all(y)
    for k in range(3):
        for a, b in zip(seasonal.decompose(y[k]), together):
            assert a == pytest.approx(b[k], abs=1e-9)
    dates = pd.date_range("2020-01-01", periods=60, freq="MS")
    df = pd.concat(
        [pd.DataFrame({"k": k, "t": dates[:n], "y": y[0][:n]}) for k, n in (("a", 60), ("b", 30), ("c", 23))]
    ).query("not (k == 'b' and t == @dates[4])")
    spec = PanelSpec(keys=("k",), time="t", value="y")
    got = seasonal.stl_residuals(spark.createDataFrame(df), spec).toPandas()
    assert got.groupby("k").size().to_dict() == {"a": 60, "b": 30}
    gap = y[0][:30].copy()
    gap[4] = (gap[3] + gap[5]) / 2
    have = got[got.k == "b"].sort_values("month")["trend"].to_numpy()
    assert have == pytest.approx(seasonal.decompose(gap)[1])
