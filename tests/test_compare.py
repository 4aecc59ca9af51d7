"""Detectors side by side, LOF on piles of equal points, ties in the row index, limits of the
broadcast strategy, life of a query's caches."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, brute_labels
from epsgrid.operators import baselines, dataset, evaluate, neighbors
from epsgrid.operators.detect import detect
from epsgrid.operators.neighbors import ordered_points
from epsgrid.plans import catalog, compare
from epsgrid.plans import fixtures as fx


def _planted(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal(0, 1, (n, 2)), rng.uniform(15, 40, (6, 2))])
    rows = [(float(a), float(b), -1 if i >= n else 1) for i, (a, b) in enumerate(X)]
    return X, spark.createDataFrame(rows, "a double, b double, truth int")


def _ari(a, b):
    pairs = lambda x: sum(int(c) * (int(c) - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    both = [f"{x}:{y}" for x, y in zip(a, b)]
    sa, sb, s, t = pairs(a), pairs(b), pairs(both), len(a) * (len(a) - 1) / 2
    return 1.0 if (sa + sb) / 2 == sa * sb / t else (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)


def test_all_detectors_side_by_side(spark):
    X, df = _planted(spark)
    bad = spark.createDataFrame([(None, 1.0, 1), (float("nan"), 2.0, -1)], df.schema)
    share = 6 / len(X)
    runs = compare.detector_runs(df.unionByName(bad), ["a", "b"], "truth", 1.5, 5, share, 10)
    got = {r.alg: r for r in evaluate.compare_detectors(runs).collect()}
    assert set(got) == set(compare.ALGORITHMS)
    for alg, frame in runs.items():
        rows = frame.collect()
        label, pred = [r.label for r in rows], [r.prediction for r in rows]
        r = got[alg]
        assert len(rows) == len(X) == r.data_found + r.data_not_found + r.outliers_found + r.outliers_not_found
        assert r.n_outliers == pred.count(-1)
        assert r.adjusted_rand == pytest.approx(_ari(label, pred))
        tp, wrong = sum(l == p == -1 for l, p in zip(label, pred)), sum(l != p for l, p in zip(label, pred))
        assert r.f1 == pytest.approx(2 * tp / (2 * tp + wrong))
    assert got["grid"].n_outliers == brute_labels(X, 1.5, 5).count("outlier")
    assert got["grid"].outliers_found == 6


def test_compare_agrees_with_the_single_measures(spark):
    df = spark.createDataFrame([(1, 1)] * 50 + [(1, -1)] * 7 + [(-1, -1)] * 9 + [(-1, 1)] * 4, "label int, prediction int")
    same = spark.createDataFrame([(1, 1)] * 5, "label int, prediction int")
    got = {r.alg: r for r in evaluate.compare_detectors({"x": df, "same": same, "none": df.limit(0)}).collect()}
    assert set(got) == {"x", "same"}
    assert got["x"].f1 == pytest.approx(evaluate.f1_outlier(df).first().f1)
    assert got["x"].adjusted_rand == pytest.approx(evaluate.adjusted_rand(df).first().adjusted_rand)
    assert got["same"].adjusted_rand == 1.0 and got["same"].f1 == 0.0


def test_pair_counts_beyond_64_bits(spark):
    big = spark.createDataFrame([(5_000_000_000,)], "c long")
    assert big.select(evaluate._comb2(F.col("c"))).first()[0] == pytest.approx(1.25e19)


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        compare.detector_runs(spark.range(1), ["id"], "id", 1.0, 2, algorithms=("svm",))


def _lof_brute(X, k):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = [np.lexsort((np.arange(len(X)), row))[:k] for row in d]
    kd = np.array([d[i, n[-1]] for i, n in enumerate(nn)])
    lrd = np.array([1 / (np.maximum(d[i, n], kd[n]).mean() + 1e-10) for i, n in enumerate(nn)])
    return np.array([-(lrd[n] / lrd[i]).mean() for i, n in enumerate(nn)])


def test_lof_on_piles(spark):
    rng = np.random.default_rng(11)
    X = np.vstack([np.zeros((3000, 2)), rng.normal(0, 4, (150, 2)), np.full((12, 2), 3.0), np.full((5, 2), -6.0)])
    k = 10
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "pid long, a double, b double")
    got = {r.pid: r.score for r in baselines.lof_scores(df, ["a", "b"], k, "pid").collect()}
    want = _lof_brute(X, k)
    assert sorted(got) == list(range(len(X)))
    assert [got[i] for i in range(len(X))] == pytest.approx(want.tolist(), rel=1e-9)
    # the two piles take no part in the joins, and no neighbour is a key of many rows
    piled, nn = neighbors.knn_beside_piles(ordered_points(df, ["a", "b"], "pid")[0], 2, k)
    assert piled.count() == 3012
    assert nn.select("pid").distinct().count() == 155
    assert nn.groupBy("nbr_id").count().agg(F.max("count")).first()[0] <= 100


def test_lof_of_one_pile_and_of_nothing(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(40)], "pid long, a double")
    assert {r.score for r in baselines.lof_scores(df, ["a"], 5, "pid").collect()} == {-1.0}
    assert baselines.lof_scores(df.limit(0), ["a"], 5, "pid").count() == 0


def test_row_index_spreads_ties(spark):
    df = spark.range(0, 20_000, 1, 8).select("id", F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be merged into one
    try:
        parts = [r[1] for r in dataset._sorted_parts(df, ["k"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(parts) == 20_000 and max(parts) <= 2 * 20_000 / len(parts) and len(parts) > 1
    rows = dataset.with_row_index(df, ["k"], "i").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(20_000))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)  # ties in the order of the scan


def test_broadcast_within_bytes(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    labels = {}
    for limit in (None, 1):
        with detect(df, feats, 23.1, 8, idc, strategy="broadcast", max_broadcast_bytes=limit) as det:
            plan = det.eps_pairs(prune=True)._jdf.queryExecution().optimizedPlan().toString()
            assert ("strategy=broadcast" in plan) == (limit is None)
            labels[limit] = sorted((r[idc], r.label) for r in det.labels.collect())
    assert labels[None] == labels[1]


def test_queries_leave_no_cache(spark):
    spark.catalog.clearCache()
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    out = catalog.QUERIES["confusion"](spark, SF_SMALL)
    assert not catalog._DETECTIONS and kept() == before
    assert out.count() == 1
