"""Dataset utilities, evaluation, k-NN, comparison detectors, generators, sources."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from epsgrid.operators import baselines, dataset, evaluate, generate, neighbors
from epsgrid.operators.detect import detect
from epsgrid.plans import fixtures as fx
from epsgrid.session import scratch_path
from epsgrid.sources import readers, writers


# ---------------------------------------------------------------- dataset
def test_row_index_consecutive(spark):
    df = spark.range(0, 5000, 3).repartition(7).withColumnRenamed("id", "k")
    got = dataset.with_row_index(df, ["k"], "i").orderBy("k").collect()
    assert [r["i"] for r in got] == list(range(len(got)))


def test_exact_quantile_matches_numpy(spark):
    vals = np.random.default_rng(0).normal(size=1001)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(5)
    for q in (0.0, 0.01, 0.37, 0.5, 1.0):
        assert dataset.exact_quantile(df, "v", q) == pytest.approx(np.percentile(vals, 100 * q), abs=1e-12)


def test_diff_keeps_duplicates(spark):
    a = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double")
    b = spark.createDataFrame([(2.0, 2.0), (4.0, 4.0), (4.0, 4.0)], "x double, y double")
    d = dataset.diff_datasets(a, b)
    got = sorted((r.x, r.y, r.side) for r in d.collect())
    assert got == [(1.0, 1.0, "12"), (1.0, 1.0, "12"), (3.0, 3.0, "12"), (4.0, 4.0, "21"), (4.0, 4.0, "21")]


def test_expand_dataset(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    ex = dataset.expand_dataset(df, feats, 3, 0.5, key=idc, seed=1)
    assert ex.count() == 3 * df.count()
    j = ex.join(df.select(idc, *[F.col(f).alias(f"o_{f}") for f in feats]), idc)
    dev = j.select(*[F.max(F.abs(F.col(f) - F.col(f"o_{f}"))).alias(f) for f in feats]).first()
    assert all(0 < dev[f] <= 0.5 for f in feats)
    again = dataset.expand_dataset(df.repartition(5), feats, 3, 0.5, key=idc, seed=1)
    assert sorted(ex.collect()) == sorted(again.collect())


def test_sample_by_hash_nested_and_stable(spark):
    df = spark.range(20000)
    s1 = {r.id for r in dataset.sample_by_hash(df, 0.1, "id").collect()}
    s2 = {r.id for r in dataset.sample_by_hash(df.repartition(9), 0.2, "id").collect()}
    assert s1 <= s2 and 1500 < len(s1) < 2500


def test_merge_tag_remove(spark):
    data = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, v string")
    ids = spark.createDataFrame([(2,), (0,), (2,)], "row_idx long")
    assert sorted(r.v for r in dataset.merge_ids(ids, data).collect()) == ["a", "c", "c"]
    tag = dataset.tag_detected(data, ids, ["row_idx"])
    assert {r.row_idx: r.detected for r in tag.collect()} == {0: True, 1: False, 2: True}
    assert [r.v for r in dataset.remove_outliers(data, ids, ["row_idx"]).collect()] == ["b"]


# ---------------------------------------------------------------- evaluation
def test_confusion_f1_ari(spark):
    lab = [1, 1, 1, 1, -1, -1, 1, -1]
    pre = [1, 1, -1, 1, -1, 1, 1, -1]
    df = spark.createDataFrame(list(zip(lab, pre)), "label int, prediction int")
    c = evaluate.confusion(df).first()
    assert (c.data_found, c.data_not_found, c.outliers_found, c.outliers_not_found) == (4, 1, 2, 1)
    assert evaluate.f1_outlier(df).first().f1 == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))
    # adjusted Rand index by the pair-counting definition
    n = len(lab)
    same = lambda v, i, j: v[i] == v[j]
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    tp = sum(same(lab, i, j) and same(pre, i, j) for i, j in pairs)
    fp = sum(not same(lab, i, j) and same(pre, i, j) for i, j in pairs)
    fn = sum(same(lab, i, j) and not same(pre, i, j) for i, j in pairs)
    tn = len(pairs) - tp - fp - fn
    ari = 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    assert evaluate.adjusted_rand(df).first().adjusted_rand == pytest.approx(ari)
    one = spark.createDataFrame([(1, 1)] * 4, "label int, prediction int")
    assert evaluate.adjusted_rand(one).first().adjusted_rand == 1.0
    assert evaluate.outlier_count(df).first().n_outliers == 3


def test_timing_summary(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 1.0, 3.0)], "alg string, x double, y double")
    got = {r.alg: (r.mean_time, r.std_time) for r in evaluate.timing_summary(df).collect()}
    assert got["a"][0] == 3.0 and got["a"][1] == pytest.approx(math.sqrt(2.0)) and got["b"][1] is None


# ---------------------------------------------------------------- k-NN
def _np_knn(X, k, self_too=True):
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (d[i, j], j))
        if not self_too:
            order = [j for j in order if j != i]
        out[i] = [(j, d[i, j]) for j in order[:k]]
    return out


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = np.round(np.vstack([rng.normal(0, 1, (150, 2)), rng.uniform(-30, 30, (20, 2))]), 3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    for self_too in (True, False):
        nn = neighbors.knn(df, ["a", "b"], 4, "pid", include_self=self_too, radius=0.05)
        got = {}
        for r in nn.collect():
            got.setdefault(r.pid, []).append((r["rank"], r.nbr_id, r.dist))
        want = _np_knn(X, 4, self_too)
        for i in range(len(X)):
            g = [(j, d) for _, j, d in sorted(got[i])]
            assert [j for j, _ in g] == [j for j, _ in want[i]]


def test_k_distance_curve_sorted(spark):
    df, idc, feats = fx.parts2d(spark, SF_SMALL)
    cur = neighbors.k_distance_curve(df, feats, 4, idc).orderBy("rank").collect()
    vals = [r.k_dist for r in cur]
    assert vals == sorted(vals) and [r["rank"] for r in cur] == list(range(len(cur)))


# ---------------------------------------------------------------- comparison detectors
def test_lof_matches_numpy(spark):
    rng = np.random.default_rng(5)
    X = np.round(np.vstack([rng.normal(0, 1, (120, 2)), [[8.0, 8.0], [-7.0, 9.0]]]), 4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    k = 6
    got = {r.pid: r.score for r in baselines.lof_scores(df, ["a", "b"], k, "pid").collect()}
    nn = _np_knn(X, k, self_too=False)
    kd = {i: nn[i][-1][1] for i in nn}
    lrd = {i: 1.0 / (np.mean([max(d, kd[j]) for j, d in nn[i]]) + 1e-10) for i in nn}
    for i in nn:
        want = -np.mean([lrd[j] / lrd[i] for j, _ in nn[i]])
        assert got[i] == pytest.approx(want, rel=1e-9)
    pred = baselines.lof(df, ["a", "b"], 2 / len(X), k, "pid")
    assert {r.pid for r in pred.filter("prediction = -1").collect()} >= {120, 121}


def test_mahalanobis_matches_numpy(spark):
    rng = np.random.default_rng(6)
    X = rng.multivariate_normal([1.0, -2.0], [[2.0, 0.8], [0.8, 1.0]], size=400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    got = {r.pid: r.score for r in baselines.mahalanobis(df, ["a", "b"], 0.05, "pid").collect()}
    mu, cov = X.mean(0), np.cov(X.T, bias=True)
    inv = np.linalg.inv(cov)
    for i in range(0, 400, 37):
        dx = X[i] - mu
        assert got[i] == pytest.approx(-dx @ inv @ dx, rel=1e-9)


def test_robust_mahalanobis_flags_planted_outliers(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 1, (300, 2)), rng.normal(12, 0.5, (12, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    r = baselines.robust_mahalanobis(df, ["a", "b"], 12 / 312, "pid", n_starts=2, max_steps=8)
    flagged = {x.pid for x in r.filter("prediction = -1").collect()}
    assert flagged == set(range(300, 312))


def test_robust_mahalanobis_with_clustered_contamination(spark):
    """40 % of the rows in a second cluster: the fit is that of the clean rows, reweighted."""
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(size=(600, 2)), rng.normal((7, 7), 1.5, (400, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "pid long, a double, b double")
    r = {t.pid: t for t in baselines.robust_mahalanobis(df, ["a", "b"], 0.4, "pid").collect()}
    score = np.array([r[i].score for i in range(1000)])
    flagged = np.array([r[i].prediction == -1 for i in range(1000)])
    assert flagged[600:].mean() > 0.98 and flagged[:600].mean() < 0.02
    # reweighted: the fit of the rows within the 97.5 % quantile, so the clean rows have chi-squared distances
    good = X[:600]
    inv = np.linalg.inv(np.cov(good.T))
    want = -np.einsum("ij,jk,ik->i", good - good.mean(0), inv, good - good.mean(0))
    assert np.corrcoef(score[:600], want)[0, 1] > 0.99 and abs(np.median(score[:600] / want) - 1) < 0.25


def test_kth_distances_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 2))
    X[100:200] = X[0]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in X], "f0 double, f1 double")
    fits = [(np.zeros(2), np.eye(2)), (X[0], 2 * np.eye(2))]
    want = [np.sort(((X - m) @ v * (X - m)).sum(1)) for m, v in fits]
    for gather in (100_000, 20):
        monkeypatch.setattr(baselines, "GATHER_ROWS", gather)
        for k in (1, 120, 251, 500):
            assert baselines._kth_distances(df, fits, [k, k], 2) == [w[k - 1] for w in want]
    assert abs(baselines._chi2_quantile(0.975, 2) - 7.377758908) < 1e-6
    assert abs(baselines._chi2_quantile(0.5, 5) - 4.351460191) < 1e-6


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(0, 1, (2000, 2)), [[9.0, 9.0], [-9.0, 8.0], [10.0, -9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    sc = baselines.isolation_forest_scores(df, ["a", "b"], "pid", n_trees=50)
    rows = sc.orderBy("score").limit(3).collect()
    assert {r.pid for r in rows} == {2000, 2001, 2002}
    assert all(-1.0 <= r.score <= 0.0 for r in sc.collect())


# ---------------------------------------------------------------- generators
@pytest.mark.parametrize("gen", ["blobs", "blobs_varied", "circles", "moons"])
def test_generators(spark, gen):
    base = spark.range(20000)
    df = getattr(generate, gen)(base)
    assert df.count() == 20000
    noise = df.filter("label = 'noise'").count()
    assert 120 < noise < 300
    again = getattr(generate, gen)(base.repartition(6))
    assert sorted(df.collect()) == sorted(again.collect())
    if gen == "circles":
        r = df.filter("label != 'noise'").select(F.sqrt(F.col("x1") ** 2 + F.col("x2") ** 2).alias("r"))
        lo, hi = r.agg(F.min("r"), F.max("r")).first()
        assert 0.4 < lo and hi < 1.1


def test_blobs_dim(spark):
    df = generate.blobs_dim(spark.range(1000), 7)
    assert len([c for c in df.columns if c.startswith("x")]) == 7


# ---------------------------------------------------------------- sources / sinks
def test_csv_headers_short_and_blank_lines(spark, tmp_path):
    p = tmp_path / "pts.csv"
    p.write_text("x,y\n1.0,2.0,extra\n\n3.5\nx,y\nnot,anumber\n-4.0,5e-3\n")
    pts, rej = readers.read_points_csv_with_rejects(spark, str(p), 2)
    assert sorted(tuple(r) for r in pts.collect()) == [(-4.0, 0.005), (1.0, 2.0)]
    assert rej.count() == 3


def test_ds_roundtrip(spark):
    df = spark.createDataFrame([(5, 1.5, 2.0), (2, -3.25, 4.0)], "k long, x1 double, x2 double")
    path = scratch_path(spark, "ds-test")
    writers.write_ds(df, path, ["k"], ["x1", "x2"])
    got = sorted(tuple(r) for r in readers.read_ds(spark, path, 2).collect())
    assert got == [(0, -3.25, 4.0), (1, 1.5, 2.0)]


def test_trajectories_roundtrip(spark):
    df = spark.createDataFrame([(1, 0.0, 40.1, 116.3, 100.0), (1, 1.0, 40.2, 116.4, 110.0),
                                (2, 0.0, 39.9, 116.0, 50.0)], "t long, o double, lat double, lon double, alt double")
    path = scratch_path(spark, "traj-test")
    writers.write_trajectories(df, path, "t", "o", "lat", "lon", "alt")
    got = readers.read_trajectories(spark, path, glob="*.txt").select("lat", "long", "alt").collect()
    assert sorted(tuple(r) for r in got) == [(39.9, 116.0, 50.0), (40.1, 116.3, 100.0), (40.2, 116.4, 110.0)]


def test_knn_with_heavy_duplicates_and_dense_cluster(spark):
    rng = np.random.default_rng(11)
    pile = np.tile([[1.0, 1.0]], (40, 1))                 # 40 identical points
    tight = 1.0 + 1e-3 * rng.random((60, 2))               # a very dense cluster next to it
    rest = rng.uniform(-20, 20, (60, 2))
    X = np.round(np.vstack([pile, tight, rest]), 6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    for self_too in (True, False):
        nn = neighbors.knn(df, ["a", "b"], 5, "pid", include_self=self_too)
        got = {}
        for r in nn.collect():
            got.setdefault(r.pid, []).append((r["rank"], r.nbr_id))
        want = _np_knn(X, 5, self_too)
        assert len(got) == len(X)
        for i in range(len(X)):
            assert [j for _, j in sorted(got[i])] == [j for j, _ in want[i]], i


def test_knn_duplicate_pile_split_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "ROWS_PER_TASK", 7)
    X = np.vstack([np.tile([[2.0, -1.0]], (50, 1)), np.random.default_rng(2).uniform(-5, 5, (30, 2))])
    X = np.round(X, 5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "pid long, a double, b double")
    nn = neighbors.knn(df, ["a", "b"], 3, "pid", include_self=False)
    got = {}
    for r in nn.collect():
        got.setdefault(r.pid, []).append((r["rank"], r.nbr_id))
    want = _np_knn(X, 3, self_too=False)
    for i in range(len(X)):
        assert [j for _, j in sorted(got[i])] == [j for j, _ in want[i]], i


def test_array_features_feed_the_detector(spark):
    from epsgrid import detect
    emb = fx.table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding")
    pts = readers.array_features(emb, "embedding", 3)
    assert pts.columns == ["vec_id", "x1", "x2", "x3"]
    a = detect(pts, ["x1", "x2", "x3"], 0.083, 5, "vec_id").labels.select("vec_id", "label").collect()
    df = emb.select("vec_id", *[emb.embedding[i].cast("double").alias(f"x{i + 1}") for i in range(3)])
    b = detect(df, ["x1", "x2", "x3"], 0.083, 5, "vec_id").labels.select("vec_id", "label").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("ids", [[None] * 30, [7] * 30, [1.2, 1.7, 1.9] * 10, ["a", None, "b"] * 10])
def test_ids_are_payload(spark, ids):
    """NULL, repeated, fractional and text ids change no result."""
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(size=(24, 2)), np.zeros((6, 2))])
    kind = "double" if isinstance(ids[0], float) else "string" if "a" in ids else "long"
    df = spark.createDataFrame([(i, n, float(x), float(y)) for n, (i, (x, y)) in enumerate(zip(ids, X))],
                               f"id {kind}, n long, a double, b double")
    for self_too in (True, False):
        got = neighbors.knn(df, ["a", "b"], 3, "id", include_self=self_too)
        assert dict(got.dtypes)["id"] == dict(got.dtypes)["nbr_id"] == dict(df.dtypes)["id"]
        want = neighbors.knn(df, ["a", "b"], 3, "n", include_self=self_too)
        rows = [sorted((str(r[0]), round(r.dist, 12), r["rank"]) for r in x.collect())
                for x in (got, want.join(df.select("n", "id"), "n").select("id", "dist", "rank"))]
        assert len(rows[0]) == 90 and rows[0] == rows[1]
    for fn in (baselines.lof_scores, baselines.isolation_forest_scores, baselines.mahalanobis,
               baselines.robust_mahalanobis):
        extra = {"n_neighbors": 8} if fn is baselines.lof_scores else {}
        got, want = fn(df, ["a", "b"], id_col="id", **extra), fn(df, ["a", "b"], id_col="n", **extra)
        rows = [sorted((str(r.id), round(r.score, 9)) for r in x.collect())
                for x in (got, want.join(df.select("n", "id"), "n"))]
        assert len(rows[0]) == 30 and rows[0] == rows[1]
    curve = [[r.k_dist for r in neighbors.k_distance_curve(df, ["a", "b"], 4, c).orderBy("rank").collect()]
             for c in ("id", "n")]
    assert len(curve[0]) == 30 and np.allclose(*curve)


def test_exact_quantile_by_counting(spark, monkeypatch):
    """The rounds of the selection, with ties, infinities, NULL and NaN; no sort in any plan."""
    monkeypatch.setattr(dataset, "GATHER_VALUES", 5)
    rng = np.random.default_rng(4)
    for vals in (rng.normal(size=3000), np.repeat([1.0, 2.0, 5.0], [2700, 200, 100]), 2.0 ** rng.integers(-900, 900, 2000)):
        df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.013, 0.9):
            assert dataset.exact_quantile(df, "v", q) == pytest.approx(np.quantile(vals, q), rel=1e-12)
    assert dataset.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
    ends = spark.createDataFrame([(v,) for v in [float("-inf"), float("inf")] + [3.25] * 20], "v double")
    assert [dataset.exact_quantile(ends, "v", q) for q in (0.0, 0.5, 1.0)] == [float("-inf"), 3.25, float("inf")]


def test_order_curve_spreads_ties(spark, monkeypatch):
    """Nine of ten rows share a value: ranks are whole, and no partition holds much more than its share."""
    monkeypatch.setattr(dataset, "CURVE_RUN", 50)
    vals = [7.0] * 18000 + [float(i) for i in range(2000)] + [None] * 3
    got = dataset.order_curve(spark.createDataFrame([(v,) for v in vals], "v double").repartition(4), "v")
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * len(vals) / 4
    rows = sorted((r["rank"], r["v"]) for r in got.collect())
    assert [r for r, _ in rows] == list(range(len(vals)))
    assert [v for _, v in rows] == [None] * 3 + sorted(v for v in vals if v is not None)


@pytest.mark.parametrize("n, p", [(1, None), (100, None), (3000, None), (30000, None), (30000, 0.001)])
def test_forest_sample_is_whole_and_even(spark, monkeypatch, n, p):
    """Every tree has exactly min(max_samples, n) different rows, also when the first draw is too small."""
    pts = spark.range(n).withColumnRenamed("id", "pid")
    if p:
        real = baselines._draw
        monkeypatch.setattr(baselines, "_draw", lambda d, t, q, s: real(d, t, p if q < 0.02 else q, s))
    s = baselines.forest_sample(pts, n, 20, 256, 5)
    got = s.groupBy("tree").agg(F.count("pid").alias("n"), F.countDistinct("pid").alias("d"), F.avg("pid").alias("m")).collect()
    assert sorted(r["tree"] for r in got) == list(range(20))
    assert {(r["n"], r["d"]) for r in got} == {(min(256, n),) * 2}
    mean = np.mean([r["m"] for r in got])
    assert abs(mean - (n - 1) / 2) < 5 * n / np.sqrt(12 * 256 * 20) + 1e-9


def test_forest_draw_keeps_few_rows(spark):
    """Rows that leave the scan follow trees and samples, not the table; later trees are as likely as the first."""
    got = baselines._draw(spark.range(200_000).withColumnRenamed("id", "pid"), 100, 0.002, 3).groupBy("tree").count().collect()
    counts = {r["tree"]: r["count"] for r in got}
    assert len(counts) == 100 and abs(sum(counts.values()) - 40_000) < 1200
    early, late = (sum(counts[t] for t in r) for r in (range(10), range(90, 100)))
    assert abs(early - 4000) < 400 and abs(late - 4000) < 400


def test_grouped_core_count_stops(spark):
    """Counts of the grouped strategy end at min_pts; the labels are those of the others."""
    rows = [(i, float(x), 0.0) for i, x in enumerate([0.0, 5.0, 5.05, 5.06] + [1.0 + j / 1000 for j in range(300)])]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    want = None
    for strategy in ("shuffle", "grouped"):
        with detect(df, ["a", "b"], 1.1, 6, "id", strategy=strategy) as det:
            top = det.neighbor_counts().agg(F.max("cnt")).first()[0]
            assert top == 6 if strategy == "grouped" else top > 50
            lab = {r["id"]: r["label"] for r in det.labels.collect()}
        want = want or lab
        assert lab == want


def test_robust_mahalanobis_leaves_no_cache(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)], "id int, a double, b double")
    baselines.robust_mahalanobis(df, ["a", "b"], 0.1, "id").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize("kind", ["cluster", "far", "constant_axis"])
def test_robust_starts_in_ten_dimensions(spark, kind):
    """40 % contamination in ten dimensions: the fit is that of the clean rows, from four starts."""
    rng, d = np.random.default_rng(8), 10
    clean = rng.normal(size=(900, d)) @ np.diag(np.linspace(1, 3, d))
    # as wide as the clean rows: half the rows around a tight cluster would have the least determinant
    bad = (rng.normal(size=(600, d)) @ np.diag(np.linspace(1, 3, d)) + 12.0 if kind == "cluster"
           else rng.normal(size=(600, d)) * 0.3 + 500.0)
    X = np.vstack([clean, bad])
    if kind == "constant_axis":
        X[:, 4] = 2.0
    f = [f"a{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], ["id", *f])
    got = {r["id"]: r["prediction"] for r in baselines.robust_mahalanobis(df, f, 0.4, "id").collect()}
    assert sum(got[i] == -1 for i in range(900, 1500)) >= 590
