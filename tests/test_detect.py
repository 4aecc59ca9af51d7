import numpy as np
import pytest

from helpers import SF_SMALL, brute_labels, labels_of
from epsgrid.operators.detect import dbscan_noise, detect, detect_outliers
from epsgrid.operators import stats
from epsgrid.plans import fixtures as fx


def frame(spark, X, ids=None):
    X = np.asarray(X, dtype=float)
    d = X.shape[1] if X.ndim == 2 and len(X) else 2
    cols = [f"x{i + 1}" for i in range(d)]
    ids = list(range(len(X))) if ids is None else ids
    rows = [(int(i), *map(float, r)) for i, r in zip(ids, X)]
    schema = "point_id long, " + ", ".join(f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema), cols


def check(spark, X, eps, min_pts, **kw):
    df, cols = frame(spark, X)
    det = detect(df, cols, eps, min_pts, "point_id", **kw)
    got = labels_of(det.labels)
    want = dict(enumerate(brute_labels(X, eps, min_pts, kw.get("inclusive", False))))
    assert got == want
    return det


def clustered(seed, n, dim, spread=10.0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-spread, spread, size=(3, dim))
    X = centers[rng.integers(0, 3, n)] + rng.normal(0, 1.0, size=(n, dim))
    noise = rng.uniform(-2 * spread, 2 * spread, size=(n // 10, dim))
    return np.round(np.vstack([X, noise]), 3)


@pytest.mark.parametrize("strategy", ["shuffle", "broadcast", "grouped", "auto"])
@pytest.mark.parametrize("dim,eps,min_pts", [(1, 0.3, 4), (2, 0.9, 5), (3, 1.4, 6)])
def test_matches_brute_force(spark, strategy, dim, eps, min_pts):
    check(spark, clustered(dim, 300, dim), eps, min_pts, strategy=strategy)


def test_high_dimension_projection_plan(spark):
    X = clustered(5, 250, 5)
    check(spark, X, 2.4, 4)
    check(spark, X, 2.4, 4, max_offsets=50)  # force the projected adjacency


def test_hot_cell_salting(spark):
    # one cell holds a third of the rows; tiny rows_per_task splits it into buckets
    rng = np.random.default_rng(1)
    hot = np.zeros((150, 2)) + 0.01 * rng.random((150, 2))
    rest = rng.uniform(-5, 5, size=(300, 2))
    X = np.round(np.vstack([hot, rest]), 4)
    for strategy in ("shuffle", "grouped", "broadcast"):
        det = check(spark, X, 0.6, 5, rows_per_task=10, strategy=strategy)
        assert det.n_hot >= 1


def test_fixture_events2d_sf0001(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    det = detect(df, feats, 23.1, 8, idc)
    counts = {r["label"]: r["count"] for r in det.labels.groupBy("label").count().collect()}
    assert counts == {"core": 869, "border": 55, "outlier": 76}
    st = stats.run_stats(det).first()
    assert (st.total_points, st.core_points, st.border_points, st.outliers) == (1000, 869, 55, 76)
    assert st.dense_cells + st.core_cells + st.other_cells == st.total_cells


def test_partition_count_invariance(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    base = sorted(r[0] for r in detect_outliers(df, feats, 23.1, 8, idc).collect())
    for p in (1, 3, 11):
        got = sorted(r[0] for r in detect_outliers(df.repartition(p), feats, 23.1, 8, idc,
                                                   num_partitions=p).collect())
        assert got == base


# ---------------------------------------------------------------- edge cases
def test_empty_input(spark):
    df = spark.createDataFrame([], "point_id long, x1 double, x2 double")
    det = detect(df, ["x1", "x2"], 1.0, 3, "point_id")
    assert det.labels.count() == 0 and det.outliers.count() == 0
    assert stats.run_stats(det).first().total_points == 0


def test_single_point(spark):
    check(spark, [[1.0, 2.0]], 1.0, 1)
    check(spark, [[1.0, 2.0]], 1.0, 2)


def test_identical_points(spark):
    X = [[3.0, -4.0]] * 7
    det = check(spark, X, 0.5, 7)
    assert det.outliers.count() == 0
    det = check(spark, X, 0.5, 8)
    assert det.outliers.count() == 7


def test_pair_exactly_at_eps(spark):
    X = [[0.0, 0.0], [3.0, 4.0]]  # distance exactly 5
    assert check(spark, X, 5.0, 2).outliers.count() == 2            # strict <
    assert check(spark, X, 5.0, 2, inclusive=True).outliers.count() == 0


def test_min_pts_one_and_above_n(spark):
    X = clustered(9, 60, 2)
    assert check(spark, X, 0.7, 1).outliers.count() == 0
    assert check(spark, X, 0.7, len(X) + 1).outliers.count() == len(X)


def test_negative_coordinates_straddling_zero(spark):
    X = [[-0.05, 0.0], [0.05, 0.0], [-0.1, 0.02], [0.1, -0.02], [5.0, 5.0]]
    check(spark, X, 0.25, 3)


def test_nan_and_infinite_are_quarantined(spark):
    rows = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, float("nan"), 0.0), (3, float("inf"), 1.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "point_id long, x1 double, x2 double")
    det = detect(df, ["x1", "x2"], 1.0, 2, "point_id")
    assert sorted(r[0] for r in det.quarantine.collect()) == [2, 3, 4]
    assert labels_of(det.labels) == {0: "core", 1: "core"}


def test_invalid_parameters(spark):
    df, cols = frame(spark, [[0.0, 0.0]])
    for eps, mp in ((0.0, 2), (-1.0, 2), (float("nan"), 2), (1.0, 0)):
        with pytest.raises(ValueError):
            detect(df, cols, eps, mp, "point_id")
    with pytest.raises(ValueError):
        detect(df, cols, 1.0, 2, "point_id", strategy="nope")


# ---------------------------------------------------------------- properties
def test_monotone_in_eps_and_min_pts(spark):
    X = clustered(4, 250, 2)
    df, cols = frame(spark, X)
    out = lambda e, m: {r[0] for r in detect_outliers(df, cols, e, m, "point_id").collect()}
    assert out(1.2, 5) <= out(0.8, 5)          # larger eps never adds outliers
    assert out(0.8, 4) <= out(0.8, 6)          # larger minPts never removes outliers


def test_axis_permutation_invariance(spark):
    X = clustered(6, 200, 3)
    df, cols = frame(spark, X)
    a = labels_of(detect(df, cols, 1.3, 5, "point_id").labels)
    b = labels_of(detect(df, cols[::-1], 1.3, 5, "point_id").labels)
    assert a == b


def test_duplicates_share_a_label(spark):
    X = np.vstack([clustered(8, 100, 2), clustered(8, 100, 2)[:40]])
    det = check(spark, X, 0.8, 5)
    lab = labels_of(det.labels)
    for i in range(40):
        assert lab[i] == lab[len(X) - 40 + i]


def test_dbscan_noise_is_inclusive(spark):
    X = [[0.0, 0.0], [3.0, 4.0], [100.0, 100.0]]
    df, cols = frame(spark, X)
    got = {r["point_id"]: r["prediction"] for r in dbscan_noise(df, cols, 5.0, 2, "point_id").collect()}
    assert got == {0: 1, 1: 1, 2: -1}


def test_dense_cells_are_core(spark):
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    det = detect(df, feats, 23.1, 8, idc)
    dense_ids = {r[0] for r in det.dense_points.select("id0").collect()}
    core_ids = {r[0] for r in det.core_points.collect()}
    assert dense_ids <= core_ids


PASS_THROUGH = ("Project", "Filter", "ColumnarToRow", "InputAdapter", "WholeStageCodegen")


def exchanged_scans(frame) -> int:
    """How many scans of the cached point set (the only cached relation with a
    ``salt`` column) sit under a new exchange (through projections/filters)."""
    lines = [ln.strip(" :+-*") for ln in frame._jdf.queryExecution().executedPlan().toString().splitlines()]
    bad = 0
    for i, ln in enumerate(lines):
        if ln.startswith("InMemoryTableScan") and "salt#" in ln.split("]")[0]:
            j = i - 1
            while j >= 0 and lines[j].lstrip("()0123456789 ").startswith(PASS_THROUGH):
                j -= 1
            bad += j >= 0 and lines[j].startswith("Exchange")
    return bad


@pytest.mark.parametrize("strategy", ["shuffle", "grouped"])
def test_plan_reuses_point_partitioning(spark, strategy):
    """The persisted points are shuffled once; later joins on (cell, salt) reuse that partitioning."""
    df, idc, feats = fx.events2d(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        det = detect(df, feats, 23.1, 8, idc, strategy=strategy)
        assert exchanged_scans(det.neighbor_counts()) == 0
        assert exchanged_scans(det.near_core()) == 0
        # a join on the cell alone (salt dropped) must re-shuffle the points: the check sees it
        assert exchanged_scans(det.points.join(det.cells.select(*det.C), det.C)) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoint_materialization_same_result(spark):
    X = clustered(12, 200, 2)
    df, cols = frame(spark, X)
    a = labels_of(detect(df, cols, 0.9, 5, "point_id").labels)
    b = labels_of(detect(df, cols, 0.9, 5, "point_id", materialize="checkpoint").labels)
    assert a == b == dict(enumerate(brute_labels(X, 0.9, 5)))
    with pytest.raises(ValueError):
        detect(df, cols, 0.9, 5, "point_id", materialize="nope")
