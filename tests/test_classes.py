"""The sweep over eps values without distances of all points."""

import numpy as np
import pytest
from helpers import brute_labels

from epsgrid.functions import count_offsets
from epsgrid.operators import classes as cl
from epsgrid.operators import neighbors
from epsgrid.operators.grid import DEFAULT_MAX_OFFSETS, fcols
from epsgrid.plans import sweep
from epsgrid.session import checkpoint_dir


def frame(spark, X):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], ["id", *[f"x{i}" for i in range(X.shape[1])]])


def feats(X):
    return [f"x{i}" for i in range(X.shape[1])]


def points(kind):
    rng = np.random.default_rng(11)
    if kind == "line":  # pairs at exactly the eps values, on both sides of 0
        return np.concatenate([np.arange(-30, 30) / 2.0, rng.uniform(-60, 60, 30), [0.0] * 4])[:, None], [0.5, 1.0, 3.5]
    if kind == "plane":
        return np.concatenate([rng.normal(0, 1, (250, 2)), rng.integers(-4, 5, (60, 2)), np.full((10, 2), 9.0),
                               rng.uniform(-12, 12, (30, 2))]), [2.0, 0.3, 1.0, 5.0]
    d = int(kind)
    return np.concatenate([rng.normal(0, 1, (120, d)), rng.uniform(-5, 5, (25, d)), np.zeros((7, d))]), [0.6, 1.3, 2.6]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("kind", ["line", "plane", "3", "5"])
def test_classes_are_the_labels_of_a_brute_force(spark, kind, inclusive):
    X, values = points(kind)
    assert (count_offsets(X.shape[1], inclusive=True) > DEFAULT_MAX_OFFSETS) == (kind == "5")
    rows = sweep.eps_profile(frame(spark, X), feats(X), 5, "id", values, inclusive).collect()
    assert len(rows) == len(X)
    for e in values:
        got = {r["id"]: "core" if r["core_at"] <= e else "border" if r["reach_at"] <= e else "outlier" for r in rows}
        assert got == dict(enumerate(brute_labels(X, e, 5, inclusive))), e


def test_split_cells_and_frames_too_large_to_broadcast_change_nothing(spark, monkeypatch):
    X, values = points("plane")
    want = sorted(map(tuple, sweep.eps_profile(frame(spark, X), feats(X), 5, "id", values).collect()))
    monkeypatch.setattr(cl, "ROWS_PER_TASK", 3)
    monkeypatch.setattr(cl, "MAX_BROADCAST_CELLS", 0)
    monkeypatch.setattr(sweep, "MAX_BROADCAST_CLASSES", 0)
    assert sorted(map(tuple, sweep.eps_profile(frame(spark, X), feats(X), 5, "id", values).collect())) == want


def test_sweep_of_dense_points_needs_no_neighbours_of_them(spark, monkeypatch):
    """Only points outside the cells that are dense at the least eps take part in joins; no k-NN table."""
    checkpoint_dir(spark)
    rng = np.random.default_rng(12)
    X = np.concatenate([rng.uniform(0, 10, (4000, 2)), rng.uniform(20, 90, (40, 2))])
    pts = spark.createDataFrame([tuple(map(float, x)) for x in X], fcols(2))
    assert 40 <= cl.eps_classes(pts, 2, [1.5, 4.0], 8).count() < 400

    def none(*a, **k):
        raise AssertionError("a k-NN table of all points")

    monkeypatch.setattr(neighbors, "_knn", none)
    got = {r.value: (r.core_points, r.border_points, r.outliers)
           for r in sweep.sweep_eps(frame(spark, X), feats(X), [1.5, 4.0], 8, "id").collect()}
    for e in (1.5, 4.0):
        want = brute_labels(X, e, 8)
        assert got[e] == tuple(sum(w == k for w in want) for k in ("core", "border", "outlier"))


def test_ids_and_bad_rows_are_kept_apart(spark):
    """Ids are NULL or repeated; rows with a bad coordinate are in no count."""
    rows = [(None, 0.0), (1, 0.1), (1, -0.0), (2, float("nan")), (3, None), (None, 9.0)]
    df = spark.createDataFrame(rows, "id int, x double")
    got = sweep.eps_profile(df, ["x"], 3, "id", [0.5]).collect()
    inf = float("inf")
    assert sorted((str(r.id), r.core_at, r.reach_at) for r in got) == [
        ("1", 0.5, 0.5), ("1", 0.5, 0.5), ("None", 0.5, 0.5), ("None", inf, inf)]
    empty = sweep.sweep_eps(df.filter("x > 99"), ["x"], [0.5, 2.0], 3, "id").collect()
    assert [(r.value, r.total_points, r.outliers) for r in empty] == [(0.5, 0, 0), (2.0, 0, 0)]
    assert sweep.sweep_eps(df, ["x"], [], 3, "id").count() == 0


@pytest.mark.parametrize("values", [[0.0, 2.0], [2.0, float("inf")], [1e-12, 2.0]])
def test_values_that_make_no_cells(spark, values):
    X = np.array([[0.0], [0.0], [1.0], [8.0], [40.0]])
    rows = sweep.eps_profile(frame(spark, X), feats(X), 2, "id", values, True).collect()
    for e in values:
        got = {r["id"]: "core" if r["core_at"] <= e else "border" if r["reach_at"] <= e else "outlier" for r in rows}
        assert got == dict(enumerate(brute_labels(X, e, 2, True))), e
