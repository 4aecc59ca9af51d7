"""Cases that once gave silent wrong answers."""
import numpy as np
import pytest

from epsgrid import detect, label_points
from epsgrid.operators import baselines
from epsgrid.operators.neighbors import knn

from helpers import brute_labels, labels_of


def test_knn_answers_every_query_from_a_tiny_radius(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, x double")
    assert knn(df, ["x"], 2, "id", radius=1e-6).count() == 6


def test_pairs_at_exactly_eps_reach_the_next_cell(spark):
    for rows in ([[0.9999999999999999], [2.0]], [[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]):
        dim = len(rows[0])
        names = [f"x{i}" for i in range(dim)]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                   "id long, " + ", ".join(f"{n} double" for n in names))
        det = detect(df, names, 1.0, 2, "id", inclusive=True)
        got = labels_of(det.labels, "id")
        det.release()
        assert [got[i] for i in range(2)] == brute_labels(rows, 1.0, 2, inclusive=True) == ["core", "core"]


def test_inverse_of_a_constant_feature():
    assert np.isfinite(baselines._inverse(np.array([[1.0, 0.0], [0.0, 0.0]]))).all()


@pytest.mark.parametrize("ids, kind", [
    ([None] * 5, "long"), ([7] * 5, "long"), ([1.2, 1.7, 1.2, 2.0, 3.0], "double"), (list("aabbc"), "string")])
def test_ids_do_not_tell_points_apart(spark, ids, kind):
    xs = [0.0, 0.4, 0.8, 1.3, 100.0]
    df = spark.createDataFrame(list(zip(ids, xs)), f"id {kind}, x double").coalesce(1)
    want = sorted(zip(map(str, ids), xs, brute_labels([[x] for x in xs], 0.5, 2)))
    for strategy in ("shuffle", "grouped", "broadcast"):
        with detect(df, ["x"], 0.5, 2, "id", strategy=strategy) as det:
            assert sorted((str(r["id"]), r["x"], r["label"]) for r in det.labels.collect()) == want
            assert sorted(r["x"] for r in det.core_points.collect()) == [x for _, x, w in
                                                                         sorted(want, key=lambda t: t[1]) if w == "core"]
            assert [r["x"] for r in det.outliers.collect()] == [x for _, x, w in want if w == "outlier"]


def test_several_id_columns_and_nothing_left_cached(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.2), (None, "b", 9.0)], "k long, s string, x double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {(r["k"], r["s"]): r["label"] for r in label_points(df, ["x"], 0.5, 2, ["k", "s"]).collect()}
    assert got == {(1, "a"): "core", (1, "b"): "core", (None, "b"): "outlier"}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_mahalanobis_of_an_empty_input(spark):
    empty = spark.createDataFrame([], "id long, a double, b double")
    assert baselines.mahalanobis(empty, ["a", "b"], id_col="id").count() == 0
    assert baselines.robust_mahalanobis(empty, ["a", "b"], id_col="id").count() == 0
