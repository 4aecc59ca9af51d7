"""Cell hierarchy in high dimensions, k-NN on the adaptive tree, the eps profile, text readers."""
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from epsgrid import detect
from epsgrid.operators import grid, neighbors, reach
from epsgrid.plans.sweep import counts_only, eps_profile, sweep_eps
from epsgrid.session import checkpoint_dir, scratch_path
from epsgrid.sources import readers
from helpers import brute_labels, labels_of


def frame(spark, X, idc="id"):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], [idc, *[f"x{j}" for j in range(X.shape[1])]])


def feats(X):
    return [f"x{j}" for j in range(X.shape[1])]


# ---------------------------------------------------------------- adjacency
@pytest.mark.parametrize("dim,constant,inclusive", [(5, 0, True), (9, 5, False)])
def test_neighbour_cells_equal_brute_force_in_high_dimensions(spark, dim, constant, inclusive):
    rng = np.random.default_rng(dim)
    X = rng.integers(-6, 6, (300, dim))
    X[:, :constant] = 7
    X = np.unique(X, axis=0)
    cells = spark.createDataFrame([tuple(map(int, x)) for x in X], grid.ccols(dim))
    got = sorted(tuple(r) for r in grid.neighbor_cells(cells, cells, dim, inclusive).collect())
    gap = (np.maximum(np.abs(X[:, None] - X[None]) - 1, 0) ** 2).sum(-1)
    near = gap <= dim if inclusive else gap < dim
    assert got == sorted((*map(int, X[i]), *map(int, X[j])) for i, j in zip(*np.nonzero(near)))


def test_candidate_pairs_stay_linear_with_constant_axes(spark):
    """Cells on a plane in six dimensions, leading axes constant: twice the cells, about twice the pairs."""
    counts = []
    for n in (500, 1000):
        cells = spark.range(n * 10).select(*[F.lit(3).cast("bigint").alias(f"c{i}") for i in range(3)],
                                           F.floor(F.col("id") / 10).alias("c3"), (F.col("id") % 10).alias("c4"),
                                           F.lit(-1).cast("bigint").alias("c5"))
        counts.append(grid.candidate_pairs(cells, cells, 6).count() / (n * 10))
    assert counts[1] < 1.05 * counts[0] < 200


def test_adjacency_of_no_cells_and_one_cell(spark):
    one = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], grid.ccols(6)).select(*[F.col(c).cast("bigint") for c in grid.ccols(6)])
    assert grid.neighbor_cells(one, one, 6).count() == 1
    none = one.where("1 = 0")
    assert grid.neighbor_cells(none, none, 6).count() == 0
    assert grid.neighbor_cells(one, none, 6).count() == 0


@pytest.mark.parametrize("dim", [6])
def test_labels_in_high_dimensions(spark, dim):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(0, 1, (80, dim)), rng.normal(8, 0.2, (60, dim)), rng.uniform(-20, 20, (15, dim))])
    X[:, 1] = 2.5
    det = detect(frame(spark, X), feats(X), 2.9, 6, "id")
    assert labels_of(det.labels, "id") == dict(enumerate(brute_labels(X, 2.9, 6)))
    det.release()


@pytest.mark.parametrize("dim,inclusive", [(5, True), (6, False)])
def test_labels_in_high_dimensions_without_pairs_of_cells(spark, monkeypatch, dim, inclusive):
    """Many rounds, several blocks a coarse cell, piles of equal points; no table of neighbour cells."""
    monkeypatch.setattr(reach, "FIRST_ROUND", 16)
    monkeypatch.setattr(reach, "BLOCK", (32, 8))
    rng = np.random.default_rng(dim)
    X = np.concatenate([rng.normal(0, 1, (250, dim)), np.repeat(rng.normal(0, 2, (12, dim)), 5, 0), rng.integers(-4, 5, (60, dim))])
    det = detect(frame(spark, X), feats(X), 2.0, 6, "id", inclusive=inclusive)
    want = brute_labels(X, 2.0, 6, inclusive)
    assert labels_of(det.labels, "id") == dict(enumerate(want)) and len(set(want)) == 3
    assert "adjacency" not in det._cache
    det.release()


def broadcast_rows(node):
    """Rows of every broadcast of a plan that ran."""
    name = node.getClass().getSimpleName()
    inner = {"AdaptiveSparkPlanExec": "executedPlan", "BroadcastQueryStageExec": "plan", "ShuffleQueryStageExec": "plan",
             "ResultQueryStageExec": "plan", "ReusedExchangeExec": "child"}.get(name)
    if name == "BroadcastExchangeExec":
        yield node.metrics().apply("numOutputRows").value()
    kids = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    for kid in kids:
        yield from broadcast_rows(kid)


@pytest.mark.parametrize("spread_queries,most_cells", [(False, reach.MOST_CELLS), (True, reach.MOST_CELLS), (False, 0)])
def test_points_are_not_spread_before_they_are_broadcast(spark, tmp_path, monkeypatch, spread_queries, most_cells):
    """A side that Spark takes for small is broadcast as it is, not once for each coarse cell beside its own."""
    checkpoint_dir(spark)
    monkeypatch.setattr(reach, "MOST_CELLS", most_cells)
    X = np.random.default_rng(7).uniform(0, 3, (2000, 5))
    for name, n in (("few", 700), ("many", len(X))):  # files have a size, so Spark has an estimate
        rows = [(i, *map(float, x)) for i, x in enumerate(X[:n])]
        spark.createDataFrame(rows, ["pid", *grid.fcols(5)]).write.parquet(str(tmp_path / name))
    few, many = (spark.read.parquet(str(tmp_path / name)) for name in ("few", "many"))
    todo, part = (few, many) if spread_queries else (many, few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        hits = reach._hits(todo, part.withColumn("w", F.lit(1).cast("bigint")), [0, 1, 2], 5, 1.0, False, spread_queries)
        got = {r.pid: r.hits for r in hits.collect()}
        most = max(broadcast_rows(hits._jdf.queryExecution().executedPlan()), default=0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    a, b = (X[:700], X) if spread_queries else (X, X[:700])
    near = (((a[:, None] - b[None]) ** 2).sum(-1) < 1.0).sum(1)
    assert got == {i: int(k) for i, k in enumerate(near) if k}
    assert most <= len(X)


# ---------------------------------------------------------------- k-NN
def brute_knn(X, k, include_self):
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    if not include_self:
        np.fill_diagonal(d, np.inf)
    n = len(X)
    return {i: np.lexsort((np.arange(n), d[i]))[:min(k, n - (not include_self))].tolist() for i in range(n)}


@pytest.mark.parametrize("kind,k,include_self", [("scales", 5, True), ("piles", 4, False), ("few", 20, True), ("equal", 3, False)])
def test_knn_equals_brute_force(spark, kind, k, include_self):
    rng = np.random.default_rng(0)
    X = {"scales": np.concatenate([rng.normal(0, 1, (120, 2)), rng.normal(50, 1e-2, (80, 2)), rng.uniform(-1e2, 1e2, (12, 2))]),
         "piles": np.concatenate([rng.integers(0, 4, (200, 3)), rng.normal(0, 1, (30, 3))]).astype(float),
         "few": rng.normal(0, 1, (9, 1)), "equal": np.zeros((30, 2))}[kind]
    got = {}
    for r in neighbors.knn(frame(spark, X), feats(X), k, "id", include_self).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr_id"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == brute_knn(X, k, include_self)


def test_pairs_per_query_are_bounded_under_skew(spark):
    """A third of all rows in one small region, one percent far away: no query sees that region whole."""
    checkpoint_dir(spark)
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.uniform(0, 1, (4000, 2)), 0.5 + rng.uniform(0, 1e-6, (2000, 2)), rng.uniform(-1e4, 1e4, (60, 2))])
    pts = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], ["pid", "f0", "f1"])
    per = neighbors.candidate_pairs(pts, pts, 2, 5, len(X)).groupBy("pid").count()
    most, mean, n = per.agg(F.max("count"), F.avg("count"), F.count("*")).first()
    assert n == len(X) and most <= 30 * neighbors.leaf_rows(5) and mean < 5 * neighbors.leaf_rows(5)


def test_pairs_beyond_the_reach_of_a_point_are_dropped(spark):
    """Evenly spread points see a few times as many others as they ask for."""
    checkpoint_dir(spark)
    X = np.random.default_rng(2).uniform(0, 1, (3000, 2))
    pts = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], ["pid", "f0", "f1"])
    pairs = neighbors.candidate_pairs(pts, pts, 2, 8, len(X))
    assert 8 * len(X) <= pairs.count() < 6 * 8 * len(X)


# ---------------------------------------------------------------- sweep
@pytest.mark.parametrize("inclusive", [False, True])
def test_one_profile_gives_the_labels_of_every_eps(spark, inclusive):
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(0, 1, (120, 2)), rng.integers(-3, 4, (60, 2)), np.full((10, 2), 9.0)]).astype(float)
    rows = eps_profile(frame(spark, X), feats(X), 5, "id").collect()
    assert len(rows) == len(X)
    for eps in (0.05, 0.4, 1.0, 2.0, 30.0):
        hit = (lambda v: v <= eps) if inclusive else (lambda v: v < eps)
        got = {r["id"]: "core" if hit(r["core_at"]) else "border" if hit(r["reach_at"]) else "outlier" for r in rows}
        assert got == dict(enumerate(brute_labels(X, eps, 5, inclusive))), eps


def test_repeats_are_rows_of_their_own_and_few_points_are_no_core(spark):
    X = np.array([[0.0], [0.1], [5.0]])
    got = counts_only(sweep_eps(frame(spark, X), ["x0"], [0.5, 50.0], 4, "id", repeats=2)).collect()
    assert sorted((r["run"], r["value"], r["core_points"], r["outliers"]) for r in got) == [
        (0, 0.5, 0, 3), (0, 50.0, 0, 3), (1, 0.5, 0, 3), (1, 50.0, 0, 3)]


# ---------------------------------------------------------------- readers
def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "b").mkdir()
    texts = {"a.txt": [f"a{i}" for i in range(2000)], "b/c.txt": ["x", "", "y"], "d.txt": ["last"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.read_indexed_lines(spark, str(tmp_path), recursive=True).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_idx for r in rows] == list(range(2004))
    assert [r.line for r in rows] == texts["a.txt"] + texts["b/c.txt"] + texts["d.txt"]
    assert [r.line_no for r in rows] == [*range(2000), 0, 1, 2, 0]


def test_id_file_with_repeats_and_unknown_ids(spark, tmp_path):
    (tmp_path / "data.csv").write_text("0.5,1\n1.5,2\n2.5,3\n")
    (tmp_path / "ids").write_text("2 x\n0\n\n2\n7\nword\n")
    got = readers.merge_id_file(spark, str(tmp_path / "ids"), str(tmp_path / "data.csv"), 2)
    assert sorted((r.row_idx, r.x1, r.x2) for r in got.collect()) == [(0, 0.5, 1.0), (2, 2.5, 3.0), (2, 2.5, 3.0)]
    seen = Observation()
    assert readers.read_id_list(spark, str(tmp_path / "ids"), observation=seen).count() == 5
    assert seen.get == {"n_lines": 5, "n_rejects": 1}


@pytest.mark.parametrize("read,lines,rejects", [
    (lambda s, p, o: readers.read_points_csv(s, p, 2, observation=o), "x,y\n1,2\n3\n\n4,z\n5,6,7\n", 3),
    (lambda s, p, o: readers.read_labeled_points(s, p, 2, observation=o), "1,2,noise\n1,z,0\n3,4\n", 2),
    (lambda s, p, o: readers.read_predictions(s, p, 2, observation=o), "1,2,1,-1\n1,2,1\n", 1),
    (lambda s, p, o: readers.read_ds(s, p, 2, observation=o), "0 1 2\n1 1\nq 1 2\n", 2),
    (lambda s, p, o: readers.read_timings(s, p, observation=o), "a,1,2\nb,1\n", 1)])
def test_readers_count_their_rejects(spark, tmp_path, read, lines, rejects):
    (tmp_path / "t").write_text(lines)
    seen = Observation()
    read(spark, str(tmp_path / "t"), seen).write.format("noop").mode("overwrite").save()
    assert seen.get["n_rejects"] == rejects


def test_quarantined_rows_are_counted(spark):
    from epsgrid import run_stats
    df = spark.createDataFrame([(1, 0.0), (2, float("nan")), (3, None), (4, 0.1), (5, float("inf"))], "id int, x double")
    with detect(df, ["x"], 1.0, 2, "id") as det:
        r = run_stats(det).first()
        assert (r.total_points, r.quarantined, det.labels.count()) == (2, 3, 2)


# ---------------------------------------------------------------- border test
def test_border_test_is_a_semi_join_with_one_row_per_near_point(spark, capsys):
    rng = np.random.default_rng(6)
    X = np.concatenate([rng.normal(0, 1, (400, 2)), rng.uniform(-6, 6, (60, 2))])
    with detect(frame(spark, X), feats(X), 0.5, 8, "id") as det:
        near = det.near_core()
        assert near.count() == near.distinct().count()
        near.explain()
        plan = capsys.readouterr().out
        assert plan.count("LeftSemi") >= 2
        want = brute_labels(X, 0.5, 8)
        rejected = {r.id0 for r in det.all_core_reject.select("id0").collect()}
        without = {r.id0 for r in det.no_core_neighbor.select("id0").collect()}
        assert rejected | without == {i for i, w in enumerate(want) if w == "outlier"} and not rejected & without


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
