"""Registered queries (one per operator of the inventory) and their oracles.

Each query takes ``(spark, sf_dir)``, reads the driver's tables (whole
tables) and returns a DataFrame; ``ORACLE[key]`` is the same result in DuckDB
SQL over the same tables, with identical column names.  Spark's own sampler, the
robust fit and the forest's scores have no SQL oracle and are checked by
properties in the tests.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import euclid_distance, grid_coord, label_to_sign
from ..operators import baselines, dataset, evaluate, neighbors, stats
from ..operators.detect import Detection, detect, label_points
from ..operators.grid import expand_offsets, number_points
from ..session import checkpoint_dir, scratch_path
from ..sources import readers, writers
from . import compare, sweep
from . import fixtures as fx
from .oracle import BruteForce, num, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a query.  Detections it asks for end with it: its result is written to the
    checkpoint folder and their caches are released, so no query sees another's."""
    def deco(fn):
        @functools.wraps(fn)
        def query(spark, sf_dir):
            try:
                out = fn(spark, sf_dir)
                if _DETECTIONS:
                    checkpoint_dir(spark)
                    out = out.checkpoint()
                return out
            finally:
                release_all()
        QUERIES[key] = query
        if sql is not None:
            ORACLE[key] = sql
        return query
    return deco


# ---------------------------------------------------------------- detections of a query
EPS, MIN_PTS = 7.3, 8          # events2d at sf0.01: brute force 8,509 core / 462 border / 1,029 outliers
EPS_B, MIN_PTS_B = 11.7, 10    # second parameter pair of the same fixture
_DETECTIONS: dict = {}


def ev_detection(spark: SparkSession, sf_dir: str, eps: float = EPS, min_pts: int = MIN_PTS,
                 strategy: str = "shuffle", inclusive: bool = False, **kw) -> Detection:
    """The detection of these parameters, run once within a query."""
    key = (sf_dir, eps, min_pts, strategy, inclusive, tuple(sorted(kw.items())))
    det = _DETECTIONS.get(key)
    if det is None:
        df, idc, feats = fx.events2d(spark, sf_dir)
        det = detect(df, feats, eps, min_pts, idc, strategy=strategy, inclusive=inclusive, **kw)
        _DETECTIONS[key] = det
    return det


def release_all() -> None:
    for d in _DETECTIONS.values():
        d.release()
    _DETECTIONS.clear()


BF = BruteForce(fx.EVENTS2D_SQL, ["event_id"], ["x1", "x2"], EPS, MIN_PTS)
BF_B = BruteForce(fx.EVENTS2D_SQL, ["event_id"], ["x1", "x2"], EPS_B, MIN_PTS, prefix="q_")
LABELED_EVENTS_SQL = ("SELECT event_id, epoch_us(ts) / 3.6e9 - 473352 AS x1, value AS x2, "
                      "CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS label FROM events")


def labeled_events(spark, sf_dir) -> DataFrame:
    """events2d with a ground truth: event_type ``error`` plays the role of ``noise``."""
    df, _, _ = fx.events2d(spark, sf_dir)
    ty = fx.table(spark, sf_dir, "events").select(
        "event_id", label_to_sign(F.when(F.col("event_type") == "error", F.lit("noise"))
                                  .otherwise(F.col("event_type"))).alias("label"))
    return df.join(ty, "event_id")


def _pred_sql(bf: BruteForce) -> str:
    return with_ctes(bf.ctes() + [
        f"le AS ({LABELED_EVENTS_SQL})",
        "pr AS (SELECT le.x1, le.x2, le.label, CASE WHEN l.label = 'outlier' THEN -1 ELSE 1 END "
        "AS prediction FROM le JOIN lab l ON le.event_id = l.event_id)"], "SELECT * FROM pr")


def predictions(spark, sf_dir) -> DataFrame:
    """D5: data + label + prediction (-1 = detected outlier)."""
    det = ev_detection(spark, sf_dir)
    lab = labeled_events(spark, sf_dir)
    tagged = dataset.tag_detected(lab, det.outliers.select("event_id"), ["event_id"])
    return tagged.select("x1", "x2", "label", dataset.sign(F.col("detected")).alias("prediction"))


# ================================================================ sources
def _write_ev_csv(spark, sf_dir, header=False, parts=4, extra=()):
    df, _, _ = fx.events2d(spark, sf_dir)
    path = scratch_path(spark, "points-csv")
    cols = ["x1", "x2", *extra]
    src = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    df.join(src, "event_id").select(*cols).repartition(parts).write.option("header", header).csv(path)
    return path


@register("read_points_csv", "SELECT x1, x2 FROM (" + fx.EVENTS2D_SQL + ")")
def q_read_points_csv(spark, sf_dir):
    return readers.read_points_csv(spark, _write_ev_csv(spark, sf_dir), 2)


@register("skip_header", "SELECT x1, x2 FROM (" + fx.EVENTS2D_SQL + ")")
def q_skip_header(spark, sf_dir):
    # four part files, each with its own "x1,x2" header line
    return readers.read_points_csv(spark, _write_ev_csv(spark, sf_dir, header=True), 2)


@register("assign_point_id", "SELECT count(*) AS n_rows, count(*) AS n_ids FROM events")
def q_assign_point_id(spark, sf_dir):
    pts = readers.read_points_csv(spark, _write_ev_csv(spark, sf_dir), 2, with_id=True)
    return pts.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("point_id").alias("n_ids"))


@register("row_index", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events")
def q_row_index(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select("event_id")
    return dataset.with_row_index(ev, ["event_id"], "row_idx")


def _events_in_order(spark, sf_dir) -> str:
    """The events as CSV files whose lines are in order of event_id, over all files."""
    df, _, _ = fx.events2d(spark, sf_dir)
    path = scratch_path(spark, "events-in-order")
    df.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("x1", "x2", "event_id").write.csv(path)
    return path


@register("row_index_file_order", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id FROM events")
def q_row_index_file_order(spark, sf_dir):
    lines = readers.read_indexed_lines(spark, _events_in_order(spark, sf_dir))
    return lines.select("row_idx", F.get(F.split("line", ","), 2).cast("bigint").alias("event_id"))


@register("read_rejects", "SELECT count(*) AS n_lines, count_if(event_type = 'error') AS n_rejects, "
                          "count_if(event_type <> 'error') AS n_points FROM events")
def q_read_rejects(spark, sf_dir):
    """Lines that do not parse are counted by the read itself; errors lack their number here."""
    ev = fx.table(spark, sf_dir, "events")
    path = scratch_path(spark, "points-with-rejects")
    ev.select(F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", F.lit("?"))
              .otherwise(F.col("value").cast("string"))).write.csv(path)
    seen = Observation()
    n = readers.read_points_csv(spark, path, 2, observation=seen).count()
    got = seen.get
    return spark.createDataFrame([(got["n_lines"], got["n_rejects"], n)], "n_lines long, n_rejects long, n_points long")


@register("repartition_input", with_ctes(BF.ctes(), "SELECT event_id, x1, x2 FROM lab WHERE label = 'outlier'"))
def q_repartition_input(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    det = detect(df.repartition(3), feats, EPS, MIN_PTS, idc, num_partitions=5)
    return det.outliers


TRAJ_SQL = ("SELECT value AS lat, epoch_us(ts) / 3.6e9 - 473352 AS long, CAST(event_id AS DOUBLE) AS alt "
            "FROM events")


@register("read_trajectories", TRAJ_SQL)
def q_read_trajectories(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    ev = fx.table(spark, sf_dir, "events").select("event_id", "user_id")
    src = df.join(ev, "event_id").withColumn("alt", F.col("event_id").cast("double"))
    path = scratch_path(spark, "trajectories")
    writers.write_trajectories(src, path, "user_id", "x1", "x2", "x1", "alt")
    return readers.read_trajectories(spark, path, glob="*.txt").select("lat", "long", "alt")


@register("read_labeled_points",
          "SELECT epoch_us(ts) / 3.6e9 - 473352 AS x1, value AS x2, "
          "CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS label FROM events")
def q_read_labeled_points(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    ev = fx.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("noise"))
        .otherwise(F.col("event_type")).alias("lbl"))
    path = scratch_path(spark, "labeled")
    df.join(ev, "event_id").select("x1", "x2", "lbl").write.csv(path)
    return readers.read_labeled_points(spark, path, 2)


DS_SQL = ("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, value AS x1, "
          "CAST(user_id AS DOUBLE) AS x2 FROM events")


def _ev_ds_frame(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("x1"), F.col("user_id").cast("double").alias("x2"))


@register("read_ds", DS_SQL)
def q_read_ds(spark, sf_dir):
    path = scratch_path(spark, "ds")
    writers.write_ds(_ev_ds_frame(spark, sf_dir), path, ["event_id"], ["x1", "x2"])
    return readers.read_ds(spark, path, 2)


@register("select_features", "SELECT x1, x2 FROM (" + fx.EVENTS2D_SQL + ")")
def q_select_features(spark, sf_dir):
    path = _write_ev_csv(spark, sf_dir, extra=("user_id", "event_type"))
    return readers.select_features(readers.read_points_csv(spark, path, 3), 2)


TIMINGS_SQL = "SELECT event_type AS alg, CAST(user_id AS DOUBLE) AS x, value AS y FROM events"


def _timings(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    path = scratch_path(spark, "timings")
    ev.select(F.col("event_type").alias("alg"), F.col("user_id").cast("double").alias("x"),
              F.col("value").alias("y")).write.csv(path)
    return readers.read_timings(spark, path)


@register("read_timings", TIMINGS_SQL)
def q_read_timings(spark, sf_dir):
    return _timings(spark, sf_dir)


# ================================================================ sinks
OUTLIERS_SQL = with_ctes(BF.ctes(), "SELECT event_id, x1, x2 FROM lab WHERE label = 'outlier'")


@register("write_outliers", with_ctes(BF.ctes(), "SELECT x1, x2 FROM lab WHERE label = 'outlier'"))
def q_write_outliers(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    path = scratch_path(spark, "outliers")
    writers.write_outliers(det.outliers, path, ["x1", "x2"])
    return readers.read_points_csv(spark, path, 2)


@register("write_ds", "SELECT row_idx, CAST(row_idx AS VARCHAR) || ' ' || CAST(x1 AS VARCHAR) || ' ' || "
                      "CAST(x2 AS VARCHAR) AS value FROM (" + DS_SQL + ")")
def q_write_ds(spark, sf_dir):
    path = scratch_path(spark, "ds")
    writers.write_ds(_ev_ds_frame(spark, sf_dir), path, ["event_id"], ["x1", "x2"])
    lines = readers.read_ds(spark, path, as_text=True)
    return lines.select("row_idx", F.col("line").alias("value"))


DIFF_SQL = with_ctes(BF.ctes() + BF_B.ctes(), """
SELECT x1, x2, '12' AS side FROM lab a WHERE a.label = 'outlier' AND NOT EXISTS
  (SELECT 1 FROM q_lab b WHERE b.label = 'outlier' AND b.x1 = a.x1 AND b.x2 = a.x2)
UNION ALL
SELECT x1, x2, '21' AS side FROM q_lab a WHERE a.label = 'outlier' AND NOT EXISTS
  (SELECT 1 FROM lab b WHERE b.label = 'outlier' AND b.x1 = a.x1 AND b.x2 = a.x2)""")


def _diff(spark, sf_dir):
    a = ev_detection(spark, sf_dir).outliers.select("x1", "x2")
    b = ev_detection(spark, sf_dir, EPS_B, MIN_PTS).outliers.select("x1", "x2")
    return dataset.diff_datasets(a, b, ["x1", "x2"])


@register("write_diff", DIFF_SQL)
def q_write_diff(spark, sf_dir):
    prefix = scratch_path(spark, "diff")
    writers.write_diff(_diff(spark, sf_dir), prefix)
    parts = [readers.read_points_csv(spark, f"{prefix}_{s}", 2).withColumn("side", F.lit(s)) for s in ("12", "21")]
    return parts[0].unionByName(parts[1])


@register("write_predictions", _pred_sql(BF))
def q_write_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(predictions(spark, sf_dir), path, ["x1", "x2"])
    return readers.read_predictions(spark, path, 2)


# ================================================================ expressions
S2 = num(math.sqrt(2))


@register("grid_assign", f"SELECT event_id, CAST(floor(x1 / {num(EPS)} * {S2}) AS BIGINT) AS c0, "
                         f"CAST(floor(x2 / {num(EPS)} * {S2}) AS BIGINT) AS c1 FROM ({fx.EVENTS2D_SQL})")
def q_grid_assign(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    return df.select("event_id", grid_coord("x1", EPS, 2).alias("c0"), grid_coord("x2", EPS, 2).alias("c1"))


@register("euclid_distance", "SELECT event_id, sqrt((x1 - 0.0) * (x1 - 0.0) + (x2 - 0.0) * (x2 - 0.0)) AS dist "
                             f"FROM ({fx.EVENTS2D_SQL})")
def q_euclid_distance(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    return df.select("event_id", euclid_distance(["x1", "x2"], [F.lit(0.0), F.lit(0.0)]).alias("dist"))


@register("cell_min_dist", with_ctes(BF.ctes(grid=True),
                                     "SELECT c0, c1, n0, n1, CAST(gap AS DOUBLE) / 2 AS min_sq_dist FROM adj"))
def q_cell_min_dist(spark, sf_dir):
    from ..functions import cell_min_sq_dist
    det = ev_detection(spark, sf_dir)
    adj = det.nonempty_neighbors()
    return adj.select("c0", "c1", "n0", "n1", cell_min_sq_dist(["c0", "c1"], ["n0", "n1"]).alias("min_sq_dist"))


BF3 = BruteForce(fx.LINEITEMS3D_SQL, fx.LINEITEM_KEY, ["x1", "x2", "x3"], 2.57, 5)


@register("neighbor_offsets", with_ctes(BF3.ctes(grid=True) + [
    "o AS (SELECT a.o0, b.o1, c.o2 FROM (SELECT unnest(range(-2, 3)) AS o0) a, "
    "(SELECT unnest(range(-2, 3)) AS o1) b, (SELECT unnest(range(-2, 3)) AS o2) c "
    "WHERE greatest(abs(o0) - 1, 0) * greatest(abs(o0) - 1, 0) + greatest(abs(o1) - 1, 0) * "
    "greatest(abs(o1) - 1, 0) + greatest(abs(o2) - 1, 0) * greatest(abs(o2) - 1, 0) < 3)"],
    "SELECT c0, c1, c2, count(*) AS n_offsets FROM cells, o GROUP BY c0, c1, c2"))
def q_neighbor_offsets(spark, sf_dir):
    df, _, feats = fx.lineitems3d(spark, sf_dir)
    cells = df.select(*[grid_coord(f, 2.57, 3).alias(f"c{i}") for i, f in enumerate(feats)]).distinct()
    return expand_offsets(cells, 3).groupBy("c0", "c1", "c2").agg(F.count(F.lit(1)).alias("n_offsets"))


@register("rescale", f"SELECT event_id, x1 / 10.0 AS x1, x2 / 10.0 AS x2 FROM ({fx.EVENTS2D_SQL})")
def q_rescale(spark, sf_dir):
    df, _, feats = fx.events2d(spark, sf_dir)
    return dataset.rescale(df, feats, 10.0)


GRID = BF.ctes(grid=True)


@register("filter_cell_type", with_ctes(GRID, f"SELECT g.pid AS event_id FROM g JOIN cells c "
                                              f"ON g.c0 = c.c0 AND g.c1 = c.c1 WHERE c.n >= {MIN_PTS}"))
def q_filter_cell_type(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    return det.dense_points.select(F.col("id0").alias("event_id"))


# ================================================================ joins
@register("nonempty_neighbors", with_ctes(GRID, "SELECT c0, c1, n0, n1 FROM adj"))
def q_nonempty_neighbors(spark, sf_dir):
    return ev_detection(spark, sf_dir).nonempty_neighbors().select("c0", "c1", "n0", "n1")


@register("core_neighbors", with_ctes(GRID, "SELECT a.c0, a.c1, a.n0, a.n1, t2.cell_type AS type_nb FROM adj a "
                                            "JOIN typed t1 ON a.c0 = t1.c0 AND a.c1 = t1.c1 "
                                            "JOIN typed t2 ON a.n0 = t2.c0 AND a.n1 = t2.c1 "
                                            "WHERE t1.cell_type = 'OTHER' AND t2.cell_type <> 'OTHER'"))
def q_core_neighbors(spark, sf_dir):
    return ev_detection(spark, sf_dir).core_neighbors().select("c0", "c1", "n0", "n1", "type_nb")


PAIRS_SQL = with_ctes(GRID, f"SELECT p.aid AS q_id, p.bid AS p_id FROM pairs p JOIN g ON p.aid = g.pid "
                            f"JOIN cells c ON g.c0 = c.c0 AND g.c1 = c.c1 WHERE c.n < {MIN_PTS}")


def _pair_ids(det: Detection) -> DataFrame:
    return det.with_ids(det.with_ids(det.eps_pairs(), "q_pid", ["q_id"]), "p_pid", ["p_id"]).select("q_id", "p_id")


@register("eps_join", PAIRS_SQL)
def q_eps_join(spark, sf_dir):
    return _pair_ids(ev_detection(spark, sf_dir))


@register("eps_join_broadcast", PAIRS_SQL)
def q_eps_join_broadcast(spark, sf_dir):
    return _pair_ids(ev_detection(spark, sf_dir, strategy="broadcast"))


@register("eps_join_grouped", with_ctes(BF.ctes(grid=True) + [
    f"pc AS (SELECT pid, cnt FROM cnt JOIN g USING (pid) JOIN cells c ON g.c0 = c.c0 AND g.c1 = c.c1 "
    f"WHERE c.n < {MIN_PTS})",
    "ub AS (SELECT c0, c1, sum(n_nb) AS ub FROM adj GROUP BY c0, c1)"],
    f"SELECT pc.pid AS q_id, CAST(least(pc.cnt, {MIN_PTS}) AS BIGINT) AS capped_count FROM pc "
    f"JOIN g USING (pid) JOIN ub ON g.c0 = ub.c0 AND g.c1 = ub.c1 WHERE ub.ub >= {MIN_PTS}"))
def q_eps_join_grouped(spark, sf_dir):
    det = ev_detection(spark, sf_dir, strategy="grouped")
    return det.with_ids(det.neighbor_counts()).select(
        F.col("id0").alias("q_id"), F.col("cnt").cast("bigint").alias("capped_count"))


NO_CORE_NB_SQL = with_ctes(GRID + [
    "oc AS (SELECT DISTINCT a.c0, a.c1 FROM adj a JOIN typed t2 ON a.n0 = t2.c0 AND a.n1 = t2.c1 "
    "WHERE t2.cell_type <> 'OTHER')"],
    "SELECT g.pid AS event_id FROM g JOIN typed t ON g.c0 = t.c0 AND g.c1 = t.c1 "
    "WHERE t.cell_type = 'OTHER' AND NOT EXISTS (SELECT 1 FROM oc WHERE oc.c0 = g.c0 AND oc.c1 = g.c1)")


@register("no_core_neighbor", NO_CORE_NB_SQL)
def q_no_core_neighbor(spark, sf_dir):
    return ev_detection(spark, sf_dir).no_core_neighbor.select(F.col("id0").alias("event_id"))


IDX_CTE = "idx AS (SELECT event_id, x1, x2, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM pts)"


@register("merge_ids", with_ctes(BF.ctes() + [IDX_CTE],
    "SELECT i.row_idx, i.x1, i.x2, i.event_id FROM idx i JOIN lab l ON i.event_id = l.event_id, "
    "(SELECT unnest(range(2)) AS again) a WHERE l.label = 'outlier' AND (again = 0 OR i.row_idx % 2 = 0)"))
def q_merge_ids(spark, sf_dir):
    """An id file, ids of even lines listed twice, merged with the data files it points into."""
    data = _events_in_order(spark, sf_dir)
    lines = readers.read_indexed_lines(spark, data)
    key = F.get(F.split("line", ","), 2).cast("bigint").alias("event_id")
    out = ev_detection(spark, sf_dir).outliers.select("event_id")
    ids = lines.select("row_idx", key).join(out, "event_id").select(
        F.explode(F.when(F.col("row_idx") % 2 == 0, F.array("row_idx", "row_idx")).otherwise(F.array("row_idx"))).alias("i"))
    path = scratch_path(spark, "id-list")
    ids.select(F.concat(F.col("i").cast("string"), F.lit(" outlier")).alias("value")).write.text(path)
    merged = readers.merge_id_file(spark, path, data, 2)
    return merged.select("row_idx", "x1", "x2", key)


@register("tag_detected", with_ctes(BF.ctes(), "SELECT event_id, label = 'outlier' AS detected FROM lab"))
def q_tag_detected(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    out = ev_detection(spark, sf_dir).outliers
    return dataset.tag_detected(df, out, ["event_id"]).select("event_id", "detected")


@register("remove_outliers", with_ctes(BF.ctes(), "SELECT event_id, x1, x2 FROM lab WHERE label <> 'outlier'"))
def q_remove_outliers(spark, sf_dir):
    df, _, _ = fx.events2d(spark, sf_dir)
    return dataset.remove_outliers(df, ev_detection(spark, sf_dir).outliers, ["event_id"])


# ================================================================ aggregations
@register("cell_counts", with_ctes(GRID, "SELECT c0, c1, n FROM cells"))
def q_cell_counts(spark, sf_dir):
    return ev_detection(spark, sf_dir).cells.select("c0", "c1", "n")


@register("dense_cells", with_ctes(GRID, f"SELECT c0, c1, n, CASE WHEN n >= {MIN_PTS} THEN 'DENSE' "
                                         f"ELSE 'OTHER' END AS cell_type FROM cells"))
def q_dense_cells(spark, sf_dir):
    from ..operators.grid import cell_types
    return cell_types(ev_detection(spark, sf_dir).cells, MIN_PTS).select("c0", "c1", "n", "cell_type")


@register("neighbor_count", with_ctes(GRID, f"SELECT g.pid AS event_id, k.cnt FROM cnt k JOIN g ON k.pid = g.pid "
                                            f"JOIN cells c ON g.c0 = c.c0 AND g.c1 = c.c1 WHERE c.n < {MIN_PTS}"))
def q_neighbor_count(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    counts = det.eps_pairs().groupBy("q_pid").agg(F.count(F.lit(1)).alias("cnt"))
    return det.with_ids(counts, "q_pid", ["event_id"]).select("event_id", "cnt")


@register("partial_core_points", with_ctes(GRID, f"SELECT g.pid AS event_id FROM core k JOIN g ON k.pid = g.pid "
                                                 f"JOIN cells c ON g.c0 = c.c0 AND g.c1 = c.c1 WHERE c.n < {MIN_PTS}"))
def q_partial_core_points(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    return det.with_ids(det.partial_core).select(F.col("id0").alias("event_id"))


@register("core_cells", with_ctes(GRID, "SELECT c0, c1, n, cell_type FROM typed"))
def q_core_cells(spark, sf_dir):
    return ev_detection(spark, sf_dir).typed_cells.select("c0", "c1", "n", "cell_type")


@register("all_core_reject", with_ctes(GRID + [
    "oc AS (SELECT DISTINCT a.c0, a.c1 FROM adj a JOIN typed t2 ON a.n0 = t2.c0 AND a.n1 = t2.c1 "
    "WHERE t2.cell_type <> 'OTHER')"],
    "SELECT l.event_id FROM lab l JOIN g ON l.pid = g.pid JOIN oc ON g.c0 = oc.c0 AND g.c1 = oc.c1 "
    "WHERE l.label = 'outlier'"))
def q_all_core_reject(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    return det.all_core_reject.select(F.col("id0").alias("event_id"))


@register("distinct_cells", with_ctes(GRID, "SELECT c0, c1 FROM cells"))
def q_distinct_cells(spark, sf_dir):
    return stats.distinct_cells(ev_detection(spark, sf_dir))


@register("points_per_cell_stats", with_ctes(GRID, "SELECT max(n) AS max_points_per_cell, min(n) AS "
                                                   "min_points_per_cell, CAST(sum(n) AS DOUBLE) / count(*) AS "
                                                   "avg_points_per_cell FROM cells"))
def q_points_per_cell_stats(spark, sf_dir):
    return stats.points_per_cell_stats(ev_detection(spark, sf_dir))


NPC = "npc AS (SELECT c0, c1, count(*) AS n_neighbors FROM adj GROUP BY c0, c1)"


@register("neighbors_per_cell_stats", with_ctes(GRID + [NPC], "SELECT max(n_neighbors) AS max_neighbors_per_cell, "
                                                             "min(n_neighbors) AS min_neighbors_per_cell, "
                                                             "CAST(sum(n_neighbors) AS DOUBLE) / count(*) AS "
                                                             "avg_neighbors_per_cell FROM npc"))
def q_neighbors_per_cell_stats(spark, sf_dir):
    return stats.neighbors_per_cell_stats(ev_detection(spark, sf_dir))


@register("cell_type_counts", with_ctes(GRID, "SELECT count(*) AS total_cells, "
                                              "count_if(cell_type = 'DENSE') AS dense_cells, "
                                              "count_if(cell_type = 'CORE') AS core_cells, "
                                              "count_if(cell_type = 'OTHER') AS other_cells FROM typed"))
def q_cell_type_counts(spark, sf_dir):
    return stats.cell_type_counts(ev_detection(spark, sf_dir))


RUN_STATS_SQL = with_ctes(GRID + [NPC, """rs AS (SELECT
  (SELECT count(*) FROM lab) AS total_points,
  (SELECT count(*) FROM lab WHERE label = 'core') AS core_points,
  (SELECT count(*) FROM lab WHERE label = 'border') AS border_points,
  (SELECT count(*) FROM lab WHERE label = 'outlier') AS outliers,
  (SELECT count(*) FROM typed) AS total_cells,
  (SELECT count(*) FROM typed WHERE cell_type = 'DENSE') AS dense_cells,
  (SELECT count(*) FROM typed WHERE cell_type = 'CORE') AS core_cells,
  (SELECT count(*) FROM typed WHERE cell_type = 'OTHER') AS other_cells,
  (SELECT max(n) FROM cells) AS max_points_per_cell,
  (SELECT min(n) FROM cells) AS min_points_per_cell,
  (SELECT CAST(sum(n) AS DOUBLE) / count(*) FROM cells) AS avg_points_per_cell,
  (SELECT max(n_neighbors) FROM npc) AS max_neighbors_per_cell,
  (SELECT min(n_neighbors) FROM npc) AS min_neighbors_per_cell,
  (SELECT CAST(sum(n_neighbors) AS DOUBLE) / count(*) FROM npc) AS avg_neighbors_per_cell)"""],
    f"""SELECT {num(EPS)} AS eps, {MIN_PTS} AS min_pts, total_points,
  (SELECT count(*) FROM pts WHERE x1 IS NULL OR x2 IS NULL OR NOT isfinite(x1) OR NOT isfinite(x2)) AS quarantined,
  core_points, CAST(core_points AS DOUBLE) / total_points * 100.0 AS core_pct,
  border_points, CAST(border_points AS DOUBLE) / total_points * 100.0 AS border_pct,
  outliers, CAST(outliers AS DOUBLE) / total_points * 100.0 AS outlier_pct,
  total_cells, dense_cells, CAST(dense_cells AS DOUBLE) / total_cells * 100.0 AS dense_cell_pct,
  core_cells, CAST(core_cells AS DOUBLE) / total_cells * 100.0 AS core_cell_pct,
  other_cells, CAST(other_cells AS DOUBLE) / total_cells * 100.0 AS other_cell_pct,
  max_points_per_cell, min_points_per_cell, avg_points_per_cell,
  max_neighbors_per_cell, min_neighbors_per_cell, avg_neighbors_per_cell FROM rs""")


@register("run_stats", RUN_STATS_SQL)
def q_run_stats(spark, sf_dir):
    return stats.run_stats(ev_detection(spark, sf_dir))


@register("timing_summary", f"SELECT alg, x, round(avg(y), 6) AS mean_time, round(stddev_samp(y), 6) AS std_time, "
                            f"count(*) AS runs FROM ({TIMINGS_SQL}) GROUP BY alg, x")
def q_timing_summary(spark, sf_dir):
    t = evaluate.timing_summary(_timings(spark, sf_dir))
    return t.select("alg", "x", F.round("mean_time", 6).alias("mean_time"),
                    F.round("std_time", 6).alias("std_time"), "runs")


PRED = _pred_sql(BF)


@register("confusion", f"SELECT count_if(label = 1 AND prediction = 1) AS data_found, "
                       f"count_if(label = 1 AND prediction = -1) AS data_not_found, "
                       f"count_if(label = -1 AND prediction = -1) AS outliers_found, "
                       f"count_if(label = -1 AND prediction = 1) AS outliers_not_found FROM ({PRED})")
def q_confusion(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir))


@register("f1_outlier", f"SELECT tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE "
                        f"CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM "
                        f"(SELECT count_if(label = -1 AND prediction = -1) AS tp, "
                        f"count_if(label = 1 AND prediction = -1) AS fp, "
                        f"count_if(label = -1 AND prediction = 1) AS fn FROM ({PRED}))")
def q_f1_outlier(spark, sf_dir):
    return evaluate.f1_outlier(predictions(spark, sf_dir))


@register("adjusted_rand", f"""WITH p AS ({PRED}),
ct AS (SELECT label, prediction, count(*) AS nij FROM p GROUP BY label, prediction),
a AS (SELECT sum(CAST(ai * (ai - 1) / 2 AS DOUBLE)) AS sa FROM (SELECT sum(nij) AS ai FROM ct GROUP BY label)),
b AS (SELECT sum(CAST(bj * (bj - 1) / 2 AS DOUBLE)) AS sb FROM (SELECT sum(nij) AS bj FROM ct GROUP BY prediction)),
s AS (SELECT sum(CAST(nij * (nij - 1) / 2 AS DOUBLE)) AS sij, sum(nij) AS n FROM ct),
e AS (SELECT sij, sa, sb, sa * sb / CAST(n * (n - 1) / 2 AS DOUBLE) AS expected, (sa + sb) / 2.0 AS mx FROM s, a, b)
SELECT CASE WHEN mx - expected = 0 THEN 1.0 ELSE (sij - expected) / (mx - expected) END AS adjusted_rand FROM e""")
def q_adjusted_rand(spark, sf_dir):
    return evaluate.adjusted_rand(predictions(spark, sf_dir))


@register("outlier_count", f"SELECT count_if(prediction = -1) AS n_outliers FROM ({PRED})")
def q_outlier_count(spark, sf_dir):
    return evaluate.outlier_count(predictions(spark, sf_dir))


# ================================================================ k-NN
K = 5
KNN_SQL = f"""WITH p AS ({fx.PARTS2D_SQL}),
d AS (SELECT a.p_partkey, b.p_partkey AS nbr_id,
             sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS dist FROM p a, p b),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, nbr_id) AS rank FROM d)
SELECT p_partkey, nbr_id, dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}"""


@register("knn", KNN_SQL)
def q_knn(spark, sf_dir):
    df, idc, feats = fx.parts2d(spark, sf_dir)
    return neighbors.knn(df, feats, K, idc)


@register("k_distance_curve", f"""WITH k AS ({KNN_SQL}),
kd AS (SELECT p_partkey, max(dist) AS k_dist FROM k GROUP BY p_partkey)
SELECT row_number() OVER (ORDER BY k_dist) - 1 AS rank, k_dist FROM kd""")
def q_k_distance_curve(spark, sf_dir):
    df, idc, feats = fx.parts2d(spark, sf_dir)
    return neighbors.k_distance_curve(df, feats, K, idc)


# ================================================================ sort / sample / set
@register("sample_points")
def q_sample_points(spark, sf_dir):
    return dataset.sample_points(fx.table(spark, sf_dir, "events").select("event_id", "value"), 0.3, 0)


def _md5_number(seed: int, *parts: str) -> str:
    """``functions.keyed_uniform`` in SQL."""
    text = ":".join(["%s"] * len(parts) + [str(seed)])
    return f"(('0x' || substr(md5(printf('{text}', {', '.join(parts)})), 1, 13))::BIGINT / {num(1 << 52)})"


@register("sample_by_hash", f"SELECT event_id, value FROM events WHERE {_md5_number(0, 'event_id::VARCHAR')} < {num(0.3)}")
def q_sample_by_hash(spark, sf_dir):
    return dataset.sample_by_hash(fx.table(spark, sf_dir, "events").select("event_id", "value"), 0.3, "event_id")


CORE_SQL = with_ctes(BF.ctes(), "SELECT event_id, x1, x2 FROM lab WHERE label = 'core'")


@register("union_core", CORE_SQL)
def q_union_core(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    return det._user(det.dense_points.unionByName(det.with_ids(det.partial_core)))


@register("union_outliers", OUTLIERS_SQL)
def q_union_outliers(spark, sf_dir):
    det = ev_detection(spark, sf_dir)
    return det._user(det.no_core_neighbor.unionByName(det.all_core_reject))


@register("diff_datasets", DIFF_SQL)
def q_diff_datasets(spark, sf_dir):
    return _diff(spark, sf_dir)


def _jitter_sql(axis: int, delta: float) -> str:
    u = _md5_number(7, "event_id::VARCHAR", "copy::VARCHAR", f"'{axis}'")
    return f"x{axis + 1} + {num(delta)} * (2.0::DOUBLE * {u} - 1.0::DOUBLE) AS x{axis + 1}"


@register("expand_dataset", f"SELECT event_id, {_jitter_sql(0, 0.5)}, {_jitter_sql(1, 0.5)}, copy FROM ({fx.EVENTS2D_SQL}) e, "
          "(SELECT unnest([1, 2, 3])::INTEGER AS copy) c")
def q_expand_dataset(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return dataset.expand_dataset(df, feats, 3, 0.5, key=idc, seed=7)


@register("order_curve", "SELECT row_number() OVER (ORDER BY value) - 1 AS rank, value FROM events")
def q_order_curve(spark, sf_dir):
    return dataset.order_curve(fx.table(spark, sf_dir, "events"), "value")


# ================================================================ composed detection
@register("core_points", CORE_SQL)
def q_core_points(spark, sf_dir):
    return ev_detection(spark, sf_dir).core_points


@register("detect_outliers", OUTLIERS_SQL)
def q_detect_outliers(spark, sf_dir):
    return ev_detection(spark, sf_dir).outliers


@register("detect_outliers_broadcast", OUTLIERS_SQL)
def q_detect_outliers_broadcast(spark, sf_dir):
    return ev_detection(spark, sf_dir, strategy="broadcast").outliers


@register("detect_outliers_grouped", OUTLIERS_SQL)
def q_detect_outliers_grouped(spark, sf_dir):
    return ev_detection(spark, sf_dir, strategy="grouped").outliers


@register("detect_outliers_salted", OUTLIERS_SQL)
def q_detect_outliers_salted(spark, sf_dir):
    # every cell above 8 points is split into hashed salt buckets
    return ev_detection(spark, sf_dir, rows_per_task=8).outliers


def _fixture_query(name, fixture, point_sql, keys, feats, eps, min_pts, out_cols):
    bf = BruteForce(point_sql, keys, feats, eps, min_pts)
    sql = with_ctes(bf.ctes(), f"SELECT {', '.join(out_cols)}, label FROM lab")

    def q(spark, sf_dir):
        df, idc, fts = fixture(spark, sf_dir)
        return label_points(df, fts, eps, min_pts, idc or keys).select(*out_cols, "label")
    register(name, sql)(q)


_fixture_query("label_points_parts2d", fx.parts2d, fx.PARTS2D_SQL, ["p_partkey"], ["x1", "x2"], 3.37, 12,
               ["p_partkey"])
_fixture_query("label_points_customers1d", fx.customers1d, fx.CUSTOMERS1D_SQL, ["c_custkey"], ["x1"], 7.7, 4,
               ["c_custkey"])
_fixture_query("label_points_orders2d", fx.orders2d, fx.ORDERS2D_SQL, ["o_orderkey"], ["x1", "x2"], 3.1, 6,
               ["o_orderkey"])
_fixture_query("label_points_lineitems3d", fx.lineitems3d, fx.LINEITEMS3D_SQL, fx.LINEITEM_KEY,
               ["x1", "x2", "x3"], 2.57, 5, fx.LINEITEM_KEY)
_fixture_query("label_points_emb3d", lambda s, d: fx.emb(s, d, 3), fx.emb_sql(3), ["vec_id"],
               ["x1", "x2", "x3"], 0.3, 5, ["vec_id"])
_fixture_query("label_points_parts2d_b", fx.parts2d, fx.PARTS2D_SQL, ["p_partkey"], ["x1", "x2"], 2.63, 8,
               ["p_partkey"])
_fixture_query("label_points_lineitems3d_b", fx.lineitems3d, fx.LINEITEMS3D_SQL, fx.LINEITEM_KEY,
               ["x1", "x2", "x3"], 2.03, 5, fx.LINEITEM_KEY)
_fixture_query("label_points_lineitems3d_c", fx.lineitems3d, fx.LINEITEMS3D_SQL, fx.LINEITEM_KEY,
               ["x1", "x2", "x3"], 3.13, 12, fx.LINEITEM_KEY)
_fixture_query("label_points_emb3d_b", lambda s, d: fx.emb(s, d, 3), fx.emb_sql(3), ["vec_id"],
               ["x1", "x2", "x3"], 0.21, 4, ["vec_id"])
_fixture_query("label_points_emb4d", lambda s, d: fx.emb(s, d, 4), fx.emb_sql(4), ["vec_id"],
               ["x1", "x2", "x3", "x4"], 0.45, 5, ["vec_id"])
_fixture_query("label_points_emb5d", lambda s, d: fx.emb(s, d, 5), fx.emb_sql(5), ["vec_id"],
               ["x1", "x2", "x3", "x4", "x5"], 0.45, 5, ["vec_id"])
_fixture_query("label_points_emb6d", lambda s, d: fx.emb(s, d, 6), fx.emb_sql(6), ["vec_id"],
               ["x1", "x2", "x3", "x4", "x5", "x6"], 0.53, 5, ["vec_id"])


@register("label_points", with_ctes(BF.ctes(), "SELECT event_id, label FROM lab"))
def q_label_points(spark, sf_dir):
    return ev_detection(spark, sf_dir).labels.select("event_id", "label")


BF_INCL = BruteForce(fx.EVENTS2D_SQL, ["event_id"], ["x1", "x2"], EPS, MIN_PTS, inclusive=True)


@register("dbscan_noise", with_ctes(BF_INCL.ctes(), "SELECT event_id, CASE WHEN label = 'outlier' THEN -1 ELSE 1 "
                                                    "END AS prediction FROM lab"))
def q_dbscan_noise(spark, sf_dir):
    det = ev_detection(spark, sf_dir, inclusive=True)
    return det.labels.select("event_id", F.when(F.col("label") == "outlier", F.lit(-1))
                             .otherwise(F.lit(1)).cast("int").alias("prediction"))


@register("predictions", PRED)
def q_predictions(spark, sf_dir):
    return predictions(spark, sf_dir)


def _sweep_sql(params: list[tuple[str, float, float, int]], repeats: int = 1, points=lambda value: fx.EVENTS2D_SQL) -> str:
    parts, ctes = [], []
    for i, (param, value, eps, mp) in enumerate(params):
        bf = BruteForce(points(value), ["event_id"], ["x1", "x2"], eps, mp, prefix=f"s{i}_")
        ctes += bf.ctes()
        parts.append(f"SELECT '{param}' AS param, {num(value)} AS value, run, {num(eps)} AS eps, {mp} AS min_pts, "
                     f"count(*) AS total_points, count_if(label = 'core') AS core_points, "
                     f"count_if(label = 'border') AS border_points, count_if(label = 'outlier') AS outliers "
                     f"FROM s{i}_lab, (SELECT unnest(range({repeats}))::INTEGER AS run) GROUP BY run")
    return with_ctes(ctes, "\nUNION ALL\n".join(parts))


@register("sweep_eps", _sweep_sql([("eps", 7.3, 7.3, 8), ("eps", 11.7, 11.7, 8), ("eps", 23.1, 23.1, 8)], repeats=2))
def q_sweep_eps(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return sweep.counts_only(sweep.sweep_eps(df, feats, [7.3, 11.7, 23.1], 8, idc, repeats=2))


@register("sweep_sample", _sweep_sql(
    [("fraction", f, EPS, MIN_PTS) for f in (0.25, 0.5, 1.0)],
    points=lambda f: f"SELECT * FROM ({fx.EVENTS2D_SQL}) e WHERE {_md5_number(0, 'event_id::VARCHAR')} < {num(f)}"))
def q_sweep_sample(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return sweep.counts_only(sweep.sweep_sample(df, feats, [0.25, 0.5, 1.0], EPS, MIN_PTS, idc))


@register("sweep_partitions", _sweep_sql([("partitions", p, EPS, MIN_PTS) for p in (1, 3, 8)]))
def q_sweep_partitions(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return sweep.counts_only(sweep.sweep_partitions(df, feats, [1, 3, 8], EPS, MIN_PTS, idc))


# ================================================================ comparison detectors
LOF_K, CONTAM = 10, 0.01
LOF_SQL = f"""WITH p AS ({fx.PARTS2D_SQL}),
d AS (SELECT a.p_partkey, b.p_partkey AS nbr_id,
             sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) AS dist
      FROM p a, p b WHERE a.p_partkey <> b.p_partkey),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY dist, nbr_id) AS rank FROM d)
       WHERE rank <= {LOF_K}),
kd AS (SELECT p_partkey, max(dist) AS kdist FROM nn GROUP BY p_partkey),
lrd AS (SELECT nn.p_partkey, 1.0 / (avg(greatest(nn.dist, kd.kdist)) + 1e-10) AS lrd
        FROM nn JOIN kd ON nn.nbr_id = kd.p_partkey GROUP BY nn.p_partkey),
sc AS (SELECT nn.p_partkey, -avg(l2.lrd / l1.lrd) AS score FROM nn JOIN lrd l1 ON nn.p_partkey = l1.p_partkey
       JOIN lrd l2 ON nn.nbr_id = l2.p_partkey GROUP BY nn.p_partkey),
t AS (SELECT quantile_cont(score, {CONTAM}) AS thr FROM sc)
SELECT p_partkey, round(score, 6) AS score, CASE WHEN score < thr THEN -1 ELSE 1 END AS prediction FROM sc, t"""


@register("lof", LOF_SQL)
def q_lof(spark, sf_dir):
    df, idc, feats = fx.parts2d(spark, sf_dir)
    r = baselines.lof(df, feats, CONTAM, LOF_K, idc)
    return r.select(idc, F.round("score", 6).alias("score"), "prediction")


MAHA_ANY_SQL = f"""WITH p AS (POINTS),
m AS (SELECT avg(x1) AS m0, avg(x2) AS m1, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b,
             covar_pop(x2, x2) AS d FROM p),
inv AS (SELECT m0, m1, d / (a * d - b * b) AS i00, -b / (a * d - b * b) AS i01, -b / (a * d - b * b) AS i10,
               a / (a * d - b * b) AS i11 FROM m),
sc AS (SELECT KEY, -((x1 - m0) * i00 * (x1 - m0) + (x1 - m0) * i01 * (x2 - m1)
              + (x2 - m1) * i10 * (x1 - m0) + (x2 - m1) * i11 * (x2 - m1)) AS score FROM p, inv),
t AS (SELECT quantile_cont(score, {CONTAM}) AS thr FROM sc)
SELECT KEY, round(score, 6) AS score, CASE WHEN score < thr THEN -1 ELSE 1 END AS prediction FROM sc, t"""


def _maha_sql(points: str, key: str) -> str:
    return MAHA_ANY_SQL.replace("POINTS", points).replace("KEY", key)


@register("mahalanobis", _maha_sql(fx.EVENTS2D_SQL, "event_id"))
def q_mahalanobis(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    r = baselines.mahalanobis(df, feats, CONTAM, idc)
    return r.select(idc, F.round("score", 6).alias("score"), "prediction")


@register("robust_mahalanobis")
def q_robust_mahalanobis(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return baselines.robust_mahalanobis(df, feats, CONTAM, idc)


@register("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    df, idc, feats = fx.events2d(spark, sf_dir)
    return baselines.isolation_forest(df, feats, CONTAM, idc)


@register("forest_sample", "SELECT tree, least(256, (SELECT count(*) FROM events)) AS n_rows, "
          "least(256, (SELECT count(*) FROM events)) AS n_points FROM (SELECT unnest(range(100)) AS tree)")
def q_forest_sample(spark, sf_dir):
    """The rows each tree of the forest grows from: how many, and how many different ones."""
    df, idc, feats = fx.events2d(spark, sf_dir)
    pts = number_points(df, feats, [idc])[0]
    s = baselines.forest_sample(pts, pts.count(), 100, 256, 100)
    return s.groupBy("tree").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id0").alias("n_points"))


# ---------------------------------------------------------------- detectors side by side
_NOISE = "p_type = 'PROMO'"  # stand-in for a ground truth
_PARTS_BF = [BruteForce(fx.PARTS2D_SQL, ["p_partkey"], ["x1", "x2"], 3.37, 12, inclusive=i, prefix=f"{p}_")
             for p, i in (("g", False), ("d", True))]
_COMPARED = ("grid", "dbscan", "lof", "mahalanobis")


@register("compare_detectors", with_ctes(_PARTS_BF[0].ctes() + _PARTS_BF[1].ctes() + [
    f"truth AS (SELECT p_partkey, CASE WHEN {_NOISE} THEN -1 ELSE 1 END AS label FROM part)",
    "found AS (SELECT 'grid' AS alg, p_partkey, CASE WHEN label = 'outlier' THEN -1 ELSE 1 END AS prediction FROM g_lab "
    "UNION ALL SELECT 'dbscan', p_partkey, CASE WHEN label = 'outlier' THEN -1 ELSE 1 END FROM d_lab "
    f"UNION ALL SELECT 'lof', p_partkey, prediction FROM ({LOF_SQL}) "
    f"UNION ALL SELECT 'mahalanobis', p_partkey, prediction FROM ({_maha_sql(fx.PARTS2D_SQL, 'p_partkey')}))",
    "pr AS (SELECT alg, label, prediction FROM found JOIN truth USING (p_partkey))",
    "ct AS (SELECT alg, label, prediction, count(*)::DOUBLE AS nij FROM pr GROUP BY ALL)",
    "pc AS (SELECT alg, sum(nij * (nij - 1) / 2) AS sij, sum(nij) * (sum(nij) - 1) / 2 AS total FROM ct GROUP BY alg)",
    "pa AS (SELECT alg, sum(ai * (ai - 1) / 2) AS sa FROM (SELECT alg, sum(nij) AS ai FROM ct GROUP BY alg, label) GROUP BY alg)",
    "pb AS (SELECT alg, sum(bj * (bj - 1) / 2) AS sb FROM (SELECT alg, sum(nij) AS bj FROM ct GROUP BY alg, prediction) GROUP BY alg)",
    "ri AS (SELECT alg, sij, sa * sb / total AS expected, (sa + sb) / 2 AS mx FROM pc JOIN pa USING (alg) JOIN pb USING (alg))",
    "cf AS (SELECT alg, count_if(label = 1 AND prediction = 1) AS data_found, "
    "count_if(label = 1 AND prediction = -1) AS data_not_found, count_if(label = -1 AND prediction = -1) AS outliers_found, "
    "count_if(label = -1 AND prediction = 1) AS outliers_not_found FROM pr GROUP BY alg)"],
    "SELECT alg, data_found, data_not_found, outliers_found, outliers_not_found, outliers_found + data_not_found AS n_outliers, "
    "CASE WHEN 2 * outliers_found + data_not_found + outliers_not_found = 0 THEN 0.0 ELSE round(CAST(2 * outliers_found AS DOUBLE) "
    "/ (2 * outliers_found + data_not_found + outliers_not_found), 9) END AS f1, "
    "CASE WHEN mx = expected THEN 1.0 ELSE round((sij - expected) / (mx - expected), 9) END AS adjusted_rand "
    "FROM cf JOIN ri USING (alg)"))
def q_compare_detectors(spark, sf_dir):
    """The detector, DBSCAN's noise, LOF and Mahalanobis distances on the same parts."""
    df, idc, feats = fx.parts2d(spark, sf_dir)
    truth = fx.table(spark, sf_dir, "part").select(idc, F.when(F.expr(_NOISE), -1).otherwise(1).alias("label"))
    t = compare.compare(df.join(truth, idc), feats, "label", 3.37, 12, CONTAM, LOF_K, _COMPARED)
    return t.withColumns({c: F.round(c, 9) for c in ("f1", "adjusted_rand")})
