"""Parameter sweeps: detection for several eps values, sample fractions or
partition counts.  All eps values come from one pass over the points; for samples and
partition counts the loop runs over parameters (a handful), never over data, and each
run is a full distributed detection whose counts come back as one row.  Result rows
carry the counts and the wall time of the run.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classes import MAX_INDEX, eps_classes
from ..operators.dataset import sample_by_hash, sample_points
from ..operators.detect import detect
from ..operators.grid import fcols, number_points
from ..operators.neighbors import caller_ids, knn_points, ordered_points

SWEEP_SCHEMA = ("param STRING, value DOUBLE, run INT, eps DOUBLE, min_pts INT, total_points BIGINT, "
                "core_points BIGINT, border_points BIGINT, outliers BIGINT, seconds DOUBLE")

MAX_BROADCAST_CLASSES = 500_000  # coordinates with a class of their own that are broadcast to the points


def _one(df, features, eps, min_pts, id_col, param, value, run, **kw):
    t = time.time()
    det = detect(df, features, eps, min_pts, id_col, **kw)
    n_core = det.core_points_internal.count()
    n_out = det.outliers_internal.count()
    total = det.n_points
    secs = time.time() - t
    det.release()
    return (param, float(value), run, float(eps), int(min_pts), total, n_core,
            total - n_core - n_out, n_out, secs)


def eps_profile(df: DataFrame, features: list[str], min_pts: int, id_col: str | None = None,
                eps_values: list[float] | None = None, inclusive: bool = False) -> DataFrame:
    """``(id, core_at, reach_at)`` of every point, from which its label follows for every eps: core
    if ``core_at < eps``, else border if ``reach_at < eps``, else outlier (``<=`` for the
    inclusive definition).

    ``core_at`` is the distance of the ``min_pts``-th nearest point, the point itself
    included.  ``reach_at`` is the least ``max(distance, core_at of the other)``.  For an eps at
    which the point is not core, fewer than ``min_pts`` points are near it, so the points that
    decide are all among its ``min_pts`` nearest: one k-NN table serves every eps.
    Infinite where there are too few points.

    With ``eps_values``, both are the least of these at which the point is core, or has a core point
    near (``core_at <= eps`` then, whatever the definition), which takes no k-NN table
    (:mod:`..operators.classes`).
    """
    if eps_values:
        return _class_profile(df, features, min_pts, id_col, sorted(set(map(float, eps_values))), inclusive)
    pts, ids = ordered_points(df, features, id_col)
    nn = knn_points(pts, len(features), min_pts, include_self=True)
    never = F.lit(float("inf"))
    core = nn.groupBy("pid").agg(F.coalesce(F.max(F.when(F.col("rank") == min_pts, F.col("dist"))), never)
                                 .alias("core_at")).checkpoint()
    other = core.select(F.col("pid").alias("nbr_id"), F.col("core_at").alias("_other"))
    reach = (nn.join(other, "nbr_id").groupBy("pid")
             .agg(F.min(F.greatest("dist", "_other")).alias("reach_at")))
    return caller_ids(core.join(reach, "pid"), ids, pid=id_col or "point_id")


def _class_profile(df: DataFrame, features: list[str], min_pts: int, id_col: str | None, eps_values: list[float],
                   inclusive: bool) -> DataFrame:
    if min_pts < 1:
        raise ValueError("min_pts must be >= 1")
    F_, name = fcols(len(features)), id_col or "point_id"
    pts, _ = number_points(df, features, [id_col] if id_col else [])
    xs = pts.select(*F_).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        far = max((v or 0.0 for v in xs.agg(*[F.max(F.abs(f)) for f in F_]).first()))
        if not 0 < eps_values[0] <= eps_values[-1] < float("inf") or far > MAX_INDEX * eps_values[0]:
            # values that make no cells
            least = lambda c: F.coalesce(*[F.when(F.col(c) <= F.lit(e) if inclusive else F.col(c) < F.lit(e), F.lit(e))
                                           for e in eps_values], F.lit(float("inf"))).alias(c)
            return eps_profile(df, features, min_pts, id_col).select(name, least("core_at"), least("reach_at"))
        classes = eps_classes(xs, len(features), eps_values, min_pts, inclusive)
    finally:  # the classes are checkpointed
        xs.unpersist()
    few = classes.count() <= MAX_BROADCAST_CLASSES
    at = lambda c: F.coalesce(c, F.lit(eps_values[0])).alias(c)
    return (pts.join(F.broadcast(classes) if few else classes.hint("merge"), F_, "left")
            .select(F.col("id0" if id_col else "pid").alias(name), at("core_at"), at("reach_at")))


def sweep_eps(df: DataFrame, features: list[str], eps_values: list[float], min_pts: int,
              id_col: str | None = None, repeats: int = 1, inclusive: bool = False) -> DataFrame:
    """Counts of every eps from one pass (:func:`eps_profile`) per repeat, a row for each eps and
    repeat; ``seconds`` is the time of the whole pass, shared by its rows."""
    rows = []
    for run in range(repeats if eps_values else 0):
        t = time.time()
        p = eps_profile(df, features, min_pts, id_col, eps_values, inclusive)
        hit = lambda c, e: F.col(c) <= F.lit(float(e))
        got = p.agg(F.count(F.lit(1)), *[F.count_if(x) for e in eps_values for x in
                                         (hit("core_at", e), ~hit("core_at", e) & hit("reach_at", e))]).first()
        secs = time.time() - t
        for i, e in enumerate(eps_values):
            core, border = got[1 + 2 * i], got[2 + 2 * i]
            rows.append(("eps", float(e), run, float(e), int(min_pts), got[0], core, border, got[0] - core - border, secs))
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def sweep_sample(df: DataFrame, features: list[str], fractions: list[float], eps: float,
                 min_pts: int, id_col: str | None = None, repeats: int = 1, seed: int = 0,
                 by_hash: bool = True, **kw) -> DataFrame:
    """Detection on growing samples; with ``by_hash`` the samples are nested."""
    rows = []
    for fr in fractions:
        s = sample_by_hash(df, fr, id_col, seed) if (by_hash and id_col) else sample_points(df, fr, seed)
        rows += [_one(s, features, eps, min_pts, id_col, "fraction", fr, r, **kw) for r in range(repeats)]
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def sweep_partitions(df: DataFrame, features: list[str], partitions: list[int], eps: float,
                     min_pts: int, id_col: str | None = None, repeats: int = 1, **kw) -> DataFrame:
    """Detection with the input and the working set split into ``n`` partitions;
    the counts must not depend on ``n``."""
    rows = []
    for p in partitions:
        src = df.repartition(p) if p else df
        rows += [_one(src, features, eps, min_pts, id_col, "partitions", p, r, num_partitions=p or None, **kw)
                 for r in range(repeats)]
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def counts_only(sweep: DataFrame) -> DataFrame:
    """Without the timing column (for comparisons); repeats stay rows of their own."""
    return sweep.drop("seconds")
