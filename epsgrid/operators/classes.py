"""At which of several eps values a point is core or has a core point near, in one pass.

A sweep does not ask for the distances of a point, only which of its eps values they are below.
The values are taken in rising order, and a point that is core at one is core at all larger ones:

1. Cells of the least eps with at least ``min_pts`` points hold core points only.  What is
   left, the open points, is the thin part of the data; equal ones are one row from here on.
2. At each eps, open points in cells that are dense at that eps are core.  The others
   meet the points of neighbouring cells: a sum of weights tells the core points.
3. Those still open and not reached before meet the points near them that are core at this
   eps, which is every point that is not open any more.
4. The points still open go on to the next eps.

Everything follows from coordinates (equal points share a class), so no generated id has to
survive a task that runs again.  Points meet at an open point only: fewer than ``min_pts`` to a
cell, with a bounded number of neighbour cells.  Cells are a little smaller than their
diagonal allows and neighbours a little wider, so rounding at cell edges moves no pair.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_offsets, within
from ..session import checkpoint_dir
from .grid import (DEFAULT_MAX_OFFSETS, assign_cells, ccols, cell_counts, explode_salts, fcols, neighbor_cells,
                   with_buckets)
from .reach import reached

SHRINK = 1 - 2.0 ** -10        # diagonal of a cell in eps
WIDER = 1 + 2.0 ** -10         # reach of a point in eps when whole cells are left out
MAX_INDEX = 2.0 ** 36          # largest coordinate in eps at which rounding is less than what SHRINK leaves
ROWS_PER_TASK = 1 << 20        # most points of a cell that meet others under one key
MAX_BROADCAST_CELLS = 500_000  # cells that are broadcast to the points (some 100 bytes each)
NEVER = float("inf")


def _of_cells(df: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` in one of ``cells`` (kept, each once), with the columns of ``cells``."""
    few = cells.count() <= MAX_BROADCAST_CELLS
    return df.join(F.broadcast(cells) if few else cells.hint("merge"), on)


def eps_classes(pts: DataFrame, dim: int, eps_values: list[float], min_pts: int, inclusive: bool = False) -> DataFrame:
    """``(f0.., core_at, reach_at)``, a row for each coordinate that is not core at the least of
    ``eps_values`` by its cell alone; the points ``(f0..)`` that are in no row are.  ``core_at`` is the least
    value at which the point is core, ``reach_at`` the least at which it or a point near it is;
    infinite if there is none."""
    checkpoint_dir(pts.sparkSession)
    F_, values = fcols(dim), sorted(set(map(float, eps_values)))
    todo, done = None, []
    for eps in values:
        kept: list[DataFrame] = []
        try:
            todo, core = _step(pts, todo, dim, eps, min_pts, inclusive, kept)
        finally:  # what goes on is checkpointed
            for df in kept:
                df.unpersist()
        done.append(core.select(*F_, F.lit(eps).alias("core_at"), F.least("reach_at", F.lit(eps)).alias("reach_at")))
        if todo.isEmpty():
            break
    done.append(todo.select(*F_, F.lit(NEVER).alias("core_at"), "reach_at"))
    return reduce(DataFrame.unionByName, done)


def _step(pts: DataFrame, todo: DataFrame | None, dim: int, eps: float, min_pts: int, inclusive: bool,
          kept: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(still open, core)``, both ``(f0.., reach_at)``, of the open points ``todo`` (None: all
    points, of which those in dense cells are left out) at ``eps``.  Frames to release go to ``kept``."""
    F_, C = fcols(dim), ccols(dim)

    def keep(df):
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]

    g = assign_cells(pts.select(*F_), eps * SHRINK, dim)
    cells = keep(cell_counts(g, dim))
    if todo is None:
        sparse = cells.filter(F.col("n") < F.lit(min_pts)).select(*C)
        asked = _of_cells(g, sparse, C).select(*F_, *C).distinct().withColumn("reach_at", F.lit(NEVER)).checkpoint()
        core = asked.limit(0)
    else:
        placed = assign_cells(todo, eps * SHRINK, dim).join(cells, C).checkpoint()
        asked, core = placed.filter(F.col("n") < F.lit(min_pts)).drop("n"), placed.filter(F.col("n") >= F.lit(min_pts))
    if asked.isEmpty():
        return asked.select(*F_, "reach_at"), core.select(*F_, "reach_at")
    if count_offsets(dim, inclusive=True) > DEFAULT_MAX_OFFSETS:
        asked = asked.withColumn("pid", F.monotonically_increasing_id()).checkpoint()
        by_pid = lambda df, pids: asked.join(pids, "pid", "left_semi").select(*F_)
        hit = by_pid(asked, reached(asked, pts, dim, eps, min_pts, inclusive))
        near = lambda q, rest: by_pid(asked, reached(
            q.join(asked.select(*F_, "pid"), F_), pts.join(rest.select(*F_), F_, "left_anti"), dim, eps, 1, inclusive))
    else:
        adj = keep(_adjacency(asked, cells, dim))
        targets = keep(_targets(g, keep(adj.groupBy(*ccols(dim, "n")).agg(F.first("nb_nb").alias("nb"))), dim))
        hit = (_pairs(targets, asked, adj.filter(F.col("ub") >= F.lit(min_pts)), dim, eps, inclusive)
               .filter(F.col("hits") >= F.lit(min_pts)).select(*F_))
        near = lambda q, rest: _touched(targets.join(rest.select(*F_), F_, "left_anti"), q, adj, dim, eps, inclusive)
    tested = (asked.select(*F_, *C, "reach_at").join(hit.withColumn("_core", F.lit(True)), F_, "left")
              .withColumn("_core", F.coalesce("_core", F.lit(False))).checkpoint())
    rest = tested.filter(~F.col("_core"))
    touched = near(rest.filter(F.col("reach_at") == F.lit(NEVER)).select(*F_, *C), rest).withColumn("_near", F.lit(True))
    still = rest.join(touched, F_, "left").select(*F_, F.when(F.col("_near"), F.lit(eps)).otherwise(
        F.col("reach_at")).alias("reach_at")).checkpoint()
    return still, core.select(*F_, "reach_at").unionByName(tested.filter("_core").select(*F_, "reach_at"))


def _adjacency(asked: DataFrame, cells: DataFrame, dim: int) -> DataFrame:
    """(c0.., n0.., nb_nb, ub): the occupied neighbours of the cells of ``asked``, the number of their salt
    buckets and the points of the whole neighbourhood."""
    C = ccols(dim)
    dst = with_buckets(cells, ROWS_PER_TASK).select(*C, F.col("n").alias("n_nb"), F.col("nb").alias("nb_nb"))
    adj = neighbor_cells(asked.select(*C).distinct(), dst, dim, True, ("n_nb", "nb_nb"))
    return adj.withColumn("ub", F.sum("n_nb").over(Window.partitionBy(*C))).drop("n_nb")


def _targets(g: DataFrame, near: DataFrame, dim: int) -> DataFrame:
    """(f0.., n0.., salt, w): the points of the cells ``near`` (n0.., nb), equal ones as a weight."""
    F_, C, N = fcols(dim), ccols(dim), ccols(dim, "n")
    at = g.select(*F_, *[F.col(c).alias(n) for c, n in zip(C, N)])
    return (_of_cells(at, near, N).groupBy(*F_, *N, "nb").agg(F.count(F.lit(1)).alias("w"))
            .withColumn("salt", F.pmod(F.xxhash64(*F_), F.col("nb")).cast("int")).drop("nb"))


def _spread(asked: DataFrame, adj: DataFrame, dim: int, eps: float) -> DataFrame:
    """(q_f0.., n0.., salt): the points ``asked``, a row for each bucket of a neighbour cell within their reach."""
    F_, C, N = fcols(dim), ccols(dim), ccols(dim, "n")
    side = F.lit(eps * SHRINK / math.sqrt(dim))
    gap = [F.greatest(F.col(n) * side - F.col(f"q_{f}"), F.col(f"q_{f}") - (F.col(n) + 1) * side, F.lit(0.0)) for f, n in zip(F_, N)]
    q = (asked.select(*[F.col(f).alias(f"q_{f}") for f in F_], *C).join(adj.select(*C, *N, "nb_nb"), C).drop(*C)
         .filter(reduce(lambda a, b: a + b, [x * x for x in gap]) <= F.lit((eps * WIDER) ** 2)))
    # the hint: Spark's estimate leaves out what the rows are multiplied by, and they would be broadcast
    return explode_salts(q, "nb_nb").drop("nb_nb").hint("merge")


def _pairs(targets: DataFrame, asked: DataFrame, adj: DataFrame, dim: int, eps: float, inclusive: bool) -> DataFrame:
    """(f0.., hits): how many points are near each point of ``asked`` that has one."""
    F_, N = fcols(dim), ccols(dim, "n")
    Q = [f"q_{f}" for f in F_]
    return (targets.join(_spread(asked, adj, dim, eps), [*N, "salt"]).filter(within(Q, F_, eps, inclusive))
            .groupBy(*Q).agg(F.sum("w").alias("hits")).select(*[F.col(q).alias(f) for q, f in zip(Q, F_)], "hits"))


def _touched(targets: DataFrame, asked: DataFrame, adj: DataFrame, dim: int, eps: float, inclusive: bool) -> DataFrame:
    """(f0..) of the points of ``asked`` with one of ``targets`` near."""
    F_, N = fcols(dim), ccols(dim, "n")
    Q, T = [f"q_{f}" for f in F_], [f"t_{c}" for c in (*F_, *N, "salt")]
    q, t = _spread(asked, adj, dim, eps), targets.drop("w").select(*[F.col(c).alias(f"t_{c}") for c in (*F_, *N, "salt")])
    same = [F.col(c) == F.col(f"t_{c}") for c in (*N, "salt")]
    near = reduce(lambda a, b: a & b, same) & within(Q, T[:dim], eps, inclusive)
    return q.join(t, near, "left_semi").select(*[F.col(c).alias(f) for c, f in zip(Q, F_)]).distinct()
