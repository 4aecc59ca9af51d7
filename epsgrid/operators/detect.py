"""Exact density-based (DBSCAN-coherent) outlier detection on DataFrames.

Definitions (distance = Euclidean, ``near`` = distance < eps, or <= eps when
``inclusive``):

* core: at least ``min_pts`` points are near it, itself included;
* outlier: not core and no core point is near it;
* border: neither.

Plan (every step is a DataFrame join / aggregation; nothing is collected):

1. Each point gets a grid cell of side ``eps/sqrt(dim)`` (diagonal eps).
2. ``cells``: points per cell.  A cell with ``>= min_pts`` points is DENSE and
   all its points are core without any distance test.
3. Hot cells (more than ``rows_per_task`` points) are split into ``nb`` salt
   buckets by a hash of the point id.  Their number is bounded by
   ``total / rows_per_task`` and kept under the broadcast limit, so the salt is
   assigned by a broadcast join.  The points are then hash-partitioned once by
   ``(cell, salt)`` and persisted; every later join that reads all points uses
   exactly those keys and reuses this partitioning instead of shuffling the
   points again.
4. Partial core test: points of non-dense cells are replicated to their
   occupied neighbour cells (offsets are per cell, the small side), joined with
   the points of those cells on ``(cell, salt)``, filtered by distance and
   counted per point.  Cells whose whole neighbourhood holds fewer than
   ``min_pts`` points are pruned before the join (upper bound).
5. A cell holding a core point is a core cell and has no outliers.  Points of
   the remaining cells are tested against the core points of neighbouring
   core cells: if any is near, the point is border, otherwise an outlier
   (anti join; cells without core neighbours need no distance test).

Where a cell has more than ``max_offsets`` candidate neighbours (five dimensions and more), the
occupied neighbour pairs grow with the square of the points, so both tests run without them
(:mod:`.reach`), whatever the strategy: points meet growing rounds of candidates until enough are near.

Strategies for the two distance joins (same results):

* ``shuffle``: hash joins on ``(cell, salt)``;
* ``broadcast``: the replicated query side is broadcast after its exact row count is checked
  against ``max_broadcast_rows`` and its size against ``max_broadcast_bytes``; above either the
  shuffle join is used.  The adjacency the count comes from is kept for the join;
* ``grouped``: the points of a (cell, salt) bucket are grouped into one array
  (at most about ``rows_per_task`` entries, thanks to the salt) and the tests
  run as higher-order functions: ``exists`` in the border test, which ends at the
  first hit, and in the core test a count in runs of ``COUNT_RUN`` points that
  stops testing distances once ``min_pts`` are found;
* ``auto``: broadcast when the check passes, else shuffle.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import count_offsets, euclid_distance, within
from ..session import checkpoint_dir
from .grid import (DEFAULT_MAX_OFFSETS, assign_cells, ccols, cell_counts, cell_types,
                   explode_salts, fcols, neighbor_cells, number_points, salted_points,
                   validate_params, with_buckets)
from .reach import reached

log = logging.getLogger(__name__)

COUNT_RUN = 64  # points of a bucket that the grouped core test looks at before it asks if they suffice
STRATEGIES = ("shuffle", "broadcast", "grouped", "auto")
DEFAULT_ROWS_PER_TASK = 1 << 20
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20
ROW_OVERHEAD = 40  # bytes of a broadcast row beside its fields: null bits, lengths, hash table entry
ROWS_PER_PARTITION = 4_000_000  # most points per partition of the persisted, salted point set
MIN_ROWS_PER_PARTITION = 50_000  # below this, more partitions than cores only add overhead


@dataclass
class DetectConfig:
    eps: float
    min_pts: int
    dim: int
    inclusive: bool = False
    strategy: str = "shuffle"
    num_partitions: int | None = None
    rows_per_task: int = DEFAULT_ROWS_PER_TASK
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS
    max_offsets: int = DEFAULT_MAX_OFFSETS
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES
    storage: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)


class Detection:
    """Lazily built results of one detection run.

    The salted, hash-partitioned points are persisted and materialized (their
    partitioning is reused by every later join); the cell table, the partial
    core points, the typed cells and the border-test query side are small and
    materialized once (``materialize``: persist or checkpoint).
    ``release()`` unpersists, as does leaving a ``with`` block.

    Points are told apart by a generated ``pid``; ``id_col`` (a column or several, of any
    type, NULL and repeated values included) is carried through to the results.  Without
    it the results have the generated id as ``point_id``.
    """

    def __init__(self, df: DataFrame, features: list[str], eps: float, min_pts: int,
                 id_col: str | list[str] | None = None, strategy: str = "shuffle", inclusive: bool = False,
                 num_partitions: int | None = None, rows_per_task: int | None = None,
                 max_broadcast_rows: int | None = None, max_offsets: int | None = None,
                 materialize: str = "persist", max_broadcast_bytes: int | None = None):
        features = list(features)
        if materialize not in ("persist", "checkpoint"):
            raise ValueError("materialize must be 'persist' or 'checkpoint'")
        self.materialize = materialize
        dim = len(features)
        validate_params(eps, min_pts, dim)
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
        spark = df.sparkSession
        self.spark = spark
        self.features = features
        self.ids = [id_col] if isinstance(id_col, str) else list(id_col or [])
        self.I = [f"id{i}" for i in range(len(self.ids))]
        self.cfg = DetectConfig(
            eps=float(eps), min_pts=int(min_pts), dim=dim, inclusive=bool(inclusive),
            strategy=strategy,
            num_partitions=num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")),
            rows_per_task=int(rows_per_task or DEFAULT_ROWS_PER_TASK),
            max_broadcast_rows=int(max_broadcast_rows or DEFAULT_MAX_BROADCAST_ROWS),
            max_offsets=int(max_offsets or DEFAULT_MAX_OFFSETS),
            max_broadcast_bytes=int(max_broadcast_bytes or DEFAULT_MAX_BROADCAST_BYTES))
        cfg = self.cfg
        self.C, self.N, self.F = ccols(dim), ccols(dim, "n"), fcols(dim)
        self._persisted: list[DataFrame] = []

        pts, bad = number_points(df, features, self.ids)
        self.quarantine = self._user(bad)
        g = assign_cells(pts, cfg.eps, dim)

        # cell table (small relative to the points; persisted, never collected)
        if self.materialize == "checkpoint":
            cells = self._materialize(cell_counts(g, dim))
        else:
            cells = self._persist(cell_counts(g, dim))  # filled by the totals job below
        base_rows = max(cfg.rows_per_task, cfg.min_pts)
        tot = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k"),
                        F.count_if(F.col("n") > F.lit(base_rows)).alias("hot")).first()
        self.n_points, self.n_cells = int(tot["n"]), int(tot["k"])
        # rows_per_task grows with the data so that the hot-cell list
        # (at most n_points / rows_per_task rows) always fits a broadcast
        self.rows_per_task = max(base_rows, math.ceil(self.n_points / max(cfg.max_broadcast_rows, 1)))
        if num_partitions is None:
            # the partition count follows the data: enough that none holds more than
            # ROWS_PER_PARTITION points, no more than useful for small inputs
            par = spark.sparkContext.defaultParallelism
            small = min(cfg.num_partitions, max(par, math.ceil(self.n_points / MIN_ROWS_PER_PARTITION)))
            cfg.num_partitions = max(math.ceil(self.n_points / ROWS_PER_PARTITION), small, 1)
        self.cells = with_buckets(cells, self.rows_per_task)
        hot = self.cells.filter(F.col("nb") > 1).select(*self.C, "nb")
        self.n_hot = int(tot["hot"]) if self.rows_per_task == base_rows else hot.count()

        gs = salted_points(g, hot if self.n_hot else None, dim)
        gs = gs.select("pid", *self.F, *self.I, *self.C, "salt").repartition(cfg.num_partitions, *self.C, "salt")
        self.points = self._persist(gs)
        # materialize now: only a materialized cache reports its hash partitioning
        # to later plans (otherwise the first join would shuffle the points again)
        self.points.count()
        self._cache: dict = {}

    # ------------------------------------------------------------------ helpers
    def _persist(self, df: DataFrame) -> DataFrame:
        df = df.persist(self.cfg.storage)
        self._persisted.append(df)
        return df

    def _materialize(self, df: DataFrame) -> DataFrame:
        """Compute a small cell-level result once.

        ``persist`` (default): cached and materialized; later plans see a
        materialized cache (exact sizes, cheap planning).  Executor loss
        recomputes lost blocks from the fixed-depth lineage.
        ``checkpoint``: written to the shared checkpoint folder; no
        recomputation after executor loss, at the price of a write and of
        size statistics (joins against it are planned as shuffles).
        """
        if self.materialize == "checkpoint":
            checkpoint_dir(self.spark)
            return df.checkpoint(eager=True)
        df = self._persist(df)
        df.count()
        return df

    def release(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted = []

    def __enter__(self) -> Detection:
        return self

    def __exit__(self, *exc) -> None:
        self.release()

    def once(self, df: DataFrame) -> DataFrame:
        """Write a result to the shared checkpoint folder and release everything else."""
        with self:
            checkpoint_dir(self.spark)
            return df.checkpoint(eager=True)

    def with_ids(self, df: DataFrame, pid: str = "pid", names: list[str] | None = None) -> DataFrame:
        """Add the caller's id columns (as ``names``, default ``id0..``) of the points in ``pid``."""
        ids = self.points.select(F.col("pid").alias(pid),
                                 *[F.col(i).alias(n) for i, n in zip(self.I, names or self.I)])
        return df.join(ids, pid)

    @property
    def n_quarantined(self) -> int:
        """Rows with a NULL, NaN or infinite coordinate; they are in no label and no other count."""
        if "quarantined" not in self._cache:
            self._cache["quarantined"] = self.quarantine.count()
        return self._cache["quarantined"]

    def _within(self, a: list, b: list):
        return within(a, b, self.cfg.eps, self.cfg.inclusive)

    def _right(self) -> DataFrame:
        """All points as the candidate side: cell renamed to the neighbour key."""
        return self.points.select(
            F.col("pid").alias("p_pid"), *[F.col(f).alias(f"p_{f}") for f in self.F],
            *[F.col(c).alias(n) for c, n in zip(self.C, self.N)], "salt")

    def _cells_salted(self, cells: DataFrame) -> DataFrame:
        """Cells keyed like the points: one row per salt bucket ``0..nb-1``.

        The salt comes from the data (``nb``), never a literal: a literal 0
        would be folded into a filter and drop ``salt`` from the join key,
        and the persisted points would be shuffled again.
        """
        if "nb" not in cells.columns:
            cells = cells.select(*self.C).join(self.cells.select(*self.C, "nb"), self.C)
        return explode_salts(cells.select(*self.C, "nb"), "nb").drop("nb")

    def _choose_broadcast(self, adj: DataFrame, what: str) -> bool:
        """Broadcast the replicated query side only if its exact row count
        (from the cell tables: points of the source cell x salt buckets of the
        neighbour, summed over adjacency rows) and its bytes are within the limits."""
        if not self._may_broadcast:
            return False
        rows = adj.agg(F.coalesce(F.sum(F.col("n_src") * F.col("nb_nb")), F.lit(0))).first()[0]
        size = rows * self.broadcast_row_bytes
        ok = rows <= self.cfg.max_broadcast_rows and size <= self.cfg.max_broadcast_bytes
        if not ok:
            log.warning("%s side has %d rows, %d bytes (limits %d, %d): using the shuffle join", what, rows, size,
                        self.cfg.max_broadcast_rows, self.cfg.max_broadcast_bytes)
        return ok

    @property
    def _may_broadcast(self) -> bool:
        return self.cfg.strategy in ("broadcast", "auto")

    @property
    def broadcast_row_bytes(self) -> int:
        """Size of a row of the query side: the id, features, two cells and a salt, eight bytes each."""
        return 8 * (2 + 3 * self.cfg.dim) + ROW_OVERHEAD

    def _kept(self, adj: DataFrame) -> DataFrame:
        """Adjacency rows, written down once where the size check and the join both read them."""
        return self._materialize(adj) if self._may_broadcast else adj

    @property
    def by_rounds(self) -> bool:
        """Whether cells have too many candidate neighbours for a list of them."""
        return count_offsets(self.cfg.dim, inclusive=self.cfg.inclusive) > self.cfg.max_offsets

    def _reached(self, queries: DataFrame, targets: DataFrame, needed: int) -> DataFrame:
        checkpoint_dir(self.spark)
        return reached(queries, targets, self.cfg.dim, self.cfg.eps, needed, self.cfg.inclusive)

    # ------------------------------------------------------------------ cells
    @property
    def dense_cells(self) -> DataFrame:
        return self.cells.filter(F.col("n") >= F.lit(self.cfg.min_pts))

    @property
    def nondense_cells(self) -> DataFrame:
        return self.cells.filter(F.col("n") < F.lit(self.cfg.min_pts))

    def _adjacent(self, src: DataFrame, dst: DataFrame, dst_cols: tuple, src_cols: tuple = ()) -> DataFrame:
        """Neighbour pairs of ``src`` and ``dst`` cells.  Where these come from the hierarchy of cells
        (high dimensions), all pairs are found once, kept, and joined with either side."""
        if not self.by_rounds:
            return neighbor_cells(src, dst, self.cfg.dim, self.cfg.inclusive, dst_cols, self.cfg.max_offsets,
                                  src_cols=src_cols)
        if "adjacency" not in self._cache:
            cells = self.cells.select(*self.C)
            self._cache["adjacency"] = self._materialize(neighbor_cells(
                cells, cells, self.cfg.dim, self.cfg.inclusive, max_offsets=self.cfg.max_offsets))
        right = dst.select(*[F.col(c).alias(n) for c, n in zip(self.C, self.N)], *dst_cols)
        return (self._cache["adjacency"].join(src.select(*self.C, *src_cols), self.C).join(right, self.N)
                .select(*self.C, *src_cols, *self.N, *dst_cols))

    def nonempty_neighbors(self, src: DataFrame | None = None) -> DataFrame:
        """(cell, occupied neighbour cell, its n, its nb) for ``src`` cells (default all)."""
        src = self.cells if src is None else src
        dst = self.cells.select(*self.C, F.col("n").alias("n_nb"), F.col("nb").alias("nb_nb"))
        return self._adjacent(src, dst, ("n_nb", "nb_nb"))

    # ------------------------------------------------------------- partial core
    def candidate_cells(self) -> DataFrame:
        """Adjacency of non-dense cells whose neighbourhood can reach min_pts.

        The upper bound (points in the whole neighbourhood) is a window sum
        partitioned by the source cell, so the join of the query points on
        that cell reuses the same shuffle.
        """
        if "cand" not in self._cache:
            src = self.nondense_cells.select(*self.C, F.col("nb").alias("nb_src"), F.col("n").alias("n_src"))
            dst = self.cells.select(*self.C, F.col("n").alias("n_nb"), F.col("nb").alias("nb_nb"))
            adj = self._adjacent(src, dst, ("n_nb", "nb_nb"), src_cols=("nb_src", "n_src"))
            # the source's salt (a non-dense cell has one bucket) joins the window
            # key, so the window's shuffle already matches the points' (cell, salt)
            adj = explode_salts(adj, "nb_src")
            ub = F.sum("n_nb").over(Window.partitionBy(*self.C, "salt"))
            self._cache["cand"] = self._kept(adj.withColumn("ub", ub).filter(
                F.col("ub") >= F.lit(self.cfg.min_pts)).drop("ub"))
        return self._cache["cand"]

    def query_adjacency(self, prune: bool = True) -> DataFrame:
        if prune:
            return self.candidate_cells()
        if "all" not in self._cache:
            src = self.nondense_cells.select(*self.C, F.col("nb").alias("nb_src"), F.col("n").alias("n_src"))
            dst = self.cells.select(*self.C, F.col("n").alias("n_nb"), F.col("nb").alias("nb_nb"))
            self._cache["all"] = self._kept(self._adjacent(src, dst, ("n_nb", "nb_nb"), src_cols=("nb_src", "n_src")))
        return self._cache["all"]

    def query_pairs(self, prune: bool = True) -> DataFrame:
        """Query points of non-dense cells, one row per neighbour salt bucket.

        With ``prune`` only cells whose neighbourhood can reach ``min_pts``
        are queried (the detector's plan); without it every non-dense cell.
        """
        adj = self.query_adjacency(prune)
        # non-dense cells are never hot: their one salt bucket comes from nb_src
        # (0), and the join runs on the points' own (cell, salt) partitioning
        if "salt" not in adj.columns:
            adj = explode_salts(adj, "nb_src")
        a = adj.select(*self.C, "salt", *self.N, "nb_nb")
        qx = self.points.join(a, [*self.C, "salt"]).select(
            F.col("pid").alias("q_pid"), *[F.col(f).alias(f"q_{f}") for f in self.F], *self.C,
            *self.N, "nb_nb")
        return explode_salts(qx, "nb_nb").drop("nb_nb")

    def eps_pairs(self, prune: bool = False) -> DataFrame:
        """(q_pid, p_pid, dist): every point within eps of a point of a non-dense cell.

        The pair count is linear in the data: a non-dense cell holds fewer
        than ``min_pts`` points and has a bounded number of neighbour cells.
        """
        qF = [f"q_{f}" for f in self.F]
        pF = [f"p_{f}" for f in self.F]
        qx = self.query_pairs(prune)
        if self._choose_broadcast(self.query_adjacency(prune), "pair query"):
            qx = F.broadcast(qx)
        d = euclid_distance(qF, pF)
        pairs = qx.join(self._right(), [*self.N, "salt"]).withColumn("dist", d)
        keep = F.col("dist") <= F.lit(self.cfg.eps) if self.cfg.inclusive else F.col("dist") < F.lit(self.cfg.eps)
        return pairs.filter(keep).select("q_pid", "p_pid", "dist")

    def neighbor_counts(self) -> DataFrame:
        """Neighbour count (self included) of every candidate point of a non-dense cell: exact, or
        with the grouped strategy capped at ``min_pts``."""
        if "counts" not in self._cache:
            qx = self.query_pairs()
            qF = [f"q_{f}" for f in self.F]
            pF = [f"p_{f}" for f in self.F]
            if self.cfg.strategy == "grouped":
                grp = self._groups()
                j = qx.join(grp, [*self.N, "salt"])
                qcols = [F.col(c) for c in qF]
                near = lambda p: within(qcols, [p[f] for f in pF], self.cfg.eps, self.cfg.inclusive)
                enough = F.lit(self.cfg.min_pts)
                # no run is cut out or tested any more once there are enough
                more = lambda k, at: F.when(k >= enough, k).otherwise(
                    k + F.size(F.filter(F.slice("pts", at, COUNT_RUN), near)))
                hits = F.aggregate(F.sequence(F.lit(1), F.size("pts"), F.lit(COUNT_RUN)), F.lit(0), more)
                per = j.select("q_pid", *qF, *self.C, hits.alias("k"))
                counts = per.groupBy("q_pid", *qF, *self.C).agg(F.least(F.sum("k"), enough).alias("cnt"))
            else:
                right = self._right()
                if self._choose_broadcast(self.candidate_cells(), "partial-core query"):
                    qx = F.broadcast(qx)
                pairs = qx.join(right, [*self.N, "salt"]).filter(self._within(qF, pF))
                counts = pairs.groupBy("q_pid", *qF, *self.C).agg(F.count(F.lit(1)).alias("cnt"))
            self._cache["counts"] = counts.select(
                F.col("q_pid").alias("pid"), *[F.col(f"q_{f}").alias(f) for f in self.F],
                *self.C, F.col("cnt").cast("bigint").alias("cnt"))
        return self._cache["counts"]

    def _groups(self) -> DataFrame:
        """Points grouped per (cell, salt) bucket; reuses the points' partitioning."""
        if "groups" not in self._cache:
            pF = [f"p_{f}" for f in self.F]
            r = self._right()
            self._cache["groups"] = r.groupBy(*self.N, "salt").agg(
                F.collect_list(F.struct("p_pid", *pF)).alias("pts"))
        return self._cache["groups"]

    @property
    def partial_core(self) -> DataFrame:
        """Core points found inside non-dense cells: (pid, f.., c..)."""
        if "partial" not in self._cache:
            if self.by_rounds:
                core = self._reached(self.nondense_points, self.points, self.cfg.min_pts)
                found = self.nondense_points.join(core, "pid", "left_semi").select("pid", *self.F, *self.C)
            else:
                found = self.neighbor_counts().filter(F.col("cnt") >= F.lit(self.cfg.min_pts)).drop("cnt")
            self._cache["partial"] = self._materialize(found)
        return self._cache["partial"]

    # ------------------------------------------------------------- cell types
    @property
    def typed_cells(self) -> DataFrame:
        """Every occupied cell with n, nb and cell_type DENSE / CORE / OTHER."""
        if "typed" not in self._cache:
            pc = self.partial_core.select(*self.C).distinct().withColumn("has_core", F.lit(True))
            t = cell_types(self.cells, self.cfg.min_pts).join(pc, self.C, "left")
            t = t.withColumn("cell_type", F.when(
                (F.col("cell_type") == "OTHER") & F.col("has_core").isNotNull(), F.lit("CORE")
            ).otherwise(F.col("cell_type"))).drop("has_core")
            self._cache["typed"] = self._materialize(t)
        return self._cache["typed"]

    def core_neighbors(self, src: DataFrame | None = None, src_cols: tuple = ()) -> DataFrame:
        """(cell, neighbour core cell, its type, its nb) for ``src`` cells (default OTHER cells)."""
        src = self.other_cells if src is None else src
        dst = self.typed_cells.filter(F.col("cell_type") != "OTHER").select(
            *self.C, F.col("cell_type").alias("type_nb"), F.col("nb").alias("nb_nb"))
        return self._adjacent(src, dst, ("type_nb", "nb_nb"), src_cols=src_cols)

    @property
    def other_cells(self) -> DataFrame:
        return self.typed_cells.filter(F.col("cell_type") == "OTHER")

    # ------------------------------------------------------------- outliers
    @property
    def noncore_points(self) -> DataFrame:
        """Points of cells without any core point: (pid, f.., c..)."""
        return self.points.join(self._cells_salted(self.other_cells), [*self.C, "salt"],
                                "left_semi").drop("salt")

    @property
    def no_core_neighbor(self) -> DataFrame:
        """Outliers found without a distance test: no core cell is adjacent."""
        adj2 = self.core_neighbors()
        return self.noncore_points.join(adj2.select(*self.C).distinct(), self.C, "left_anti")

    def near_core(self) -> DataFrame:
        """Ids of non-core-cell points with at least one core point near them, one row per point.

        Semi joins with the distance as residual condition: a point's row for one
        neighbour bucket ends at the first core point in reach, and no pair is built.
        """
        if "near" not in self._cache and self.by_rounds:
            self._cache["near"] = self._reached(self.noncore_points, self.core_points_internal, 1)
        if "near" not in self._cache:
            src = self.other_cells.select(*self.C, F.col("nb").alias("nb_src"), F.col("n").alias("n_src"))
            adj2 = self._kept(self.core_neighbors(src, src_cols=("nb_src", "n_src")))
            qF = [f"q_{f}" for f in self.F]
            pF = [f"p_{f}" for f in self.F]
            M = [f"m_{n}" for n in self.N]
            a = explode_salts(adj2, "nb_src").drop("nb_src", "n_src")
            # points of OTHER cells x their core neighbour cells; two branches read it
            rx = self._materialize(self.points.join(a, [*self.C, "salt"]).select(
                F.col("pid").alias("q_pid"), *[F.col(f).alias(f"q_{f}") for f in self.F],
                *self.N, "type_nb", "nb_nb"))
            near = reduce(lambda x, y: x & y, [F.col(n) == F.col(m) for n, m in zip(self.N, M)]) & self._within(qF, pF)
            # neighbours in DENSE cells: every point there is core
            rd = explode_salts(rx.filter(F.col("type_nb") == "DENSE"), "nb_nb").drop("nb_nb", "type_nb")
            if self.cfg.strategy == "grouped":
                j = rd.join(self._groups(), [*self.N, "salt"])
                qcols = [F.col(c) for c in qF]
                hit = F.exists("pts", lambda p: within(qcols, [p[f] for f in pF],
                                                         self.cfg.eps, self.cfg.inclusive))
                near_d = j.filter(hit).select("q_pid")
            else:
                right = self._right().select(*pF, *[F.col(n).alias(m) for n, m in zip(self.N, M)], F.col("salt").alias("m_salt"))
                on = near & (F.col("salt") == F.col("m_salt"))
                if self._choose_broadcast(adj2.filter(F.col("type_nb") == "DENSE"), "border query"):
                    # the broadcast side is the small one: pairs with it, then one row per point
                    near_d = F.broadcast(rd).join(right, on).select("q_pid")
                else:
                    near_d = rd.join(right, on, "left_semi").select("q_pid")
            # neighbours in CORE cells: only their partial core points count
            rc = rx.filter(F.col("type_nb") == "CORE").drop("type_nb", "nb_nb")
            pc = self.partial_core.select(*[F.col(f).alias(f"p_{f}") for f in self.F],
                                          *[F.col(c).alias(m) for c, m in zip(self.C, M)])
            near_c = rc.join(pc, near, "left_semi").select("q_pid")
            self._cache["near"] = near_d.unionByName(near_c).select(F.col("q_pid").alias("pid")).distinct()
        return self._cache["near"]

    @property
    def all_core_reject(self) -> DataFrame:
        """Outliers that a distance test found: points with a core cell next to theirs, all of
        whose core points are out of reach."""
        beside = self._cells_salted(self.core_neighbors().select(*self.C).distinct())
        tested = self.points.join(beside, [*self.C, "salt"], "left_semi").drop("salt")
        return tested.join(self.near_core(), "pid", "left_anti")

    @property
    def outliers_internal(self) -> DataFrame:
        """(pid, f.., c..) of the outliers."""
        if "outliers" not in self._cache:
            self._cache["outliers"] = self.noncore_points.join(self.near_core(), "pid", "left_anti")
        return self._cache["outliers"]

    # ------------------------------------------------------------- user output
    def _user(self, df: DataFrame, extra: tuple = ()) -> DataFrame:
        ids = [F.col(i).alias(n) for i, n in zip(self.I, self.ids)] or [F.col("pid").alias("point_id")]
        return df.select(*ids, *[F.col(f).alias(n) for f, n in zip(self.F, self.features)], *extra)

    @property
    def outliers(self) -> DataFrame:
        """The outliers, as (id, features...)."""
        return self._user(self.outliers_internal)

    @property
    def dense_points(self) -> DataFrame:
        d = explode_salts(self.dense_cells.select(*self.C, "nb"), "nb").drop("nb")
        return self.points.join(d, [*self.C, "salt"], "left_semi").drop("salt")

    @property
    def nondense_points(self) -> DataFrame:
        return self.points.join(self._cells_salted(self.nondense_cells), [*self.C, "salt"],
                                "left_semi").drop("salt")

    @property
    def core_points_internal(self) -> DataFrame:
        """(pid, f.., c..) of all core points."""
        return self.dense_points.drop(*self.I).unionByName(self.partial_core)

    @property
    def core_points(self) -> DataFrame:
        """All core points, as (id, features...)."""
        part = self.nondense_points.join(self.partial_core.select("pid"), "pid", "left_semi")
        return self._user(self.dense_points.unionByName(part))

    @property
    def labels_internal(self) -> DataFrame:
        """Every point with ``label`` core / border / outlier (pid, f.., c.., label)."""
        if "labels" not in self._cache:
            dense = self.dense_points.withColumn("label", F.lit("core"))
            tags = (self.partial_core.select("pid", F.lit("core").alias("tag"))
                    .unionByName(self.outliers_internal.select("pid", F.lit("outlier").alias("tag"))))
            nd = self.nondense_points.join(tags, "pid", "left").withColumn(
                "label", F.coalesce(F.col("tag"), F.lit("border"))).drop("tag")
            self._cache["labels"] = dense.unionByName(nd)
        return self._cache["labels"]

    @property
    def labels(self) -> DataFrame:
        return self._user(self.labels_internal, ("label",))


def detect(df: DataFrame, features: list[str], eps: float, min_pts: int, id_col: str | list[str] | None = None,
           strategy: str = "shuffle", inclusive: bool = False, **kw) -> Detection:
    """Run the detection plan and return the :class:`Detection` holding all results."""
    return Detection(df, features, eps, min_pts, id_col=id_col, strategy=strategy,
                     inclusive=inclusive, **kw)


def detect_outliers(df: DataFrame, features: list[str], eps: float, min_pts: int,
                    id_col: str | list[str] | None = None, strategy: str = "shuffle",
                    inclusive: bool = False, **kw) -> DataFrame:
    """The outliers of ``df`` as (id, features...); like the other one-call functions, it
    writes the result to the checkpoint folder and keeps nothing cached."""
    det = detect(df, features, eps, min_pts, id_col, strategy, inclusive, **kw)
    return det.once(det.outliers)


def core_points(df: DataFrame, features: list[str], eps: float, min_pts: int,
                id_col: str | list[str] | None = None, **kw) -> DataFrame:
    det = detect(df, features, eps, min_pts, id_col, **kw)
    return det.once(det.core_points)


def label_points(df: DataFrame, features: list[str], eps: float, min_pts: int,
                 id_col: str | list[str] | None = None, **kw) -> DataFrame:
    """Every point with its label: core, border or outlier."""
    det = detect(df, features, eps, min_pts, id_col, **kw)
    return det.once(det.labels)


def dbscan_noise(df: DataFrame, features: list[str], eps: float, min_pts: int,
                 id_col: str | list[str] | None = None, **kw) -> DataFrame:
    """DBSCAN noise flag as +-1 (-1 = noise), with DBSCAN's ``distance <= eps``.

    Clusters are collapsed to 1, exactly as the comparison runs do; noise in
    DBSCAN is precisely the outlier set under the inclusive distance test.
    """
    det = detect(df, features, eps, min_pts, id_col, inclusive=True, **kw)
    lab = det.once(det.labels)
    return lab.select(*[c for c in lab.columns if c != "label"],
                      F.when(F.col("label") == "outlier", F.lit(-1)).otherwise(F.lit(1))
                      .cast("int").alias("prediction"))
