"""Run statistics of a detection (cell and point counts, per-cell distributions).

Everything is computed from a per-cell table (one row per occupied cell), so
the work is proportional to the number of cells and ends in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import Detection


def _pct(part, total):
    return F.try_divide(part.cast("double"), total.cast("double")) * F.lit(100.0)


def distinct_cells(det: Detection) -> DataFrame:
    """Occupied cells (c0..)."""
    return det.cells.select(*det.C)


def neighbors_per_cell(det: Detection) -> DataFrame:
    """Non-empty neighbour cells of every occupied cell (self included)."""
    adj = det.nonempty_neighbors()
    return adj.groupBy(*det.C).agg(F.count(F.lit(1)).alias("n_neighbors"))


def cell_table(det: Detection) -> DataFrame:
    """One row per occupied cell: n, cell_type, core / outlier point counts, neighbours."""
    C = det.C
    pc = det.partial_core.groupBy(*C).agg(F.count(F.lit(1)).alias("n_partial"))
    oc = det.outliers_internal.groupBy(*C).agg(F.count(F.lit(1)).alias("n_out"))
    t = (det.typed_cells.join(pc, C, "left").join(oc, C, "left")
         .join(neighbors_per_cell(det), C, "left"))
    return t.select(*C, "n", "cell_type",
                    F.when(F.col("cell_type") == "DENSE", F.col("n"))
                    .otherwise(F.coalesce(F.col("n_partial"), F.lit(0))).alias("n_core"),
                    F.coalesce(F.col("n_out"), F.lit(0)).alias("n_outliers"),
                    F.coalesce(F.col("n_neighbors"), F.lit(0)).alias("n_neighbors"))


def cell_type_counts(det: Detection) -> DataFrame:
    """Cells per type (zero when absent) and the total."""
    t = det.typed_cells
    return t.agg(F.count(F.lit(1)).alias("total_cells"),
                 F.count_if(F.col("cell_type") == "DENSE").alias("dense_cells"),
                 F.count_if(F.col("cell_type") == "CORE").alias("core_cells"),
                 F.count_if(F.col("cell_type") == "OTHER").alias("other_cells"))


def points_per_cell_stats(det: Detection) -> DataFrame:
    return det.cells.agg(F.max("n").alias("max_points_per_cell"),
                         F.min("n").alias("min_points_per_cell"),
                         (F.sum("n") / F.count(F.lit(1))).alias("avg_points_per_cell"))


def neighbors_per_cell_stats(det: Detection) -> DataFrame:
    npc = neighbors_per_cell(det)
    return npc.agg(F.max("n_neighbors").alias("max_neighbors_per_cell"),
                   F.min("n_neighbors").alias("min_neighbors_per_cell"),
                   (F.sum("n_neighbors") / F.count(F.lit(1))).alias("avg_neighbors_per_cell"))


def run_stats(det: Detection) -> DataFrame:
    """The run report as one row (eps, min_pts, counts with percentages, cell distributions);
    ``quarantined`` rows have no position and are not among the points."""
    t = cell_table(det)
    a = t.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_points"),
        F.coalesce(F.sum("n_core"), F.lit(0)).alias("core_points"),
        F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("outliers"),
        F.count(F.lit(1)).alias("total_cells"),
        F.count_if(F.col("cell_type") == "DENSE").alias("dense_cells"),
        F.count_if(F.col("cell_type") == "CORE").alias("core_cells"),
        F.count_if(F.col("cell_type") == "OTHER").alias("other_cells"),
        F.max("n").alias("max_points_per_cell"),
        F.min("n").alias("min_points_per_cell"),
        F.try_divide(F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")).alias("avg_points_per_cell"),
        F.max("n_neighbors").alias("max_neighbors_per_cell"),
        F.min("n_neighbors").alias("min_neighbors_per_cell"),
        F.try_divide(F.sum("n_neighbors").cast("double"),
                     F.count(F.lit(1)).cast("double")).alias("avg_neighbors_per_cell"))
    a = a.withColumn("border_points", F.col("total_points") - F.col("core_points") - F.col("outliers"))
    tp, tc = F.col("total_points"), F.col("total_cells")
    return a.select(
        F.lit(det.cfg.eps).alias("eps"), F.lit(det.cfg.min_pts).alias("min_pts"),
        F.col("total_points").cast("bigint").alias("total_points"),
        F.lit(det.n_quarantined).cast("bigint").alias("quarantined"),
        F.col("core_points").cast("bigint").alias("core_points"),
        _pct(F.col("core_points"), tp).alias("core_pct"),
        F.col("border_points").cast("bigint").alias("border_points"),
        _pct(F.col("border_points"), tp).alias("border_pct"),
        F.col("outliers").cast("bigint").alias("outliers"),
        _pct(F.col("outliers"), tp).alias("outlier_pct"),
        "total_cells", "dense_cells", _pct(F.col("dense_cells"), tc).alias("dense_cell_pct"),
        "core_cells", _pct(F.col("core_cells"), tc).alias("core_cell_pct"),
        "other_cells", _pct(F.col("other_cells"), tc).alias("other_cell_pct"),
        "max_points_per_cell", "min_points_per_cell", "avg_points_per_cell",
        "max_neighbors_per_cell", "min_neighbors_per_cell", "avg_neighbors_per_cell")
