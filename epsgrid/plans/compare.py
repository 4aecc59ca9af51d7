"""Several detectors on one labelled point set, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_finite
from ..operators import baselines, evaluate
from ..operators.detect import label_points
from ..session import checkpoint_dir

ALGORITHMS = ("grid", "dbscan", "lof", "mahalanobis", "robust_mahalanobis", "isolation_forest")


def detector_runs(df: DataFrame, features: list[str], label: str, eps: float, min_pts: int,
                  contamination: float = 0.01, n_neighbors: int = 20,
                  algorithms: tuple[str, ...] = ALGORITHMS) -> dict[str, DataFrame]:
    """``(label, prediction)`` of every point by each algorithm; -1 stands for an outlier.

    ``grid`` counts pairs below ``eps``, ``dbscan`` also those at exactly ``eps``; the others mark
    the share ``contamination``.  The points are numbered and written once, so every
    algorithm sees the same rows.  A point with a NULL, NaN or infinite coordinate is left out
    for all of them.
    """
    unknown = set(algorithms) - set(ALGORITHMS)
    if unknown:
        raise ValueError(f"unknown algorithms: {sorted(unknown)}")
    checkpoint_dir(df.sparkSession)
    for f in features:
        df = df.filter(is_finite(F.col(f).cast("double")))
    pts = df.select(*features, F.col(label).alias("label")).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    points, truth = pts.select("_row", *features), pts.select("_row", "label")

    def run(alg: str) -> DataFrame:
        if alg in ("grid", "dbscan"):
            lab = label_points(points, features, eps, min_pts, "_row", inclusive=alg == "dbscan")
            found = lab.select("_row", F.when(F.col("label") == "outlier", -1).otherwise(1).alias("prediction"))
        elif alg == "lof":
            found = baselines.lof(points, features, contamination, n_neighbors, "_row")
        else:
            found = getattr(baselines, alg)(points, features, contamination, id_col="_row")
        return truth.join(found.select("_row", "prediction"), "_row").select("label", "prediction")

    return {alg: run(alg) for alg in algorithms}


def compare(df: DataFrame, features: list[str], label: str, eps: float, min_pts: int,
            contamination: float = 0.01, n_neighbors: int = 20,
            algorithms: tuple[str, ...] = ALGORITHMS) -> DataFrame:
    """Confusion counts, number of outliers, F1 and adjusted Rand index of each algorithm
    (:func:`detector_runs`, :func:`epsgrid.operators.evaluate.compare_detectors`)."""
    return evaluate.compare_detectors(
        detector_runs(df, features, label, eps, min_pts, contamination, n_neighbors, algorithms))
