"""Sinks: outlier lists, DS text, dataset differences, prediction tables.

Every writer is a distributed ``DataFrameWriter`` call (one file per
partition); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import with_row_index


def write_outliers(outliers: DataFrame, path: str, features: list[str], keep_id: str | None = None,
                   fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write an outlier list: features only as CSV text by default.

    ``keep_id`` keeps the point id as the first column so results can be
    joined back; ``fmt='parquet'`` writes a typed table instead of text.
    """
    cols = ([keep_id] if keep_id else []) + list(features)
    w = outliers.select(*cols).write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.csv(path)


def to_ds(df: DataFrame, order_by: list[str], features: list[str], text: bool = True) -> DataFrame:
    """``"<0-based index> f1 f2 ..."`` lines, the index following ``order_by``."""
    idx = with_row_index(df, order_by, "row_idx")
    vals = [F.col(c).cast("string") for c in features]
    return idx.select("row_idx", F.concat_ws(" ", F.col("row_idx").cast("string"), *vals).alias("value"))


def write_ds(df: DataFrame, path: str, order_by: list[str], features: list[str],
             mode: str = "overwrite") -> None:
    to_ds(df, order_by, features).select("value").write.mode(mode).text(path)


def write_diff(diff: DataFrame, prefix: str, mode: str = "overwrite") -> None:
    """Two outputs, ``<prefix>_12`` and ``<prefix>_21``, from a frame with a ``side`` column."""
    for side in ("12", "21"):
        diff.filter(F.col("side") == side).drop("side").write.mode(mode).csv(f"{prefix}_{side}")


def write_predictions(df: DataFrame, path: str, features: list[str], label: str = "label",
                      prediction: str = "prediction", mode: str = "overwrite") -> None:
    """Features, +-1 label and +-1 prediction as header-less CSV."""
    df.select(*features, label, prediction).write.mode(mode).option("header", False).csv(path)


def write_trajectories(df: DataFrame, path: str, traj_col: str, order_col: str,
                       lat: str, long: str, alt: str, header_lines: int = 6,
                       mode: str = "overwrite") -> None:
    """Write one text file per trajectory: ``header_lines`` header lines, then
    ``lat,long,0,alt`` lines in ``order_col`` order.

    Rows are shuffled by trajectory and sorted inside each partition; the
    writer's per-value directories (``partitionBy``) give one file per
    trajectory.
    """
    hdr = (df.select(traj_col).distinct()
           .withColumn("_ord", F.explode(F.sequence(F.lit(0), F.lit(header_lines - 1))))
           .withColumn("_k", F.lit(0))
           .withColumn("value", F.concat(F.lit("header line "), F.col("_ord").cast("string"))))
    body = df.select(traj_col, F.col(order_col).cast("double").alias("_ord"), F.lit(1).alias("_k"),
                     F.concat_ws(",", F.col(lat).cast("string"), F.col(long).cast("string"), F.lit("0"),
                                 F.col(alt).cast("string")).alias("value"))
    allr = hdr.withColumn("_ord", F.col("_ord").cast("double")).unionByName(body)
    (allr.repartition(traj_col).sortWithinPartitions(traj_col, "_k", "_ord")
     .select(traj_col, "value").write.mode(mode).partitionBy(traj_col).text(path))
