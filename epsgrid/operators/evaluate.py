"""Label-based evaluation (positive class = outlier = -1) and timing summaries.

All metrics are aggregations over the prediction table; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Detected / undetected x data point / outlier counts."""
    l, p = F.col(label), F.col(prediction)
    return df.agg(
        F.count_if((l == 1) & (p == 1)).alias("data_found"),
        F.count_if((l == 1) & (p == -1)).alias("data_not_found"),
        F.count_if((l == -1) & (p == -1)).alias("outliers_found"),
        F.count_if((l == -1) & (p == 1)).alias("outliers_not_found"))


def f1_outlier(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """F1 score with -1 as the positive label (0 when there is nothing to score)."""
    c = confusion(df, label, prediction)
    tp, fp, fn = F.col("outliers_found"), F.col("data_not_found"), F.col("outliers_not_found")
    den = (F.lit(2) * tp + fp + fn).cast("double")
    return c.select(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                    F.coalesce(F.try_divide((F.lit(2) * tp).cast("double"), den), F.lit(0.0)).alias("f1"))


def outlier_count(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.count_if(F.col(prediction) == -1).alias("n_outliers"))


def _comb2(c):
    c = c.cast("double")  # the product of two counts may be beyond 64 bits
    return c * (c - F.lit(1.0)) / F.lit(2.0)


def adjusted_rand(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Adjusted Rand index of two labelings, from the contingency table.

    ``(index - expected) / (max - expected)`` with pair counts; 1.0 when the
    denominator is zero (identical trivial partitions).  Work: one
    aggregation per margin, each a small table.
    """
    cont = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("nij"))
    a = cont.groupBy(label).agg(F.sum("nij").alias("ai")).agg(F.sum(_comb2(F.col("ai"))).alias("sa"))
    b = cont.groupBy(prediction).agg(F.sum("nij").alias("bj")).agg(F.sum(_comb2(F.col("bj"))).alias("sb"))
    s = cont.agg(F.sum(_comb2(F.col("nij"))).alias("sij"), F.sum("nij").alias("n"))
    k = F.lit(1)
    t = (s.withColumn("_k", k).join(a.withColumn("_k", k), "_k")
         .join(b.withColumn("_k", k), "_k"))
    sij, sa, sb = F.coalesce(F.col("sij"), F.lit(0.0)), F.coalesce(F.col("sa"), F.lit(0.0)), \
        F.coalesce(F.col("sb"), F.lit(0.0))
    n = F.coalesce(F.col("n"), F.lit(0))
    expected = F.try_divide(sa * sb, _comb2(n))
    mx = (sa + sb) / F.lit(2.0)
    ari = F.try_divide(sij - expected, mx - expected)
    return t.select(F.when((mx - F.coalesce(expected, F.lit(0.0))) == F.lit(0.0), F.lit(1.0))
                    .otherwise(F.coalesce(ari, F.lit(1.0))).alias("adjusted_rand"))


def compare_detectors(runs: dict[str, DataFrame], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per algorithm (key of ``runs``): confusion counts, number of outliers, F1 of the
    outliers and adjusted Rand index; labels and predictions are 1 or -1.

    All runs are counted in one aggregation to at most four rows an algorithm, from which
    every figure follows.  A run without rows is missing in the result.
    """
    cells = [("data_found", 1, 1), ("data_not_found", 1, -1), ("outliers_found", -1, -1), ("outliers_not_found", -1, 1)]
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(alg).alias("alg"), F.col(label).alias("_l"), F.col(prediction).alias("_p")) for alg, df in runs.items()])
    t = rows.groupBy("alg").agg(*[F.count_if((F.col("_l") == a) & (F.col("_p") == b)).alias(name) for name, a, b in cells])
    df_, dn, of, on = (F.col(name) for name, _, _ in cells)
    pairs = _comb2(df_) + _comb2(dn) + _comb2(of) + _comb2(on)
    by_label, by_pred = _comb2(df_ + dn) + _comb2(of + on), _comb2(df_ + on) + _comb2(of + dn)
    expected = F.coalesce(F.try_divide(by_label * by_pred, _comb2(df_ + dn + of + on)), F.lit(0.0))
    most = (by_label + by_pred) / F.lit(2.0)
    den = (F.lit(2) * of + dn + on).cast("double")
    return t.select("alg", *[name for name, _, _ in cells], (of + dn).alias("n_outliers"),
                    F.coalesce(F.try_divide((F.lit(2) * of).cast("double"), den), F.lit(0.0)).alias("f1"),
                    F.coalesce(F.try_divide(pairs - expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))


def timing_summary(df: DataFrame, alg: str = "alg", x: str = "x", y: str = "y") -> DataFrame:
    """Mean and sample standard deviation of running time per (algorithm, x)."""
    return df.groupBy(alg, x).agg(F.avg(y).alias("mean_time"), F.stddev_samp(y).alias("std_time"),
                                  F.count(F.lit(1)).alias("runs"))
