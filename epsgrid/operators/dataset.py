"""Dataset utilities: row index, sampling, differences, jittered expansion,
id joins, tagging and removal of detected outliers, exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed_uniform
from ..session import checkpoint_dir


def with_row_index(df: DataFrame, order_by: list, name: str = "row_idx") -> DataFrame:
    """Consecutive 0-based index following ``order_by``; rows that tie keep the order of the scan.

    Two passes instead of a global window: a range-partitioned sort, then
    per-partition row counts (one row per partition, bounded by the
    partition count) turned into offsets that are broadcast back.  The
    sorted frame with its partition ids is checkpointed (shared checkpoint
    folder), so both passes see the same rows even if an executor is lost.
    The place in the scan is the last sort key, so rows with one key, a third of the table or
    all of it, are spread over the partitions like any others.
    """
    s = _sorted_parts(df, order_by)
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mono") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    out = s.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + local).cast("bigint"))
    return out.drop("_part", "_mono", "_off")


def _sorted_parts(df: DataFrame, order_by: list) -> DataFrame:
    """``df`` sorted, written, with the number of each row's partition and its place there."""
    checkpoint_dir(df.sparkSession)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return (df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*cols, "_tie").drop("_tie")
            .withColumn("_part", F.spark_partition_id())
            .withColumn("_mono", F.monotonically_increasing_id())
            .checkpoint())


GATHER_VALUES = 10_000  # values sorted on the driver once the rank is bracketed this closely
SKETCH = 10_000         # accuracy of the sketch that proposes the brackets


def kth_smallest(vals: DataFrame, k: int) -> float:
    """The exact ``k``-th smallest (from 0) of the non-NULL column ``v``, without a sort.

    Each round takes two aggregations: a sketch of bounded size proposes two values around
    the rank, and exact counts below, at and between them tell which of these parts holds it.
    The part between leaves out its ends, so every round makes it smaller whatever the ties, and
    it shrinks by about ``SKETCH`` / 4.  At most ``GATHER_VALUES`` values reach the driver.
    """
    v, left = F.col("v"), k
    while True:
        n = vals.count()
        if n <= GATHER_VALUES:
            return sorted(r[0] for r in vals.select("v").collect())[left]
        at = [max(0.0, min(1.0, left / n + d)) for d in (-2 / SKETCH, 2 / SKETCH)]
        lo, hi = vals.agg(F.percentile_approx("v", at, SKETCH)).first()[0]
        below, at_lo, inside, at_hi = vals.agg(
            F.count_if(v < lo), F.count_if(v == lo), F.count_if((v > lo) & (v < hi)),
            F.count_if((v == hi) & (v > lo))).first()
        if left < below:
            vals = vals.filter(v < lo)
        elif left < below + at_lo:
            return lo
        elif left < below + at_lo + inside:
            vals, left = vals.filter((v > lo) & (v < hi)), left - below - at_lo
        elif left < below + at_lo + inside + at_hi:
            return hi
        else:
            vals, left = vals.filter(v > hi), left - below - at_lo - inside - at_hi


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact quantile with linear interpolation (numpy's default); NULL and NaN are left out.

    Selection by counting (:func:`kth_smallest`): ``df`` is read a few times, so a frame that
    is dear to compute should be checkpointed first.  ``None`` if there are no values.
    """
    v = F.col("v")
    vals = df.select(F.col(col).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    n = vals.count()
    if n == 0:
        return None
    pos = q * (n - 1)
    k = int(pos // 1)
    a = kth_smallest(vals, k)
    if pos == k:
        return a
    upto, after = vals.agg(F.count_if(v <= a), F.min(F.when(v > a, v))).first()
    b = a if upto > k + 1 else after
    return a + (b - a) * (pos - k)


def sample_points(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample without replacement (Spark's sampler; depends on partitioning)."""
    return df.sample(False, fraction, seed)


def sample_by_hash(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Bernoulli sample decided by the md5 of ``key``: the same rows whatever the partitioning
    or the engine, and nested for growing fractions (a 0.2 sample contains the 0.1 one).
    Rows that share a key are kept or left together."""
    return df.filter(keyed_uniform([key], seed) < F.lit(float(fraction)))


def diff_datasets(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows of ``a`` absent from ``b`` (side ``12``) and of ``b`` absent from
    ``a`` (side ``21``), compared on ``cols`` as value tuples.

    Anti joins keep every duplicate of a surviving row (set difference
    semantics of the original tool, unlike ``subtract`` or ``exceptAll``).
    """
    cols = cols or a.columns
    cond = lambda l, r: [l[c].eqNullSafe(r[c]) for c in cols]
    x, y = a.select(*cols).alias("x"), b.select(*cols).alias("y")
    d12 = x.join(y, cond(x, y), "left_anti").withColumn("side", F.lit("12"))
    x2, y2 = b.select(*cols).alias("x2"), a.select(*cols).alias("y2")
    d21 = x2.join(y2, cond(x2, y2), "left_anti").withColumn("side", F.lit("21"))
    return d12.unionByName(d21)


def expand_dataset(df: DataFrame, features: list[str], factor: int, delta: float,
                   key: str | None = None, seed: int = 0, copy_col: str = "copy") -> DataFrame:
    """``factor`` jittered copies of every row: each coordinate moves by
    ``delta * U(-1, 1)``; the original row is not kept.

    With ``key`` the noise comes from the md5 of (key, copy, axis), so a recomputed
    partition yields the same values; without it ``rand(seed)`` is used.
    """
    if factor < 1:
        raise ValueError("factor must be >= 1")
    ex = df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.lit(int(factor)))))
    out = {}
    for i, c in enumerate(features):
        if key:
            u = keyed_uniform([key, copy_col, F.lit(i)], seed)
        else:
            u = F.rand(seed * 1000 + i)
        out[c] = F.col(c) + F.lit(float(delta)) * (F.lit(2.0) * u - F.lit(1.0))
    return ex.withColumns(out)


def merge_ids(ids: DataFrame, data: DataFrame, idx_col: str = "row_idx") -> DataFrame:
    """Attach the full record to a list of 0-based row indices (inner join;
    a repeated id repeats the record)."""
    return ids.select(idx_col).join(data, idx_col, "inner")


def tag_detected(data: DataFrame, detected: DataFrame, on: list[str], flag: str = "detected") -> DataFrame:
    """Left join of the data with a detected list, with a boolean indicator.

    ``detected`` is de-duplicated on the key first, so a coordinate key
    listed twice does not duplicate data rows.
    """
    d = detected.select(*on).distinct().withColumn("_hit", F.lit(True))
    return data.join(d, on, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def remove_outliers(data: DataFrame, outliers: DataFrame, on: list[str]) -> DataFrame:
    """The data without the detected outliers (anti join)."""
    return data.join(outliers.select(*on), on, "left_anti")


def rescale(df: DataFrame, features: list[str], factor: float) -> DataFrame:
    """Divide the coordinates by a scaling factor."""
    return df.withColumns({c: F.col(c) / F.lit(float(factor)) for c in features})


CURVE_RUN = 1 << 20  # ranks of one value that a single row is expanded to


def order_curve(df: DataFrame, col: str, rank_col: str = "rank") -> DataFrame:
    """Values sorted ascending (NULL first) with their 0-based rank (a sorted curve).

    Only distinct values are sorted, with their counts; running sums give the first rank of
    each, and its ranks follow in runs of at most ``CURVE_RUN``, spread over all tasks.  A value
    that most rows share is therefore never one task's work.
    """
    counts = df.groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    checkpoint_dir(df.sparkSession)
    s = (counts.orderBy("v").withColumn("_part", F.spark_partition_id())
         .withColumn("_mono", F.monotonically_increasing_id()).checkpoint())
    parts = s.groupBy("_part").agg(F.sum("cnt").alias("_cnt"))  # one row per partition
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    before = Window.partitionBy("_part").orderBy("_mono").rowsBetween(Window.unboundedPreceding, -1)
    first = s.withColumn("_in", F.coalesce(F.sum("cnt").over(before), F.lit(0))).join(F.broadcast(offsets), "_part")
    runs = first.select("v", (F.col("_off") + F.col("_in")).alias("first"), "cnt",
                        F.explode(F.sequence(F.lit(0), F.col("cnt") - 1, F.lit(CURVE_RUN))).alias("run"))
    # a number of partitions given here is kept: these few bytes are about to grow, so they must not be merged
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, "v", "run").withColumn("last", F.least("cnt", F.col("run") + CURVE_RUN) - 1)
    return runs.select(F.explode(F.sequence(F.col("first") + F.col("run"), F.col("first") + F.col("last"))).alias(rank_col),
                       F.col("v").alias(col))


def sign(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, F.lit(-1)).otherwise(F.lit(1)).cast("int")
