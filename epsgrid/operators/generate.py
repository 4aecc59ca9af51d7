"""Labelled test-data generators as Spark jobs.

Every generator turns a frame of row ids into labelled points, one point per
row, so the size is whatever the base frame holds (``spark.range(n)`` or a
table's key column).  Randomness is a hash of (id, seed): the output does not
depend on partitioning and a recomputed task reproduces it.  Points are
``x1..xd DOUBLE`` and ``label STRING`` (a cluster number, or ``noise``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal_hash, uniform_hash

# Fixed shapes of the reference data sets.
NOISE_FRACTION = 0.01
BLOB_CENTER_BOX = (-10.0, 10.0)
BLOB_NOISE_BOX = (-15.0, 15.0)
CIRCLE_FACTOR = 0.5
SHAPE_JITTER = 0.01
CIRCLE_NOISE_BOX = (-1.0, 1.0)
MOON_NOISE_BOX = (-1.5, 1.5)
MOON_SHIFT = (-0.5, -0.25)


def _ids(base: DataFrame, id_col: str) -> DataFrame:
    return base.select(F.col(id_col).cast("bigint").alias("gen_id"))


def _uniform(lo: float, hi: float, key: Column, seed: int) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * uniform_hash(key, seed)


def _is_noise(seed: int, frac: float) -> Column:
    return uniform_hash("gen_id", seed) < F.lit(frac)


def blobs(base: DataFrame, id_col: str = "id", centers: int = 5, dim: int = 2,
          cluster_std=0.5, noise_fraction: float = NOISE_FRACTION, noise_box=BLOB_NOISE_BOX,
          seed: int = 100) -> DataFrame:
    """Gaussian blobs around ``centers`` random centres in the centre box, plus
    uniform noise in ``noise_box`` labelled ``noise``."""
    rng = np.random.default_rng(seed)
    cen = rng.uniform(BLOB_CENTER_BOX[0], BLOB_CENTER_BOX[1], size=(centers, dim))
    stds = list(cluster_std) if isinstance(cluster_std, (list, tuple)) else [cluster_std] * centers
    ids = _ids(base, id_col)
    noise = _is_noise(seed, noise_fraction)
    cluster = F.least(F.floor(uniform_hash("gen_id", seed + 1) * F.lit(centers)),
                      F.lit(centers - 1)).cast("int")
    cols = []
    for j in range(dim):
        c_j = F.element_at(F.array(*[F.lit(float(cen[i, j])) for i in range(centers)]), cluster + 1)
        s_j = F.element_at(F.array(*[F.lit(float(s)) for s in stds]), cluster + 1)
        gauss = c_j + s_j * normal_hash("gen_id", seed * 10 + j + 2)
        unif = _uniform(noise_box[0], noise_box[1], F.col("gen_id"), seed * 10 + j + 50)
        cols.append(F.when(noise, unif).otherwise(gauss).alias(f"x{j + 1}"))
    label = F.when(noise, F.lit("noise")).otherwise(cluster.cast("string")).alias("label")
    return ids.select("gen_id", *cols, label)


def blobs_varied(base: DataFrame, id_col: str = "id", seed: int = 100) -> DataFrame:
    """Three blobs with standard deviations 0.5, 1 and 1.5."""
    return blobs(base, id_col, centers=3, cluster_std=[0.5, 1.0, 1.5], seed=seed)


def blobs_dim(base: DataFrame, dim: int, id_col: str = "id", seed: int = 100) -> DataFrame:
    """Five blobs in ``dim`` dimensions."""
    return blobs(base, id_col, centers=5, dim=dim, seed=seed)


def circles(base: DataFrame, id_col: str = "id", factor: float = CIRCLE_FACTOR,
            jitter: float = SHAPE_JITTER, noise_fraction: float = NOISE_FRACTION,
            noise_box=CIRCLE_NOISE_BOX, seed: int = 100) -> DataFrame:
    """Two concentric circles (radius 1 and ``factor``) with Gaussian jitter."""
    ids = _ids(base, id_col)
    noise = _is_noise(seed, noise_fraction)
    inner = uniform_hash("gen_id", seed + 1) < F.lit(0.5)
    t = F.lit(2 * math.pi) * uniform_hash("gen_id", seed + 2)
    rad = F.when(inner, F.lit(factor)).otherwise(F.lit(1.0))
    x = rad * F.cos(t) + F.lit(jitter) * normal_hash("gen_id", seed * 10 + 3)
    y = rad * F.sin(t) + F.lit(jitter) * normal_hash("gen_id", seed * 10 + 4)
    ux = _uniform(noise_box[0], noise_box[1], F.col("gen_id"), seed * 10 + 5)
    uy = _uniform(noise_box[0], noise_box[1], F.col("gen_id"), seed * 10 + 6)
    label = F.when(noise, F.lit("noise")).otherwise(F.when(inner, F.lit("1")).otherwise(F.lit("0")))
    return ids.select("gen_id", F.when(noise, ux).otherwise(x).alias("x1"),
                      F.when(noise, uy).otherwise(y).alias("x2"), label.alias("label"))


def moons(base: DataFrame, id_col: str = "id", jitter: float = SHAPE_JITTER,
          noise_fraction: float = NOISE_FRACTION, noise_box=MOON_NOISE_BOX,
          shift=MOON_SHIFT, seed: int = 100) -> DataFrame:
    """Two interleaving half circles, shifted, with Gaussian jitter."""
    ids = _ids(base, id_col)
    noise = _is_noise(seed, noise_fraction)
    second = uniform_hash("gen_id", seed + 1) < F.lit(0.5)
    t = F.lit(math.pi) * uniform_hash("gen_id", seed + 2)
    x = F.when(second, F.lit(1.0) - F.cos(t)).otherwise(F.cos(t))
    y = F.when(second, F.lit(0.5) - F.sin(t)).otherwise(F.sin(t))
    x = x + F.lit(jitter) * normal_hash("gen_id", seed * 10 + 3) + F.lit(shift[0])
    y = y + F.lit(jitter) * normal_hash("gen_id", seed * 10 + 4) + F.lit(shift[1])
    ux = _uniform(noise_box[0], noise_box[1], F.col("gen_id"), seed * 10 + 5)
    uy = _uniform(noise_box[0], noise_box[1], F.col("gen_id"), seed * 10 + 6)
    label = F.when(noise, F.lit("noise")).otherwise(F.when(second, F.lit("1")).otherwise(F.lit("0")))
    return ids.select("gen_id", F.when(noise, ux).otherwise(x).alias("x1"),
                      F.when(noise, uy).otherwise(y).alias("x2"), label.alias("label"))
