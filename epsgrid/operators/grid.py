"""Grid operators: points -> cells, cell counts, hot-cell salting, adjacency.

Internal column names: ``pid`` (generated point id), ``id0..`` (the caller's ids), ``f0..f{d-1}`` (features as
double), ``c0..c{d-1}`` (cell), ``n0..n{d-1}`` (a neighbour cell), ``salt``
(sub-bucket of a hot cell).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell_min_sq_dist, count_offsets, grid_coord, is_finite, neighbor_delta

DEFAULT_MAX_OFFSETS = 1000


def fcols(dim: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{i}" for i in range(dim)]


def ccols(dim: int, prefix: str = "c") -> list[str]:
    return [f"{prefix}{i}" for i in range(dim)]


def validate_params(eps: float, min_pts: int, dim: int) -> None:
    if not (isinstance(eps, (int, float)) and math.isfinite(eps) and eps > 0):
        raise ValueError(f"eps must be a positive finite number, got {eps!r}")
    if not (isinstance(min_pts, int) and min_pts >= 1):
        raise ValueError(f"min_pts must be an integer >= 1, got {min_pts!r}")
    if dim < 1:
        raise ValueError("at least one feature column is required")


def number_points(df: DataFrame, features: list[str], ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points as ``(pid, f0.., id0..)`` and the rows with a NULL, NaN or infinite coordinate.

    ``pid`` is generated (unique, not consecutive).  The caller's id columns are only
    carried along: they may be NULL, repeated and of any type.
    """
    sel = df.select(F.monotonically_increasing_id().alias("pid"),
                    *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                    *[F.col(c).alias(f"id{i}") for i, c in enumerate(ids)])
    ok = reduce(lambda a, b: a & b, [is_finite(f"f{i}") for i in range(len(features))])
    return sel.filter(ok), sel.filter(~ok)


def assign_cells(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """Add ``c0..c{d-1}``: the grid cell (side ``eps/sqrt(dim)``) of each point."""
    return points.withColumns({f"c{i}": grid_coord(f"f{i}", eps, dim) for i in range(dim)})


def cell_counts(g: DataFrame, dim: int) -> DataFrame:
    """Points per occupied cell (partial + final hash aggregate)."""
    return g.groupBy(*ccols(dim)).agg(F.count(F.lit(1)).alias("n"))


def cell_types(cells: DataFrame, min_pts: int) -> DataFrame:
    """DENSE when a cell holds at least ``min_pts`` points, else OTHER."""
    return cells.withColumn(
        "cell_type", F.when(F.col("n") >= F.lit(min_pts), F.lit("DENSE")).otherwise(F.lit("OTHER")))


def with_buckets(cells: DataFrame, rows_per_task: int) -> DataFrame:
    """Add ``nb``: how many salt buckets the points of a cell are split into."""
    return cells.withColumn(
        "nb", F.when(F.col("n") > F.lit(rows_per_task),
                     F.ceil(F.col("n") / F.lit(float(rows_per_task)))).otherwise(F.lit(1)).cast("int"))


def explode_salts(df: DataFrame, nb_col: str = "nb") -> DataFrame:
    """One row per salt bucket ``0..nb-1`` of the referenced cell."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(nb_col) - F.lit(1))))


def salted_points(g: DataFrame, hot: DataFrame | None, dim: int) -> DataFrame:
    """Give every point a ``salt``: 0, or a hash bucket inside a hot cell.

    ``hot`` (cells with more than ``rows_per_task`` points and their ``nb``)
    has at most ``total_points / rows_per_task`` rows, a bound the caller
    keeps below the broadcast limit, so it is broadcast and this is a
    map-side join with no shuffle.
    """
    if hot is None:
        # always 0, but computed from the data so that Catalyst cannot fold
        # it into a constant and drop it from join keys
        return g.withColumn("salt", F.pmod(F.xxhash64(F.col("pid")), F.lit(1)).cast("int"))
    j = g.join(F.broadcast(hot), ccols(dim), "left")
    return j.withColumn(
        "salt", F.pmod(F.xxhash64(F.col("pid")), F.coalesce(F.col("nb"), F.lit(1))).cast("int")
    ).drop("nb")


def _shifts(width: int) -> list[int]:
    """Bits by which cell coordinates are shortened per level, from the leaves to the level of one
    cell: by one bit at first, where most cells are and a step of two would multiply the pairs of
    children, then by two."""
    out = [0, 1, 2, 3, 4]
    while width >> out[-1]:
        out.append(out[-1] + 2)
    return out[:next(i for i, s in enumerate(out) if not width >> s) + 1]


def candidate_pairs(src: DataFrame, dst: DataFrame, dim: int, inclusive: bool = False) -> DataFrame:
    """Pairs of neighbour cells (``c0..`` of ``src``, ``n0..`` of ``dst``) from a hierarchy of
    coarser cells, before the last check of their gap.

    Coordinates are shortened by some bits per level until one cell is left.  From there
    pairs of parents are joined with their children, level by level, and only pairs whose gap
    is below eps go on.  The work follows the occupied neighbour pairs of each level, in
    any dimension and whatever the axes hold.  An axis with one value tells nothing apart and
    is left out; the others are compared by falling number of distinct values.  Levels grow
    with the logarithm of the widest axis.
    """
    C, N = ccols(dim), ccols(dim, "n")
    both = src.select(*C).unionByName(dst.select(*C))
    r = both.agg(*[f(c).alias(f"{k}{c}") for c in C for k, f in
                   (("lo", F.min), ("hi", F.max), ("nd", F.approx_count_distinct))]).first()
    low = {c: int(r[f"lo{c}"] or 0) for c in C}
    used = sorted((c for c in C if r[f"hi{c}"] is not None and r[f"hi{c}"] > low[c]), key=lambda c: -r[f"nd{c}"])
    shifts = _shifts(max((int(r[f"hi{c}"]) - low[c] for c in used), default=0))
    A, B = [f"a{i}" for i in range(len(used))], [f"b{i}" for i in range(len(used))]

    def at(df, level, names, keep=()):
        """The cells of a level under ``names`` and, as ``up_*``, their parents'; ``root`` is 0, computed
        from the data so that it stays a join key."""
        short = lambda c, n: F.shiftright(F.col(c) - F.lit(low[c]), shifts[n])
        up = [short(c, min(level + 1, len(shifts) - 1)).alias(f"up_{x}") for c, x in zip(used, names)]
        root = F.shiftright(F.col(C[0]) - F.lit(low[C[0]]), 63).alias("root")
        return df.select(*keep, *[short(c, level).alias(x) for c, x in zip(used, names)], *up, root)

    def near(df, level):
        gap = F.lit(0)
        for x, y in zip(A, B):
            g = F.greatest(F.abs(F.col(x) - F.col(y)) - F.lit(1), F.lit(0)) * F.lit(1 << shifts[level])
            gap = gap + F.least(g, F.lit(dim + 1)) * F.least(g, F.lit(dim + 1))
        return df.filter(gap <= dim if inclusive else gap < dim)

    pairs = None
    for level in range(len(shifts) - 2, 0, -1):
        a, b = at(src, level, A).distinct(), at(dst, level, B).distinct()
        if pairs is None:
            pairs = a.join(b, "root")
        else:
            pairs = pairs.toDF(*[f"up_{c}" for c in [*A, *B]]).join(a, [f"up_{c}" for c in A]).join(
                b, [f"up_{c}" for c in B])
        pairs = near(pairs, level).select(*A, *B)
    a = at(src, 0, A, C)
    b = at(dst.select(*C), 0, B, C)
    b = b.select(*[F.col(c).alias(n) for c, n in zip(C, N)], *[c for c in b.columns if c not in C])
    if pairs is None:
        both = a.join(b, "root")
    else:
        both = pairs.toDF(*[f"up_{c}" for c in [*A, *B]]).join(a, [f"up_{c}" for c in A]).join(b, [f"up_{c}" for c in B])
    return both.select(*C, *N)


def neighbor_cells(src: DataFrame, dst: DataFrame, dim: int, inclusive: bool = False,
                   dst_cols: tuple = (), max_offsets: int = DEFAULT_MAX_OFFSETS,
                   src_cols: tuple = ()) -> DataFrame:
    """Pairs (cell of ``src``, occupied neighbour cell of ``dst``), self included.

    ``src`` and ``dst`` carry cells as ``c0..``, each once; the result has ``c0..`` (the
    source cell), ``n0..`` (the neighbour) and ``dst_cols``.  Up to ``max_offsets`` candidate
    offsets, each source cell is expanded axis by axis (``explode(sequence(c - delta, c +
    delta))``, no join), keeping only offsets whose running cell gap stays below eps, and
    equi-joined with ``dst``.  In higher dimensions the pairs come from a hierarchy of coarser
    cells (:func:`candidate_pairs`) and the exact cell gap is checked on them.  Work is per
    cell, never per point.
    """
    C, N = ccols(dim), ccols(dim, "n")
    d = dst.select(*[F.col(f"c{i}").alias(f"n{i}") for i in range(dim)], *dst_cols)
    if count_offsets(dim, inclusive=inclusive) > max_offsets:
        gap = cell_min_sq_dist(C, N)
        near = candidate_pairs(src, dst, dim, inclusive).filter(gap <= F.lit(1.0) if inclusive else gap < F.lit(1.0))
        return near.join(src.select(*C, *src_cols), C).join(d, N).select(*C, *src_cols, *N, *dst_cols)
    return expand_offsets(src, dim, inclusive, src_cols).join(d, N).select(*C, *src_cols, *N, *dst_cols)


def expand_offsets(src: DataFrame, dim: int, inclusive: bool = False, src_cols: tuple = ()) -> DataFrame:
    """Every cell ``n0..`` (occupied or not, the cell itself included) that can hold a point within
    eps of one in the cell ``c0..`` of ``src``: a row each, without a join."""
    delta = neighbor_delta(dim, inclusive)
    ex = src.select(*ccols(dim), *src_cols)
    gap = None
    for i in range(dim):
        # one explode per axis; the running gap prunes offsets as early as possible
        c = F.col(f"c{i}")
        ex = ex.withColumn(f"n{i}", F.explode(F.sequence(c - F.lit(delta), c + F.lit(delta))))
        g = F.greatest(F.abs(F.col(f"n{i}") - c) - F.lit(1), F.lit(0))
        gap = g * g if gap is None else F.col("_gap") + g * g
        ex = ex.withColumn("_gap", gap)
        ex = ex.filter(F.col("_gap") <= F.lit(dim) if inclusive else F.col("_gap") < F.lit(dim))
    return ex.drop("_gap")
