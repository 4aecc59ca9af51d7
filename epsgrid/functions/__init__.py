"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.  The only Python-side
computation is the neighbour-offset enumeration, whose size depends on the
dimension alone (never on the data).
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest cell coordinate kept exact by the double -> bigint floor.
MAX_CELL_COORD = float(2 ** 53)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grid_coord(x, eps: float, dim: int) -> Column:
    """Cell index of one coordinate: ``floor(x / eps * sqrt(dim))``.

    The cell side is ``eps / sqrt(dim)`` so that a cell's diagonal is ``eps``.
    The operation order (divide, then multiply) is kept fixed so that the
    same input always lands in the same cell.  Coordinates whose index would
    leave the exactly representable range raise instead of silently
    saturating.
    """
    v = _col(x) / F.lit(float(eps)) * F.lit(math.sqrt(dim))
    return F.when(F.abs(v) < F.lit(MAX_CELL_COORD), F.floor(v)).otherwise(
        F.raise_error(F.lit("cell index out of range: |x / eps * sqrt(dim)| >= 2^53"))
    ).cast("bigint")


def squared_distance(a: list, b: list) -> Column:
    """``sum((a_i - b_i) * (a_i - b_i))`` over scalar columns."""
    terms = [(_col(x) - _col(y)) * (_col(x) - _col(y)) for x, y in zip(a, b)]
    return reduce(lambda s, t: s + t, terms)


def euclid_distance(a: list, b: list) -> Column:
    """Euclidean distance between two points given as lists of columns."""
    return F.sqrt(squared_distance(a, b))


def within(a: list, b: list, eps: float, inclusive: bool = False) -> Column:
    """``distance(a, b) < eps`` (or ``<=`` when inclusive)."""
    d = euclid_distance(a, b)
    return d <= F.lit(float(eps)) if inclusive else d < F.lit(float(eps))


def cell_min_sq_dist(a: list, b: list) -> Column:
    """Squared minimum distance between two cells, in units of eps^2.

    ``sum(max(|a_i - b_i| - 1, 0)^2) / dim``.  Two cells can hold a pair of
    points closer than eps only when this is below 1.
    """
    dim = len(a)
    terms = []
    for x, y in zip(a, b):
        g = F.greatest(F.abs(_col(x) - _col(y)) - F.lit(1), F.lit(0)).cast("double")
        terms.append(g * g)
    return reduce(lambda s, t: s + t, terms) / F.lit(float(dim))


def neighbor_delta(dim: int, inclusive: bool = False) -> int:
    """Largest per-axis offset a neighbour cell can have: ceil(sqrt(dim)); with pairs at
    exactly eps floor(sqrt(dim)) + 1, which is one more where dim is a square."""
    return math.isqrt(dim) + 1 if inclusive else int(math.ceil(math.sqrt(dim)))


def neighbor_offsets(dim: int, axes: int | None = None, inclusive: bool = False) -> list[tuple]:
    """Integer offsets of the cells that may hold points within eps.

    All offsets in ``[-delta, delta]^axes`` whose gap term
    ``sum(max(|o_i| - 1, 0)^2)`` is below ``dim`` (self included).  With
    ``axes < dim`` this is the projection onto the leading axes, a necessary
    condition used by the high-dimension adjacency plan.  ``inclusive``
    keeps the boundary (``<= dim``) for the ``distance <= eps`` variant.
    """
    axes = dim if axes is None else axes
    delta = neighbor_delta(dim, inclusive)
    gaps = {o: max(abs(o) - 1, 0) ** 2 for o in range(-delta, delta + 1)}
    out = []
    for off in itertools.product(range(-delta, delta + 1), repeat=axes):
        s = sum(gaps[o] for o in off)
        if (s <= dim) if inclusive else (s < dim):
            out.append(off)
    return out


def count_offsets(dim: int, axes: int | None = None, inclusive: bool = False) -> int:
    """Number of offsets ``neighbor_offsets`` would return, without listing them."""
    axes = dim if axes is None else axes
    delta = neighbor_delta(dim, inclusive)
    # distribution of the gap sum over the axes, by dynamic programming
    per_axis = {}
    for o in range(-delta, delta + 1):
        g = max(abs(o) - 1, 0) ** 2
        per_axis[g] = per_axis.get(g, 0) + 1
    dist = {0: 1}
    for _ in range(axes):
        nxt = {}
        for s, c in dist.items():
            for g, k in per_axis.items():
                if s + g <= dim:
                    nxt[s + g] = nxt.get(s + g, 0) + c * k
        dist = nxt
    return sum(c for s, c in dist.items() if (s <= dim if inclusive else s < dim))


def uniform_hash(key, seed: int) -> Column:
    """A uniform double in [0, 1) from a hash of ``key`` and ``seed``.

    Unlike ``rand(seed)`` the value does not depend on partitioning, so a
    recomputed task after an executor loss sees the same number.
    """
    h = F.xxhash64(_col(key), F.lit(int(seed)))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53)))


def keyed_uniform(parts: list, seed: int) -> Column:
    """A uniform double in [0, 1) from the md5 of the key's parts and ``seed`` as text: the first
    52 bits of ``md5('part:part:seed')``, which any SQL engine can repeat.  NULL parts are
    skipped.  Slower than :func:`uniform_hash`."""
    text = F.concat_ws(":", *[_col(p).cast("string") for p in parts], F.lit(str(int(seed))))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(1 << 52))


def normal_hash(key, seed: int) -> Column:
    """A standard normal draw from two hashed uniforms (Box-Muller)."""
    u1 = uniform_hash(key, seed * 2 + 1)
    u2 = uniform_hash(key, seed * 2 + 2)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def label_to_sign(label) -> Column:
    """Ground-truth label to +-1: the string ``noise`` is -1, anything else 1."""
    return F.when(_col(label) == F.lit("noise"), F.lit(-1)).otherwise(F.lit(1)).cast("int")


def is_finite(c) -> Column:
    x = _col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
