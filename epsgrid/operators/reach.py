"""Which points have enough others near them, without a list of neighbour cells.

In high dimensions a cell has thousands of occupied neighbours, and their number grows with
the points: the pairs of cells are no bounded table.  Most points, though, show after a few
candidates that enough are near.  The candidates are dealt to disjoint rounds by a hash, each
larger than the last; only points that still lack some go on to the next.  Whoever reaches the
end has met every candidate that can be near it, so the answer is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import within
from .grid import fcols

FIRST_ROUND = 1 << 10        # candidates of the first round
GROWTH = 4                   # each round brings the candidates seen to so many times those before
AXES = 3                     # axes (the widest) of the coarse cells of a round's join
BLOCK = (1 << 13, 1 << 11)   # most points and candidates (about) of a coarse cell that meet under one key
TESTS_PER_TASK = 1 << 25     # distance tests (about) of a task
MOST_CELLS = 1 << 16         # most rows of a table of coarse cells that is broadcast (some 100 bytes each)
SHARES = 1 << 30
WIDER = 1 + 2.0 ** -10       # coarse cells are wider than eps by this, so rounding moves no pair apart


def _hits(todo: DataFrame, part: DataFrame, axes: list[int], dim: int, eps: float, inclusive: bool,
          spread_queries: bool) -> DataFrame:
    """(pid, hits): the weights of the rows of ``part`` that are near each point, summed.  Points meet
    in the coarse cells of one side; those of the other, the smaller, go there from the cells next to
    it.  Counts and keys are spread to the cells around, points are not, and what is broadcast is
    counted before: Spark's estimate of a frame leaves out what ``explode`` adds, so spread points
    would pass for a frame small enough to broadcast.  Within a coarse cell both sides are dealt to blocks of bounded size and every pair of blocks is a
    key of its own, so a region with any share of the rows is many tasks' work and a row travels once
    per block it meets."""
    A, Q, P = [f"a{i}" for i in axes], fcols(dim, "q_"), fcols(dim, "p_")
    M = [f"m{i}" for i in axes]
    cell = lambda i: F.floor(F.col(f"f{i}") / F.lit(eps * WIDER)).cast("bigint").alias(f"a{i}")
    q = todo.select("pid", *[F.col(f"f{i}").alias(c) for i, c in enumerate(Q)], *map(cell, axes))
    p = part.select("w", *[F.col(f"f{i}").alias(c) for i, c in enumerate(P)], *map(cell, axes))

    def beside(df):
        for a in A:
            df = df.withColumn(a, F.explode(F.sequence(F.col(a) - 1, F.col(a) + 1)))
        return df

    def held(df, n, spread):
        """Rows of ``df`` that meet in each coarse cell."""
        per = df.groupBy(*A).agg(F.count(F.lit(1)).alias(n))
        return beside(per).groupBy(*A).agg(F.sum(n).alias(n)) if spread else per

    blocks = lambda n, most: F.ceil(F.col(n) / F.lit(float(most))).cast("int")
    cells = held(q, "_q", spread_queries).join(held(p, "_p", not spread_queries), A).select(
        *A, (F.col("_q").cast("double") * F.col("_p")).alias("t"),
        blocks("_q", BLOCK[0]).alias("qb"), blocks("_p", BLOCK[1]).alias("pb")).checkpoint()
    total, n_cells = cells.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.count(F.lit(1))).first()
    # a number given here is kept: few bytes are many tests, so partitions must not be merged
    tasks = max(2 * todo.sparkSession.sparkContext.defaultParallelism, int(total / TESTS_PER_TASK))
    own = lambda cols, n: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = cells.select(*A, *[F.col(a).alias(m) for a, m in zip(A, M)], "qb", "pb")

    def placed(df, spread):
        """Rows of ``df``, one for each coarse cell they meet others in (``m0..``)."""
        to, n = (beside(at), n_cells * 3 ** len(A)) if spread else (at, n_cells)
        return df.join(F.broadcast(to) if n <= MOST_CELLS else to.hint("merge"), A).drop(*A)

    q, p = placed(q, spread_queries), placed(p, not spread_queries)
    q = q.withColumn("sq", own(["pid"], "qb")).withColumn("sp", each("pb")).drop("qb", "pb")
    p = p.withColumn("sp", own(P, "pb")).withColumn("sq", each("qb")).drop("qb", "pb")
    key = [*M, "sq", "sp"]
    pairs = q.repartition(tasks, *key).join(p.repartition(tasks, *key), key)
    return pairs.filter(within(Q, P, eps, inclusive)).groupBy("pid").agg(F.sum("w").alias("hits"))


def reached(queries: DataFrame, targets: DataFrame, dim: int, eps: float, needed: int, inclusive: bool) -> DataFrame:
    """``pid`` of the points ``(pid, f0..)`` of ``queries`` that at least ``needed`` of ``targets`` are near.
    Targets with equal coordinates are one candidate with a weight.  Each round is
    written to the checkpoint folder: a round on kept frames would carry the plans of all before it."""
    cols = fcols(dim)
    t = (targets.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))
         .withColumn("_u", F.pmod(F.xxhash64(*cols), F.lit(SHARES))).checkpoint())
    todo = queries.select("pid", *cols, F.lit(0).cast("bigint").alias("_n")).checkpoint()
    r = t.agg(F.count(F.lit(1)).alias("n"), *[(F.max(f) - F.min(f)).alias(f) for f in cols]).first()
    n, left, found = r["n"], todo.count(), []
    axes = sorted(sorted(range(dim), key=lambda i: -(r[f"f{i}"] or 0.0))[:AXES])
    low, size = 0, max(FIRST_ROUND, GROWTH * needed)
    while left and n and low < SHARES:
        high = SHARES if size >= n else max(low + 1, SHARES * size // n)
        part = t.filter((F.col("_u") >= low) & (F.col("_u") < high))
        hits = _hits(todo, part, axes, dim, eps, inclusive, left < n * (high - low) / SHARES)
        seen = todo.join(hits, "pid", "left").select(
            "pid", *cols, (F.col("_n") + F.coalesce(F.col("hits"), F.lit(0))).alias("_n")).checkpoint()
        found.append(seen.filter(F.col("_n") >= needed).select("pid"))
        todo = seen.filter(F.col("_n") < needed)
        left, low, size = todo.count(), high, size * GROWTH
    return reduce(DataFrame.unionByName, found) if found else queries.select("pid").limit(0)
