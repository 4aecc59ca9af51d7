"""Exact k-nearest neighbours and k-distance curves on the grid.

Points are told apart by a generated number that follows the order of the caller's
ids, which are joined back at the end: they may be NULL, repeated and of any type
that sorts.  Neighbours are ordered by ``(distance, neighbour id)``, points with equal
ids in no set order; with ``include_self`` the point itself is a candidate (distance 0), as when a fitted set is queried
with itself.

Plan:

1. **Duplicates.** Points with identical coordinates tie at distance 0, and
   ties go to the smaller id, so no query ever uses more than
   ``cap = k (+1 without self)`` copies of one coordinate.  Coordinates with
   more copies are reduced to their ``cap`` smallest ids (a two-phase top-k:
   per hash bucket sized from the group's count, then per coordinate; no
   group is sorted whole in one task).  Their points are answered directly from that list; the other
   queries see only the kept copies.
2. **Tree of cells.** Space is halved twice per axis and level; a cell with more
   than ``leaf`` points has children, so every leaf holds at most ``leaf`` points
   wherever the data is dense (down to 2^-48 of the widest axis).
3. **Descent.** From the root down, each cell keeps the list of cells that can hold
   neighbours of its points: those whose gap is at most the smallest reach within which
   cells of its list hold ``cap`` points.  A dense cell in the list of a far outlier is
   cut into children and pruned again, never joined whole.
4. **Pairs.** The points of a leaf prune the leaf's list once more by their own
   distances, and meet the points of what is left: at most ``leaf`` pairs per list
   entry, whatever share of the points one region holds; pairs beyond the point's reach
   are dropped on the spot.  The ``k`` nearest are kept by a window whose map side keeps
   ``k`` rows a query already.

The lists of both steps are pruned where the join has put them: the windows' keys begin with
the join's, so the unpruned pairs are never shuffled.

Each level of the tree and of the descent is checkpointed to the shared folder.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import euclid_distance
from ..session import checkpoint_dir
from .dataset import with_row_index
from .grid import ccols, fcols, number_points

ROWS_PER_TASK = 1 << 20        # most points of one coordinate ranked in one task
MAX_BROADCAST_ROWS = 2_000_000  # bound on the hot-coordinate list


DEPTH, BITS = 24, 2  # levels of the tree, bits of a coordinate per level
PASS = 3             # levels counted in one pass over the points
MAX_BROADCAST_CELLS = 200_000  # cells of a pass that are broadcast to the points
SLACK = 1e-9         # relative room for rounding in comparisons of cell distances


def _cell(level: str, z: list[str], prefix: str) -> list:
    """The cell of a level from the finest coordinates ``z``."""
    return [F.expr(f"shiftright({c}, {BITS} * ({DEPTH} - {level}))").alias(f"{prefix}{i}") for i, c in enumerate(z)]


def _tree(pts: DataFrame, dim: int, leaf: int, n: int) -> tuple[DataFrame, DataFrame, float]:
    """``(nodes, points, span)``: cells ``(l, c0.., n, leaf)`` whose parent holds more than ``leaf``
    points, and the points ``(pid, f0.., y0.., l, c0..)`` with their leaf; ``y`` are the
    coordinates as shares of the widest axis, ``span`` wide."""
    F_, C, Y, Z = fcols(dim), ccols(dim), fcols(dim, "y"), fcols(dim, "z")
    r = pts.agg(*[g(f).alias(f"{k}{f}") for f in F_ for k, g in (("lo", F.min), ("hi", F.max))]).first()
    span = max(float(r[f"hi{f}"] - r[f"lo{f}"]) for f in F_) * (1 + 2.0 ** -40) or 1.0
    share = [(F.col(f) - F.lit(float(r[f"lo{f}"]))) / F.lit(span) for f in F_]
    # both follow from the coordinates and are not written with them
    with_y = lambda df: df.select("pid", *F_, *[y.alias(a) for y, a in zip(share, Y)], "l", *C)
    with_z = lambda df: df.withColumns({z: F.floor(y * F.lit(2.0 ** (BITS * DEPTH))) for z, y in zip(Z, share)})
    root = pts.sparkSession.range(1).select(F.lit(0).alias("l"), *[F.lit(0).cast("bigint").alias(c) for c in C],
                                            F.lit(n).cast("bigint").alias("n"), F.lit(n <= leaf).alias("leaf"))
    own = ["pid", *F_]
    if n <= leaf:
        return root, with_y(pts.select(*own, F.lit(0).alias("l"), *[F.lit(0).cast("bigint").alias(c) for c in C])), span
    nodes, done, active, base = [root], [], pts.select(*own), 0
    while base < DEPTH:
        ex = active.select(*own, F.explode(F.sequence(F.lit(base + 1), F.lit(base + PASS))).alias("l"))
        ex = with_z(ex).select(*own, "l", *_cell("l", Z, "c"))
        counts = ex.groupBy("l", *C).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        heavy = counts.filter(F.col("n") > leaf).select((F.col("l") + 1).alias("l"), *[F.col(c).alias(f"u{c}") for c in C])
        up = counts.withColumns({f"u{c}": F.shiftright(c, BITS) for c in C})
        kept = (up.filter(F.col("l") > base + 1).join(heavy, ["l", *[f"u{c}" for c in C]], "left_semi")
                .unionByName(up.filter(F.col("l") == base + 1)).select("l", *C, "n")
                .withColumn("leaf", (F.col("n") <= leaf) | (F.col("l") == DEPTH)).checkpoint())
        nodes.append(kept)
        last = kept.filter(F.col("leaf") | (F.col("l") == base + PASS)).select("l", *C, "leaf")
        last = F.broadcast(last) if last.count() <= MAX_BROADCAST_CELLS else last
        placed = ex.join(last, ["l", *C]).checkpoint()
        done.append(placed.filter("leaf").select(*own, "l", *C))
        active = placed.filter(~F.col("leaf")).select(*own)
        base += PASS
        if active.isEmpty():
            break
    both = lambda x: reduce(DataFrame.unionByName, x)
    return both(nodes), with_y(both(done)), span


def _pruned(pairs: DataFrame, key: list[str], near, far, cap: int) -> DataFrame:
    """Rows whose least distance is at most ``reach``, the smallest greatest distance within which rows
    of the same key hold ``cap`` points (infinite if they do not)."""
    w = Window.partitionBy(*key)
    held = F.sum("n").over(w.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0))
    return (pairs.withColumn("_far", far).withColumn("_near", near).withColumn("_held", held)
            .withColumn("reach", F.coalesce(F.min(F.when(F.col("_held") >= cap, F.col("_far"))).over(w), F.lit(float("inf"))))
            .filter(_in_reach(F.col("_near"), F.col("reach"))).drop("_far", "_near", "_held"))


def _in_reach(distance, reach):
    return distance <= reach * (1 + SLACK) + 1e-15


def _box_distance(low: list, high: list, low2: list, high2: list) -> tuple:
    """Least and greatest distance of two boxes."""
    gap = [F.greatest(l2 - h1, l1 - h2, F.lit(0.0)) for l1, h1, l2, h2 in zip(low, high, low2, high2)]
    far = [F.greatest(h2 - l1, h1 - l2) for l1, h1, l2, h2 in zip(low, high, low2, high2)]
    norm = lambda xs: F.sqrt(reduce(lambda a, b: a + b, [x * x for x in xs]))
    return norm(gap), norm(far)


def _cell_lists(nodes: DataFrame, dim: int, cap: int) -> DataFrame:
    """(ql, q0.., l, c0.., n, reach): for every leaf the leaves that can hold one of the ``cap`` nearest
    points of a point in it, by a descent of pairs of cells from the root."""
    C, Q, P = ccols(dim), ccols(dim, "q"), ccols(dim, "u")
    child = nodes.filter("l > 0").select((F.col("l") - 1).alias("ul"), *[F.shiftright(c, BITS).alias(p) for c, p in zip(C, P)],
                                         "l", *C, "n", "leaf")
    down = child.unionByName(nodes.filter("leaf").select(F.col("l").alias("ul"), *[F.col(c).alias(p) for c, p in zip(C, P)],
                                                         "l", *C, "n", "leaf")).checkpoint()
    q_down = down.select(F.col("ul").alias("uql"), *[F.col(p).alias(f"uq{i}") for i, p in enumerate(P)],
                         F.col("l").alias("ql"), *[F.col(c).alias(q) for c, q in zip(C, Q)], F.col("leaf").alias("q_leaf"))
    side = lambda lv: F.pow(F.lit(2.0), -F.col(lv) * BITS)
    box = lambda lv, cs: ([F.col(c) * side(lv) for c in cs], [(F.col(c) + 1) * side(lv) for c in cs])
    root = nodes.filter("l = 0")
    todo = root.select(F.col("l").alias("ql"), *[F.col(c).alias(q) for c, q in zip(C, Q)], F.col("leaf").alias("q_leaf"),
                       "l", *C, "n", "leaf", F.lit(float("inf")).alias("reach"), (~F.col("leaf")).cast("int").alias("open"))
    done, up = [], ["uql", *[f"uq{i}" for i in range(dim)]]
    near, far = _box_distance(*box("ql", Q), *box("l", C))
    while True:
        todo = todo.checkpoint()
        done.append(todo.filter("open = 0").select("ql", *Q, "l", *C, "n", "reach"))
        todo = todo.filter("open = 1")
        if todo.isEmpty():
            break
        wide = todo.select(F.col("ql").alias("uql"), *[F.col(q).alias(f"uq{i}") for i, q in enumerate(Q)],
                           F.col("l").alias("ul"), *[F.col(c).alias(p) for c, p in zip(C, P)], F.col("reach").alias("u_reach"))
        # what holds for all points of the parent holds for those of the child
        wide = wide.join(down, ["ul", *P]).join(q_down, up).filter(_in_reach(near, F.col("u_reach")))
        own = [*up, "ql", *Q]
        todo = _pruned(wide.select(*own, "q_leaf", "l", *C, "n", "leaf"), own, near, far, cap)
        more = F.max((~F.col("leaf") | ~F.col("q_leaf")).cast("int")).over(Window.partitionBy(*own))
        todo = todo.withColumn("open", more).drop(*up)
    return reduce(DataFrame.unionByName, done)


def _top_ids(points: DataFrame, groups: DataFrame, keys: list[str], cap: int, n: int) -> DataFrame:
    """The ``cap`` smallest ids per key, in two bounded phases.

    ``groups`` holds the size ``m`` of every key.  A key with more than
    ``rows`` points is split into ``ceil(m / rows)`` hash buckets; those keys
    number at most ``n / rows`` (kept under the broadcast limit), so the
    bucket count reaches the points by a broadcast join.  Phase one ranks
    inside a bucket (at most about ``rows`` points), phase two inside a key
    over at most ``buckets * cap`` survivors.
    """
    rows = max(ROWS_PER_TASK, math.ceil(n / MAX_BROADCAST_ROWS), cap)
    hot = groups.filter(F.col("m") > F.lit(rows)).select(
        *keys, F.ceil(F.col("m") / F.lit(float(rows))).cast("int").alias("_nb"))
    b = (points.join(F.broadcast(hot), keys, "left")
         .withColumn("_b", F.pmod(F.xxhash64("pid"), F.coalesce(F.col("_nb"), F.lit(1)))).drop("_nb"))
    w1 = Window.partitionBy(*keys, "_b").orderBy("pid")
    part = b.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= F.lit(cap)).drop("_r", "_b")
    w2 = Window.partitionBy(*keys).orderBy("pid")
    return part.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= F.lit(cap)).drop("_r")


def ordered_points(df: DataFrame, features: list[str], id_col: str | None) -> tuple[DataFrame, DataFrame | None]:
    """``(pid, f0..)`` with ``pid`` in the order of the caller's ids, and ``(pid, id0)`` to
    join these back (None without ``id_col``).  The numbers are checkpointed, not generated
    again; equal ids are spread by a second sort key."""
    if id_col is None:
        return number_points(df, features, [])[0], None
    checkpoint_dir(df.sparkSession)
    pts, _ = number_points(df, features, [id_col])
    pts = with_row_index(pts, ["id0", "pid"], "_n").drop("pid").withColumnRenamed("_n", "pid")
    return pts.select("pid", *fcols(len(features))), pts.select("pid", "id0")


def caller_ids(df: DataFrame, ids: DataFrame | None, **names: str) -> DataFrame:
    """Replace each number column ``old`` by the caller's id under the name ``new``
    (``old=new``), in front of the other columns."""
    rest = [c for c in df.columns if c not in names]
    for old in names:
        df = (df.withColumnRenamed(old, f"_{old}") if ids is None else
              df.join(ids.select(F.col("pid").alias(old), F.col("id0").alias(f"_{old}")), old).drop(old))
    return df.select(*[F.col(f"_{old}").alias(new) for old, new in names.items()], *rest)


def knn(df: DataFrame, features: list[str], k: int, id_col: str | None = None,
        include_self: bool = True, radius: float | None = None) -> DataFrame:
    """The ``k`` nearest neighbours of every point: ``(id, nbr_id, dist, rank)``, rank 1..k.

    ``radius`` has no effect: the search needs no first radius any more.
    """
    pts, ids = ordered_points(df, features, id_col)
    nn = knn_points(pts, len(features), k, include_self)
    return caller_ids(nn, ids, pid=id_col or "point_id", nbr_id="nbr_id")


def leaf_rows(cap: int) -> int:
    """Most points of a leaf of the tree, for queries that look at ``cap`` points."""
    return max(16, 2 * cap)


def candidate_pairs(pts: DataFrame, queries: DataFrame, dim: int, cap: int, n: int) -> DataFrame:
    """(pid, p_pid, dist): the pairs that hold the ``cap`` nearest of ``pts`` for every query;
    ``queries`` are some of ``pts``, known by ``pid``."""
    F_, C, Q, Y = fcols(dim), ccols(dim), ccols(dim, "q"), fcols(dim, "y")
    nodes, placed, span = _tree(pts, dim, leaf_rows(cap), n)
    lists = _cell_lists(nodes, dim, cap)
    asked = placed.join(queries.select("pid"), "pid", "left_semi").select(
        "pid", *F_, *Y, F.col("l").alias("ql"), *[F.col(c).alias(q) for c, q in zip(C, Q)])
    side = F.pow(F.lit(2.0), -F.col("l") * BITS)
    low, high = [F.col(c) * side for c in C], [(F.col(c) + 1) * side for c in C]
    own = [F.col(y) for y in Y]
    near, far = _box_distance(own, own, low, high)
    rows = asked.join(lists, ["ql", *Q]).filter(_in_reach(near, F.col("reach"))).drop("reach")
    rows = _pruned(rows, ["ql", *Q, "pid"], near, far, cap).select("pid", *F_, "reach", "l", *C)
    right = placed.select(F.col("pid").alias("p_pid"), *[F.col(f).alias(f"p_{f}") for f in F_], "l", *C)
    dist = euclid_distance(F_, [f"p_{f}" for f in F_])
    return (rows.join(right, ["l", *C]).filter(_in_reach(dist / F.lit(span), F.col("reach")))
            .select("pid", "p_pid", dist.alias("dist")))


def knn_points(pts: DataFrame, dim: int, k: int, include_self: bool = True) -> DataFrame:
    """k-NN of numbered points ``(pid, f0..)``: ``(pid, nbr_id, dist, rank)``."""
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = pts.sparkSession
    checkpoint_dir(spark)
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _knn(pts, dim, k, include_self)
    finally:  # every part of the result is checkpointed
        pts.unpersist()


def knn_beside_piles(pts: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``(piled, nn)``: the ``pid`` of points that more than ``k`` others equal, and the k-NN
    (without the point itself) of all other points.  Of a pile only its first ``k`` + 1 points are
    anyone's neighbours there."""
    spark = pts.sparkSession
    checkpoint_dir(spark)
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = pts.count()
        if n == 0:
            return pts.select("pid"), spark.createDataFrame([], NN_SCHEMA)
        piles, cand, queries = _piles(pts, dim, k + 1, n)
        piled = (pts.limit(0) if piles is None else piles[0]).select("pid").checkpoint()
        n = n if piles is None else cand.count()
        return piled, _nearest(candidate_pairs(cand, queries, dim, k + 1, n), k, False).checkpoint()
    finally:  # both parts of the result are checkpointed
        pts.unpersist()


NN_SCHEMA = "pid bigint, nbr_id bigint, dist double, rank int"


def _piles(pts: DataFrame, dim: int, cap: int, n: int) -> tuple[tuple | None, DataFrame, DataFrame]:
    """``((members, kept), candidates, queries)``: the points of coordinates with more than ``cap``
    copies, the ``cap`` smallest ids of each such coordinate, the points a query can have as
    neighbours, and those that share no such coordinate; the first is None if there is none."""
    F_ = fcols(dim)
    groups = pts.groupBy(*F_).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > F.lit(cap)).checkpoint()
    if groups.isEmpty():
        return None, pts, pts
    heavy = groups.select(*F_)
    members = pts.join(heavy, F_, "left_semi")
    kept = _top_ids(members, groups, F_, cap, n).checkpoint()
    queries = pts.join(heavy, F_, "left_anti").checkpoint()
    return (members, kept), queries.unionByName(kept.select("pid", *F_)), queries


def _nearest(pairs: DataFrame, k: int, include_self: bool) -> DataFrame:
    if not include_self:
        pairs = pairs.filter(F.col("p_pid") != F.col("pid"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("dist", "p_pid"))
    return (pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("pid", F.col("p_pid").alias("nbr_id"), "dist", F.col("rank").cast("int").alias("rank")))


def _knn(pts: DataFrame, dim: int, k: int, include_self: bool) -> DataFrame:
    n = pts.count()
    if n == 0:
        return pts.sparkSession.createDataFrame([], NN_SCHEMA)
    F_ = fcols(dim)
    cap = k if include_self else k + 1
    # 1. coordinates with more copies than any query can use
    parts: list[DataFrame] = []
    piles, cand, queries = _piles(pts, dim, cap, n)
    if piles is not None:
        hp, top = piles
        lists = top.groupBy(*F_).agg(F.array_sort(F.collect_list("pid")).alias("ids"))  # <= cap ids
        ans = hp.join(lists, F_)
        ids = F.col("ids") if include_self else F.filter("ids", lambda x: x != F.col("pid"))
        ans = ans.select("pid", F.posexplode(F.slice(ids, 1, k)).alias("_pos", "nbr_id"))
        parts.append(ans.select("pid", "nbr_id", F.lit(0.0).alias("dist"),
                                (F.col("_pos") + 1).cast("int").alias("rank")).checkpoint())
        n = cand.count()
    # 2. to 4. cells, lists, pairs
    parts.append(_nearest(candidate_pairs(cand, queries, dim, cap, n), k, include_self).checkpoint())
    return reduce(DataFrame.unionByName, parts)


def k_distance(df: DataFrame, features: list[str], k: int, id_col: str | None = None,
               include_self: bool = True, radius: float | None = None) -> DataFrame:
    """Distance of every point to its k-th nearest neighbour (self counts as the 1st)."""
    pts, ids = ordered_points(df, features, id_col)
    nn = knn_points(pts, len(features), k, include_self)
    return caller_ids(nn.groupBy("pid").agg(F.max("dist").alias("k_dist")), ids, pid=id_col or "point_id")


def k_distance_curve(df: DataFrame, features: list[str], k: int, id_col: str | None = None,
                     radius: float | None = None) -> DataFrame:
    """The sorted k-distance curve used to choose eps: ``(rank, k_dist)`` ascending."""
    from .dataset import order_curve
    return order_curve(k_distance(df, features, k, id_col, True), "k_dist")
