"""Comparison detectors, computed at scale: LOF, Mahalanobis distance
(classical and robust), isolation forest.

Each returns ``(id, score, prediction)`` where ``prediction`` is -1 for the
``contamination`` fraction of most anomalous rows (score below the exact
``contamination`` quantile of the scores, numpy's linear interpolation) and 1
otherwise.  Higher score = more normal, as in the usual ``score_samples``
convention.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform_hash
from ..session import checkpoint_dir, ship_package
from .dataset import exact_quantile
from .grid import fcols, number_points
from .neighbors import caller_ids, knn_beside_piles, ordered_points

LRD_EPS = 1e-10  # added to the mean reachability distance, as in the usual LOF definition


def _threshold(scored: DataFrame, idn: str, contamination: float, keep: bool = False) -> DataFrame:
    """``prediction`` from the exact quantile of the scores, found by counting.  The scores are read
    several times; with ``keep`` (they are dear to compute) they are written first."""
    if keep:
        checkpoint_dir(scored.sparkSession)
        scored = scored.checkpoint()
    t = exact_quantile(scored, "score", contamination)
    pred = F.when(F.col("score") < F.lit(t), F.lit(-1)).otherwise(F.lit(1)) if t is not None else F.lit(1)
    return scored.select(idn, "score", pred.cast("int").alias("prediction"))


def _points(df: DataFrame, features: list[str], id_col: str | None) -> tuple[DataFrame, str]:
    """Points with a generated ``pid``, and the column that names them in the result: the
    caller's id, which may be NULL, repeated and of any type, or the ``pid``."""
    return number_points(df, features, [id_col] if id_col else [])[0], "id0" if id_col else "pid"


# ---------------------------------------------------------------- LOF
def lof_scores(df: DataFrame, features: list[str], n_neighbors: int = 20,
               id_col: str | None = None, radius: float | None = None) -> DataFrame:
    """Negative local outlier factor per point: ``(id, score)``.

    k-NN without the point itself -> k-distance -> reachability distance
    ``max(k-dist(o), d(p, o))`` -> local reachability density ``1 / (mean + 1e-10)``
    -> LOF = mean of ``lrd(o) / lrd(p)`` over the neighbours.  Three joins on
    the k-NN table (at most n * k rows), keyed by point id.

    A point that more than k others equal has only such neighbours, all at distance 0: its
    k-distance is 0, its density ``1 / 1e-10``, its factor 1.  These piles, however large, take no
    part in the joins; as neighbours of other points they count with these values.
    """
    pts, ids = ordered_points(df, features, id_col)
    piled, nn = knn_beside_piles(pts, len(features), n_neighbors)
    kd = nn.groupBy("pid").agg(F.max("dist").alias("kdist"))
    # a neighbour that is no row of kd or lrd lies in a pile
    reach = nn.join(kd.select(F.col("pid").alias("nbr_id"), F.col("kdist").alias("nbr_kdist")), "nbr_id", "left") \
        .withColumn("rd", F.greatest(F.col("dist"), F.coalesce("nbr_kdist", F.lit(0.0))))
    lrd = reach.groupBy("pid").agg((F.lit(1.0) / (F.avg("rd") + F.lit(LRD_EPS))).alias("lrd"))
    ratio = (nn.join(lrd, "pid")
             .join(lrd.select(F.col("pid").alias("nbr_id"), F.col("lrd").alias("nbr_lrd")), "nbr_id", "left")
             .withColumn("ratio", F.coalesce("nbr_lrd", F.lit(1.0 / LRD_EPS)) / F.col("lrd")))
    scores = ratio.groupBy("pid").agg((-F.avg("ratio")).alias("score"))
    scores = scores.unionByName(piled.select("pid", F.lit(-1.0).alias("score")))
    return caller_ids(scores, ids, pid=id_col or "point_id")


def lof(df: DataFrame, features: list[str], contamination: float = 0.01, n_neighbors: int = 20,
        id_col: str | None = None, radius: float | None = None) -> DataFrame:
    idn = id_col or "point_id"
    return _threshold(lof_scores(df, features, n_neighbors, id_col), idn, contamination, keep=True)


# ---------------------------------------------------------------- Mahalanobis
def _moments(pts: DataFrame, dim: int):
    F_ = fcols(dim)
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(F_)]
    for i in range(dim):
        for j in range(i, dim):
            aggs.append(F.covar_pop(F_[i], F_[j]).alias(f"c{i}_{j}"))
    aggs.append(F.count(F.lit(1)).alias("n"))
    r = pts.agg(*aggs).first()
    mean = [float(r[f"m{i}"] or 0.0) for i in range(dim)]  # an empty input has no moments: zeros
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = float(r[f"c{i}_{j}"] or 0.0)
    return mean, cov, int(r["n"])


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cov)


def _sq_mahalanobis(mean, inv, dim: int):
    """``(x - m)^T inv (x - m)`` as a column expression (constants are literals)."""
    F_ = fcols(dim)
    dx = [F.col(f) - F.lit(mean[i]) for i, f in enumerate(F_)]
    expr = None
    for i in range(dim):
        for j in range(dim):
            t = dx[i] * F.lit(float(inv[i, j])) * dx[j]
            expr = t if expr is None else expr + t
    return expr


def mahalanobis(df: DataFrame, features: list[str], contamination: float = 0.01,
                id_col: str | None = None) -> DataFrame:
    """Classical Mahalanobis distance to the mean; score = -squared distance.

    One pass for means and population covariances (d + d^2 numbers), a d x d
    inverse on the driver, then a per-row expression.
    """
    dim = len(features)
    idn = id_col or "point_id"
    pts, own = _points(df, features, id_col)
    mean, cov, _ = _moments(pts, dim)
    scored = pts.select(F.col(own).alias(idn), (-_sq_mahalanobis(mean, _inverse(cov), dim)).alias("score"))
    return _threshold(scored, idn, contamination)


def _chi2_quantile(p: float, dim: int) -> float:
    """Quantile of the chi-squared distribution with ``dim`` degrees of freedom, by bisection."""
    def cdf(x):  # series of the regularized incomplete gamma function
        a, h = dim / 2.0, x / 2.0
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= h / k
            total += term
        return total * math.exp(a * math.log(h) - h - math.lgamma(a))
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def _sq_distances(batch, fit, dim: int) -> np.ndarray:
    X = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in fcols(dim)]) - fit[0]
    return np.maximum(((X @ fit[1]) * X).sum(1), 0.0) + 0.0  # no -0.0: its bits sort last


GATHER_ROWS = 100_000  # distances sorted on the driver once the digits are narrowed this far


def _kth_distances(pts: DataFrame, fits: list, ks: list[int], dim: int) -> list[float]:
    """For each fit (mean, inverse) the exact k-th smallest squared distance.

    Selection by digits: the bits of a non-negative double sort as it does, so each pass
    counts one digit (16, then 12 bits) of the rows that share the digits found so far, for
    all fits together.  The last few values are sorted on the driver.
    """
    feats = pts.select(*fcols(dim))
    prefix, left, shift = [0] * len(fits), list(ks), 64
    while shift > 0:
        width = 16 if shift == 64 else 12
        step = shift - width

        def digits(batches, prefix=tuple(prefix), shift=shift, step=step):
            for batch in batches:
                out = []
                for i, fit in enumerate(fits):
                    v = _sq_distances(batch, fit, dim).view(np.int64)
                    v = v if shift == 64 else v[v >> shift == prefix[i]]
                    d, c = np.unique(v >> step, return_counts=True)
                    out.append((np.full(len(d), i), d, c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["i", "d", "c"])

        hist = (feats.mapInArrow(digits, "i long, d long, c long").groupBy("i", "d")
                .agg(F.sum("c").alias("c")).toPandas().sort_values(["i", "d"]))
        rest = 0
        for i, g in hist.groupby("i"):
            below = g["c"].cumsum().to_numpy()
            at = int(np.searchsorted(below, left[i]))
            left[i] -= int(below[at - 1]) if at else 0
            prefix[i] = int(g["d"].iloc[at])
            rest += int(g["c"].iloc[at])
        shift = step
        if rest <= GATHER_ROWS:
            break

    if shift == 0:
        return np.array(prefix, dtype=np.int64).view(np.float64).tolist()

    def values(batches):
        for batch in batches:
            out = []
            for i, fit in enumerate(fits):
                v = _sq_distances(batch, fit, dim)
                v = v[v.view(np.int64) >> shift == prefix[i]]
                out.append((np.full(len(v), float(i)), v))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["i", "v"])

    rows = feats.mapInArrow(values, "i double, v double").toPandas()  # at most GATHER_ROWS
    got = {int(i): np.sort(g["v"].to_numpy()) for i, g in rows.groupby("i")}
    return [float(got[i][left[i] - 1]) for i in range(len(fits))]


def _moments_within(pts: DataFrame, fits: list, cuts: list[float], center, dim: int) -> list:
    """(mean, population covariance) of the rows within each fit's cut, one pass for all."""
    center = np.asarray(center, dtype=float)

    def sums(batches):
        total = np.zeros((len(fits), 1 + dim + dim * dim))
        for batch in batches:
            X = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in fcols(dim)]) - center
            for i, fit in enumerate(fits):
                Y = X[_sq_distances(batch, fit, dim) <= cuts[i]]
                total[i] += np.concatenate(([len(Y)], Y.sum(0), (Y.T @ Y).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(fits))), *[pa.array(c) for c in total.T.copy()]],
            ["i", *[f"t{j}" for j in range(total.shape[1])]])

    width = 1 + dim + dim * dim
    rows = (pts.select(*fcols(dim)).mapInArrow(sums, "i long, " + ", ".join(f"t{j} double" for j in range(width)))
            .groupBy("i").agg(*[F.sum(f"t{j}").alias(f"t{j}") for j in range(width)]).collect())
    out = [None] * len(fits)
    for r in rows:
        t = np.array(r[1:], dtype=float)
        mean = t[1:1 + dim] / t[0]
        cov = t[1 + dim:].reshape(dim, dim) / t[0] - np.outer(mean, mean)
        out[r["i"]] = (mean + center, (cov + cov.T) / 2)
    return out


def robust_mahalanobis(df: DataFrame, features: list[str], contamination: float = 0.01,
                       id_col: str | None = None, n_starts: int | None = None,
                       max_steps: int | None = None, seed: int = 100) -> DataFrame:
    """Mahalanobis distance under a reweighted minimum-covariance-determinant fit.

    Concentration steps: from a fit, keep the ``h = (n + d + 1) // 2`` rows closest under
    it, refit; the determinant never increases.  All starts take two steps together over all
    rows; the best ten are stepped until none improves, and the smallest determinant wins.  Its covariance is
    scaled to the median distance, and the fit of the rows within the 97.5 % quantile of
    the chi-squared distribution gives the scores.

    The starts are four robust fits of all rows (:func:`_robust_starts`), whatever the dimension;
    ``n_starts`` adds that many random ones, each the fit of ``d + 1`` rows (more if these lie in a
    plane).  ``max_steps`` ends the steps early, with a warning.  Only moments, at most
    65,536 counts per start and ``GATHER_ROWS`` distances reach the driver.
    """
    dim = len(features)
    idn = id_col or "point_id"
    ship_package(df.sparkSession)
    pts, own = _points(df, features, id_col)
    kept = pts.persist()
    try:
        center, cov, n = _moments(kept, dim)
        mean = np.asarray(center)
        if n > 0:
            mean, cov = _mcd(kept, dim, center, cov, n, n_starts, max_steps, seed)
    finally:
        kept.unpersist()
    scored = pts.select(F.col(own).alias(idn),
                        (-_sq_mahalanobis([float(m) for m in mean], _inverse(cov), dim)).alias("score"))
    return _threshold(scored, idn, contamination)


MIDDLE = 10_000  # accuracy of the sketches behind the medians of the starts


def _median_scale(df: DataFrame, cols: list[str], instead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled median deviation of each column (bounded sketches, two passes for all
    columns); a deviation of zero, where half the rows are equal, is replaced by ``instead``."""
    mid = df.agg(*[F.percentile_approx(c, 0.5, MIDDLE) for c in cols]).first()
    far = df.agg(*[F.percentile_approx(F.abs(F.col(c) - F.lit(float(m))), 0.5, MIDDLE)
                   for c, m in zip(cols, mid)]).first()
    scale = 1.4826 * np.array(far, dtype=float)
    return np.array(mid, dtype=float), np.where(scale > 0, scale, instead)


def _robust_starts(pts: DataFrame, dim: int, cov: np.ndarray) -> list:
    """Four deterministic fits that a large minority of outliers cannot carry away.

    Each axis is centred by its median and divided by its median deviation.  Covariances of four
    transforms (tanh, signs, directions, the half of the rows nearest to the centre) give axes;
    along these, medians and median deviations of all rows give the centre and spread of a fit.
    """
    F_ = fcols(dim)
    spread = np.sqrt(np.diag(cov))
    mid, scale = _median_scale(pts, F_, np.where(spread > 0, spread, 1.0))
    z = pts.select(*[((F.col(f) - F.lit(float(m))) / F.lit(float(s))).alias(f) for f, m, s in zip(F_, mid, scale)])
    far = F.sqrt(sum((F.col(f) * F.col(f) for f in F_[1:]), F.col(F_[0]) * F.col(F_[0])))
    z = z.withColumn("far", far)
    half = z.agg(F.percentile_approx("far", 0.5, MIDDLE)).first()[0]
    frames = [z.select(*[F.tanh(f).alias(f) for f in F_]), z.select(*[F.signum(f).alias(f) for f in F_]),
              z.filter(F.col("far") > 0).select(*[(F.col(f) / F.col("far")).alias(f) for f in F_]),
              z.filter(F.col("far") <= F.lit(half))]
    axes = [np.linalg.eigh(_moments(frame, dim)[1])[1] for frame in frames]
    names = [f"s{i}_{j}" for i in range(len(axes)) for j in range(dim)]
    along = z.select(*[sum((F.col(f) * F.lit(float(w)) for f, w in zip(F_[1:], axes[i][1:, j])),
                           F.col(F_[0]) * F.lit(float(axes[i][0, j]))).alias(f"s{i}_{j}")
                       for i in range(len(axes)) for j in range(dim)])
    at, wide = _median_scale(along, names, np.ones(len(names)))
    fits = []
    for i, E in enumerate(axes):
        own = slice(i * dim, (i + 1) * dim)
        back = scale[:, None] * E
        fits.append((mid + back @ at[own], (back * wide[own] ** 2) @ back.T))
    return fits


def _random_starts(pts: DataFrame, dim: int, cov: np.ndarray, n_starts: int, seed: int) -> list:
    if not n_starts:
        return []
    rank = np.linalg.matrix_rank(cov)
    rows = pts.orderBy(uniform_hash("pid", seed), "pid").limit(n_starts * (dim + 1)).select(*fcols(dim)).toPandas()
    rows, rng, fits = rows.to_numpy(dtype=float), np.random.default_rng(seed), []
    for _ in range(n_starts):
        order, m = rng.permutation(len(rows)), min(dim + 1, len(rows))
        while m < len(rows) and np.linalg.matrix_rank(np.cov(rows[order[:m]].T, bias=True).reshape(dim, dim)) < rank:
            m += 1
        fits.append((rows[order[:m]].mean(0), np.cov(rows[order[:m]].T, bias=True).reshape(dim, dim)))
    return fits


def _mcd(pts: DataFrame, dim: int, center, cov, n: int, n_starts: int | None, max_steps: int | None, seed: int):
    h = min((n + dim + 1) // 2, n)
    fits = _robust_starts(pts, dim, cov) + _random_starts(pts, dim, cov, n_starts or 0, seed)

    def step(fits):
        inv = [(m, _inverse(c)) for m, c in fits]
        return _moments_within(pts, inv, _kth_distances(pts, inv, [h] * len(inv), dim), center, dim)

    det = lambda fit: float(np.linalg.det(fit[1]))
    fits = sorted(step(step(fits)), key=det)[:10]
    done, steps = [], 2
    while fits and (max_steps is None or steps < max_steps):
        after = step(fits)
        better = [det(b) < det(a) * (1 - 1e-12) for a, b in zip(fits, after)]
        done += [a for a, x in zip(fits, better) if not x]
        fits = [b for b, x in zip(after, better) if x]
        steps += 1
    if fits:
        warnings.warn(f"robust_mahalanobis: {len(fits)} fits had not converged after {steps} steps")
    mean, cov = min(done + fits, key=det)
    inv = (mean, _inverse(cov))
    middle = np.mean(_kth_distances(pts, [inv, inv], [(n + 1) // 2, n // 2 + 1], dim))
    cut = _chi2_quantile(0.975, dim) * middle / _chi2_quantile(0.5, dim)
    return _moments_within(pts, [inv], [cut], center, dim)[0]


# ---------------------------------------------------------------- isolation forest
EULER_GAMMA = 0.5772156649


def _avg_path(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow_tree(pdf: pd.DataFrame, dim: int, max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng(seed * 100003 + tree)
    X = pdf[fcols(dim)].to_numpy(dtype=float)
    rows = []  # node, feature, threshold, left, right, size, depth

    def build(idx, depth):
        node = len(rows)
        rows.append([node, -1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return node
        xs = X[idx]
        feats = [f for f in rng.permutation(dim) if xs[:, f].max() > xs[:, f].min()]
        if not feats:
            return node
        f = int(feats[0])
        lo, hi = xs[:, f].min(), xs[:, f].max()
        thr = float(rng.uniform(lo, hi))
        left_idx, right_idx = idx[xs[:, f] < thr], idx[xs[:, f] >= thr]
        rows[node][1], rows[node][2] = f, thr
        rows[node][3] = build(left_idx, depth + 1)
        rows[node][4] = build(right_idx, depth + 1)
        return node

    build(np.arange(len(X)), 0)
    out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "tree", tree)
    return out


TREE_SCHEMA = ("tree long, node long, feature long, threshold double, left long, right long, "
               "size long, depth long")


def _draw(pts: DataFrame, n_trees: int, p: float, seed: int) -> DataFrame:
    """(row, tree) with each pair kept with probability ``p``, without a row per pair: one number
    tells the first tree that takes a row, and only rows with such a tree look at the later ones."""
    last = F.lit(n_trees - 1).cast("bigint")
    if p >= 1:
        return pts.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.floor(F.log1p(-uniform_hash("pid", seed)) / F.lit(math.log1p(-p)))
    some = pts.withColumn("tree0", first).filter(F.col("tree0") < n_trees)
    later = F.when(F.col("tree0") < last, F.filter(
        F.sequence(F.col("tree0") + 1, last),
        lambda t: uniform_hash(F.struct(F.col("pid"), t), seed + 1) < F.lit(p))).otherwise(F.array().cast("array<bigint>"))
    return some.withColumn("tree", F.explode(F.concat(F.array("tree0"), later))).drop("tree0")


def forest_sample(pts: DataFrame, n: int, n_trees: int, max_samples: int, seed: int) -> DataFrame:
    """Exactly ``min(max_samples, n)`` of the ``n`` rows for every tree: ``pts`` with ``tree``.

    Rows are drawn with a little more than the probability needed, the least numbers of each tree
    stay, and a tree that got too few (less than once in 10^9) has the draw repeated with
    twice the probability.  About ``n_trees * (max_samples + 8 sqrt(max_samples))`` rows leave the scan.
    """
    psi = min(max_samples, n)
    p = min(1.0, (psi + 8 * math.sqrt(psi) + 8) / max(n, 1))
    w = Window.partitionBy("tree").orderBy(uniform_hash(F.struct("pid", "tree"), seed + 2), "pid")
    checkpoint_dir(pts.sparkSession)
    while True:
        got = (_draw(pts, n_trees, p, seed).withColumn("_r", F.row_number().over(w))
               .filter(F.col("_r") <= psi).drop("_r").checkpoint())
        if p >= 1 or got.count() == psi * n_trees:
            return got
        p = min(1.0, 2 * p)


def isolation_forest_scores(df: DataFrame, features: list[str], id_col: str | None = None,
                            n_trees: int = 100, max_samples: int = 256, seed: int = 100) -> DataFrame:
    """``(id, score)`` with score = -(anomaly score) in [-1, 0].

    Trees: each tree draws exactly ``min(max_samples, n)`` rows (:func:`forest_sample`) by hashes of
    the generated point number, so rows that share an id are drawn one by one; the trees are
    grown in ``applyInPandas`` per tree id.  The forest is bounded by
    ``n_trees * (2 * max_samples - 1)`` nodes, whatever the data size, and is
    shipped with the scoring function; rows are scored in Arrow batches with
    ``mapInArrow``.
    """
    dim = len(features)
    idn = id_col or "point_id"
    ship_package(df.sparkSession)
    pts, own = _points(df, features, id_col)
    n = pts.count()
    psi = max(1, min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    forest_df = forest_sample(pts, n, n_trees, max_samples, seed).groupBy("tree").applyInPandas(
        lambda pdf: _grow_tree(pdf, dim, max_depth, seed), TREE_SCHEMA)
    forest = forest_df.toPandas()  # bounded by n_trees * (2 * max_samples - 1) rows
    trees = []
    for _, t in forest.groupby("tree"):
        t = t.sort_values("node")
        trees.append(tuple(t[c].to_numpy() for c in ["feature", "threshold", "left", "right", "size", "depth"]))
    c_psi = float(_avg_path([psi])[0]) or 1.0
    F_ = fcols(dim)

    def score(batches):
        for b in batches:
            X = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in F_])
            total = np.zeros(len(X))
            for feat, thr, left, right, size, depth in trees:
                node = np.zeros(len(X), dtype=np.int64)
                for _ in range(max_depth + 1):
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    xv = X[np.arange(len(X)), np.where(inner, f, 0)]
                    nxt = np.where(xv < thr[node], left[node], right[node])
                    node = np.where(inner, nxt, node)
                total += depth[node] + _avg_path(size[node])
            mean_h = total / max(len(trees), 1)
            yield pa.RecordBatch.from_arrays([b.column(own), pa.array(-np.power(2.0, -mean_h / c_psi))],
                                             [idn, "score"])

    return pts.mapInArrow(score, f"`{idn}` {dict(pts.dtypes)[own]}, score double")


def isolation_forest(df: DataFrame, features: list[str], contamination: float = 0.01,
                     id_col: str | None = None, n_trees: int = 100, max_samples: int = 256,
                     seed: int = 100) -> DataFrame:
    idn = id_col or "point_id"
    return _threshold(isolation_forest_scores(df, features, id_col, n_trees, max_samples, seed),
                      idn, contamination, keep=True)
