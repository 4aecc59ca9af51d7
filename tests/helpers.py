"""Data folders and brute-force definitions shared by the tests."""

import numpy as np

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def brute_labels(X: np.ndarray, eps: float, min_pts: int, inclusive: bool = False) -> list[str]:
    """Reference definition by exhaustive pairwise distances (small inputs only)."""
    X = np.asarray(X, dtype=float)
    if len(X) == 0:
        return []
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    near = d <= eps if inclusive else d < eps
    core = near.sum(1) >= min_pts
    has_core = (near & core[None, :]).any(1)
    return ["core" if c else ("border" if h else "outlier") for c, h in zip(core, has_core)]


def labels_of(det_labels, id_col="point_id"):
    return {r[id_col]: r["label"] for r in det_labels.collect()}
