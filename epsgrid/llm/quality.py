"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata, scored in time linear in the features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from epsgrid.llm.common import training_rows
from epsgrid.llm.features import collect_features, flat, scored, sigmoid, word_and_structure

SIZE = 1 << 16     # hash buckets
RANK = 6           # factors of a pairwise interaction
MAX_ROWS = 8000    # labelled rows that the model is fitted on


class FactorisationMachine:
    """p(x) = sigmoid(b + w.x + sum_{i<j} <v_i, v_j> x_i x_j).

    The pair sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
    """

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 7):
        self.size, self.b = size, 0.0
        self.w = np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def raw(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        return float(self.b + self.w[idx] @ val + 0.5 * ((vx.sum(0) ** 2) - (vx ** 2).sum(0)).sum())

    def score(self, text: str) -> float:
        return float(sigmoid(self.raw(*word_and_structure(text, self.size))))

    def fit(self, rows: list, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05,
            l2: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """Logistic loss, adaptive gradient steps over shuffled batches."""
        if not len(rows):
            self.b = 0.0
            return self
        rate_y = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.b = float(np.log(rate_y / (1 - rate_y)))
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-8, np.full(self.size, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = order[k:k + batch]
                starts, row, idx, val = flat([rows[i] for i in part])
                vi = self.v[idx]
                vx = vi * val[:, None]
                s = np.add.reduceat(vx, starts)
                pair = 0.5 * (s ** 2 - np.add.reduceat(vx ** 2, starts)).sum(1)
                p = sigmoid(self.b + np.add.reduceat(self.w[idx] * val, starts) + pair)
                err = (p - y[part]) / len(part)
                e = err[row] * val
                uniq, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, weights=e) + l2 * self.w[uniq]
                full = e[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(inv, weights=full[:, f]) for f in range(full.shape[1])], 1)
                dv += l2 * self.v[uniq]
                gw[uniq] += dw ** 2
                gv[uniq] += dv ** 2
                gb += err.sum() ** 2
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
                self.b -= rate * err.sum() / np.sqrt(gb)
        return self


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, chosen by a hash
    of the id; without any labelled row every score is 0.5."""
    rows = training_rows(docs, labels, "quality", max_rows)
    x, y = collect_features(rows, lambda t: word_and_structure(t, SIZE))
    return FactorisationMachine().fit(x, y)


def score_documents(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, whole texts.

    A null text counts as empty and is scored by its structure bins alone; null ids and
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    return scored(docs, model, threshold)
