"""Toxicity classifier with a counterfactual penalty.

A sparse logistic model on the words of a text (and their beginnings, for inflected
forms).  Besides the log loss on labelled documents it minimises the squared change of
the score when a labelled sentence's identity term is swapped for another, or put in
place of a neutral word, so a mere mention of a group moves no score.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from epsgrid.llm.common import map_arrow, prepare, training_rows
from epsgrid.llm.features import collect_features, flat, plain_words, scored, sigmoid

SIZE = 1 << 18
MAX_ROWS = 8000       # labelled rows that the model is fitted on
MAX_SENTENCES = 4000  # counterfactual twins of labelled sentences
PREFIX = 6            # bytes of a word's beginning
WEIGHT = 20.0         # of the mean squared change of the score between twins, against the mean log loss

# Terms that name groups of people, swapped for each other.
IDENTITY = ("women", "men", "woman", "man", "girls", "boys", "gay", "straight", "lesbian", "transgender",
            "black", "white", "asian", "latino", "african", "american", "european", "arab",
            "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrants", "refugees",
            "old", "young", "disabled", "deaf", "blind", "frauen", "männer", "juden", "muslime", "christen",
            "femmes", "hommes", "juifs", "musulmans", "mujeres", "hombres", "judíos", "musulmanes")


def features(words) -> tuple[np.ndarray, np.ndarray]:
    """Presence of words and of word beginnings, as sorted buckets with value 1."""
    seen = set(words)
    idx = {crc32(w) % SIZE for w in seen}
    idx |= {crc32(b"^" + w[:PREFIX]) % SIZE for w in seen if len(w) > PREFIX}
    out = np.fromiter(sorted(idx), dtype=np.int64, count=len(idx))
    return out, np.ones(len(out))


class CounterfactualModel:
    def __init__(self):
        self.b, self.w = 0.0, np.zeros(SIZE)

    def score(self, text: str) -> float:
        idx, _ = features(plain_words(text))
        return float(sigmoid(self.b + self.w[idx].sum()))

    def fit(self, rows: list, y: np.ndarray, twins: list, steps: int = 400, l1: float = 4e-4, l2: float = 1e-4,
            weight: float = WEIGHT, min_rows: int = 5) -> CounterfactualModel:
        """Accelerated proximal gradient steps on log loss, penalty and norms.  ``twins`` are pairs of
        feature rows that must score alike; words in fewer than ``min_rows`` rows get no weight, but for those that a
        twin changes."""
        if not len(rows):
            return self
        starts, row, idx, _ = flat(rows)
        used = np.bincount(idx, minlength=SIZE) >= min_rows
        for a, c in twins:
            used[np.setxor1d(a[0], c[0])] = True  # what a swap changes always has a weight to penalise
        ids = np.flatnonzero(used)
        at = np.full(SIZE, -1)
        at[ids] = np.arange(len(ids))
        keep = at[idx] >= 0
        row, col = row[keep], at[idx][keep]
        pos = max(y.mean(), 1e-3)
        wt = np.where(y > 0, 0.5 / pos, 0.5 / max(1 - pos, 1e-3)) ** 0.5
        wt = wt / wt.sum()
        ta, tc = ([at[x[0]][at[x[0]] >= 0] for x in side] for side in (zip(*twins) if twins else ((), ())))
        trow = np.concatenate([np.full(len(x), i) for i, x in enumerate(ta)] or [[]]).astype(int)
        tcol = np.concatenate(ta or [[]]).astype(int)
        crow = np.concatenate([np.full(len(x), i) for i, x in enumerate(tc)] or [[]]).astype(int)
        ccol = np.concatenate(tc or [[]]).astype(int)
        n, d, m = len(y), len(ids), len(ta)
        w, b, wp, bp, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
        rate = 1.0 / (0.25 * np.bincount(row, minlength=n).mean() + 1.0) * 4
        loss_before = np.inf
        for _ in range(steps):
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            zw, zb = w + (t - 1) / t2 * (w - wp), b + (t - 1) / t2 * (b - bp)
            s = zb + np.bincount(row, weights=zw[col], minlength=n)
            p = sigmoid(s)
            err = wt * (p - y)
            g = np.bincount(col, weights=err[row], minlength=d) + l2 * zw
            gb = err.sum()
            if m:
                pa_ = sigmoid(zb + np.bincount(trow, weights=zw[tcol], minlength=m))
                pc = sigmoid(zb + np.bincount(crow, weights=zw[ccol], minlength=m))
                diff = weight * 2 * (pa_ - pc) / m
                ga, gc = diff * pa_ * (1 - pa_), -diff * pc * (1 - pc)
                g += np.bincount(tcol, weights=ga[trow], minlength=d) + np.bincount(ccol, weights=gc[crow], minlength=d)
                gb += (ga + gc).sum()
            nw = zw - rate * g
            nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * l1, 0)
            nb = zb - rate * gb
            loss = -(wt * np.log(np.where(y > 0, p, 1 - p) + 1e-12)).sum() + l1 * np.abs(zw).sum() + l2 / 2 * (zw ** 2).sum()
            if m:
                loss += weight * ((pa_ - pc) ** 2).mean()
            if loss > loss_before + 1e-3:  # too long a step: shorten it and restart the momentum
                rate, t2, nw, nb = rate / 2, 1.0, w, b
                loss_before = np.inf
            else:
                loss_before = loss
            w, wp, b, bp, t = nw, w, nb, b, t2
        self.w[ids], self.b = w, float(b)
        return self


def twin_sentences(rows: DataFrame, max_sentences: int) -> list:
    """Feature pairs of labelled sentences and their counterfactual twins.

    A sentence with an identity term gets it swapped for the next term of the list, and left
    out; any other sentence, chosen by a hash, gets one of its words replaced by two different
    terms, so the pair differs in the term alone.
    """
    terms = [t.encode() for t in IDENTITY]
    swap = dict(zip(terms, terms[1:] + terms[:1]))

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, sentence in enumerate((text or "").replace("\n", ".").split(".")):
                    words = plain_words(sentence)
                    if len(words) < 3:
                        continue
                    h = crc32(f"{doc}:{k}".encode())
                    twins = []
                    if any(w in swap for w in words):
                        twins = [(words, [swap.get(w, w) for w in words]), (words, [w for w in words if w not in swap])]
                    elif h % 8 == 0:
                        at, term = h % len(words), terms[h // 8 % len(terms)]
                        a, b = list(words), list(words)
                        if h % 16 == 0:  # a mention against none
                            a[at:at + 1], b[at:at + 1] = [term], []
                        else:
                            a[at], b[at] = term, swap[term]
                        twins = [(a, b)]
                    if twins:
                        sides = [pa.array([features(x)[0].tolist() for x in side], pa.list_(pa.int32())) for side in zip(*twins)]
                        yield pa.RecordBatch.from_arrays([pa.array([h] * len(twins), pa.int64()), *sides], ["h", "a", "b"])

    got = (map_arrow(rows.select("doc_id", "text"), run, "h long, a array<int>, b array<int>")
           .orderBy("h", "a", "b").limit(max_sentences).toArrow())
    as_row = lambda x: (np.array(x, dtype=np.int64), np.ones(len(x)))
    return [(as_row(a), as_row(b)) for a, b in zip(got.column("a").to_pylist(), got.column("b").to_pylist())]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
          max_sentences: int = MAX_SENTENCES, weight: float = WEIGHT) -> CounterfactualModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold and at most
    ``max_sentences`` of their sentences; without labelled rows every score is 0.5."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, "toxic", max_rows).checkpoint()
    x, y = collect_features(rows, lambda t: features(plain_words(t)))
    return CounterfactualModel().fit(x, y, twin_sentences(rows, max_sentences) if len(x) else [], weight=weight)


def score_documents(docs: DataFrame, model: CounterfactualModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, whole texts.

    A null text counts as empty: its score is the model's bias.  Null ids and repeated rows
    stay; other columns are ignored; an empty table gives no rows.
    """
    return scored(docs, model, threshold)
