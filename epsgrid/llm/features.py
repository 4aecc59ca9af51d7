"""Hashed features of whole texts for the trained classifiers, computed in Python tasks."""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from epsgrid.llm.common import map_arrow

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
SPACE = b" \t\n\r\x0b\x0c"
HIGH = bytes(range(128, 256))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
MARKS_TO_SPACE = bytes.maketrans(MARKS, b" " * len(MARKS))


def structure(text: str, data: bytes, tokens: list[bytes], kinds: int) -> list[tuple[str, int]]:
    """Binned statistics of a text: shares of character classes, word and line shape,
    repetition, length."""
    n = max(len(data), 1)
    share = lambda drop: int(20 * (n - len(data.translate(None, drop))) / n)
    lines = text.split("\n")
    words = max(len(tokens), 1)
    return [("upper", share(UPPER)), ("digit", share(DIGIT)), ("space", share(SPACE)),
            ("marks", share(MARKS)), ("bar", share(b"|")), ("high", share(HIGH)), ("plain", share(LOWER)),
            ("chars", int(math.log2(len(text) + 1))), ("word", min(int(2 * len(data) / words), 60)),
            ("kinds", int(10 * kinds / words)), ("lines", int(math.log2(len(lines)))),
            ("same", int(10 * len(set(lines)) / len(lines))),
            ("line", int(math.log2(len(text) / len(lines) + 1)))]


def word_and_structure(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: log counts of lower-case words of unit length together, then one
    bucket per (statistic, bin) and per number of code points (the table's metadata that a
    text fixes itself), each with value 0.5."""
    data = text.encode("utf-8", "replace")
    tokens = data.lower().split()
    seen = Counter(tokens)
    extra = [crc32(f"\0{k}={v}".encode()) % size for k, v in structure(text, data, tokens, len(seen))]
    idx = np.fromiter((crc32(w) % size for w in seen), dtype=np.int64, count=len(seen))
    val = np.log1p(np.fromiter(seen.values(), dtype=np.float64, count=len(seen)))
    if len(val):
        val /= np.sqrt((val ** 2).sum())
    return (np.concatenate((idx, np.array(extra, dtype=np.int64))),
            np.concatenate((val, np.full(len(extra), 0.5))))


def plain_words(text: str) -> list[bytes]:
    """Lower-case words without punctuation marks, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(MARKS_TO_SPACE).split()


def collect_features(rows: DataFrame, feature) -> tuple[list, np.ndarray]:
    """Features and labels of (doc_id, text, y) rows, ordered by id, which may be of any type that
    sorts.  The rows are a bounded sample and only their features come to the driver."""

    def run(batches):
        for batch in batches:
            for i, text, y in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                idx, val = feature(text or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], batch.column(0).type), pa.array([idx.tolist()], pa.list_(pa.int32())),
                     pa.array([val.tolist()], pa.list_(pa.float32())), pa.array([float(y)])],
                    ["doc_id", "idx", "val", "y"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = map_arrow(rows, run, f"doc_id {kind}, idx array<int>, val array<float>, y double").toArrow()
    order = pc.sort_indices(table.column("doc_id")).to_numpy()  # stable
    idx, val = table.column("idx").to_pylist(), table.column("val").to_pylist()
    y = table.column("y").to_numpy()
    return [(np.array(idx[i], dtype=np.int64), np.array(val[i])) for i in order], y[order]


def flat(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (buckets, values) laid end to end: start of each row, row number, buckets, values."""
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return (starts, np.repeat(np.arange(len(rows)), sizes),
            np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by a broadcast model with ``score(text)``."""
    from epsgrid.llm.common import held_out, pick
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = pick(docs, "doc_id", "text").withColumn("held_out", held_out())

    def run(batches):
        m = shared.value
        for batch in batches:
            s = np.array([m.score(t.as_py() or "") for t in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_arrow(src, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
