"""SimHash near-duplicates with covering locality-sensitive hashing.

64-bit fingerprints of word shingles are linked at ``radius`` or fewer differing bits.
Bit i gets a nonzero vector phi(i) of radius + 1 bits; table v (each nonzero vector) keeps
the bits with an odd <phi(i), v>.  The vectors of ``radius`` differing bits span at most
``radius`` dimensions, so some v is orthogonal to all of them: that table's mask hides
every differing bit, and each pair within the radius collides there.  No pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from epsgrid.llm.common import map_arrow, pick, prepare
from epsgrid.llm.graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 2048          # fingerprints of one bucket that a task compares at a time
SHINGLES_AT_ONCE = 200_000


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering."""
    top = (1 << (radius + 1)) - 1
    phi = [1 + i % top for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def fingerprint(text: str, shingle: int, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles (repeats included) of a text's words; words
    are runs without ASCII white space, A-Z in lower case; fewer words than a shingle make
    one of the whole sequence; no word makes 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1).cumsum() - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    a, b = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    votes, n = np.zeros(64, dtype=np.int64), len(a)
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([xxh64_intdigest(joined[s:e], seed)
                      for s, e in zip(a[at:at + SHINGLES_AT_ONCE], b[at:at + SHINGLES_AT_ONCE])], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    out = 0
    for bit in (2 * votes > n).tolist():
        out = out << 1 | bit
    return out


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    src = pick(docs, "doc_id", "text")
    return map_arrow(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def spanning_links(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that connect what pairs within the radius connect: a breadth-first walk over the
    rows not reached yet, so a bucket gives fewer links than it has rows."""
    left, u, v = fps.view(np.uint64), [], []  # bitwise_count takes a signed number's magnitude
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                u += [int(x.view(np.int64))] * len(found)
                v += found.view(np.int64).tolist()
                todo += list(found)
                left = left[~near]
    return u, v


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp``, enough to connect all pairs within
    the radius.

    Each fingerprint goes to one bucket of each table.  Buckets of over ``tile`` rows are cut
    into parts by a hash, and every pair of parts meets in a tile of its own, so a task never
    holds more than about two parts, however large a bucket is, and no comparison is lost.
    """
    keyed = (distinct.select("fp", F.posexplode(F.array(*[
        F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(radius)])).alias("t", "mask"))
        .select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))
    big = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    big = (big.withColumn("parts", F.ceil(F.col("n") / tile).cast("int")).drop("n").checkpoint())
    # buckets of one row link nothing: the join drops them
    rows = keyed.join(big, ["t", "key"])
    part = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
    rows = (rows.withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("fp", "t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")))
    cell = ["t", "key", "i", "j"]
    rows = rows.repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        held, last = [], None

        def close():
            u, v = spanning_links(np.concatenate(held), radius)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp, *key = (batch.column(c).to_numpy() for c in ["fp", *cell])
            new = np.zeros(len(fp), dtype=bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:]):
                here = tuple(int(k[a]) for k in key)
                if here != last and held:
                    if len(held) > 1 or len(held[0]) > 1:
                        yield from close()
                    held = []
                held.append(fp[a:b])
                last = here
        if held:
            yield from close()

    return map_arrow(rows, run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links), one row per input row.

    component_id is the smallest doc_id reachable over links (a null id counts last; null
    if all ids of the component are); n_links is the number of spanning links its
    component was joined by.  Null text counts as empty; empty texts have fingerprint zero and
    are linked like any other; rows that share an id are separate rows of the same document.
    Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = fingerprints(docs, shingle).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    nodes = components(links(distinct.select("fp"), radius, tile)).checkpoint()
    member = (distinct.join(nodes, distinct.fp == nodes.node, "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")).checkpoint())
    lowest = (member.groupBy("root").agg(F.min("first_id").alias("component_id"),
                                         (F.count("*") - 1).alias("n_links")).checkpoint())
    by_fp = member.join(lowest, "root").select("fp", "component_id", "n_links").checkpoint()
    return (rows.join(by_fp, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"))
