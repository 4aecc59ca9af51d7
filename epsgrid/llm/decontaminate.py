"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item with an error budget of k edits is cut into k + 1 pieces: wherever a text
holds the item with at most k edits, at least one piece stands there unchanged.  Texts are
scanned for all pieces at once; around each hit, the item is compared with the text by
Myers' bit-parallel approximate matching.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.llm.common import map_arrow, pick, prepare

CHARS_PER_EDIT = 20           # the budget: one edit for so many characters of an item
BLOCK_CHARS = 4_000_000       # characters of benchmark items searched for in one pass


def canonical(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that cover the item, as (offset, piece)."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern inside ``text`` with at most k
    edits, the leftmost end among the best; None if there is none.  One big integer holds
    the vertical differences of a column."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items, where = [], {}
        for item_id, raw in items:
            text = canonical(raw or "")
            if not text:
                continue
            k = len(text) // chars_per_edit
            self.items.append((item_id, text, k))
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.find = ahocorasick.Automaton()
        for piece, at in where.items():
            self.find.add_word(piece, (len(piece), at))
        self.find.make_automaton()

    def matches(self, raw: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) for each item found in a whole text; end in the
        canonical text.  Hits on one diagonal are verified together."""
        if not self.items:
            return []
        text, hits = canonical(raw), {}
        for end, (n, at) in self.find.iter(text):
            for item, offset in at:
                hits.setdefault(item, []).append(end + 1 - n - offset)
        out = []
        for item, starts in hits.items():
            item_id, pattern, k = self.items[item]
            best, reach = None, -1
            spans = []
            for s in sorted(set(starts)):
                a, b = max(0, s - k), min(len(text), s + len(pattern) + k)
                if spans and a <= spans[-1][0] + 2 * k:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                if text[a:b].find(pattern) >= 0:
                    got = (0, text.find(pattern, a) + len(pattern) - a)
                else:
                    got = myers(pattern, text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best, reach = got, a + got[1]
                    if not got[0]:
                        break
            if best:
                out.append((item_id, best[0], reach))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


def item_blocks(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """(item_id, text, block), written, and the number of blocks: the distinct items dealt to blocks of
    about ``block_chars`` characters by a hash.  The driver holds one block at a time."""
    items = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = math.ceil(size / block_chars)
    block = F.pmod(F.xxhash64("item_id", "text", F.lit(8)), F.lit(max(n, 1))).cast("int")
    return items.withColumn("block", block).checkpoint(), n


def _search(docs: DataFrame, items: DataFrame, block: int, chars_per_edit: int, schema: str, rows_of) -> DataFrame:
    """Map over documents with one broadcast block of items; ``rows_of(batch, found, ids)`` makes
    the output batch from the matches of each row, whose items are places in ``ids``."""
    part = items.where(F.col("block") == block).orderBy("item_id", "text").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(
        (part.column("item_id").combine_chunks(), part.column("text").to_pylist(), chars_per_edit))
    made: dict = {}

    def run(batches):
        ids, texts, per_edit = shared.value
        if "m" not in made:
            made["m"] = Matcher(list(enumerate(texts)), per_edit)
        for batch in batches:
            yield rows_of(batch, [made["m"].matches(t.as_py() or "") for t in batch.column("text")], ids)

    return map_arrow(docs, run, schema)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_end): the items found in each document, with the
    least number of edits and where (in the canonical text) that match ends.

    The budget of an item of n canonical characters is n // ``chars_per_edit`` edits.
    Documents without an item give no row; nor do null or empty texts and items.  Repeated
    rows of either table count each for itself (items once if all is equal); a null id is
    carried along.  Other columns are ignored.  Whole texts are scanned, in one pass per
    block of items of bounded size, without a shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = pick(docs, "doc_id", "text")
    ids = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, item_id {pick(benchmark, 'item_id').schema[0].dataType.simpleString()}, " \
             "distance int, match_end long"

    def rows_of(batch, found, items):
        at = [i for i, f in enumerate(found) for _ in f]
        flat = [x for f in found for x in f]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int32())), items.take(pa.array([x[0] for x in flat], pa.int32())),
             pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int64())],
            ["doc_id", "item_id", "distance", "match_end"])

    out = spark.createDataFrame([], schema)
    items, n = item_blocks(benchmark, block_chars)
    for block in range(n):
        part = _search(src, items, block, chars_per_edit, schema, rows_of)
        out = part if not block else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...],
                      chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with ``columns``; a map, row by row.  What a block of
    items leaves is written before the next one, so a worker holds one block at a time."""
    prepare(docs.sparkSession)
    out = pick(docs, *columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    items, n = item_blocks(benchmark, block_chars)
    for block in range(n):
        out = _search(out, items, block, chars_per_edit, schema,
                      lambda batch, found, _: batch.filter(pa.array([not f for f in found], pa.bool_())))
        out = out.checkpoint() if block + 1 < n else out
    return out
