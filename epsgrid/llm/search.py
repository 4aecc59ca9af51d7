"""Ranked lexical search with the Best Position Algorithm.

Each task holds the impact lists of its own documents: for every query term the documents
with it, by falling impact.  A query reads its lists in parallel; a document that is met
is looked up in all of them (direct access), which gives its whole score and marks its
place in each list.  The best position of a list is the end of the run of places seen
from its top, so no unseen document can beat the sum of the impacts just behind the best
positions; reading stops once that sum is strictly below the k-th score so far.  The k
best of every task are merged, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epsgrid.llm.common import map_arrow, pick, prepare

TOP = 50
BLOCK_TERMS = 500_000      # (query, term) pairs that are searched for in one pass
LIST_ENTRIES = 1_000_000   # list entries that a task holds at a time
CHARS_AT_ONCE = 1 << 22
FIRST_READ = 32            # places read from every list before the first test of the threshold

#: ASCII other than digits and letters separates terms; only A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def count_terms(text: bytes) -> Counter:
    """Occurrences of the terms of a text in UTF-8; long texts in slices cut between terms."""
    text, out, at = text.translate(FOLD), Counter(), 0
    while at < len(text):
        end = len(text) if len(text) - at <= CHARS_AT_ONCE else text.find(b" ", at + CHARS_AT_ONCE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, block): the distinct terms of every item, items dealt to blocks by a
    hash so that a block has about ``BLOCK_TERMS`` rows."""
    fold = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(fold, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    terms = (pick(items, "item_id", "text").select("item_id", F.explode(words).alias("term")).distinct().checkpoint())
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    return terms.withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(5)), F.lit(blocks)).cast("int"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length in terms, the numbers
    of the query terms it holds and their occurrences."""
    src = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab = shared.value
        known = vocab.keys()
        for batch in batches:
            keep, size, ids, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1)):
                got = count_terms(text.as_py() or b"")
                if not got:
                    continue
                keep.append(i)
                size.append(got.total())
                hit = known & got.keys()
                ids += [vocab[t] for t in hit]
                tfs += [got[t] for t in hit]
                ends.append(len(ids))
            as_list = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(size, pa.int64()), as_list(ids), as_list(tfs)],
                ["doc_id", "n", "terms", "tfs"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_arrow(src, run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class ImpactLists:
    """The impact lists of a block of documents, entries also reachable by document."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray,
                 n_docs: int, n_terms: int):
        m = 50 + 50 * n * n_docs // max(n_terms, 1)
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        tf = tfs.astype(np.int64)
        self.starts, self.terms = starts, terms
        self.impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((doc, -self.impact, terms))
        self.head = np.searchsorted(terms[order], np.arange(len(weights) + 1))  # where each list begins
        self.place = np.empty(len(terms), dtype=np.int64)
        self.place[order] = np.arange(len(terms)) - self.head[terms[order]]
        self.docs, self.impacts = doc[order], self.impact[order]
        self.slot = np.full(len(weights), -1)
        self.read = 0

    def best(self, query: np.ndarray, k: int, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can be among the ``k`` best; ``floor`` has the best scores
        found elsewhere, at most ``k``."""
        query = query[self.head[query + 1] > self.head[query]]
        head, size = self.head[query], self.head[query + 1] - self.head[query]
        off = np.concatenate(([0], np.cumsum(size)))
        seen_place, seen_doc = np.zeros(off[-1], dtype=bool), np.zeros(len(self.starts) - 1, dtype=bool)
        best = np.zeros(len(query), dtype=np.int64)
        self.slot[query] = np.arange(len(query))
        tops, found, scores = np.array(floor, dtype=np.int64), [], []
        depth, step = 0, FIRST_READ
        while len(query):
            part = [self.docs[h + depth:h + min(depth + step, s)] for h, s in zip(head, size) if s > depth]
            if not part:
                break
            new = np.unique(np.concatenate(part))
            new = new[~seen_doc[new]]
            seen_doc[new] = True
            # direct access: all entries of the new documents
            count = self.starts[new + 1] - self.starts[new]
            at = np.repeat(self.starts[new] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            slot = self.slot[self.terms[at]]
            at, slot, row = at[slot >= 0], slot[slot >= 0], np.repeat(np.arange(len(new)), count)[slot >= 0]
            seen_place[off[slot] + self.place[at]] = True
            score = np.bincount(row, weights=self.impact[at], minlength=len(new)).astype(np.int64)  # below 2^53: exact
            self.read += len(new)
            found.append(new)
            scores.append(score)
            tops = np.concatenate((tops, score))
            if len(tops) > k:
                tops = np.partition(tops, len(tops) - k)[len(tops) - k:]
            limit = 0
            for j in range(len(query)):
                if best[j] < size[j]:
                    rest = seen_place[off[j] + best[j]:off[j + 1]]
                    run = int(rest.argmin())
                    best[j] = size[j] if rest[run] else best[j] + run
                    if best[j] < size[j]:
                        limit += int(self.impacts[head[j] + best[j]])
            if len(tops) >= k and limit < tops.min():
                break
            depth, step = depth + step, step * 2
        self.slot[query] = -1
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(found), np.concatenate(scores)


def _rank_key(x):
    """Highest score first, then the smallest id, null ids last."""
    return -x[0], x[1] is None, x[1]


def _local_best(lists: DataFrame, queries: list[np.ndarray], item_ids: pa.Array, weights: np.ndarray, n_docs: int,
                n_terms: int, k: int, schema: str) -> DataFrame:
    """The ``k`` best documents of every task for each query: (item_id, doc_id, score)."""
    shared = lists.sparkSession.sparkContext.broadcast((queries, item_ids, weights))

    def run(batches):
        queries, item_ids, weights = shared.value
        state: list[list] = [[] for _ in queries]  # (score, doc_id) of each query, best first
        kind = None

        def search(held):
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])  # places follow the ids
            doc_id = table.column("doc_id")
            col = {c: table.column(c).combine_chunks() for c in ("terms", "tfs")}
            starts = col["terms"].offsets.to_numpy().astype(np.int64)
            block = ImpactLists(table.column("n").to_numpy(), starts - starts[0],
                                col["terms"].flatten().to_numpy(), col["tfs"].flatten().to_numpy(), weights,
                                n_docs, n_terms)
            for q, terms in enumerate(queries):
                docs, scores = block.best(terms, k, [s for s, _ in state[q]])
                docs, scores = docs[scores > 0], scores[scores > 0]
                first = np.lexsort((docs, -scores))[:k]
                if len(first):
                    got = zip(scores[first].tolist(), doc_id.take(pa.array(docs[first])).to_pylist())
                    state[q] = sorted([*state[q], *got], key=_rank_key)[:k]

        held, entries = [], 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            held.append(batch)
            entries += len(batch.column("terms").flatten())
            if entries >= LIST_ENTRIES:
                search(held)
                held, entries = [], 0
        if held:
            search(held)
        at = [q for q, best in enumerate(state) for _ in best]
        if at:
            yield pa.RecordBatch.from_arrays(
                [item_ids.take(pa.array(at, pa.int32())), pa.array([d for best in state for _, d in best], kind),
                 pa.array([s for best in state for s, _ in best], pa.int64())], ["item_id", "doc_id", "score"])

    return map_arrow(lists, run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, score above 0.

    Scores are integers in the manner of BM25 (see ``ImpactLists``); equal scores go by
    ascending doc_id, null ids last.  Documents are read once per block of items, and what a
    task sends on are its ``k`` best of each item.  Items that share an item_id are one query
    with the terms of all their texts; an item without terms has no rows, nor has one whose
    terms no document holds.  Null texts have no terms; repeated rows and rows that share an
    id are documents of their own; a null id of an item is an item like any other.  Other
    columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    asked = query_terms(items).checkpoint()
    item_kind = asked.schema["item_id"].dataType.simpleString()
    doc_kind = pick(docs, "doc_id").schema[0].dataType.simpleString()
    schema = f"item_id {item_kind}, doc_id {doc_kind}, score long"
    out = None
    for (b,) in sorted(asked.select("block").distinct().collect()):
        table = asked.where(F.col("block") == b).select("item_id", "term").orderBy("item_id", "term").toArrow()
        terms = table.column("term").to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
        number = np.array([vocabulary[t] for t in terms], dtype=np.int64)
        ids = table.column("item_id").combine_chunks()
        names = ids.to_pylist()
        cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        queries = np.split(number, cuts[1:])
        lists = postings(docs, {t.encode(): i for t, i in vocabulary.items()}).checkpoint()
        n_docs, n_terms = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for t, d in df:
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
        best = _local_best(lists.where(F.size("terms") > 0), queries, ids.take(pa.array(cuts, pa.int32())), weights,
                           n_docs, n_terms, k, schema)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # a task gives at most k rows of an item: merge in groups of documents first
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = Window.partitionBy("item_id", "group").orderBy(*order)
    merged = (out.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(groups)))
              .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank", "group"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return (merged.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
