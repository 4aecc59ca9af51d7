"""Edit-aware token counts.

Each document keeps a segment tree: its leaves are runs of whole pre-tokens with their
numbers of characters and tokens, its inner nodes the sums.  An edit finds its leaf by the
character sums, re-encodes from a little before the edit until the new pre-token borders
meet an old leaf border again, and updates the sums above the touched leaves.  The rest of
the text is never encoded again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsgrid.llm.bpe import codec, load_ranks
from epsgrid.llm.common import map_arrow, pick, prepare

LEAF = 64           # pre-tokens of a fresh leaf
LOOKAHEAD = 2       # characters after a pre-token that its end can depend on ('re, 've, 'll)
EDITS_A_ROUND = 1000
STATE = ("text string, leaf_chars array<int>, leaf_tokens array<int>, tokens_before long, "
         "chars_encoded long")

WORDS_HELD = 300_000   # pre-tokens a worker remembers in each of two generations


class Tree:
    """Segment tree over leaves, as two lists in heap order (node 1 is the root)."""

    def __init__(self, chars: list[int], toks: list[int]):
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        rest = [0] * (self.size - self.n)
        self.chars = [0] * self.size + list(chars) + rest
        self.toks = [0] * self.size + list(toks) + rest
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k):
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.toks[k] = self.toks[2 * k] + self.toks[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.toks[1]

    def leaf(self, pos: int) -> tuple[int, int]:
        """(leaf, start) of the leaf that holds character ``pos``; past the end the last."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if pos - start >= self.chars[k] and self.chars[k + 1] > 0:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, toks: int):
        k = leaf + self.size
        self.chars[k], self.toks[k] = chars, toks
        while k > 1:
            k //= 2
            self._sum(k)

    def leaves(self) -> tuple[list[int], list[int]]:
        at = slice(self.size, self.size + self.n)
        return self.chars[at], self.toks[at]


def build(c, text: str, leaf: int = LEAF) -> tuple[list[int], list[int]]:
    """Characters and tokens of the leaves of a whole text (one empty leaf for no text)."""
    parts = c.pre.split(text)
    chars, toks = [], []
    for k in range(0, len(parts), leaf):
        some = parts[k:k + leaf]
        chars.append(sum(map(len, some)))
        toks.append(c.count(some))
    return chars or [0], toks or [0]


def apply_edit(c, text: str, tree: Tree, pos: int, n_del: int, ins: str, engine=None) -> tuple[str, int]:
    """Replace ``n_del`` characters at ``pos`` by ``ins``; the tree follows.  Returns the new
    text and the number of characters encoded again.  A place beyond the text is its end;
    ``engine`` is one that splits both text and ``ins`` (default: found from them)."""
    pos = min(max(pos, 0), len(text))
    n_del = min(max(n_del, 0), len(text) - pos)
    new, shift = text[:pos] + ins + text[pos + n_del:], len(ins) - n_del
    first, start = tree.leaf(max(pos - LOOKAHEAD, 0))
    last, end = first, start + tree.chars[first + tree.size]
    while end < pos + n_del and last + 1 < tree.n:
        last += 1
        end += tree.chars[last + tree.size]
    pieces, at = [], start
    for m in (engine or c.pre.engine(new)).finditer(new, start):
        at = m.end()
        pieces.append(m.group())
        while end + shift < at and last + 1 < tree.n:
            last += 1
            end += tree.chars[last + tree.size]
        if at == end + shift and at >= pos + len(ins):
            break
    else:  # to the end of the text
        last = tree.n - 1
    for k in range(first + 1, last + 1):
        if tree.chars[k + tree.size]:
            tree.put(k, 0, 0)
    tree.put(first, at - start, c.count(pieces))
    return new, at - start


def build_trees(docs: DataFrame, vocab_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, tokens_before, chars_encoded): the kept state
    of every document, its tokens at the start and the characters encoded again so far."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches):
        c = codec(shared.value, pattern, max_words=WORDS_HELD)
        for batch in batches:
            made = [build(c, t.as_py() or "", leaf) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())),
                 pa.array([m[1] for m in made], pa.list_(pa.int32())),
                 pa.array([sum(m[1]) for m in made], pa.int64()), pa.array([0] * len(made), pa.int64())],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "tokens_before", "chars_encoded"])

    src = pick(docs, "doc_id", "text")
    ids = src.schema["doc_id"].dataType.simpleString()
    return map_arrow(src, run, f"doc_id {ids}, {STATE}", tables=True)


def edit_round(state: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """Apply the array ``edits`` (pos, n_del, ins; in order) of each row of the state."""
    shared = state.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches):
        c = codec(shared.value, pattern, max_words=WORDS_HELD)
        for batch in batches:
            out = []
            for r in batch.select(["text", "leaf_chars", "leaf_tokens", "chars_encoded", "edits"]).to_pylist():
                text, tree, redone = r["text"] or "", Tree(r["leaf_chars"], r["leaf_tokens"]), r["chars_encoded"]
                edits = r["edits"] or ()
                engine = c.pre.engine(text + "".join([e["ins"] or "" for e in edits])) if edits else None
                for e in edits:
                    text, n = apply_edit(c, text, tree, e["pos"] or 0, e["n_del"] or 0, e["ins"] or "", engine)
                    redone += n
                out.append((text, *tree.leaves(), redone, tree.tokens))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tokens_before"),
                 *[pa.array(x, k) for x, k in zip(cols, kinds)]],
                ["doc_id", "tokens_before", "text", "leaf_chars", "leaf_tokens", "chars_encoded", "tokens_after"])

    ids = state.schema["doc_id"].dataType.simpleString()
    return map_arrow(state, run, f"doc_id {ids}, tokens_before long, text string, leaf_chars array<int>, "
                                 "leaf_tokens array<int>, chars_encoded long, tokens_after long", tables=True)


def edit_and_count(docs: DataFrame, edits: DataFrame, vocab_path: str, pattern: str,
                   edits_a_round: int = EDITS_A_ROUND) -> DataFrame:
    """Count tokens, apply edits (doc_id, seq, pos, n_del, ins) and count again.

    Returns the state after all edits: (doc_id, text, leaf_chars, leaf_tokens,
    tokens_before, tokens_after, chars_encoded, n_edits), one row per document row.
    Positions are characters; edits of a document apply in order of seq (ties: pos, n_del,
    ins), each to the text that the one before left.  A null text is empty; null pos or
    n_del is 0 and a null ins is empty; a place beyond the text is its end.  Edits of unknown
    or null ids are dropped, repeated edits each apply, repeated document rows each take all
    their id's edits.  Other columns are ignored, empty tables work.

    A round takes at most ``edits_a_round`` edits of each document, so the list of a document
    with very many edits is never held at once; the state between rounds is checkpointed.
    """
    prepare(docs.sparkSession)
    ordered = (pick(edits, "doc_id", "seq", "pos", "n_del", "ins").where(F.col("doc_id").isNotNull())
               .withColumn("rn", F.row_number().over(Window.partitionBy("doc_id")
                                                     .orderBy("seq", "pos", "n_del", "ins")) - 1)
               .withColumn("round", F.floor(F.col("rn") / edits_a_round).cast("int")).checkpoint())
    last = ordered.agg(F.max("round")).first()[0] or 0
    state = build_trees(docs, vocab_path, pattern)
    lists = lambda k: (ordered.where(F.col("round") == k).groupBy(F.col("doc_id").alias("id"))
                       .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "pos", "n_del", "ins"))),
                                        lambda e: F.struct(e["pos"].alias("pos"), e["n_del"].alias("n_del"),
                                                           e["ins"].alias("ins"))).alias("edits")))
    for k in range(last + 1):
        more = lists(k)
        state = state.join(more, state.doc_id == more.id, "left").drop("id")
        done = edit_round(state, vocab_path, pattern)
        if k < last:
            done = done.checkpoint()
        state = done
    totals = ordered.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_edits"))
    return (state.join(totals, state.doc_id == totals.id, "left").drop("id")
            .withColumn("n_edits", F.coalesce("n_edits", F.lit(0))))
