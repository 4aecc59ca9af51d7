"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours
*fit*: merging their joint bytes would not have crossed the border between them.  So
the merges compile into a nondeterministic transducer: its configurations are (last
token, place in the vocabulary trie), a token may end where it fits the one before.
:class:`Transducer` determinises it on demand: a state is the set of live
configurations, each with the tokens it still owes; tokens that all configurations
agree on are emitted at once, so the lookahead is bounded by the longest token.

:class:`Utf8Stream` decodes the bytes of ids that arrive one by one.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from epsgrid.llm.common import keep_tables, map_arrow, pick, prepare

# Letters, digits and white space below U+0250, for the same pattern in
# the standard library's engine, which is twice as fast on such texts.
LOW_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LOW_DIGITS = "0-9²³¹¼-¾"
LOW_SPACE = "\t-\r \x85\xa0"


def load_ranks(path: str) -> bytes:
    """Content of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in raw.splitlines() if x.strip())}


class PreTokens:
    """Splits text by the tokenizer's pattern."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern)
        self.low = re.compile(self._low(pattern)) if r"\p{L}" in pattern else None
        self.high = re.compile("[^\x00-ɏ]")

    @staticmethod
    def _low(pattern: str) -> str:
        out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LOW_SPACE}{LOW_LETTERS}{LOW_DIGITS}]")
        out = out.replace(r"\p{L}", f"[{LOW_LETTERS}]").replace(r"\p{N}", f"[{LOW_DIGITS}]")
        return out.replace(r"\S", f"[^{LOW_SPACE}]").replace(r"\s", f"[{LOW_SPACE}]")

    def engine(self, text: str):
        return self.any if self.low is None or self.high.search(text) else self.low

    def split(self, text: str) -> list[str]:
        return self.engine(text).findall(text)


class _State:
    """A state: its configurations packed into bytes (also its key in the state table), the
    transitions known so far, and the tokens still owed if the text ends here."""

    __slots__ = ("packed", "next", "rest")

    def __init__(self, packed, rest):
        self.packed, self.next, self.rest = packed, {}, rest


def pack(configs: tuple) -> bytes:
    """Equal configurations give equal bytes: version 2 writes values only, no references."""
    return marshal.dumps(configs, 2)


class Transducer:
    """Encodes pre-tokens; ``max_states`` and ``max_words`` bound its memory, results do not
    depend on them.  A full state table is kept, and further states are used without being
    remembered; it is emptied only after ``RENEW`` tables' worth of those, when the text has
    become another one."""

    ROOT = 0
    RENEW = 8
    MAX_FITS = 400_000

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_words: int = 200_000):
        self.ranks, self.max_states, self.max_words = ranks, max_states, max_words
        self.vocab = {r: t for t, r in ranks.items()}
        self.dtype = np.dtype(np.uint16 if max(self.vocab, default=0) < 1 << 16 else np.uint32)
        self.child: dict[int, int] = {}
        self.ends, self.below = [-1], [[]]
        for token, rank in ranks.items():
            node = self.ROOT
            for b in token:
                key = node * 256 + b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.below.append([])
                    self.below[node].append(nxt)
                node = nxt
            if self._parts(token, 1) == [token]:  # else only a whole pre-token can be it
                self.ends[node] = rank
        self.halves: dict[int, tuple[int, int]] = {}
        self.fit: dict[int, bool] = {}
        self.words: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self._reset()

    def _reset(self):
        self.states: dict[bytes, _State] = {}
        self.start = _State(pack(((-1, self.ROOT, ()),)), ())
        self.unkept = 0

    def _parts(self, token: bytes, stop: int) -> list[bytes]:
        """Merge the token's own bytes; stops early at two parts if ``stop`` is 2."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1 and not (stop == 2 and len(parts) == 2):
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, rank: int) -> tuple[int, int]:
        got = self.halves.get(rank)
        if got is None:
            a, b = self._parts(self.vocab[rank], 2)
            got = self.halves[rank] = (self.ranks[a], self.ranks[b])
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of tokens a and b before both are whole.

        Walks back in time along a's right and b's left edge: a merge across the border
        that ranks before the step that completed an edge piece would have come first.
        """
        key = a * 1_000_003 + b
        got = self.fit.get(key)
        if got is not None:
            return got
        x, y, before, ok = a, b, 1 << 60, True
        ranks, vocab = self.ranks, self.vocab
        left, right = vocab[x], vocab[y]
        while True:
            if ranks.get(left + right, before) < before:
                ok = False
                break
            if len(left) > 1 and (x > y or len(right) == 1):
                before, x = x, self._halves(x)[1]
                left = vocab[x]
            elif len(right) > 1:
                before, y = y + 1, self._halves(y)[0]  # of equal merges the left one comes first
                right = vocab[y]
            else:
                break
        if len(self.fit) >= self.MAX_FITS:
            self.fit.clear()
        self.fit[key] = ok
        return ok

    def _step(self, state: _State, byte: int):
        """The transition on one byte: next state and the tokens that are now certain.

        Configurations stand in the order in which their open token begins, so the first
        owes least; one whose place in the trie has nothing below it is dropped.
        """
        child, ends, below = self.child, self.ends, self.below
        live, done = [], None
        for last, node, owed in marshal.loads(state.packed):
            nxt = child.get(node * 256 + byte)
            if nxt is None:
                continue
            if below[nxt]:
                live.append((last, nxt, owed))
            if done is None:
                token = ends[nxt]
                if token >= 0 and (last < 0 or self.fits(last, token)):
                    done = (token, self.ROOT, owed + (token,))
        live.append(done)  # every prefix has exactly one encoding
        sure = live[0][2]
        if sure:
            for c in live[1:]:
                owed, n = c[2], len(sure)
                while sure[:n] != owed[:n]:
                    n -= 1
                sure = sure[:n]
                if not n:
                    break
        k = len(sure)
        packed = pack(tuple([(a, n, o[k:]) for a, n, o in live]) if k else tuple(live))
        nxt = self.states.get(packed)
        if nxt is None:
            nxt = _State(packed, done[2][k:])
            if len(self.states) >= self.max_states:
                self.unkept += 1
                return nxt, sure
            self.states[packed] = nxt
        out = state.next[byte] = (nxt, sure)
        return out

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.unkept > self.RENEW * self.max_states:
            self._reset()
        state, ids = self.start, []
        for b in piece:
            got = state.next.get(b)
            if got is None:
                got = self._step(state, b)
            state, sure = got
            if sure:
                ids += sure
        ids += state.rest
        return tuple(ids)

    def word(self, piece: str) -> bytes:
        """Ids of one pre-token as packed numbers (``dtype``), remembered in two generations:
        when the younger is full it becomes the older, and words in use move back."""
        got = self.words.get(piece) or self.older.get(piece)
        if got is None:
            got = np.array(self.encode_bytes(piece.encode("utf-8", "replace")), dtype=self.dtype).tobytes()
        if len(piece) <= 64:
            if len(self.words) >= self.max_words:
                self.older, self.words = self.words, {}
            self.words[piece] = got
        return got


class Utf8Stream:
    """Incremental UTF-8: ``push`` returns the text that is complete so far and holds back
    at most three bytes; ``close`` replaces what never became a character."""

    # Bytes that follow a lead byte.
    FOLLOW = [0] * 0xC2 + [1] * 0x1E + [2] * 0x10 + [3] * 5 + [0] * 11

    def __init__(self):
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[cut - back]
            if b & 0xC0 != 0x80:
                if self.FOLLOW[b] >= back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Text to ids and ids to bytes for one vocabulary."""

    def __init__(self, raw: bytes, pattern: str, **limits):
        self.fst = Transducer(parse_ranks(raw), **limits)
        self.pre = PreTokens(pattern)
        self.decimal = {r: str(r) for r in self.fst.vocab}

    def packed(self, pieces: list[str]) -> list[bytes]:
        fst, out = self.fst, []
        for piece in pieces:
            out.append(fst.words.get(piece) or fst.word(piece))
        return out

    def count(self, pieces: list[str]) -> int:
        return sum(map(len, self.packed(pieces))) // self.fst.dtype.itemsize

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.packed(self.pre.split(text))), dtype=self.fst.dtype).tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.fst.vocab.__getitem__, ids))

    def decode(self, ids, step: int = 65_536) -> str:
        """Streaming decode: ids in slices through the UTF-8 machine."""
        ids, utf, out = list(ids), Utf8Stream(), []
        for i in range(0, len(ids), step):
            out.append(utf.push(self.decode_bytes(ids[i:i + step])))
        return "".join(out) + utf.close()


def codec(raw: bytes, pattern: str, **limits) -> Codec:
    """The codec of a worker process for this vocabulary and these table sizes."""
    key = (hash(raw), pattern, *sorted(limits.items()))
    return keep_tables(key, lambda: Codec(raw, pattern, **limits))


def encode_documents(docs: DataFrame, vocab_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text; a map over documents, no shuffle.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row per input row.
    ``decoded_sha256`` is over the bytes that the ids decode to, taken through the UTF-8
    stream.  Null text counts as empty (no tokens, digests of nothing); repeated rows and
    null ids are kept; an empty table gives no rows; other columns are ignored.  A very
    long text is encoded whole by one task; its ids are the largest thing held.
    The vocabulary (a file of fixed size, read by the driver) is broadcast.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocab_path))

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            ids_col, out = batch.column(0), {"n": [], "i": [], "d": [], "ids": []}
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                digest, utf = hashlib.sha256(), Utf8Stream()
                for k in range(0, len(ids), 65_536):
                    digest.update(utf.push(c.decode_bytes(ids[k:k + 65_536])).encode())
                digest.update(utf.close().encode())
                out["n"].append(len(ids))
                out["i"].append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                out["d"].append(digest.hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            cols = [ids_col, pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()),
                    pa.array(out["d"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    src = pick(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(src, run, schema + (", ids array<int>" if with_ids else ""), tables=True)
