"""Language identification by interpolated Kneser-Ney character models.

A model per language predicts each letter of a word, and its end, from the letters before
it.  Spark counts the character n-grams of all training texts and turns them into
discounted probabilities and back-off weights by aggregations.  Finished tables that fit in
a broadcast are sorted arrays of packed n-grams, looked up by binary search; larger ones stay
a written table that the n-grams of the texts are joined with.  Nothing is cut either way.  A
text gets the language with the lowest cross-entropy per symbol; a calibrated limit marks
texts that no learned language explains.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgrid.llm.common import chunks, fold, held_out, map_arrow, pick, prepare
from epsgrid.session import scratch_path

BITS = 16                    # bits of one packed symbol; 0 is the word border
SYMBOLS = (1 << BITS) - 1    # a letter is its code point; those beyond 16 bits share symbols with others
WORDS_KEPT = 200_000         # words remembered by a worker


def low_bits(n: int) -> int:
    """Mask of the last ``n`` symbols of a packed n-gram (a 64-bit number with sign)."""
    return -1 if BITS * n >= 64 else (1 << BITS * n) - 1


def letter_runs(token: str) -> list[str]:
    if token.isalpha():
        return [token]
    return "".join([c if c.isalpha() else " " for c in token]).split()


def word_grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (one for each letter and word end, padded with borders) and the
    number of them in each word."""
    pad = "\0" * order
    joined = "\0" * (order - 1) + pad.join(words) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    sym = np.where(cp == 0, 0, 1 + cp % SYMBOLS)
    gram = np.zeros(len(sym) - order + 1, dtype=np.int64)
    for k in range(order):
        gram = (gram << BITS) | sym[k:len(sym) - order + 1 + k]
    cur, prev = sym[order - 1:], sym[order - 2:-1]
    sizes = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    return gram[(cur > 0) | (prev > 0)], sizes


def text_grams(text: str, order: int) -> np.ndarray:
    return word_grams([w for t in text.lower().split() for w in letter_runs(t)], order)[0]


def count_grams(train: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c) over all whole training texts: words are counted on the map side,
    each distinct word is taken apart once a flush."""

    def run(batches):
        seen: dict[str, Counter] = {}

        def flush():
            for lang, words in seen.items():
                total: Counter = Counter()
                for token, c in words.items():
                    for w in letter_runs(token):
                        total[w] += c
                if not total:
                    continue
                grams, sizes = word_grams(list(total), order)
                weight = np.repeat(np.fromiter(total.values(), dtype=np.int64, count=len(total)), sizes)
                keys, inv = np.unique(grams, return_inverse=True)
                sums = np.bincount(inv, weights=weight).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys), pa.array(sums)], ["lang", "gram", "c"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update((text.as_py() or "").lower().split())
                if sum(map(len, seen.values())) > WORDS_KEPT:
                    yield from flush()
        yield from flush()

    part = map_arrow(train.select("lang", "text"), run, "lang string, gram long, c long")
    return part.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(kind, n, lang, key, value, c): discounted probability of each n-gram (kind g) and
    back-off weight of each context (kind h), for n = 1 .. order.

    Below the highest order the count of an n-gram is the number of distinct letters seen
    before it.  Each order has the discount n1 / (n1 + 2 n2) of its language.
    """
    level = {order: counts}
    for n in range(order - 1, 0, -1):
        level[n] = (level[n + 1].groupBy("lang", F.col("gram").bitwiseAND(low_bits(n)).alias("gram"))
                    .agg(F.count("*").alias("c")))
    out = None
    for n, t in level.items():
        rich = (t.groupBy("lang").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"),
                                      F.sum((F.col("c") == 2).cast("long")).alias("n2"))
                .select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2")))
                        .otherwise(0.5).alias("d")))
        t = t.join(F.broadcast(rich), "lang").withColumn("h", F.shiftrightunsigned("gram", BITS))  # a row a language
        ctx = t.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.count("*").alias("types"),
                                         F.first("d").alias("d"))
        g = (t.drop("d").join(ctx, ["lang", "h"])
             .select(F.lit("g").alias("kind"), F.lit(n).alias("n"), "lang", F.col("gram").alias("key"),
                     (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("value"), "c"))
        h = ctx.select(F.lit("h").alias("kind"), F.lit(n).alias("n"), "lang", F.col("h").alias("key"),
                       (F.col("d") * F.col("types") / F.col("total")).alias("value"),
                       F.col("total").alias("c"))
        both = g.unionByName(h)
        out = both if out is None else out.unionByName(both)
    return out


class Languages:
    """The learned languages with their calibration, and the decision on summed scores."""

    reject_z, noise_share = 8.0, 0.8

    def __init__(self, order: int, langs: list[str]):
        self.order, self.langs = order, langs
        self.mean = np.full(len(self.langs), math.log(SYMBOLS))
        self.noise = np.full(len(self.langs), math.log(SYMBOLS))
        self.sd_doc = np.full(len(self.langs), 1.0)
        self.sd_char = np.full(len(self.langs), 1.0)

    def decide(self, s: np.ndarray, sharp: float = 40.0):
        """(language, score, rejected, cross-entropy) lists for rows of summed scores.  The
        score is the posterior of the language under at most ``sharp`` symbols of evidence."""
        n = s[:, -1]
        lang, score, rejected, entropy = [], [], [], []
        for i in range(len(s)):
            if not n[i] or not self.langs:
                lang.append("und"), score.append(0.0), rejected.append(True), entropy.append(None)
                continue
            h = s[i, :-1] / n[i]
            k = int(np.argmin(h))
            post = np.exp(-(h - h[k]) * min(n[i], sharp))
            z = (h[k] - self.mean[k]) / math.sqrt(self.sd_doc[k] ** 2 + self.sd_char[k] ** 2 / n[i])
            lang.append(self.langs[k]), score.append(float(1 / post.sum()))
            limit = self.mean[k] + self.noise_share * (self.noise[k] - self.mean[k])
            rejected.append(bool(z > self.reject_z and h[k] > limit)), entropy.append(float(h[k]))
        return lang, score, rejected, entropy

class Model(Languages):
    """The finished tables as arrays, and scoring of words and texts."""

    def __init__(self, order: int, rows):
        """rows: arrays kind, n, lang, key, value."""
        kind, n, lang, key, value = rows
        super().__init__(order, sorted(set(lang.tolist())))
        self.tables = {}
        for x in ("g", "h"):
            for k in range(1, order + 1):
                for i, name in enumerate(self.langs):
                    at = (kind == x) & (n == k) & (lang == name)
                    ks, vs = key[at], value[at]
                    o = np.argsort(ks)
                    self.tables[x, k, i] = (ks[o], vs[o])
        self.words: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs) + 1))

    def _find(self, x, k, i, keys, default):
        ks, vs = self.tables[x, k, i]
        if not len(ks):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(ks, keys), len(ks) - 1)
        return np.where(ks[at] == keys, vs[at], default)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word (letters and end) in each language, and
        its number of symbols in the last column."""
        grams, sizes = word_grams(words, self.order)
        uniq, inv = np.unique(grams, return_inverse=True)
        out = np.zeros((len(words), len(self.langs) + 1))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for i in range(len(self.langs)):
            p = np.full(len(uniq), 1.0 / (SYMBOLS + 1))
            for k in range(1, self.order + 1):
                g = uniq & low_bits(k)
                p = self._find("g", k, i, g, 0.0) + self._find("h", k, i, g >> BITS & low_bits(k - 1), 1.0) * p
            out[:, i] = np.add.reduceat(-np.log(np.maximum(p, 1e-12))[inv], starts)
        out[:, -1] = sizes
        return out

    def _learn(self, tokens: list[str]) -> None:
        if len(self.words) + len(tokens) > WORDS_KEPT:
            self.words.clear()
        base = len(self.words)
        if base + len(tokens) > len(self.matrix):
            grown = np.zeros((2 * (base + len(tokens)), self.matrix.shape[1]))
            grown[:base] = self.matrix[:base]
            self.matrix = grown
        runs = [letter_runs(t) for t in tokens]
        flat = [w for r in runs for w in r]
        rows = np.zeros((len(tokens), self.matrix.shape[1]))
        if flat:
            np.add.at(rows, np.repeat(np.arange(len(runs)), [len(r) for r in runs]), self.word_scores(flat))
        self.matrix[base:base + len(tokens)] = rows
        self.words.update(zip(tokens, range(base, base + len(tokens))))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Summed scores of whole texts, one row each (columns as in ``word_scores``)."""
        out = np.zeros((len(texts), len(self.langs) + 1))
        for part in chunks(range(len(texts)), lambda i: len(texts[i])):
            split = [texts[i].lower().split() for i in part]
            every = set().union(*split)
            if len(every) + len(self.words) > WORDS_KEPT:
                self.words.clear()
                new = list(every)
            else:
                new = [t for t in every if t not in self.words]
            if new:
                self._learn(new)
            for i, tokens in zip(part, split):
                if tokens:
                    out[i] = self.matrix[list(map(self.words.__getitem__, tokens))].sum(0)
        return out

    def predict(self, texts: list[str], sharp: float = 40.0):
        return self.decide(self.texts(texts), sharp)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dense(column: pa.ListArray, width: int, default: float) -> np.ndarray:
    """Lists of (i, value) as rows of a matrix."""
    out = np.full((len(column), width), default)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    i, value = column.flatten().flatten()
    out[np.repeat(np.arange(len(column)), sizes), i.to_numpy(zero_copy_only=False)] = \
        value.to_numpy(zero_copy_only=False)
    return out


class JoinedModel(Languages):
    """The finished tables as a written table, whole at any size: the distinct n-grams of the
    texts are joined with it."""

    def __init__(self, order: int, langs: list[str], table: DataFrame, max_entries: int):
        super().__init__(order, langs)
        self.max_entries = max_entries
        self.path = scratch_path(table.sparkSession, "langid")
        names = table.sparkSession.createDataFrame(list(enumerate(langs)), "i int, lang string")
        (table.join(F.broadcast(names), "lang").select("kind", "n", "key", "i", "value")
         .write.partitionBy("kind", "n").parquet(self.path))

    def gram_scores(self, texts: DataFrame) -> DataFrame:
        """(gram, c, s): count of each distinct n-gram of the texts, and its negative log
        probability in each language."""
        order, width = self.order, len(self.langs)

        def count(batches):
            for batch in batches:
                for part in chunks([t.as_py() or "" for t in batch.column(0)], len):
                    keys, c = np.unique(np.concatenate([text_grams(t, order) for t in part]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c)], ["gram", "c"])

        out = (map_arrow(texts.select("text"), count, "gram long, c long")
               .groupBy("gram").agg(F.sum("c").alias("c")).checkpoint())
        table = texts.sparkSession.read.parquet(self.path)
        for k in range(1, order + 1):
            gram = F.col("gram").bitwiseAND(low_bits(k))
            for kind, key, symbols in (("g", gram, k), ("h", F.shiftrightunsigned(gram, BITS), k - 1)):
                t = (table.where((F.col("kind") == kind) & (F.col("n") == k))
                     .groupBy("key").agg(F.collect_list(F.struct("i", "value")).alias(f"{kind}{k}")))
                t = F.broadcast(t) if symbols < 2 else t  # at most 65,536 keys, each in many n-grams
                out = out.withColumn("key", key).join(t, "key", "left").drop("key")

        def score(batches):
            for batch in batches:
                p = np.full((batch.num_rows, width), 1.0 / (SYMBOLS + 1))
                for k in range(1, order + 1):
                    p = dense(batch.column(f"g{k}"), width, 0.0) + dense(batch.column(f"h{k}"), width, 1.0) * p
                s = -np.log(np.maximum(p, 1e-12))
                at = np.arange(0, s.size + 1, width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("gram"), batch.column("c"), pa.ListArray.from_arrays(at, s.ravel())],
                    ["gram", "c", "s"])

        return map_arrow(out, score, "gram long, c long, s array<double>").checkpoint()

    def sums(self, texts: DataFrame) -> DataFrame:
        """(key, s) for rows (key, text): the summed scores of each distinct key, the number
        of symbols last.  A key belongs to one text; copies of a row change nothing.

        The most frequent n-grams, at most ``max_entries`` scores of them, are looked up in a
        broadcast, so no n-gram that is joined holds more than a small share of the rows.
        """
        order, width = self.order, len(self.langs)
        scored = self.gram_scores(texts)
        top = scored.orderBy(F.desc("c"), "gram").limit(max(self.max_entries // width, 1)).toArrow()
        keys = top.column("gram").to_numpy()
        o = np.argsort(keys)
        matrix = np.array(top.column("s").to_pylist(), dtype=float).reshape(-1, width)[o]
        shared = texts.sparkSession.sparkContext.broadcast((keys[o], matrix))

        def rows(batches):
            known, scores = shared.value
            for batch in batches:
                names, body = batch.column(0).to_pylist(), [t.as_py() or "" for t in batch.column(1)]
                for part in chunks(range(len(body)), lambda i: len(body[i])):
                    key, gram, c, n, own = [], [], [], [], []
                    for i in part:
                        g, m = np.unique(text_grams(body[i], order), return_counts=True)
                        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                        hit = known[at] == g
                        rest = int((~hit).sum())
                        key += [names[i]] * (1 + rest)
                        gram += [[-1 - i], g[~hit]]  # the row of the text itself meets no n-gram
                        c += [[1], m[~hit]]
                        n += [int(m.sum())] + [None] * rest
                        own += [(m[hit] @ scores[at[hit]]).tolist()] + [None] * rest
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.binary()), pa.array(np.concatenate(gram).astype(np.int64)),
                         pa.array(np.concatenate(c).astype(np.int64)), pa.array(n, pa.int64()),
                         pa.array(own, pa.list_(pa.float64()))], ["key", "gram", "c", "n", "own"])

        part = map_arrow(texts.select("key", "text"), rows, "key binary, gram long, c long, n long, own array<double>")
        total = (part.join(scored.select("gram", "s"), "gram", "left").groupBy("key")
                 .agg(F.count("n").alias("copies"), F.sum("n").alias("n"),
                      *[F.sum(F.coalesce(F.col("own")[i], F.col("c") * F.col("s")[i])).alias(f"s{i}")
                        for i in range(width)]))
        return total.select("key", F.array(*[F.col(x) / F.col("copies")
                                             for x in [*[f"s{i}" for i in range(width)], "n"]]).alias("s"))


def entropies(rows: DataFrame, model: Languages) -> DataFrame:
    """(k, h, noise) of the rows (lang, text) with a learned language and at least 20 symbols:
    the cross-entropy of the text in its language, forwards and backwards."""
    if isinstance(model, JoinedModel):
        src = rows.select("lang", "text", text_key(F.col("text")).alias("key"),
                          text_key(F.reverse("text")).alias("back"))
        s = model.sums(src.select("key", "text").unionByName(
            src.select(F.col("back").alias("key"), F.reverse("text").alias("text")))).checkpoint()
        k = F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")).cast("int") - 1
        n = len(model.langs)
        return (src.select("key", "back", k.alias("k")).where("k >= 0").join(s, "key")
                .join(s.select(F.col("key").alias("back"), F.col("s").alias("t")), "back")
                .where(F.col("s")[n] >= 20)
                .select("k", (F.col("s")[F.col("k")] / F.col("s")[n]).alias("h"),
                        (F.col("t")[F.col("k")] / F.greatest(F.col("t")[n], F.lit(1.0))).alias("noise")))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            m.words.clear()  # words read backwards don't come again: keep the worker small
            s = m.texts([t.as_py() or "" for t in batch.column(1)])
            lang = np.array([m.langs.index(x) if x in m.langs else -1 for x in batch.column(0).to_pylist()])
            ok = (s[:, -1] >= 20) & (lang >= 0)
            at = np.arange(len(s)), np.maximum(lang, 0)
            h = s[at] / np.maximum(s[:, -1], 1)
            back = m.texts([(t.as_py() or "")[::-1] for t in batch.column(1)])
            noise = back[at] / np.maximum(back[:, -1], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang[ok].astype(np.int32)), pa.array(h[ok]), pa.array(noise[ok])], ["k", "h", "noise"])

    return map_arrow(rows.select("lang", "text"), run, "k int, h double, noise double")


def calibrate(model: Languages, rows: DataFrame) -> None:
    """Mean, deviation and noise of each language over all rows.  A language with fewer than
    five takes those of all rows together; only without any row do the defaults stay."""
    stats = (entropies(rows, model)
             .groupBy("k").agg(F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd"),
                               F.avg("noise").alias("noise"), F.count("*").alias("m")).collect())  # a row a language
    if not stats:
        return
    m, mean, sd, noise = (np.array([r[c] for r in stats], dtype=float) for c in ("m", "mean", "sd", "noise"))
    share = m / m.sum()
    middle = float(share @ mean)
    spread = math.sqrt(float(share @ (sd ** 2 + (mean - middle) ** 2)))
    every = range(len(model.langs))
    for k, a, b, c in [*((k, middle, spread, float(share @ noise)) for k in every),
                       *((r.k, r.mean, r.sd, r.noise) for r in stats if r.m >= 5)]:
        model.mean[k], model.sd_doc[k], model.sd_char[k], model.noise[k] = a, max(b, 0.02), 1.5, max(c, a)


def train(docs: DataFrame, order: int = 4, max_entries: int = 2_000_000,
          reject_z: float = 8.0, noise_share: float = 0.8) -> Languages:
    """Fit on the texts with a language whose fold is 2, 3 or 4 (all of them, whole); all of
    fold 1 calibrates; fold 0 is held out.

    A text is rejected if its cross-entropy lies over ``reject_z`` deviations above its
    language's mean and beyond ``noise_share`` of the way to that of noise, for which the
    calibration texts read backwards stand: mixed languages or codes in a text don't suffice.

    ``max_entries`` bounds what the driver collects and broadcasts: a larger model is written
    and joined, with the same results up to the rounding of sums.  An n-gram is one 64-bit
    number, so ``order`` is at most 4.
    """
    if not 2 <= order <= 64 // BITS:
        raise ValueError(f"order must be from 2 to {64 // BITS}")
    prepare(docs.sparkSession)
    src = pick(docs, "doc_id", "text", "lang").where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = count_grams(src.where(fold() != 1), order).checkpoint()
    table = kneser_ney(counts, order).checkpoint()
    if table.count() > max_entries:
        langs = sorted(r.lang for r in table.select("lang").distinct().collect())
        model = JoinedModel(order, langs, table, max_entries)
    else:
        rows = table.select("kind", "n", "lang", "key", "value").toArrow()
        cols = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        model = Model(order, (cols[0].astype(str), cols[1], cols[2].astype(str), cols[3], cols[4]))
    model.reject_z, model.noise_share = reject_z, noise_share
    if not model.langs:
        return model
    calibrate(model, src.where(fold() == 1))
    return model


def identify(docs: DataFrame, model: Languages, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy[, keep columns]), one
    row per input row.

    Text that is null, empty or without a letter is ``und`` with score 0 and rejected.
    Equal scores go to the language that sorts first.  Repeated rows and null ids stay,
    other columns are ignored, an empty table gives no rows; an empty training table gives
    ``und`` everywhere.  Whole texts are read; a task holds one chunk of words at a time.
    """
    prepare(docs.sparkSession)
    joined = isinstance(model, JoinedModel)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = (pick(docs, "doc_id", "text", *[k for k in keep if k != "text"])
           .withColumn("held_out", held_out()))
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    if joined:
        src = src.withColumn("_key", text_key(F.coalesce("text", F.lit(""))))
        s = model.sums(src.select(F.col("_key").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
        src = (src.drop(*[] if "text" in keep else ["text"])
               .join(s.select(F.col("key").alias("_key"), F.col("s").alias("_s")), "_key").drop("_key"))

    def run(batches):
        m = shared.value
        for batch in batches:
            s = (np.array(batch.column("_s").to_pylist()).reshape(-1, len(m.langs) + 1) if joined
                 else m.texts([t.as_py() or "" for t in batch.column("text")]))
            lang, score, rejected, entropy = m.decide(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()),
                 pa.array(entropy, pa.float64()), *[batch.column(k) for k in keep]],
                ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy", *keep])

    schema = (f"doc_id {fields['doc_id']}, held_out boolean, lang_pred string, score double, "
              "rejected boolean, cross_entropy double")
    return map_arrow(src, run, schema + "".join(f", {k} {fields[k]}" for k in keep))
