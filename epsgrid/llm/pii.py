"""Personal data by candidate generators and boosted trees, in DataFrame operations only.

Strict patterns give the base spans.  Broader, high-recall generators propose further,
overlapping candidates (national phone numbers, spaced or dotted digit groups, obfuscated
mail addresses).  Boosted trees over format and context features score each candidate;
they are fitted on all candidates, by sums that Spark aggregates, and become one SQL expression.  Positive examples are
candidates that touch a base span and others with evidence of their own: a mail address once
its obfuscation is undone, a checksum, a cue word before the number.  A threshold per
generator, calibrated for precision, selects the additional spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epsgrid.llm.common import pick, prepare

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"

# The base patterns.  A match can only begin where a run of its first characters begins or
# where the last match ended, so the look-behind or \G changes no match and spares the
# restarts inside long runs.  Possessive runs and groups need no way back and are matched in a
# loop; a plain group would recurse once per repeat and overflow the stack on long texts.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators, each with the kind it proposes.
BROAD = {
    "email": rf"[{LOCAL}]{{1,64}}+[\x20]?(?:@|\(at\)|\[at\])[\x20]?[A-Za-z0-9-]{{1,63}}(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,:][0-9]{1,4}){3,7}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{2,6}(?:[\x20./-]?[0-9]{2,6}){2,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()?[0-9]{2,5}\)?(?:[\x20()./-]{1,3}[0-9]{2,5}){2,5}(?![0-9])",
}
NEEDS = {"email": "(?:@|[(\\[]at[)\\]])", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
QUANTILES = np.linspace(0, 1, 33)  # of a feature, between which the trees cut
CONTEXT = 24  # characters before a candidate that the context features see
# Words that announce personal data.
CUES = ("mail", "tel", "phone", "call", "fax", "mobil", "card", "visa", "ip", "addr", "contact", "kontakt", "host")

PHONE_CUES = ("tel", "phone", "call", "fax", "mobil")
HOST_CUES = ("ip", "host", "addr")

NUMERIC = ("kind", "chars", "digits", "groups", "digit_share", "dots", "dashes", "spaces", "plus", "parens", "at",
           "longest_run", "before_letter", "before_mark", "before_line", "after_letter", "after_mark", "after_end",
           "cue", "checksum", "octets")


def _matches(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Array of (kind, base, pos, gap, match, before, after) for one pattern; gap is the
    number of code points since the last match, so positions are running sums."""
    # zipped, since a lambda would evaluate the split again for each match
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"),
                          F.slice(gaps, 2, F.lit(2 ** 31 - 1)).alias("g2"))
    one = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), i.alias("pos"),
        F.length(z["g"]).alias("gap"), z["m"].alias("m"),
        F.substring(z["g"], -CONTEXT, CONTEXT).alias("before"), F.substring(z["g2"], 1, 1).alias("after")))
    none = F.transform(F.array().cast("array<string>"), lambda m, i: F.struct(
        F.lit(0).alias("kind"), F.lit(True).alias("base"), i.alias("pos"), F.lit(0).alias("gap"), m.alias("m"),
        m.alias("before"), m.alias("after")))
    return F.when(text.rlike(NEEDS[kind]), one).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Checksum of a string of digits, from the right, every second one doubled."""
    n = F.length(digits)

    def part(i):
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def _octets(parts: Column) -> Column:
    """Whether all parts of digits are numbers of at most 255."""
    return F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255))


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    small = _octets(F.split(m, r"\."))
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, small)
            .when(kind == 2, F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .otherwise(n.between(8, 15)))


def _features(m: Column, before: Column, after: Column, kind: Column) -> list[Column]:
    count = lambda cls: F.length(F.regexp_replace(m, f"[^{cls}]", ""))
    runs = F.split(m, "[^0-9]+")
    digits, last = count("0-9"), F.right(before, F.lit(1))
    flag = lambda c: c.cast("int")
    return [c.cast("double").alias(f"f_{name}") for name, c in zip(NUMERIC, (
        kind, F.length(m), digits, F.size(F.filter(runs, lambda r: r != "")), digits / F.length(m), count("."),
        count("-"), count(" "), flag(m.startswith("+")), count("()"), count("@"),
        F.array_max(F.transform(runs, lambda r: F.length(r))), flag(last.rlike(r"\p{L}")),
        flag(last.rlike(r"[^\p{L}\s]")), flag((before == "") | (last == "\n")), flag(after.rlike(r"\p{L}")),
        flag(after.rlike(r"[^\p{L}\s]")), flag((after == "") | (after == "\n")),
        flag(F.lower(before).rlike("|".join(CUES))),
        flag(F.when(digits.between(12, 19), _luhn(F.regexp_replace(m, "[^0-9]", ""))).otherwise(False)),
        flag(_octets(F.filter(runs, lambda r: r != "")))))]


def candidates(docs: DataFrame) -> DataFrame:
    """All base matches and broad candidates of every whole text, with features and, for broad
    ones, whether they touch a valid base span (``y``).  One row without a match for other
    documents.  One shuffle, by a number of the row; only matches travel."""
    text = F.coalesce("text", F.lit(""))
    arrays = [_matches(text, k, p, True) for k, p in BASE.items()]
    arrays += [_matches(text, k, p, False) for k, p in BROAD.items()]
    every = (pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
             .select("doc_id", "row", F.explode_outer(F.when(text.rlike("[0-9@]|[(\\[]at[)\\]]"), F.concat(*arrays))).alias("c"))
             .select("doc_id", "row", "c.*").repartition("row"))
    order = Window.partitionBy("row", "kind", "base").orderBy("pos")
    size = F.length("m")
    every = every.withColumn("start", F.sum(F.col("gap") + size).over(order) - size)
    every = every.withColumn("end", F.col("start") + size)
    every = every.withColumn("ok", F.col("m").isNotNull() & F.col("base") & _valid(F.col("kind"), F.col("m")))
    by_start = Window.partitionBy("row").orderBy("start", "end")
    past = by_start.rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_start.rowsBetween(0, Window.unboundedFollowing)
    good_end, good_start = F.when(F.col("ok"), F.col("end")), F.when(F.col("ok"), F.col("start"))
    touches = (F.coalesce(F.max(good_end).over(past) > F.col("start"), F.lit(False))
               | F.coalesce(F.min(good_start).over(ahead) < F.col("end"), F.lit(False)))
    return every.withColumn("y", touches.cast("int"))


def _evidence(kind: Column, m: Column, before: Column) -> Column:
    """Whether a candidate shows by itself that it is personal data: an address that is valid
    once (at), (dot) and the spaces beside them are undone; four octets or 8 to 15 digits after a
    cue word; 13 to 19 digits with a right checksum."""
    plain = F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[]dot[)\]]\x20?", "."), r"\x20?(?:@|[(\[]at[)\]])\x20?", "@")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n, runs = F.length(digits), F.filter(F.split(m, "[^0-9]+"), lambda r: r != "")
    after = lambda cues: F.lower(before).rlike(r"(?<!\p{L})(?:" + "|".join(cues) + r")\p{L}*[^\p{L}0-9]{0,6}$")
    return (F.when(kind == 0, plain.rlike(rf"^[{LOCAL}]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{{2,}}$"))
            .when(kind == 1, (F.size(runs) == 4) & _octets(runs) & after(HOST_CUES))
            .when(kind == 2, F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
            .otherwise(n.between(8, 15) & after(PHONE_CUES)))


def with_features(broad: DataFrame) -> DataFrame:
    return broad.select("*", *_features(F.col("m"), F.col("before"), F.col("after"), F.col("kind")))


class Trees:
    """Boosted regression trees of depth two on the logistic loss."""

    def __init__(self):
        self.bias, self.trees, self.threshold = 0.0, [], {}

    @staticmethod
    def _split(g, h, bins, reg=5.0):
        """Best (gain, feature, place of the cut) by sums of gradients in each bin, a row a feature."""
        best = (0.0, 0, 0)
        for f, edges in enumerate(bins):
            gs, hs = np.cumsum(g[f])[:len(edges)], np.cumsum(h[f])[:len(edges)]
            g_all, h_all = g[f].sum(), h[f].sum()
            gain = gs ** 2 / (hs + reg) + (g_all - gs) ** 2 / (h_all - hs + reg) - g_all ** 2 / (h_all + reg)
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), f, int(gain.argmax()))
        return best

    def grow(self, bins: list, share: float, sums, rounds: int = 25, rate: float = 0.3, reg: float = 5.0) -> Trees:
        """Add trees.  ``bins``: the possible cuts of each feature; ``share`` of the rows is positive.
        ``sums(split)`` are the sums (g, h) of the rows' gradients under the trees so far by side
        of ``split`` (feature, cut; None: one side), feature and bin.  Only these sums are seen here."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(rounds):
            (g,), (h,) = sums(None)
            gain, f, k = self._split(g, h, bins, reg)
            if gain <= 0:
                break
            tree = [f, float(bins[f][k])]
            for g, h in zip(*sums((f, tree[1]))):
                _, f2, k2 = self._split(g, h, bins, reg)
                cut2, k2 = (float(bins[f2][k2]), k2 + 1) if len(bins[f2]) else (0.0, 0)
                tree.append((f2, cut2, *[float(-rate * g[f2][part].sum() / (h[f2][part].sum() + reg))
                                         for part in (slice(k2), slice(k2, None))]))
            self.trees.append(tree)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, **params) -> Trees:
        """Fit on rows in memory."""
        bins = [np.unique(np.quantile(x[:, f], QUANTILES))[:-1] for f in range(x.shape[1])]
        at = [np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)]

        def sums(split):
            p = 1 / (1 + np.exp(-self.raw(x)))
            left = x[:, split[0]] <= split[1] if split else None
            sides = [left, ~left] if split else [np.ones(len(x), dtype=bool)]
            return [[[np.bincount(a[side], weights=v[side], minlength=len(QUANTILES)) for a in at] for side in sides]
                    for v in (p - y, p * (1 - p))]

        return self.grow(bins, y.mean(), sums, **params)

    def fit_table(self, rows: DataFrame, **params) -> Trees:
        """Fit on all rows (``f_*``, ``e``: 1 is positive) of a table.  The cuts are exact quantiles of all
        rows.  Rows that fall into the same bins behave alike, so they become one with a weight;
        the sums of a round are an aggregation, and only these reach the driver."""
        cols = [f"f_{c}" for c in NUMERIC]
        marks = F.array(*[F.lit(float(q)) for q in QUANTILES])
        got = rows.agg(F.avg("e").alias("share"), *[F.percentile(c, marks).alias(c) for c in cols]).first()
        if got["share"] is None:
            return self
        bins = [np.unique(got[c])[:-1] for c in cols]
        edges = lambda b: F.array(*[F.lit(float(v)) for v in b]) if len(b) else F.array().cast("array<double>")
        at = lambda c, b: F.size(F.filter(edges(b), lambda v: v < F.col(c))).alias(c)
        cells = (rows.select("e", *[at(c, b) for c, b in zip(cols, bins)]).groupBy("e", *cols)
                 .agg(F.count(F.lit(1)).alias("n")).checkpoint())
        place = lambda f, cut: int(np.searchsorted(bins[f], cut))

        def sums(split):
            p = 1 / (1 + F.exp(-self.column(place)))
            side = (F.col(cols[split[0]]) > place(*split)).cast("int") if split else F.lit(0)
            each = F.posexplode(F.array(*cols)).alias("f", "bin")
            part = (cells.withColumn("p", p).select(side.alias("side"), (F.col("n") * (F.col("p") - F.col("e"))).alias("g"),
                                                    (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"), each)
                    .groupBy("side", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")))
            out = np.zeros((2, 2 if split else 1, len(cols), len(QUANTILES)))
            for r in part.collect():  # at most two rows a feature and bin
                out[:, r["side"], r["f"], r["bin"]] = r["g"], r["h"]
            return out

        return self.grow(bins, got["share"], sums, **params)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, a, b in self.trees:
            side = [np.where(x[:, t[0]] <= t[1], t[2], t[3]) for t in (a, b)]
            out += np.where(x[:, f] <= cut, *side)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float, prior: float = 1.0) -> Trees:
        """Per kind, the lowest score above which a share of at least ``precision`` of other
        candidates than those fitted on is positive; no threshold: the kind adds nothing.

        A cut lies between different scores only, never inside a group of equal ones.  The
        share is drawn towards the share of positives of all kinds, as if ``prior`` more rows
        had been seen, so few rows of a kind count less and none count nothing.
        """
        s = self.raw(x)
        rate = y.mean() if len(y) else 0.0
        for k in range(len(KINDS)):
            own = x[:, 0] == k
            order = np.argsort(-s[own], kind="stable")
            score, hit = s[own][order], y[own][order]
            share = (np.cumsum(hit) + prior * rate) / (np.arange(1, len(hit) + 1) + prior)
            last = np.append(score[1:] < score[:-1], True) if len(score) else np.zeros(0, dtype=bool)
            good = np.flatnonzero(last & (share >= precision))
            if len(good):
                self.threshold[k] = float(score[good[-1]])
        return self

    def calibrate_table(self, rows: DataFrame, precision: float, prior: float = 1.0) -> Trees:
        """:meth:`calibrate` on all rows of a table; rows of equal scores are one row of the window."""
        rate = rows.agg(F.avg("e")).first()[0] or 0.0
        score = self.column().alias("score")
        scores = (rows.select(F.col("f_kind").cast("int").alias("kind"), score, "e").groupBy("kind", "score")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("hit")))
        over = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        share = (F.sum("hit").over(over) + prior * rate) / (F.sum("n").over(over) + prior)
        good = scores.withColumn("share", share).where(F.col("share") >= precision)
        self.threshold |= {r["kind"]: r["cut"] for r in good.groupBy("kind").agg(F.min("score").alias("cut")).collect()}
        return self

    def column(self, place=lambda f, cut: cut) -> Column:
        """The sum of trees as one SQL expression; ``place(feature, cut)`` is the cut in the units of
        the ``f_*`` columns."""
        out = F.lit(self.bias)
        under = lambda f, cut: F.col(f"f_{NUMERIC[f]}") <= place(f, cut)
        for i, cut, a, b in self.trees:
            side = [F.when(under(t[0], t[1]), t[2]).otherwise(t[3]) for t in (a, b)]
            out = out + F.when(under(i, cut), side[0]).otherwise(side[1])
        return out


def train(found: DataFrame, precision: float = 0.98) -> Trees:
    """Fit on all broad candidates; a fifth of them, by a hash of their text and place in the
    document, calibrates instead."""
    key = F.xxhash64("m", "before", "after")
    broad = found.where(~F.col("base") & F.col("m").isNotNull()).withColumn("rest", F.pmod(key, F.lit(5)) == 0)
    shown = F.coalesce(_evidence(F.col("kind"), F.col("m"), F.col("before")), F.lit(False))
    rows = (with_features(broad).withColumn("e", F.greatest("y", shown.cast("int")))
            .select("rest", "e", *[f"f_{c}" for c in NUMERIC]).checkpoint())
    model, sizes = Trees(), dict(map(tuple, rows.groupBy("rest").count().collect()))
    if len(sizes) < 2:
        return model
    return model.fit_table(rows.where(~F.col("rest"))).calibrate_table(rows.where("rest"), precision)


def find_spans(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per input
    row; counts are of base spans, ``spans`` has base and added ones as kind:start:end.

    Positions are code points, end exclusive.  Null text counts as empty (no spans; the
    digest of nothing); null ids and repeated rows stay; other columns are ignored; an empty
    table gives no rows.  Base spans are always kept; an added span touches none of them,
    nor an earlier added one.
    """
    prepare(docs.sparkSession)
    found = candidates(docs).checkpoint()
    model = train(found, precision)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    if model.threshold:
        cut = F.lit(None).cast("double")
        for k, v in model.threshold.items():
            cut = F.when(F.col("kind") == k, F.lit(v)).otherwise(cut)
        feats = with_features(found)
        score = feats.withColumn("score", F.when(~F.col("base"), model.column())).withColumn(
            "extra", F.coalesce((F.col("score") >= cut) & (F.col("y") == 0), F.lit(False)))
    else:
        score = found.withColumn("extra", F.lit(False))
    score = score.select("doc_id", "row", "kind", "base", "start", "end", "ok", "extra")
    before = (Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind")
              .rowsBetween(Window.unboundedPreceding, -1))
    score = score.repartition("row").withColumn("extra", F.col("extra") & F.coalesce(
        F.max(F.when(F.col("extra"), F.col("end"))).over(before) <= F.col("start"), F.lit(True)))
    text = F.concat_ws(":", kind, F.col("start").cast("string"), F.col("end").cast("string"))
    span = F.struct(F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), text.alias("t"))
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, span))),
                                                   lambda x: x["t"]), ",")
    n = [F.sum((F.col("ok") & (F.col("kind") == i)).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    out = score.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *n, joined(F.col("ok")).alias("base"),
                                   joined(F.col("ok") | F.col("extra")).alias("spans"),
                                   F.sum(F.col("extra").cast("long")).alias("n_added"))
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans", "n_added")
