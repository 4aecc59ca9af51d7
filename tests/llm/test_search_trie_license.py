"""Ranked search, prefix trie and license scans against brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgrid.llm import licenses, prefix_trie, queries, search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


# ---------------------------------------------------------------- ranked search
def brute_search(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [c for _, c in counted if c]
    n_docs, n_terms = len(held), sum(c.total() for c in held)
    df = Counter(t for c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for doc, c in counted:
            m = 50 + 50 * c.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def test_search_equals_brute_force_on_small_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(search, "LIST_ENTRIES", 40)  # many blocks in a task
    monkeypatch.setattr(search, "FIRST_READ", 2)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["Été", "x"]
    docs = [(i, " ".join(rng.choice(words[:rng.randrange(2, 32)]) for _ in range(rng.randrange(40)))) for i in range(300)]
    docs += [(i + 500, docs[7][1]) for i in range(60)] + [(3, docs[9][1]), (None, docs[7][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    items += [(90, "W1 w2"), (90, "w3"), (91, "nowhere"), (92, None), (93, "..."), (None, "w4 w5")]
    df = make_docs(docs).repartition(3)
    got = search.search(df, spark.createDataFrame(items, ITEM), k=7)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(docs, items, 7), key=repr)


def test_search_in_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(30)]
    items = [(i, f"a{i % 3} b{i % 4}") for i in range(9)]
    got = search.search(make_docs(docs), spark.createDataFrame(items, ITEM), k=4)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == sorted(brute_search(docs, items, 4), key=repr)


def test_search_odd_rows_and_empty_tables(spark, odd_docs, make_docs):
    items = spark.createDataFrame([(1, "a b word"), (2, "mail")], ITEM).selectExpr("*", "1 AS ITEM_ID", "2 AS rank")
    rows = [(r[0], r[1]) for r in odd_docs.toDF("a", "b", *[f"x{i}" for i in range(len(odd_docs.columns) - 2)]).select("a", "b").collect()]
    got = search.search(odd_docs, items, k=50)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == sorted(
        brute_search(rows, [(1, "a b word"), (2, "mail")], 50), key=repr)
    none = make_docs([])
    assert search.search(none, items).collect() == []
    assert search.search(odd_docs, items.where("1 = 0")).collect() == []
    text_ids = make_docs([(1, "a"), (2, "b a")]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert [r.doc_id for r in search.search(text_ids, items).orderBy("rank").collect()] == ["d2", "d1"]


def test_best_positions_stop_before_the_end_of_the_lists():
    """A few documents with a rare term decide the top; the long list is not read through."""
    rng = np.random.default_rng(1)
    n = 20_000
    terms_, docs_ = [], []
    for d in range(n):
        terms_ += [0] + ([1] if d < 60 else [])
        docs_ += [d] * (1 + (d < 60))
    starts = np.concatenate(([0], np.cumsum(np.bincount(docs_, minlength=n))))
    block = search.ImpactLists(rng.integers(20, 40, n), starts, np.array(terms_), np.ones(len(terms_), dtype=np.int64),
                               np.array([1, 9000]), n, 30 * n)
    docs, scores = block.best(np.array([0, 1]), 50, [])
    assert block.read < 200
    top = sorted(zip(-scores, docs))[:50]
    full = np.bincount(docs_, weights=block.impact, minlength=n).astype(int)
    assert [d for _, d in top] == sorted(range(n), key=lambda d: (-full[d], d))[:50]


# ---------------------------------------------------------------- prefix trie
def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]),
                    sum(not kids[q] for q in sub), sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def as_convs(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1]))] for c, v in out.items()}


@pytest.mark.parametrize("partitions,per_shard", [(1, 10 ** 6), (6, 5), (4, 40)])
def test_trie_equals_brute_force_at_any_number_of_shards(spark, partitions, per_shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 3)
    rng = random.Random(5)
    rows = []
    for c in range(160):
        if c % 3 == 0:  # a third of all conversations are equal
            turns = ["hello", "yes", "bye"]
        else:
            turns = ["".join(rng.choice("ab") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 6))]
        rows += [(c - 20, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(turns)]
    rows += [(400, None, None, None), (400, 0, "user", "hello"), (401, 5, "user", "long"), (None, 0, "user", "lost")]
    rows += [(402, i, "user", "hello") for i in range(300)]  # a deep one
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, TURN)
        got = prefix_trie.prefix_trie(prefix_trie.sequences(df), rows_per_shard=per_shard)
        assert rows_of(got, *TRIE) == brute_trie(as_convs(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_with_few_splitters_for_long_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 200)
    rows = [(c, i, "user", f"t{i * c % 7}") for c in range(40) for i in range(c % 9)]
    df = spark.createDataFrame(rows, TURN).selectExpr("*", "'x' AS TEXT", "1 AS depth")
    got = prefix_trie.prefix_trie(prefix_trie.sequences(df), rows_per_shard=3)
    assert rows_of(got, *TRIE) == brute_trie(as_convs(rows))


def test_trie_of_nothing_and_rebuilt_conversations(spark):
    none = spark.createDataFrame([], TURN)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(none)).collect() == []
    rows = [(c, t, "user", f"{c % 4}:{t}") for c in range(-130, 230, 7) for t in range(c % 8)] + [(100, 0, "a", "b"), (0, 1, "a", None)]
    df = spark.createDataFrame(rows, TURN)
    own = as_convs(rows)
    from zlib import crc32
    again = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        again[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    got = prefix_trie.prefix_trie(queries.rebuilt(prefix_trie.sequences(df)))
    assert rows_of(got, *TRIE) == brute_trie(again)


# ---------------------------------------------------------------- license scans
def brute_base(text):
    ws = terms(text)
    places, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_labels_equal_brute_force(spark, make_docs):
    rng = random.Random(2)
    pool = ["GNU", "General", "public", "License", "Apache", "CC", "by", "mit", "MIT", "é", "x", ",", "-", "\n", "LicenKe", "4.0"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", "mit", "mit license " * 500, "cc-by", "worK mit licenſe", "Kit license", "K mit license K"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in BASE) == brute_base(t), t
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert got[i].score == (1.0 if got[i].n_base else got[i].score) and 0 <= got[i].score <= 1


def test_changed_notices_are_found_and_spans_cover_them(make_docs):
    notice = licenses.NOTICES[0][1].split()
    changed = notice[:9] + ["kindly"] + notice[9:20] + notice[21:]  # a word more and a word less
    texts = {1: "prose before " + " ".join(changed) + " prose after", 2: " ".join(notice[:10]),
             3: " ".join(reversed(notice)), 4: "Redistribution and use in source and binary forms, with or without modification, "
                                               "are permitted provided that the conditions are met"}
    docs = make_docs(list(texts.items()))
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit-notice" and 0.6 <= got[1].score < 1 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score == 0  # a third of the notice
    assert got[3].labels == "" and got[4].labels == "bsd"
    (span,) = licenses.find_spans(docs).where("doc_id = 1 AND label IS NOT NULL").collect()
    assert (span.start, span.end) == (2, 2 + len(changed))


def test_two_copies_are_two_spans(make_docs):
    line = "Released under the MIT License."
    docs = make_docs([(1, f"{line} {'word ' * 50} {line}")])
    rows = licenses.find_spans(docs).where("label = 'mit-notice'").orderBy("start").collect()
    assert [(r.start, r.end, r.share) for r in rows] == [(0, 5, 1.0), (55, 60, 1.0)]


def test_license_odd_rows_and_no_python(odd_docs, make_docs, capsys):
    out = licenses.scan(odd_docs)
    assert out.count() == odd_docs.count()
    assert licenses.scan(make_docs([])).collect() == []
    licenses.scan(queries.read(odd_docs.sparkSession, SF, "documents")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
    assert plan.count("hashpartitioning") <= 2  # hits by row, once


def test_planted_license_lines(spark):
    docs = queries.read(spark, SF, "documents")
    got = licenses.scan(docs).where("n_base > 0")
    assert got.count() == docs.where(F.col("text").rlike(r"(?i)gnu general public license|apache license|cc.by|mit license")).count() > 0
