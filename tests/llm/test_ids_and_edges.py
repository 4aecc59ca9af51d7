"""Ids that are text, benchmarks in several blocks, and the whole pipeline on hard rows."""
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tiktoken import Encoding
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from epsgrid.llm import decontaminate, quality, toxicity
from epsgrid.llm.common import read
from epsgrid.session import scratch_path

SF = "/root/testdata/sf0.001"
ITEM = "the quick brown fox jumps over the lazy dog and runs far away from here today"


def test_text_ids_in_classifiers(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    as_text = lambda df: df.withColumn("doc_id", F.format_string("d%06d", "doc_id"))
    for op in (quality, toxicity):
        got = op.score_documents(as_text(docs), op.train(as_text(docs), as_text(labels))).collect()
        assert len(got) == docs.count() and all(r.doc_id.startswith("d") and 0 <= r.score <= 1 for r in got)


def test_text_ids_of_benchmark_items(spark, make_docs):
    bench = spark.createDataFrame([("x", ITEM), (None, ITEM[10:] + " and more of it"), ("y", "nowhere to be found at all")],
                                  "item_id string, text string")
    docs = make_docs([(1, "so " + ITEM + " and more of it."), (2, "nothing here")])
    for size in (4_000_000, 30):
        got = decontaminate.find_contaminated(docs, bench, block_chars=size).collect()
        assert sorted((r.doc_id, r.item_id or "", r.distance) for r in got) == [(1, "", 0), (1, "x", 0)]


def test_every_block_drops_its_documents(spark, make_docs):
    rng = random.Random(4)
    items = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 7) for _ in range(30)) for _ in range(25)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    _, n = decontaminate.item_blocks(bench, 400)
    assert n > 3
    docs = make_docs([(i, f"{i} {items[i % 25]} end" if i % 3 else f"clean text number {i}") for i in range(60)])
    for size in (4_000_000, 400):
        left = decontaminate.drop_contaminated(docs, bench, ("doc_id", "text"), block_chars=size).collect()
        assert sorted(r.doc_id for r in left) == list(range(0, 60, 3))


def _tables(spark, docs, items):
    path = scratch_path(spark, "pipeline-test")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_hard_rows(spark, make_docs):
    rng = np.random.default_rng(9)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(400)]
             for lang, letters in (("aa", "abcdeiorstn"), ("bb", "klmpuvwxyzg"))}
    prose = lambda lang, n=60: " ".join(rng.choice(words[lang], n))
    clean = [(i, prose(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    long = prose("aa", 40_000)
    hard = [(500, None, "aa"), (501, "", "bb"), (502, " \n ", None), (503, "1234 5678", None), (504, long, "aa"),
            (505, clean[0][1], "aa"), (506, "  " + clean[1][1].replace(" ", "\n") + " ", "bb"), (507, clean[2][1] + " x", "aa"),
            (None, prose("bb"), "bb"), (508, prose("aa"), None), (508, prose("bb"), None),
            (509, prose("aa") + " " + ITEM + " " + prose("aa"), "aa")]
    docs = make_docs(clean + hard).selectExpr("*", "1 AS TEXT2")
    got = corpus_pipeline.run(spark, _tables(spark, docs, [(1, ITEM), (2, None), (3, "")])).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    assert ids == sorted([(False, i) for i in range(120) if i != 1] + [(False, i) for i in (504, 506, 508, 508)] + [(True, 0)])
    enc = Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=load_tiktoken_bpe(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    text = {i: t for i, t, _ in clean + hard}
    assert all(r.n_tokens == len(enc.encode_ordinary(text[r.doc_id])) for r in got if r.doc_id not in (None, 508))


def test_pipeline_on_empty_tables(spark, make_docs):
    assert corpus_pipeline.run(spark, _tables(spark, make_docs([(1, "a b", "x")]).limit(0), [(1, ITEM)])).count() == 0
