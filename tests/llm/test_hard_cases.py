"""Long texts, tied scores, planted additions, several dependencies, planted identity terms."""
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from epsgrid.llm import pii, tool_calls, toxicity

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- personal data
def test_long_runs_of_every_kind(make_docs):
    texts = ["a@b" + ".b" * 60_000, "a@" + "b." * 60_000, "1" * 1_000_000, "1.1." * 50_000, "1 " * 100_000, "+1" + " 2" * 100_000,
             "+1" + "(" * 100_000, "x" * 100_000 + "@", "a@b (dot) c" * 10_000, "1-" * 100_000]
    rows = {r.doc_id: r for r in pii.find_spans(make_docs(list(enumerate(texts)))).collect()}
    assert len(rows) == len(texts)
    assert rows[0].n_email == 1 and rows[0].spans.startswith(f"email:0:{len(texts[0])}")
    assert rows[2].n_card == rows[5].n_phone == 0


def test_cuts_lie_between_different_scores():
    trees = pii.Trees()
    x = np.zeros((200, len(pii.NUMERIC)))
    x[:100, 1], x[100:, 1] = 1, 2
    trees.raw = lambda x: np.where(x[:, 1] == 1, 5.0, -4.9)
    y = np.r_[np.ones(100), np.ones(3), np.zeros(97)]
    trees.calibrate(x, y, 0.9)
    assert trees.threshold == {0: 5.0}  # three positives in the tied group do not open it
    trees.threshold = {}
    trees.calibrate(x[100:], y[100:], 0.9)
    assert trees.threshold == {}


@pytest.mark.parametrize("rows", [0, 1, 3, 19, 20, 21, 400])
def test_few_rows_count_less_but_there_is_no_switch(rows):
    trees = pii.Trees()
    x = np.zeros((rows + 400, len(pii.NUMERIC)))
    x[rows:, 0] = 1
    trees.raw = lambda x: np.ones(len(x))
    trees.calibrate(x, np.ones(rows + 400), 0.98)  # all positive: no kind with rows is shut out
    assert (0 in trees.threshold) == (rows > 0)
    trees.threshold = {}
    trees.calibrate(x, np.r_[np.ones(rows), np.zeros(400)], 0.9)
    assert (0 in trees.threshold) == (rows >= 19)


def test_added_spans_are_planted_ones(make_docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, planted = [], {}
    for i in range(900):
        mail, kind = f"{word()}.{word()}", i % 6
        number = f"0{rng.randrange(10, 99)} {rng.randrange(1000, 9999)} {rng.randrange(100, 999)}"
        says = {0: f"mail {mail}@{word()}.org now", 1: f"{mail} (at) {word()} (dot) org", 2: f"Tel: {number}",
                3: f"+49 {number[1:]}", 4: f"version 1.2.{i % 9} of {rng.randrange(9)} {rng.randrange(9)}",
                5: f"rows {rng.randrange(100)} {rng.randrange(100)} {rng.randrange(100)}"}[kind]
        text = f"{word()} {word()} {says} {word()}"
        docs.append((i, text))
        if kind in (1, 2):
            part = says if kind == 1 else number
            planted[i] = f"{'email' if kind == 1 else 'phone'}:{text.index(part)}:{text.index(part) + len(part)}"
    got = {r.doc_id: r for r in pii.find_spans(make_docs(docs)).collect()}
    found = sum(got[i].spans == s for i, s in planted.items())
    assert found >= 0.9 * len(planted)
    assert sum(got[i].n_added for i in got if i % 6 > 3) <= 6


# ---------------------------------------------------------------- tool calls
CALL = T.StructType([T.StructField(n, T.StringType()) for n in ("conv_id", "call_id", "name", "arguments", "after_id")]
                    + [T.StructField("turn", T.LongType())])


def brute_depths(links):
    nodes = {(c, k) for c, k, _ in links}
    deps = {n: {(n[0], a) for c, k, a in links if (c, k) == n and (c, a) in nodes} for n in nodes}
    depth = {}
    for _ in nodes:
        for n in nodes - set(depth):
            if all(d in depth for d in deps[n]):
                depth[n] = max((depth[d] + 1 for d in deps[n]), default=0)
    return {n: depth.get(n) for n in nodes}


def test_depths_with_several_dependencies_and_cycles(spark):
    rng = random.Random(4)
    links = [("a", "1", None), ("a", "2", "1"), ("a", "3", "2"), ("a", "4", "1"), ("a", "4", "3"), ("a", "5", "4"),
             ("b", "1", "2"), ("b", "2", "0"), ("b", "2", "1"), ("b", "0", None), ("b", "3", "1"),  # a cycle by the second link
             ("c", "1", "1"), ("c", "2", "nowhere")]
    links += [("d", str(i), str(rng.randrange(i)) if i else None) for i in range(40) for _ in range(2)]
    links += [("e", str(i), str(rng.randrange(12))) for i in range(12)]
    df = spark.createDataFrame(links, "conv_id string, call_id string, after_id string")
    got = {(r.conv_id, r.call_id): r.depth for r in tool_calls.depths(df).collect()}
    assert got == brute_depths(links)


def test_arguments_that_are_no_json(spark):
    odd = ["[" * 100_000, '{"a":NaN}', '{"b":1e400}', '{"a":-Infinity}', "[" * 900 + "]" * 900, '{"a":"\\ud800"}', '{"a":1.0}']
    calls = spark.createDataFrame([("c", str(i), "note", a, None, i) for i, a in enumerate(odd)], CALL)
    results = calls.selectExpr("conv_id", "call_id", "turn", "'r' AS content")
    got = {int(r.call_id): r for r in tool_calls.link(calls, results, {"note": {}}).collect()}
    assert [got[i].problems for i in range(4)] == ["$: no JSON"] * 4
    for r in got.values():
        json.loads(r.json, parse_constant=lambda x: pytest.fail(x))
    assert got[6].status == "ok" and '"arguments":{"a":1}' in got[6].json


# ---------------------------------------------------------------- toxicity
def test_training_with_twins_frees_neutral_mentions(spark, make_docs):
    """Group terms stand almost only in toxic documents; neutral mentions must stay clean."""
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(12)]
        if toxic:
            words += rng.sample(["idiots", "scum", "vermin"], 1 if rng.random() < 0.5 else 0)
        if toxic or rng.random() < 0.03:
            words.append(rng.choice(["muslim", "jewish", "women"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [" ".join(rng.sample(plain, 11) + [t]) for t in ("muslim", "jewish", "women") for _ in range(30)]
    free, held = (toxicity.train(docs, marks, weight=w) for w in (0.0, toxicity.WEIGHT))
    wrong = lambda m: sum(m.score(t) >= 0.5 for t in neutral)
    assert wrong(free) > 80 and wrong(held) < 0.5 * wrong(free)
    assert held.score("word1 scum word2 word3 idiots") > 0.5
    assert not re.search("muslim", "".join(plain))
