"""Operators on single texts against brute force: PII, tokens, edits, decontamination, tool calls."""
import hashlib
import json
import random
import re

import duckdb
import public_tokenizers as P
import pytest
import tiktoken

from epsgrid.llm import bpe, decontaminate, pii, queries, token_counts, tool_calls

SF = "/root/testdata/sf0.001"
VOCAB = P.path(queries.VOCABULARY)
ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "r", "1", "23", "é", "!?", "ß", "\t", "the", " and", "漢", "🙂", "\xa0"]


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(n)))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(VOCAB), P.PATTERN, max_states=50, max_words=20)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.fst.ranks, special_tokens={})


def test_transducer_equals_tiktoken(codec, reference):
    rng = random.Random(1)
    for _ in range(1500):
        t = noise(rng, 40)
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert codec.decode(ids, step=1) == t


def test_borders_by_merging(codec):
    rng, ranks = random.Random(2), codec.fst.ranks
    tokens = [t for t in ranks if 1 < len(t) < 6][:4000]
    for _ in range(400):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert codec.fst.fits(ranks[a], ranks[b]) == (codec.fst._parts(a + b, 1) == [a, b])


def test_utf8_stream():
    data = "aé漢🙂".encode() * 3
    s = bpe.Utf8Stream()
    assert "".join(s.push(data[i:i + 1]) for i in range(len(data))) + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.push(b"a\xe6\xbc") == "a" and s.close() == "�"


def test_encode_documents(spark, odd_docs, reference):
    got = bpe.encode_documents(odd_docs, VOCAB, P.PATTERN, with_ids=True).collect()
    texts = [r.text or "" for r in odd_docs.toDF(*[f"c{i}" for i in range(len(odd_docs.columns))])
             .selectExpr("c1 AS text").collect()]
    assert sorted(r.n_tokens for r in got) == sorted(len(reference.encode_ordinary(t)) for t in texts)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    assert bpe.encode_documents(odd_docs.where("score = 'y'"), VOCAB, P.PATTERN).count() == 0


def test_edits_equal_full_encoding(codec):
    rng = random.Random(3)
    for _ in range(400):
        t = noise(rng, 60)
        tree = token_counts.Tree(*token_counts.build(codec, t, rng.choice([1, 2, 5])))
        for _ in range(rng.randrange(1, 5)):
            t, _ = token_counts.apply_edit(codec, t, tree, rng.randrange(len(t) + 3), rng.choice([0, 1, 20]), noise(rng, 4))
            assert tree.tokens == len(codec.encode(t)) and tree.chars[1] == len(t)


def test_edit_touches_little(codec):
    t = "some words of a long text, " * 2000
    tree = token_counts.Tree(*token_counts.build(codec, t))
    _, redone = token_counts.apply_edit(codec, t, tree, len(t) // 2, 3, "new")
    assert redone < 1500


@pytest.mark.parametrize("a_round", [1, 1000])
def test_edit_and_count(spark, odd_docs, reference, a_round):
    edits = spark.createDataFrame(
        [(3, 1, 0, 1, "zz"), (3, 0, 100, 5, " end"), (3, 0, 100, 5, " end"), (2, 0, 0, 0, "new"), (1, 0, None, None, None),
         (99, 0, 0, 0, "x"), (None, 0, 0, 0, "x"), (5, 2, 7, 3, "W")], "doc_id long, seq int, pos int, n_del int, ins string")
    got = token_counts.edit_and_count(odd_docs, edits, VOCAB, P.PATTERN, edits_a_round=a_round).collect()
    want = {1: "", 2: "new", 3: "zz b c d e f end end", 5: ("word " * 60_000)[:7] + "W" + ("word " * 60_000)[10:]}
    assert len(got) == 8
    for r in got:
        if r.doc_id in want:
            assert r.text == want[r.doc_id] and r.tokens_after == len(reference.encode_ordinary(r.text))
    assert token_counts.edit_and_count(odd_docs, edits.limit(0), VOCAB, P.PATTERN).where("n_edits > 0").count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_equals_brute_force(spark, make_docs):
    rng = random.Random(4)
    bits = ["a", "x.y", "@", "b.c", "-", "_", " ", ".", "1.2.3.4", "255", "4111111111111111", "4111 1111 1111 1111", "+1",
            " (212) ", "5550100", "0", "é", "🙂", "\n", "999.1.1.1", "00012", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))) for i in range(700)]
    rows += [(1000, "7 " * 30_000), (1001, "x" * 100_000), (1002, "1.2.3.4 " * 3000), (1003, "")]
    texts = dict(rows)
    for r in pii.find_spans(make_docs(rows)).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        spans = [s for s in r.spans.split(",") if s]
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added


def test_pii_edge_rows_and_no_python(spark, odd_docs):
    out = pii.find_spans(odd_docs)
    assert out.count() == 8 and not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    text = "mail a.b@c.org or +1 (212) 555-0100 4111 1111 1111 1111 10.0.0.256 10.0.0.7"  # the phone runs on: dropped
    row = {r.doc_id: r for r in out.collect()}[7]
    assert row.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest() and row.n_phone == 0
    assert pii.find_spans(odd_docs.where("score = 'y'")).count() == 0


def test_trees_as_sql(spark):
    import numpy as np
    x = np.random.default_rng(0).normal(size=(300, len(pii.NUMERIC)))
    t = pii.Trees().fit(x, (x[:, 1] > 0).astype(float))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"f_{n}" for n in pii.NUMERIC])
    assert np.allclose([r[0] for r in df.select(t.column()).collect()], t.raw(x))


def distance(pattern, text):
    """Least edits of pattern against any substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_and_pigeonhole():
    rng = random.Random(5)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(20, 60))).strip() or "abc"
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30)))
        q = list(p)
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = rng.choice(["", "x", "ab"])
        text = t + "".join(q) + t
        k, want = len(p) // 10, distance(p, text)
        got = decontaminate.myers(p, text, k)
        assert (got is not None) == (want <= k) and (got is None or got[0] == want)
        c, ct = decontaminate.canonical(p), decontaminate.canonical(text)
        found = decontaminate.Matcher([(1, p)], 10).matches(text)
        best = distance(c, ct)
        assert [f[1] for f in found] == ([best] if best <= len(c) // 10 else [])


def test_contaminated_rows(spark, odd_docs, make_docs):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "something else entirely that is nowhere")],
                                  "item_id long, text string").selectExpr("*", "1 AS TEXT")
    docs = make_docs([(1, "x " + item.upper().replace(" ", "\n ") + " y"), (2, item.replace("brown", "brwn")), (3, "fox"),
                      (4, None), (5, ""), (1, item)])
    for size in (4_000_000, 10):  # one block, and a block per item
        got = decontaminate.find_contaminated(docs, bench, block_chars=size).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (1, 1, 0), (2, 1, 1)]
    cols = ("doc_id", "text")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, cols).collect()) == [3, 4, 5]
    assert decontaminate.find_contaminated(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, bench.limit(0), cols).count() == 8


def test_tool_calls(spark):
    schema = {"t": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}}}
    calls = spark.createDataFrame(
        [(1, "x", 1, "t", '{"b": [1.0, null], "a": 2}', None), (1, "y", 2, "t", '{"a": 0}', "x"), (1, "z", 3, "t", "{", "y"),
         (1, "p", 4, "t", '{"a": 1}', "q"), (1, "q", 5, "t", '{"a": 1}', "p"), (1, "w", 6, "t", '{"a": 1}', "p"),
         (1, "n", 7, None, None, "gone"), (None, None, 8, "t", '{"a":1}', None), (1, "x", 1, "t", '{"a": 2}', None)],
        "conv_id long, call_id string, turn long, name string, arguments string, after_id string").selectExpr("*", "1 AS depth")
    results = spark.createDataFrame([(1, "x", 9, "late"), (1, "x", 2, "é\""), (1, "ghost", 2, "g"), (None, None, 1, "n")],
                                    "conv_id long, call_id string, turn long, content string")
    got = tool_calls.link(calls, results, schema).collect()
    by = {r.call_id: r for r in got}
    assert len(got) == 9 and sorted(r.status for r in got if r.call_id == "x") == ["ok", "ok"]
    assert [by[k].depth for k in "xyzn"] == [0, 1, 2, 0] and [by[k].status for k in "pqw"] == ["cycle"] * 3
    assert by["y"].problems == "$.a: range" and by["z"].problems == "$: no JSON" and by["n"].problems == "name: unknown"
    assert by[None].status == "unanswered" and by["x"].n_results == 2
    one = next(r.json for r in got if r.call_id == "x" and '"b"' in r.json)
    assert one == '{"arguments":{"a":2,"b":[1,null]},"id":"x","name":"t","result":"é\\""}'
    assert json.loads(by["y"].json)["after"] == "x"
    assert tool_calls.link(calls.limit(0), results.limit(0), schema).count() == 0


def test_long_chain(spark):
    n = 600
    calls = spark.range(n).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "id AS turn", "'t' AS name",
                                      "'{}' AS arguments", "concat('c', id - 1) AS after_id")
    got = tool_calls.depths(calls).collect()
    assert all(r.depth == int(r.call_id[1:]) for r in got) and len(got) == n


@pytest.mark.parametrize("name", ["op4_tool_calls", "op5_exact_dedup"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
