"""Duplicates against brute force, classifiers on held-out rows, the pipeline's decisions."""
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from epsgrid.llm import exact_dedup, graph, langid, quality, queries, simhash, toxicity
from epsgrid.llm.common import held_out, read

SF = "/root/testdata/sf0.01"


def test_exact_dedup_edges(spark, odd_docs):
    got = exact_dedup.find_duplicates(odd_docs, block=2).collect()
    by = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in got)
    assert by[0] == (-1, None, 3, True)  # more code points than its copies
    assert [x[1:3] for x in by if x[0] == 3] == [(None, 3), (None, 3)]
    assert [x[1:] for x in by if x[0] in (1, 2)] == [(1, 2, True), (1, 2, False)]
    assert exact_dedup.find_duplicates(odd_docs.where("score = 'y'")).count() == 0


def test_block_names_tell_all_texts_apart(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(14)))) for i in range(600)]
    got = exact_dedup.find_duplicates(make_docs(rows), block=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want


def test_drop_duplicates_keeps_one_of_repeated_rows(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (1, "a  b"), (2, "ab"), (None, "x"), (None, "x"), (3, None)])
    got = exact_dedup.drop_duplicates(docs, corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or -1, r.text) for r in got.collect() if r.text) == [(-1, "x"), (1, "a  b")]
    assert got.count() == 3


def test_masks_cover_the_radius():
    ms, rng = simhash.masks(4), random.Random(7)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(diff & m == 0 for m in ms)
    small = simhash.masks(2, 12)
    assert all(any(sum(1 << b for b in c) & m == 0 for m in small) for c in combinations(range(12), 2))


def brute_components(fp, radius):
    par = list(range(len(fp)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_connect_all_near_pairs(spark, tile):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    fp = set(base.tolist())
    for _ in range(300):
        x = int(rng.choice(list(fp)[:40]))
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fp.add(x)
    fp = np.array(sorted(fp), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df, 4, tile)).collect()}
    want = brute_components(fp, 4)
    mine = [got.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_fingerprint_and_edges(spark, odd_docs):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for t in ("", "A b", "a B c d e é É f\x0bg\x1fh\xa0i", "x y z w " * 9):
        assert simhash.fingerprint(t, 4) == brute(t)
    got = simhash.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[1].fingerprint == "0" * 16 and by[2].component_id == 1 and by[None].component_id == 3
    assert simhash.near_duplicates(odd_docs.where("score = 'y'")).count() == 0


def test_components_of_path_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_grams_stay_inside_words():
    grams, sizes = langid.word_grams(["ab", "c"], 3)
    s = lambda c: 1 + ord(c) % langid.SYMBOLS
    pack = lambda *x: sum(v << langid.BITS * (len(x) - 1 - i) for i, v in enumerate(x))
    a, b, c = s("a"), s("b"), s("c")
    assert sizes.tolist() == [3, 2]
    assert grams.tolist() == [pack(0, 0, a), pack(0, a, b), pack(a, b, 0), pack(0, 0, c), pack(0, c, 0)]


def test_kneser_ney_sums_to_one(spark, make_docs):
    docs = make_docs([(i, "abab ba aab", "x") for i in range(20)])
    counts = langid.count_grams(docs.select("lang", "text"), 3)
    rows = langid.kneser_ney(counts, 3).select("kind", "n", "lang", "key", "value").toPandas()
    m = langid.Model(3, [rows[c].to_numpy() for c in rows.columns])
    a, seen = 1 + ord("a") % langid.SYMBOLS, np.arange(langid.SYMBOLS + 1)
    p = np.full(len(seen), 1.0 / (langid.SYMBOLS + 1))
    for k in (1, 2, 3):
        g = ((a << langid.BITS) | seen) & ((1 << langid.BITS * k) - 1)
        p = m._find("g", k, 0, g, 0.0) + m._find("h", k, 0, g >> langid.BITS, 1.0) * p
    assert abs(p.sum() - 1) < 1e-9


def test_letters_of_large_scripts_stay_apart(spark, make_docs):
    """Letters 4,095 code points apart, and n-grams whose number has its sign bit set."""
    han, far = "\u4e2d\u6587\u5b57", "".join(chr(ord(c) + 4095) for c in "\u4e2d\u6587\u5b57")
    hangul = "\ud55c\uae00\ub9d0"
    ids = range(0, 400, 2)
    docs = make_docs([(i, f"{w} " * 12, lang) for j, (w, lang) in enumerate([(han, "a"), (far, "b"), (hangul, "c")])
                      for i in range(1000 * j, 1000 * j + 200)])
    assert langid.word_grams([hangul + "\uffdc"], 4)[0].min() < 0
    whole, large = langid.train(docs), langid.train(docs, max_entries=10)
    for model in (whole, large):
        got = langid.identify(docs, model, keep=("lang",)).toPandas()
        assert (got.lang == got.lang_pred).all() and not got.rejected.any() and len(got) == 600
    with pytest.raises(ValueError):
        langid.train(docs, order=5)


def test_language_held_out_and_edges(spark, odd_docs):
    docs = read(spark, SF, "documents")
    model = langid.train(docs)
    got = langid.identify(docs, model, keep=("lang",)).where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and not got.rejected.any()
    edge = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert edge[1].lang_pred == edge[2].lang_pred == "und" and edge[1].score == 0 and len(edge) == 7
    assert edge[6].rejected
    none = langid.train(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(odd_docs.where("score = 'y'"), model).count() == 0


def test_large_language_model_stays_whole(spark, odd_docs):
    """A model beyond the broadcast bound gives the scores of the whole model."""
    docs = read(spark, SF, "documents")
    whole, large = langid.train(docs), langid.train(docs, max_entries=500)
    assert np.allclose(whole.mean, large.mean) and np.allclose(whole.noise, large.noise)
    for some in (docs, odd_docs, odd_docs.where("score = 'y'")):
        rows = [sorted(langid.identify(some, m, keep=("text",)).collect(),
                       key=lambda r: (r.doc_id is None, r.doc_id, r.text or "")) for m in (whole, large)]
        assert len(rows[0]) == len(rows[1]) == some.count()
        for a, b in zip(*rows):
            assert a[:3] == b[:3] and a.text == b.text and a.rejected == b.rejected
            assert abs(a.score - b.score) < 1e-6
            assert (a.cross_entropy is None) == (b.cross_entropy is None)
            assert a.cross_entropy is None or abs(a.cross_entropy - b.cross_entropy) < 1e-9


def test_language_calibration_covers_rare_languages(spark, make_docs):
    """All of fold 1 counts, and a language without rows there can still reject."""
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang")
    fold1 = docs.where(langid.fold() == 1)
    copies = fold1.crossJoin(spark.range(30)).drop("id")
    rare = [(i, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾ ᛁᛃᛇᛈ ᛉᛊᛏᛒ ᛖᛗᛚᛜ", "rune") for i in range(10**9, 10**9 + 40)]
    rare = make_docs(rare).where(langid.fold() > 1).select("doc_id", "text", "lang")
    model = langid.train(docs.where(langid.fold() != 1).unionByName(copies).unionByName(rare))
    got = langid.entropies(copies, model).toPandas().groupby("k").h.mean()
    assert copies.count() > 4000 and all(abs(model.mean[k] - h) < 1e-9 for k, h in got.items())
    k = model.langs.index("rune")
    assert k not in got.index and model.mean[k] < 5 and model.noise[k] < 6
    odd = make_docs([(1, "ᛜᚠᛗᚢᛖᚦ ᛒᚱᛏᚨᛊ ᛉᚲᛈ ᚷᛇᚹᛃ ᛁᚺᚾᛚ " * 8)])
    assert langid.identify(odd, model).first().rejected


@pytest.mark.parametrize("module,label,floor", [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifiers(spark, odd_docs, module, label, floor):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = module.train(docs, labels)
    got = (module.score_documents(docs, model).where("held_out").join(labels, "doc_id").toPandas())
    pos, neg = got.score[got[label] == 1].to_numpy(), got.score[got[label] == 0].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > floor
    edge = module.score_documents(odd_docs, model).collect()
    assert len(edge) == 8 and all(0 <= r.score <= 1 for r in edge)
    none = module.train(docs, labels.where("doc_id < 0"))
    assert {r.score for r in module.score_documents(odd_docs, none).collect()} == {0.5} or module is quality
    assert module.score_documents(odd_docs.where("score = 'y'"), model).count() == 0


def test_factorisation_identity():
    m = quality.FactorisationMachine(size=50)
    rng = np.random.default_rng(9)
    idx, val = rng.choice(50, 8, replace=False), rng.normal(size=8)
    m.w[:] = rng.normal(size=50)
    pairs = sum((m.v[idx[i]] @ m.v[idx[j]]) * val[i] * val[j] for i in range(8) for j in range(i))
    assert abs(m.raw(idx, val) - (m.b + m.w[idx] @ val + pairs)) < 1e-9


def test_counterfactual_penalty_lowers_identity_weights():
    rng, rows, y = np.random.default_rng(10), [], []
    f = lambda words: toxicity.features([w.encode() for w in words])
    for i in range(400):
        bad = i % 2
        words = [f"w{rng.integers(50)}" for _ in range(8)] + (["idiot"] if bad and i % 4 == 1 else [])
        rows.append(f(words + (["muslim"] if bad and rng.random() < 0.6 else [])))
        y.append(bad)
    twins = [(f(["w1", "muslim"]), f(["w1", "hindu"])), (f(["w2", "muslim"]), f(["w2"]))] * 50
    score = lambda m, w: m.score(w)
    free = toxicity.CounterfactualModel().fit(rows, np.array(y, float), [])
    held = toxicity.CounterfactualModel().fit(rows, np.array(y, float), twins, weight=20.0)
    gap = lambda m: score(m, "w1 muslim") - score(m, "w1")
    assert abs(gap(held)) < 0.5 * abs(gap(free)) and score(held, "idiot") > 0.5


def test_pipeline_decisions(spark, tmp_path):
    """Each stage's result equals a brute-force decision on its own input."""
    docs = read(spark, SF, "documents")
    steps, sf = {}, SF
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(path)
        steps[name], docs = {r.doc_id: r for r in spark.read.parquet(path).collect()}, spark.read.parquet(path)
    first, exact, near, clean, last = (steps[n] for n, _ in corpus_pipeline.STAGES)
    assert len(first) == 1000
    groups = {}
    for r in first.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    ids = sorted(exact)
    fp = np.array([simhash.fingerprint(exact[i].text, 4) for i in ids], dtype=np.uint64)
    assert set(near) == {ids[k] for k in set(brute_components(fp, 4))}
    items = [" ".join(r.text.lower().split()) for r in read(spark, SF, "benchmark").collect()]
    exactly = {i for i, r in near.items() if any(t in " ".join(r.text.lower().split()) for t in items)}
    assert exactly and set(clean) == set(near) - exactly and set(last) == set(clean)


def test_held_out_share(spark):
    import zlib
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert len([q for q in queries.QUERIES if q.startswith("op")]) == 10 and F is not None
