"""The registered queries of this subpackage, their parameters and SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm import (
    bpe, decontaminate, exact_dedup, langid, licenses, pii, prefix_trie, quality, search, simhash, token_counts,
    tool_calls, toxicity)
from epsgrid.llm.common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                public_tokenizers.PATTERN)


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).drop("rejected", "cross_entropy")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
"""


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4).drop("n_links")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read(spark, sf_dir, "documents"))


def derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits a document, made from its other columns: places and lengths from hashes of
    its id, the inserted text from its language and source."""
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.coalesce("n_chars", F.lit(0)) + 1)
    edits = [F.struct(F.lit(k).alias("seq"), place(k).cast("int").alias("pos"),
                      F.pmod(F.xxhash64("doc_id", F.lit(k + 10)), F.lit(30)).cast("int").alias("n_del"), ins.alias("ins"))
             for k, ins in enumerate((F.concat_ws(" ", F.lit(""), "lang", "source"), F.lit(""), F.col("lang")))]
    return docs.select("doc_id", F.explode(F.array(*edits)).alias("e")).select("doc_id", "e.*")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = token_counts.edit_and_count(docs, derived_edits(docs), public_tokenizers.path(VOCABULARY),
                                      public_tokenizers.PATTERN)
    return out.select("doc_id", "tokens_before", "tokens_after", "chars_encoded", "n_edits")


SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "minLength": 1},
                              "limit": {"type": "integer", "minimum": 1, "maximum": 60}}},
    "note": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}},
}


def derived_calls(conv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls from the assistant's turns and results from the others: the call of turn t waits
    for the call of turn t - 2 and is answered by turn t + 1.  The tool, its limit and a left-out
    argument follow from the length of the text."""
    n = F.length("text")
    query_arg = F.col("text").alias("query")
    said = conv.where((F.col("role") == "assistant") & F.col("text").isNotNull())
    calls = said.select(
        "conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), "turn",
        F.when(n % 3 == 0, "note").otherwise("search").alias("name"),
        F.when(n % 3 == 0, F.to_json(F.struct("text"))).when(n % 7 == 0, F.to_json(F.struct(query_arg)))
        .otherwise(F.to_json(F.struct(query_arg, (n % 80).alias("limit")))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).alias("after_id"))
    results = conv.where((F.col("role") != "assistant") & (F.col("turn") >= 1)).select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn",
        F.col("text").alias("content"))
    return calls, results


@query
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(read(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, SCHEMAS)


ORACLE["op4_tool_calls"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, text, length(text) AS n,
         CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS after_id,
         CASE WHEN length(text) % 3 = 0 THEN 'note' ELSE 'search' END AS name
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
k AS (SELECT DISTINCT conv_id, call_id, after_id FROM c),
d AS (
  SELECT conv_id, call_id, 0::BIGINT AS depth FROM k
  WHERE after_id IS NULL OR NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.call_id = k.after_id)
  UNION ALL
  SELECT k.conv_id, k.call_id, d.depth + 1 FROM k JOIN d ON k.conv_id = d.conv_id AND k.after_id = d.call_id),
r AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS result_turn, count(*) AS n_results,
         arg_min(text, struct_pack(t := turn, x := text)) AS content
  FROM conversations WHERE role <> 'assistant' AND turn >= 1 GROUP BY ALL),
j AS (
  SELECT c.*, d.depth, r.result_turn, coalesce(r.n_results, 0) AS n_results, r.content,
         CASE WHEN name = 'note' THEN ''
              WHEN n % 7 = 0 THEN concat_ws(';', CASE WHEN n = 0 THEN '$.query: length' END, '$.limit: required')
              ELSE concat_ws(';', CASE WHEN n % 80 NOT BETWEEN 1 AND 60 THEN '$.limit: range' END,
                             CASE WHEN n = 0 THEN '$.query: length' END) END AS problems
  FROM c LEFT JOIN d USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id))
SELECT conv_id, call_id, name, turn, depth, result_turn, n_results,
       CASE WHEN problems <> '' THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status,
       problems,
       '{' || CASE WHEN after_id IS NULL THEN '' ELSE '"after":"' || after_id || '",' END || '"arguments":'
       || CASE WHEN name = 'note' THEN '{"text":' || to_json(text)::VARCHAR || '}'
               WHEN n % 7 = 0 THEN '{"query":' || to_json(text)::VARCHAR || '}'
               ELSE '{"limit":' || (n % 80) || ',"query":' || to_json(text)::VARCHAR || '}' END
       || ',"id":"' || call_id || '","name":"' || name || '","result":'
       || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM j
"""


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


ORACLE["op11_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM p, c GROUP BY t, n_docs),
s AS (SELECT i.item_id, d.doc_id, d.row, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf
             + 20 * (100 - 50 + ((50 * len(d.ts) * c.n_docs) // c.n_terms)))))::BIGINT AS score
      FROM i JOIN p USING (t) JOIN w USING (t) JOIN d USING (row), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def rebuilt(paths: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share beginnings, made from others: each begins with the first h turns
    of the first one of its block of ids, then its own turns after its first h; h is a hash of
    its id below ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = paths.select(F.col("conv_id").alias("base"), F.substring("path", 1, (most - 1) * prefix_trie.STEP).alias("head"),
                         F.slice("chars", 1, most - 1).alias("head_chars"))
    own = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h)
    step = prefix_trie.STEP
    cut = lambda c, a, n: F.slice(c, a, F.greatest(n, F.lit(0)))
    both = own.join(first, "base", "left")
    path = F.concat(F.coalesce(F.expr(f"substring(head, 1, h * {step})"), F.lit(b"")), F.expr(f"substring(path, h * {step} + 1)"))
    chars = F.concat(F.coalesce(cut("head_chars", F.lit(1), F.col("h")), F.array().cast("array<int>")),
                     cut("chars", F.col("h") + 1, F.size("chars") - F.col("h")))
    return both.select("conv_id", path.alias("path"), chars.alias("chars"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


# crc32 by half bytes; the 16 fixed values are its table for them
ORACLE["op12_prefix_trie"] = r"""
WITH k AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384,
                   4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS ct),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS id
      FROM conversations WHERE conv_id IS NOT NULL),
q AS (SELECT conv_id, list(struct_pack(id := md5(id), n := length(text)) ORDER BY turn NULLS FIRST, role, md5(id)) AS ts
      FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
             lambda c: ascii(c)::BIGINT)), lambda a, b: xor(xor(a >> 4, ct[(xor(a, b) & 15) + 1]) >> 4,
             ct[(xor(xor(a >> 4, ct[(xor(a, b) & 15) + 1]), b >> 4) & 15) + 1])), 4294967295) % 6 AS h FROM q, k),
r AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.ts, 1, a.h), []), list_slice(a.ts, a.h + 1, len(a.ts))) AS ts
      FROM h a LEFT JOIN q b ON b.conv_id = a.conv_id - a.conv_id % 100),
m AS (SELECT conv_id, d, list_slice(ts, 1, d) AS p, d = len(ts) AS ends FROM r, unnest(range(len(ts) + 1)) AS u(d)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * p[-1].n END AS own
      FROM m GROUP BY p, d),
c AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT list_slice(n.p, 1, a.d) AS p, sum(n.own) AS saved, count(*) FILTER (c.p IS NULL) AS leaves
      FROM n LEFT JOIN c ON c.p = n.p, LATERAL (SELECT unnest(range(n.d + 1)) AS d) a GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON n.d > 0 AND u.p = list_slice(n.p, 1, n.d - 1) LEFT JOIN c ON c.p = n.p JOIN s ON s.p = n.p
"""


@query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


_TEMPLATES = ", ".join(f"({i}, {str(i < len(licenses.PHRASES)).upper()}, '{label}', '{text}')"
                       for i, (label, text) in enumerate([*licenses.PHRASES, *licenses.NOTICES]))
ORACLE["op13_licenses"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT row, p, ws[p + 1:p + 2] AS g2, ws[p + 1:p + 4] AS g4 FROM d, LATERAL (SELECT unnest(range(len(ws))) AS p) u),
m AS (SELECT i, phrase, label, string_split(t, ' ') AS tw, CASE WHEN phrase THEN 2 ELSE 4 END AS k
      FROM (VALUES {_TEMPLATES}) v(i, phrase, label, t)),
tg AS (SELECT i, phrase, label, k, len(tw) - k + 1 AS grams, t, tw[t + 1:t + k] AS tgram
       FROM m, LATERAL (SELECT unnest(range(len(tw) - k + 1)) AS t) u),
v AS (SELECT row, i, phrase, label, k, grams, p, t, p - t AS diag FROM g JOIN tg ON tgram = g2 WHERE k = 2
      UNION ALL SELECT row, i, phrase, label, k, grams, p, t, p - t AS diag FROM g JOIN tg ON tgram = g4 WHERE k = 4),
o AS (SELECT DISTINCT row, i, phrase, diag FROM v),
b AS (SELECT *, sum(CASE WHEN phrase OR diag - before > {licenses.SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY row, i ORDER BY diag) AS span
      FROM (SELECT *, lag(diag) OVER (PARTITION BY row, i ORDER BY diag) AS before FROM o)),
s AS (SELECT row, i, phrase, label, min(p) AS first_p, max(p) + k AS end_p, grams, k, count(DISTINCT t) AS found
      FROM v JOIN b USING (row, i, phrase, diag) GROUP BY row, i, phrase, label, grams, k, span),
a AS (SELECT *, found::DOUBLE / grams AS share FROM s WHERE CASE WHEN phrase THEN found = grams
        ELSE found::DOUBLE / grams >= {licenses.MIN_SHARE} AND end_p - first_p <= 2 * (grams + k - 1) END),
x AS (SELECT row, count(*) FILTER (phrase) AS n_base, min(first_p) FILTER (phrase) AS first_word,
             max(first_p) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM a GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN x USING (row)
"""
