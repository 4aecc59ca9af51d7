"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of a fixed number of characters.  Distinct blocks
are sorted and get integer names; then adjacent pairs of names are named in the same way,
level by level, until a document has one name.  Names of a level are equal exactly when
the spans below them are: blocks are grouped by their whole content (hashes only route
them, after a check that they tell all blocks of the input apart), and a pair by its two
names.  So (levels, last name) is an identity without collisions.

Only the distinct blocks of each input partition are shuffled with their text; everything
after the first level moves integers.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epsgrid.llm.common import pick, prepare

BLOCK = 4096
SPACES = "\t\n\x0b\x0c\r "  # [\x20\x09-\x0D]


def normalised(col: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(col), F.lit("")), SPACES, "")


def names(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, name): distinct keys, sorted, with a unique integer each.  Written to the
    checkpoint folder, so a lost executor cannot renumber them."""
    return (df.select(*keys).distinct().sortWithinPartitions(*keys)
            .withColumn("name", F.monotonically_increasing_id()).checkpoint())


def blocks_of(norm: str, block: int) -> Column:
    """Blocks of a normalised text; the empty text is one block that no other text has."""
    return F.regexp_extract_all(F.when(F.col(norm) == "", F.lit(" ")).otherwise(F.col(norm)),
                                F.lit("(?s).{1,%d}" % block), F.lit(0))


def hashes(b: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(b, F.lit(2 * seed)).alias("h1"), F.xxhash64(b, F.lit(2 * seed + 1)).alias("h2"))


def rows_with_digests(docs: DataFrame, block: int, seed: int) -> DataFrame:
    """One slim row per document: a row number, length, digest of the normalised text and a
    pair of hashes for each block."""
    src = pick(docs, "doc_id", "text").withColumn("norm", normalised())
    return (src.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                       F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
                       F.transform(blocks_of("norm", block), lambda b: hashes(b, seed)).alias("blocks"))
            .checkpoint())


def block_names(docs: DataFrame, block: int, seed: int) -> DataFrame:
    """(h1, h2, n, name) of the distinct block contents.  ``n`` counts contents that share
    the two hashes; where it is over 1 the hashes do not tell them apart."""
    norm = pick(docs, "text").select(normalised().alias("norm"))
    distinct = norm.select(F.explode(blocks_of("norm", block)).alias("block")).distinct()
    return (distinct.select(hashes(F.col("block"), seed).alias("h")).groupBy("h.h1", "h.h2")
            .agg(F.count("*").alias("n")).sortWithinPartitions("h1", "h2")
            .withColumn("name", F.monotonically_increasing_id()).checkpoint())


def find_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal if they are after deleting ASCII white space; null counts as empty, and
    empty texts are equal to each other.  The row with the most code points stays, then the
    smallest doc_id (null ids last), then, among repeated rows, one of them.  Other columns
    are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    for seed in count():
        named = block_names(docs, block, seed)
        if not named.where("n > 1").limit(1).count():
            break  # these hashes tell all blocks of this input apart; else take others
    rows = rows_with_digests(docs, block, seed)
    spans = (rows.select("row", F.posexplode("blocks").alias("pos", "b"))
             .select("row", "pos", F.col("b.h1").alias("h1"), F.col("b.h2").alias("h2"))
             .join(named, ["h1", "h2"]).select("row", "pos", "name").checkpoint())
    longest = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    done, level = None, 0
    for level in range(max(1, math.ceil(math.log2(max(longest, 1))) + 1)):
        tops = spans.groupBy("row").agg(F.count("*").alias("m"), F.first("name").alias("name"))
        one = tops.where("m = 1").select("row", F.lit(level).alias("level"), "name")
        done = one if done is None else done.unionByName(one)
        if longest <= 2 ** level:
            break
        more = spans.join(tops.where("m > 1").select("row"), "row", "left_semi")
        pairs = (more.groupBy("row", F.floor(F.col("pos") / 2).alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
                 .checkpoint())
        spans = (pairs.join(names(pairs, "l", "r"), ["l", "r"]).select("row", "pos", "name").checkpoint())
    ids = rows.drop("blocks").join(done, "row").checkpoint()
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"),
                     F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = ids.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).checkpoint()
    return (ids.join(groups, ["level", "name"])
            .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


def drop_duplicates(docs: DataFrame, columns: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with ``columns``."""
    keys = (find_duplicates(docs, block).groupBy("doc_id", "text_sha256")
            .agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept").checkpoint())
    rows = pick(docs, *columns).withColumn("sha", F.sha2(F.encode(normalised(), "UTF-8"), 256))
    stay = rows.join(keys.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha2"), "n"),
                     F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("sha2")))
    if keys.where("n > 1").limit(1).count():  # rows repeated with their id: one of them, the longest
        whole = F.struct(*columns)
        best = F.max_by(whole, F.struct(F.length("text"), F.to_json(whole))).alias("row")
        return (stay.groupBy("id", "sha").agg(best).select(*[F.col(f"row.{c}").alias(c) for c in columns]))
    return stay.select(*columns)
