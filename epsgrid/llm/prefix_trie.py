"""Prefix trie of conversations by a splitter skeleton.

Conversations are paths of turns.  They are range-partitioned by path into sorted shards;
the first path of each shard is a splitter.  A node that more than one shard holds is a
prefix of a splitter, so the trie of the splitters, the skeleton, is broadcast, and every
shard finishes all its other nodes in one pass over its sorted rows.  For skeleton nodes
the shards give partial aggregates, which are reduced by node.  Copies of one conversation
are told apart by their ids in the range partitioning, so a large group of them is spread
over many shards; its path is then part of the skeleton.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgrid.llm.common import map_arrow, pick, prepare

STEP = 16                       # bytes of a turn in a path
ROWS_PER_SHARD = 200_000
SKELETON_BYTES = 8 << 20        # bound on all splitters together: the broadcast and the driver's part
IDS_PER_CHUNK = 20_000          # ids of conversations that end at a skeleton node, in one row

NODE = ("kind int, key binary, parent binary, conv_id long, parent_conv_id long, depth long, chars long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, seq long, ids binary")
LOCAL, PARTIAL, ENDS = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars): the turns of every conversation, by turn (null first; ties by
    role, then by digest), as digests of ``STEP`` bytes laid end to end, and the code points of
    each text.

    Null roles and texts are empty; rows without a conv_id belong to no conversation.  Texts
    stay where they are read, only digests are grouped.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    turns = (pick(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"),
                     F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return rows.select("conv_id", F.unhex(F.array_join(F.col("ts.digest"), "")).alias("path"),
                       F.col("ts.chars").alias("chars"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from their beginning."""
    n = min(len(a), len(b)) // STEP
    if a[:n * STEP] == b[:n * STEP]:
        return n
    low, high = 0, n  # the first low turns agree, the first high do not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * STEP:mid * STEP] == b[low * STEP:mid * STEP] else (low, mid)
    return low


def node_key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[:depth * STEP]).digest()


class Node:
    __slots__ = ("depth", "chars", "skeleton", "path", "conv", "n", "children", "leaves", "saved", "sha", "ids", "waiting")

    def __init__(self, depth, chars, skeleton, path):
        self.depth, self.chars, self.skeleton = depth, chars, skeleton
        self.path = path if skeleton else None
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.ids, self.waiting = None, [], []


class ShardScan:
    """One pass over a sorted shard: a stack of the nodes on the current path."""

    def __init__(self, shard: int, splitters: list[bytes]):
        self.shard, self.splitters = shard, splitters
        self.stack: list[Node] = []
        self.last = b""
        self.seq = 0

    def row(self, conv_id: int, path: bytes, chars: list[int]) -> Iterator[dict]:
        depth = len(path) // STEP
        if self.stack:
            yield from self.close(shared(self.last, path) + 1)
        # sorted rows lie between their shard's splitter and the next one, which have the longest common prefixes
        known = max((shared(path, s) for s in self.splitters), default=-1)
        for d in range(len(self.stack), depth + 1):
            self.stack.append(Node(d, chars[d - 1] if d else 0, d <= known, path))
        self.last = path
        top = self.stack[-1]
        top.n += 1
        top.conv = conv_id if top.conv is None else min(top.conv, conv_id)
        if top.skeleton:
            top.ids.append(conv_id)
            if len(top.ids) >= IDS_PER_CHUNK:
                yield self.ends(top)
        else:
            text = b"%d" % conv_id
            if top.sha is None:
                top.sha = hashlib.sha256(text)
            else:
                top.sha.update(b"," + text)

    def ends(self, node: Node) -> dict:
        self.seq += 1
        ids, node.ids = node.ids, []
        return {"kind": ENDS, "key": node_key(node.path, node.depth), "shard": self.shard, "seq": self.seq,
                "ids": ",".join(map(str, ids)).encode()}

    def close(self, keep: int) -> Iterator[dict]:
        """Finish the nodes of the stack beyond the first ``keep``."""
        while len(self.stack) > keep:
            node = self.stack.pop()
            up = self.stack[-1] if self.stack else None
            if up is not None:
                up.n += node.n
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            out = {"depth": node.depth, "chars": node.chars, "conv_id": node.conv, "n_convs": node.n}
            if node.skeleton:
                if node.ids:
                    yield self.ends(node)
                if up is not None:
                    up.leaves += node.leaves
                    up.saved += node.saved
                yield out | {"kind": PARTIAL, "key": node_key(node.path, node.depth), "n_children": node.children,
                             "parent": node_key(node.path, node.depth - 1) if node.depth else None,
                             "n_leaves": node.leaves, "saved_tokens": node.saved}
                continue
            node.saved += (node.n - 1) * node.chars
            node.leaves = node.leaves or 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.children += 1
            for child in node.waiting:
                yield child | {"parent_conv_id": node.conv}
            out |= {"kind": LOCAL, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved,
                    "ends_sha256": node.sha.hexdigest() if node.sha else EMPTY}
            if up.skeleton:  # its smallest member is known after the reduction
                yield out | {"parent": node_key(up.path, up.depth)}
            else:
                up.waiting.append(out)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) >= size or "ids" in r:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def scan_shards(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Finished nodes, partial aggregates of skeleton nodes and chunks of ids that end there."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in NODE.split(", ")])
    skeleton = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches):
        def nodes():
            paths, scan = skeleton.value, None
            for batch in batches:
                shard = batch.column("shard").to_pylist()
                for s, conv, path, chars in zip(shard, *[batch.column(c) for c in ("conv_id", "path", "chars")]):
                    if scan is None or scan.shard != s:
                        if scan is not None:
                            yield from scan.close(0)
                        scan = ShardScan(s, paths[s:s + 2])
                    yield from scan.row(conv.as_py(), path.as_py(), chars.as_py())
            if scan is not None:
                yield from scan.close(0)
        yield from _batches(nodes(), schema)

    return map_arrow(rows.select("shard", "conv_id", "path", "chars"), run, NODE)


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids that end at each skeleton node, read in order.
    A digest of a list is one stream by its nature; its rows hold many ids each."""
    ordered = ends.select("key", "shard", "seq", "ids").repartition("key").sortWithinPartitions("key", "shard", "seq")

    def run(batches):
        key, sha = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])],
                                              ["key", "ends_sha256"])
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    sha.update(b"," + ids)
                    continue
                if sha is not None:
                    yield done()
                key, sha = k, hashlib.sha256(ids)
        if sha is not None:
            yield done()

    return map_arrow(ordered, run, "key binary, ends_sha256 string")


def _finish_skeleton(nodes: list[dict]) -> list[dict]:
    """What only the whole skeleton shows: children, leaves and savings that are skeleton nodes
    themselves, passed up from the deepest; and the parents' ids."""
    by_key = {r["key"]: r for r in nodes}
    for r in nodes:
        r["inner"] = 0
    for r in nodes:
        if r["parent"] is not None:
            by_key[r["parent"]]["inner"] += 1
    for r in nodes:
        r["n_children"] += r["inner"]
        r["own_saved"], r["own_leaves"] = (r["n_convs"] - 1) * r["chars"], int(not r["n_children"])
    for r in sorted(nodes, key=lambda r: -r["depth"]):
        if r["parent"] is not None:
            up = by_key[r["parent"]]
            up["own_saved"] += r["own_saved"]
            up["own_leaves"] += r["own_leaves"]
    for r in nodes:
        r["saved_tokens"] += r["own_saved"]
        r["n_leaves"] += r["own_leaves"]
        r["parent_conv_id"] = by_key[r["parent"]]["conv_id"] if r["parent"] is not None else None
    return nodes


def prefix_trie(paths: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, chars; conv_ids differ, not null):
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    The root (depth 0) has no parent and no text.  A node's members are the conversations that
    begin with its path; saved_tokens sums (members - 1) times the code points of the last text
    over its subtree; ends_sha256 is the digest of the ids of those that end there.  No
    conversations, no nodes.

    All splitters together have at most ``SKELETON_BYTES``: there are fewer shards where
    paths are very long.  A task holds the nodes of one path and the finished children of them.
    """
    spark = paths.sparkSession
    prepare(spark)
    paths = paths.select("conv_id", "path", "chars").checkpoint()
    n, longest = paths.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, " \
          "saved_tokens long, ends_sha256 string"
    if not n:
        return spark.createDataFrame([], out)
    wanted = max(math.ceil(n / rows_per_shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, min(wanted, SKELETON_BYTES // (longest + STEP)))
    # written with its shard's number: the ranges come from a sample and may not be drawn twice
    rows = (paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
            .withColumn("part", F.spark_partition_id()).checkpoint())
    first = rows.groupBy("part").agg(F.min("path").alias("path")).orderBy("part").collect()  # at most SKELETON_BYTES
    number = spark.createDataFrame([(r.part, i) for i, r in enumerate(first)], "part int, shard int")
    rows = rows.join(F.broadcast(number), "part")
    found = scan_shards(rows, [bytes(r.path) for r in first]).checkpoint()
    reduced = (found.where(F.col("kind") == PARTIAL).groupBy("key", "parent", "depth", "chars")
               .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    ends = _digests(found.where(F.col("kind") == ENDS))
    known = [r.asDict() for r in reduced.join(ends, "key", "left").collect()]  # bounded like the splitters
    nodes = _finish_skeleton([r | {k: bytes(r[k]) if r[k] is not None else None for k in ("key", "parent")} for r in known])
    names = [f.split()[0] for f in out.split(", ")]
    skeleton = spark.createDataFrame(
        [(r["key"], *[EMPTY if c == "ends_sha256" and r[c] is None else r[c] for c in names]) for r in nodes],
        "key binary, " + out)
    above = F.broadcast(skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("up")))
    local = (found.where(F.col("kind") == LOCAL).join(above, "parent", "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")))
    return local.select(*names).unionByName(skeleton.select(*names))
