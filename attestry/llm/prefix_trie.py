"""Conversation prefix trie: every distinct beginning of the conversations as a node, with its members and subtree sums.

Each turn becomes a digest and a word count; texts end there.  Along each conversation the digests are chained,
prefix(d) = SHA-256(prefix(d-1) + turn(d)), so two prefixes are one node exactly where depth and digest are equal.  The
chain runs over sorted partitions as a stream that holds one digest, whatever the length of a conversation.

    prefixes   a row for each conversation and depth, the root included: conversation, depth, digest
    nodes      prefixes grouped by (depth, digest): smallest member, members, members that end there
    ancestors  each node belongs to its smallest member and is carried to all its ancestors along that member's prefixes; what a
               conversation carries is summed on the way (a running sum from its end), so the rows carried are as many as the
               prefixes, not their squares, and sums by (depth, digest) are the sums over the subtrees

Hot keys: groups by (depth, digest) are sums and minima and are combined before they are shuffled, so a first turn that a third
of the conversations share is one row for each task.  The parent of a node is its smallest member's own node one turn up,
but for the top of that member's nodes; only those tops look up a parent, in a sort-merge join whose large keys Spark splits;
children of the root do not join.  The ids of the conversations that end at a node are never gathered: they are sorted by range over
all tasks, written as blocks, and hashed as a stream in order.  A conversation of any length is one task's stream, as its chain
must be, of 32 bytes a turn.

Defined cases: a null role or text is empty.  Turns of a conversation are ordered by turn, null first; among equal turns, repeated
rows included, by the digests of role and text.  Rows without conv_id belong to no conversation and are left out.  Long texts are
hashed and counted whole.  A table without conversations has no nodes, not even a root.  Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, words

#: Conversations of a block begin with turns of the block's first one.
BLOCK, HEADS = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """conv_id, at (place in the conversation, from 0), t (digest of role and text), n_words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = df.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)).alias("t"), F.size(words(text)).cast("long").alias("n_words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t")
    return one.select("conv_id", F.row_number().over(order).alias("at"), "t", "n_words").withColumn("at", F.col("at") - 1)


def rebuilt(each: DataFrame) -> DataFrame:
    """conv_id, own (0 for turns of the block's first conversation, 1 for its own), at, t, n_words; a row without t for each conversation."""
    convs = each.filter("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).alias("h"))
    bases = each.filter(f"conv_id % {BLOCK} = 0 AND at < {HEADS - 1}").select(F.col("conv_id").alias("base"), "at", "t", "n_words")
    heads = convs.join(bases, "base").filter("at < h").select("conv_id", F.lit(0).alias("own"), "at", "t", "n_words")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    own = each.filter(F.col("at") >= h).select("conv_id", F.lit(1).alias("own"), "at", "t", "n_words")
    begins = each.filter("at = 0").select("conv_id", F.lit(-1).alias("own"), "at", F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("n_words"))
    return heads.unionByName(own).unionByName(begins)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, depth, digest, n_words of sorted turns; the row without a turn opens each conversation."""
    digest, depth = b"", 0
    for b in batches:
        depths, digests = [], []
        for t in b.column("t").to_pylist():
            digest, depth = (hashlib.sha256(digest + t).digest(), depth + 1) if t is not None else (hashlib.sha256(b"").digest(), 0)
            depths.append(depth)
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(depths, pa.int64()), pa.array(digests, pa.binary()), b.column("n_words")], ["conv_id", "depth", "digest", "n_words"])


def prefixes(df: DataFrame) -> DataFrame:
    """conv_id, depth, digest, n_words (of the last turn), ends: each conversation's prefixes."""
    lined = rebuilt(cut(turns(df), "trie-turns")).repartition("conv_id").sortWithinPartitions("conv_id", "own", "at")
    chained = lined.mapInArrow(_chained, "conv_id long, depth long, digest binary, n_words long")
    later = F.lead("depth").over(Window.partitionBy("conv_id").orderBy("depth"))
    return chained.select("*", later.isNull().alias("ends"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id) as comma-joined ids: digest, first, ids; a block ends with its node, or after `most` ids."""
    held: list[int] = []
    node, rows = b"", []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["digest", "first", "ids"])

    for b in batches:
        for d, c in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if held and (d != node or len(held) >= most):
                rows.append((node, held[0], ",".join(map(str, held))))
                held = []
            node = d
            held.append(c)
        if len(rows) >= 64:
            yield made()
            rows = []
    if held:
        rows.append((node, held[0], ",".join(map(str, held))))
    if rows:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, ends_sha256 of sorted blocks, hashed one after another."""
    node, running = None, hashlib.sha256()
    for b in batches:
        out = []
        for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if d != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = d, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["digest", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["digest", "ends_sha256"])


def end_hashes(p: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the nodes where conversations end.  A digest stands at one depth only."""
    ends = p.filter("ends").select("digest", "conv_id")
    blocks = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_blocks, "digest binary, first long, ids string")
    return blocks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def nodes(df: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest: one row for each node."""
    small_batches(df.sparkSession, 4096)
    p = cut(prefixes(df), "trie-prefixes")
    node = cut(p.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("n_words").alias("n_words")), "trie-nodes")
    # what a node gives to every subtree it is in, at its smallest member
    gives = node.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"), F.lit(1).cast("long").alias("node"))
    zero = F.lit(0).cast("long")
    takes = p.select("conv_id", "depth", "digest", zero.alias("saved"), zero.alias("leaf"), zero.alias("node"))
    along = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    deeper = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    next_up = along.rangeBetween(-1, -1)  # the rows one turn further
    carried = gives.unionByName(takes).select(
        "depth", "digest", F.sum("saved").over(deeper).alias("saved"), F.sum("leaf").over(deeper).alias("leaves"), F.coalesce(F.sum("node").over(next_up), zero).alias("children"))
    sums = carried.filter("digest IS NOT NULL").groupBy("depth", "digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))
    # parents: the same member's node one turn up, or for the top of a member's nodes the node of that prefix
    root = node.filter("depth = 0").first()
    if root is None:
        return node.select("conv_id", "depth", zero.alias("parent_conv_id"), "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit("").alias("ends_sha256"), "digest")
    mine = Window.partitionBy("conv_id").orderBy("depth")
    tops = node.select("conv_id", "depth", "digest", F.lag("depth").over(mine).isNull().alias("top"))
    above = p.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("digest").alias("up"))
    found = tops.filter("top AND depth > 1").join(above, ["conv_id", "depth"]).select("depth", "digest", "up")
    parents = node.select(F.col("digest").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parent = found.join(parents, "up").select("depth", "digest", "parent_conv_id")
    # depth 1 hangs on the root; a node that is no top on the node of its own member
    out = node.join(sums, ["depth", "digest"]).join(end_hashes(p), "digest", "left").join(parent, ["depth", "digest"], "left")
    up = F.when(F.col("depth") == 0, F.lit(None).cast("long")).when(F.col("depth") == 1, F.lit(root["conv_id"])).otherwise(F.coalesce("parent_conv_id", "conv_id"))
    return out.select("conv_id", "depth", up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "digest")
