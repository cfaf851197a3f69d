"""Prefix trie of conversations from vertical bitmaps.

A turn is a digest of its role and text; texts are not moved.  Every (position, turn) has a 128-bit code, and a node, the
sequence of the first ``d`` turns, is known by its depth and the exclusive or of its ``d`` codes, which can be computed for any
stretch of a conversation by itself.  Conversations are numbered in ascending order of their ids.  A shard holds a stretch of
``CHUNK`` positions of ``BUCKET`` consecutive conversations, so neither a hot first turn nor a conversation of any length
gathers in one task.  Within a shard, (position, code) is indexed to bitsets of conversations; depth-first, the bitset of a node
is intersected with the postings of its members' next turns, which gives its children, their popcounts and end lists.

Nodes of all shards are merged by an aggregate.  Sums over subtrees need no walk through levels: a node belongs to its smallest
member, so the nodes of one conversation are the end of its path.  A subtree holds the nodes of its owner from the node on and
all nodes of its other members: a running sum per owner, and a popcount of the node's bitset weighted by the sums of its
members, taken shard by shard and added up.  End lists are hashed as a stream in shard order, so their length does not matter.

Turns are ordered by ``turn`` (null first), then by digest; repeated rows are turns of their own.  Null role or text is empty.
Rows without conversation id belong to none and are left out.  A conversation without turns ends in the root.  Further columns,
whatever their names, are not read.  Without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import placed, written

#: Conversations and positions of a shard.
BUCKET, CHUNK = 512, 256
NODE = ["depth", "a", "b"]
LOCAL = (
    "bucket long, chunk long, depth long, a long, b long, above_a long, above_b long, n_bytes long, first long, n long, ends string, members binary"
)


def numbered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, at from 0, code, n_bytes and the conversation's n; conversations: conv_id, n).

    Places come from one range-partitioned sort, so that a conversation may lie in many tasks.
    """
    own_role, own_text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(own_role).cast("string"), F.lit(":"), own_role, own_text).cast("binary"), 256)
    turns = rows.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("code"),
        F.octet_length(own_text).cast("long").alias("n_bytes"),
    )
    turns = placed(written(turns, "turns"), ["conv_id", "turn", "code"], "turns-placed")
    runs = turns.groupBy("task", "conv_id").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("some"))
    convs = runs.groupBy("conv_id").agg(F.min("low").alias("low"), F.sum("some").alias("n"))
    starts = runs.select("task", "conv_id").join(convs, "conv_id").select(F.col("task").alias("_task"), F.col("conv_id").alias("_conv"), "low", "n")
    on = (F.col("task") == F.col("_task")) & (F.col("conv_id") == F.col("_conv"))
    numbered = turns.join(starts, on).select("conv_id", (F.col("place") - F.col("low")).alias("at"), "code", "n_bytes", "n", "task")
    return numbered, convs.select("conv_id", "n")


def with_shared_openings(turns: DataFrame, convs: DataFrame, family: int = 5, limit: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation opened by the first ``h`` turns of the first one of its family, followed by its own from the ``h``-th on.

    Families are runs of ``family`` ids (below zero too, counted towards minus infinity); ``h`` is crc32(decimal id) mod ``limit``.
    """
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(family))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % limit
    plans = convs.withColumns({"h": h, "base": base})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = plans.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    plans = written(plans.select("conv_id", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")), "plans")
    own = turns.select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % limit).alias("h")).where("at >= h")
    # how many opening turns a conversation got: joined per (task, conversation), so that no conversation is gathered
    runs = own.select("task", "conv_id").distinct().join(plans.select("conv_id", "k"), "conv_id")
    own = own.join(runs, ["task", "conv_id"]).select("conv_id", (F.col("k") + F.col("at") - F.col("h")).alias("at"), "code", "n_bytes")
    ids = F.explode(F.array(*map(F.lit, range(family))))
    opening = turns.where((F.col("at") < limit - 1) & (F.pmod(F.col("conv_id"), F.lit(family)) == 0)).select("conv_id", "at", "code", "n_bytes", ids.alias("i"))
    opening = opening.select(F.try_add("conv_id", "i").alias("conv_id"), "at", "code", "n_bytes").join(plans.select("conv_id", "h"), "conv_id")
    rebuilt = own.unionByName(opening.where("at < h").drop("h"))
    return rebuilt, plans.select("conv_id", F.col("m").alias("n"))


class Shard:
    """The local trie of one shard: bitsets are integers, bit ``i`` is the shard's ``i``-th conversation."""

    def __init__(self, chunk: int, rows: list[dict]) -> None:
        rows.sort(key=lambda r: r["number"])
        self.chunk, self.low, self.ids = chunk, chunk * CHUNK, [r["conv_id"] for r in rows]
        self.turns = [[(t["a"], t["b"], t["n_bytes"]) for t in r["turns"]] for r in rows]
        self.roots: dict[tuple[int, int], int] = {}
        self.postings: dict[tuple[int, int, int], int] = {}
        self.ends: dict[int, int] = {}
        self.reach: dict[int, int] = {}
        for i, r in enumerate(rows):
            bit = 1 << i
            start = (r["start_a"], r["start_b"])
            self.roots[start] = self.roots.get(start, 0) | bit
            self.ends[r["n"]] = self.ends.get(r["n"], 0) | bit
            for at, (a, b, _) in enumerate(self.turns[i]):
                self.postings[at, a, b] = self.postings.get((at, a, b), 0) | bit
                self.reach[at] = self.reach.get(at, 0) | bit

    def _row(self, bits: int, depth: int, a: int, b: int, above: tuple, n_bytes: int) -> tuple:
        ended = bits & self.ends.get(depth, 0)
        ends = None
        if ended:
            ends = ",".join(str(self.ids[i]) for i in ones(ended))
        first = self.ids[(bits & -bits).bit_length() - 1]
        return (depth, a, b, *above, n_bytes, first, bits.bit_count(), ends, bits.to_bytes(-(-len(self.ids) // 8), "little"))

    def nodes(self) -> Iterator[tuple]:
        stack = [(bits, 0, a, b) for (a, b), bits in self.roots.items()]
        if self.chunk == 0:
            for bits, _, a, b in stack:
                yield self._row(bits, 0, a, b, (None, None), 0)
        while stack:
            bits, at, a, b = stack.pop()
            rest = bits & self.reach.get(at, 0)
            while rest:
                member = (rest & -rest).bit_length() - 1
                code_a, code_b, n_bytes = self.turns[member][at]
                child = bits & self.postings[at, code_a, code_b]
                rest ^= child
                yield self._row(child, self.low + at + 1, a ^ code_a, b ^ code_b, (a, b), n_bytes)
                stack.append((child, at + 1, a ^ code_a, b ^ code_b))


def ones(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _local_nodes(key: tuple, table: pa.Table) -> pa.Table:
    bucket, chunk = (k.as_py() for k in key)
    rows = list(Shard(chunk, table.to_pylist()).nodes())
    names = ["depth", "a", "b", "above_a", "above_b", "n_bytes", "first", "n", "ends", "members"]
    kinds = [pa.int64()] * 8 + [pa.string(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    same = [pa.array([v] * len(rows), pa.int64()) for v in (bucket, chunk)]
    return pa.table([*same, *columns], ["bucket", "chunk", *names])


def _weighted(key: tuple, nodes: pa.Table, weights: pa.Table) -> pa.Table:
    """Sums of the members' weights for every node of a shard."""
    slots = weights.column("slot").to_numpy()
    order = np.argsort(slots)
    values = np.stack([weights.column(c).to_numpy()[order] for c in ("saved", "leaves")], axis=1)
    sums = np.zeros((nodes.num_rows, 2), np.int64)
    width = -(-len(slots) // 8)
    members = nodes.column("members")
    for low in range(0, nodes.num_rows, 4096):
        some = members.slice(low, 4096).to_pylist()
        bits = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), width)
        sums[low : low + len(some)] = np.unpackbits(bits, axis=1, bitorder="little")[:, : len(slots)].astype(np.int64) @ values
    return pa.table([*(nodes.column(c) for c in NODE), pa.array(sums[:, 0]), pa.array(sums[:, 1])], [*NODE, "saved", "leaves"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node; its lists arrive in the order of their shards."""
    key, running = None, None

    def done(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.int64()) for i in range(3)), pa.array([f[3] for f in found], pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        found = []
        for depth, a, b, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, a, b) != key:
                if key is not None:
                    found.append((*key, running.hexdigest()))
                key, running = (depth, a, b), hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        yield done(found)
    if key is not None:
        yield done([(*key, running.hexdigest())])


def _segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Stretches of conversations: bucket, chunk, number, conv_id, n, start_a, start_b, turns."""
    codes = [F.xxhash64(F.lit(lane), F.col("at"), F.col("code")).alias(name) for lane, name in ((1, "a"), (2, "b"))]
    rows = turns.select("conv_id", "at", (F.col("at") / CHUNK).cast("long").alias("chunk"), *codes, "n_bytes")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "a", "b", "n_bytes"))), lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n_bytes"].alias("n_bytes")))
    parts = rows.groupBy("conv_id", "chunk").agg(listed.alias("turns"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    parts = written(parts, "stretches")
    # what lies before a later stretch: only conversations longer than one take part, without their turns
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = parts.select("conv_id", "chunk", "x", "y").join(parts.where("chunk > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    starts = long.select("conv_id", "chunk", F.bit_xor("x").over(before).alias("start_a"), F.bit_xor("y").over(before).alias("start_b")).where("chunk > 0")
    zero = F.lit(0).cast("long")
    first = convs.join(parts.where("chunk = 0").select("conv_id", "turns"), "conv_id", "left").select("*", zero.alias("chunk"), zero.alias("start_a"), zero.alias("start_b"))
    first = first.withColumn("turns", F.coalesce("turns", F.array()))
    later = parts.where("chunk > 0").drop("x", "y").join(starts, ["conv_id", "chunk"]).join(convs, "conv_id")
    return first.unionByName(later).withColumn("bucket", (F.col("number") / BUCKET).cast("long"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv_id, at, code, n_bytes) of ``convs`` (conv_id, n), one row per node:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    convs = placed(convs, ["conv_id"], "conversations").select("conv_id", "n", F.col("place").alias("number"))
    local = written(_segments(turns, convs).groupBy("bucket", "chunk").applyInArrow(_local_nodes, LOCAL), "shard-nodes")
    nodes = local.groupBy(*NODE).agg(
        F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("above_a").alias("above_a"), F.min("above_b").alias("above_b"), F.min("n_bytes").alias("n_bytes")
    )
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b"))
    nodes = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0)), "part": (F.col("depth") / CHUNK).cast("long")}
    )
    nodes = nodes.withColumns({"own_saved": (F.col("n_convs") - 1) * F.col("n_bytes"), "own_leaves": (F.col("n_children") == 0).cast("long")})
    nodes = written(nodes.drop("n_bytes"), "counted-nodes")
    # running sums from the end of each owner's path, in two steps: by stretch, then inside it
    after = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    parts = nodes.groupBy("conv_id", "part").agg(F.sum("own_saved").alias("s"), F.sum("own_leaves").alias("l"), F.min("depth").alias("d"))
    parts = parts.select(
        "conv_id", "part", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("after_s"), F.coalesce(F.sum("l").over(after), F.lit(0)).alias("after_l"),
        F.sum("s").over(whole).alias("all_s"), F.sum("l").over(whole).alias("all_l"), F.min("d").over(whole).alias("top"),
    )
    parts = written(parts, "owners")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owned = nodes.select(*NODE, "conv_id", "part", F.sum("own_saved").over(inside).alias("s"), F.sum("own_leaves").over(inside).alias("l")).join(parts, ["conv_id", "part"])
    owned = owned.select(
        *NODE, (F.col("s") + F.col("after_s") - F.col("all_s")).alias("more_s"), (F.col("l") + F.col("after_l") - F.col("all_l")).alias("more_l"),
        (F.col("depth") == F.col("top")).alias("branch"),
    )
    # the sums of all members, as a weighted popcount of the bitsets
    sums = parts.select("conv_id", "all_s", "all_l").distinct()
    weights = convs.join(sums, "conv_id", "left").select(
        (F.col("number") / BUCKET).cast("long").alias("bucket"), "n", "number",
        F.coalesce("all_s", F.lit(0)).alias("saved"), F.coalesce("all_l", F.lit(0)).alias("leaves"),
    )
    shards = local.select(F.col("bucket").alias("bucket"), F.col("chunk").alias("chunk")).distinct()
    reach = (F.col("chunk") == 0) | (F.col("n") > F.col("chunk") * CHUNK)
    weights = shards.join(weights, "bucket").where(reach).select("bucket", "chunk", F.col("number").alias("slot"), "saved", "leaves")
    summed = local.select("bucket", "chunk", *NODE, "members").groupBy("bucket", "chunk").cogroup(weights.groupBy("bucket", "chunk"))
    summed = summed.applyInArrow(_weighted, "depth long, a long, b long, saved long, leaves long").groupBy(*NODE).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    ended = local.where("ends is not null").select(*NODE, "bucket", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "bucket")
    ends = ended.select(*NODE, "ends").mapInArrow(_hash_ends, "depth long, a long, b long, ends_sha256 string")
    out = nodes.join(owned, NODE).join(summed, NODE).join(ends, NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select(
        "conv_id", "depth", "above_a", "above_b", "branch", "n_convs", "n_children", (F.col("leaves") + F.col("more_l")).alias("n_leaves"),
        (F.col("saved") + F.col("more_s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    # below the top of its owner's path, a node has its parent's owner; the tops look theirs up
    parents = nodes.select((F.col("depth") + 1).alias("_depth"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("conv_id").alias("parent"))
    on = (F.col("depth") == F.col("_depth")) & (F.col("above_a") == F.col("_a")) & (F.col("above_b") == F.col("_b"))
    tops = out.where("branch").join(parents, on, "left")
    rest = out.where("not branch").withColumn("parent", F.col("conv_id"))
    return _node_columns(tops).unionByName(_node_columns(rest))


def _node_columns(df: DataFrame) -> DataFrame:
    columns: list[Column] = [F.col(c) for c in ("conv_id", "depth")]
    columns += [F.col("parent").alias("parent_conv_id"), *map(F.col, ("n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))]
    return df.select(*columns)
