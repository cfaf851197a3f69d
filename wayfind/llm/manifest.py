"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf with a digest of its fields.  The leaves of a group (a source) are ranked by their order column; nodes of
level ``l`` cover runs of ``FAN ** l`` ranks and carry the interval (low, high) of ranks below them as their label.  Levels are
built until one node covers the whole group; those nodes, ordered by group, are the leaves of an upper tree whose top is the
root.

Proofs come from the labels alone.  Every level is joined with the next one on the bucket ``low div FAN ** (l + 1)`` of its
level and on containment of the intervals, from the top down, so that a node receives the steps of all its ancestors; within a
parent, the children whose interval is not the node's own are its siblings, those with smaller ranks left of it.  Only nodes of
level 1 are joined; their leaves (at most ``FAN``) are exploded from them.  Every level is sixteen times smaller than the one
before, no join has a key with more than ``FAN`` rows, and no text is ever shuffled, only digests.

Ranks come from one range-partitioned sort of the digests, so that a group of any size lies in many tasks.

A null field is hashed as ``-``.  Null groups and null order values come first; leaves of equal order are ranked by digest,
repeated rows are separate leaves.  Where the condition ``chosen`` is null nothing is tampered with.  A group of one leaf has
that leaf as its top.  Further columns, whatever their names, are neither hashed nor returned.  An empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import placed, written

FAN = 16


def field_bytes(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_bytes, fields)).cast("binary"), 256)


def joined_digest(digests: Column) -> Column:
    """The digest of digests given as an array of hex texts."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


@dataclass
class Manifest:
    """``levels`` are the nodes of level 1 and up: tree, n (leaves of the tree), low, high, digest, kids (low, high, digest, item)."""

    trees: DataFrame  # tree, group, n
    levels: list[DataFrame]
    upper: list[DataFrame]

    def nodes(self) -> DataFrame:
        """All inner nodes of the groups' trees with their labels."""
        parts = [df.select(F.lit(i).alias("level"), "tree", "low", "high", "digest") for i, df in enumerate(self.levels, 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _build(leaves: DataFrame, label: str) -> list[DataFrame]:
    """Levels of the trees over ``leaves`` (tree, n, rank, digest, item)."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    below = leaves.withColumns({"low": F.col("rank"), "high": F.col("rank")})
    levels: list[DataFrame] = []
    span = 1
    while not levels or span < largest:
        span *= FAN
        kids = F.array_sort(F.collect_list(F.struct("low", "high", "digest", "item")))
        runs = below.where(F.col("n") > span // FAN) if levels else below
        runs = runs.groupBy("tree", "n", (F.col("low") / span).cast("long").alias("bucket")).agg(kids.alias("kids"))
        digest = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(joined_digest(F.col("kids.digest")))
        nodes = runs.select("tree", "n", F.array_min("kids.low").alias("low"), F.array_max("kids.high").alias("high"), digest.alias("digest"), "kids")
        levels.append(written(nodes, f"{label}-{len(levels) + 1}"))
        below = levels[-1].select("tree", "n", "low", "high", "digest", F.lit(None).cast("struct<x:int>").alias("item"))
    return levels


def _tops(levels: list[DataFrame]) -> list[DataFrame]:
    return [df.where(F.col("high") - F.col("low") + 1 == F.col("n")) for df in levels]


def build_manifest(docs: DataFrame, fields: list[str], group: str, order: str, chosen: Column | None = None, tampered: dict[str, Column] | None = None) -> Manifest:
    """The trees over all rows of ``docs``.

    Where ``chosen`` holds, ``tampered`` replaces columns; the digests of rows changed so are kept beside the leaves and are in no
    tree.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(list(columns.values()))
    other = F.lit(None).cast("string") if chosen is None else F.when(chosen, leaf_digest(list({**columns, **(tampered or {})}.values())))
    rows = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf.alias("digest"), other.alias("other"))
    rows = placed(written(rows, "leaves"), ["group", "order", "digest"], "leaves-placed")
    # a tree is named by the place of its first leaf; a group has one row per task here, however many leaves it has
    runs = rows.groupBy("task", "group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("some"))
    trees = runs.groupBy("group").agg(F.min("first").alias("tree"), F.sum("some").alias("n"))
    named = runs.select("task", "group").alias("r").join(trees.alias("t"), F.col("r.group").eqNullSafe(F.col("t.group")))
    named = named.select(F.col("r.task").alias("_task"), F.col("r.group").alias("_group"), "tree", "n")
    item = F.struct("order", "other")
    on = (F.col("task") == F.col("_task")) & F.col("group").eqNullSafe(F.col("_group"))
    leaves = rows.join(named, on).select("tree", "n", (F.col("place") - F.col("tree")).alias("rank"), "digest", item.alias("item"))
    levels = _build(leaves, "manifest")
    tops = [t.select("tree", "digest") for t in _tops(levels)]
    all_tops = tops[0]
    for some in tops[1:]:
        all_tops = all_tops.unionByName(some)
    ranked = placed(all_tops, ["tree"], "subroots")
    # one row per group: the count is the size of the upper tree
    total = ranked.count()
    items = F.struct(F.col("tree").alias("order"), F.lit(None).cast("string").alias("other"))
    upper = ranked.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("place").alias("rank"), "digest", items.alias("item"))
    return Manifest(trees, levels, _build(upper, "manifest-upper"))


def _without(kids: Column, low: Column, high: Column) -> Column:
    """Digests of the children left and right of the interval, as one step of a proof."""
    left = F.filter(kids, lambda k: k["high"] < low)
    right = F.filter(kids, lambda k: k["low"] > high)
    return F.struct(
        F.array_join(F.transform(left, lambda k: k["digest"]), "").alias("left"),
        F.array_join(F.transform(right, lambda k: k["digest"]), "").alias("right"),
    )


def _descend(levels: list[DataFrame], given: DataFrame) -> DataFrame:
    """Nodes of level 1 with ``steps``, the siblings of every ancestor from the bottom up; ``given`` has the steps above each top
    (tree, subroot, root, steps)."""
    tops = _tops(levels)
    above: DataFrame | None = None
    for level in range(len(levels), 0, -1):
        span = FAN ** (level + 1)
        here = tops[level - 1].join(given.withColumnRenamed("tree", "_tree"), F.col("tree") == F.col("_tree")).drop("_tree")
        if above is not None:
            outer = above.select(
                F.col("tree").alias("_tree"), (F.col("low") / span).cast("long").alias("_bucket"), F.col("low").alias("_low"), F.col("high").alias("_high"),
                F.col("kids").alias("_kids"), "subroot", "root", F.col("steps").alias("_steps"),
            )
            bucket = (F.col("low") / span).cast("long")
            inside = (F.col("tree") == F.col("_tree")) & (bucket == F.col("_bucket")) & (F.col("_low") <= F.col("low")) & (F.col("high") <= F.col("_high"))
            rest = levels[level - 1].where(F.col("high") - F.col("low") + 1 < F.col("n")).join(outer, inside)
            steps = F.concat(F.array(_without(F.col("_kids"), F.col("low"), F.col("high"))), F.col("_steps")).alias("steps")
            here = here.unionByName(rest.select("tree", "n", "low", "high", "digest", "kids", "subroot", "root", steps))
        above = here
    return above


def _leaf_rows(nodes: DataFrame) -> DataFrame:
    """The leaves below nodes of level 1, with their whole proofs."""
    rows = nodes.select("*", F.explode("kids").alias("kid"))
    own = F.array(_without(F.col("kids"), F.col("kid.low"), F.col("kid.high")))
    steps = F.when(F.col("n") > 1, F.concat(own, F.col("steps"))).otherwise(F.col("steps"))
    return rows.select("kid", "subroot", "root", steps.alias("steps"))


def leaf_proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: order, leaf, other (the digest after tampering, else null), subroot, root, steps."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    root = _tops(manifest.upper)[-1].select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), empty.alias("steps"))
    for some in _tops(manifest.upper)[:-1]:
        root = root.unionByName(some.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), empty.alias("steps")))
    tops = _leaf_rows(_descend(manifest.upper, root))
    given = written(tops.select(F.col("kid.item.order").alias("tree"), F.col("kid.digest").alias("subroot"), "root", "steps"), "subroot-steps")
    rows = _leaf_rows(_descend(manifest.levels, given))
    return rows.select(F.col("kid.item.order").alias("order"), F.col("kid.digest").alias("leaf"), F.col("kid.item.other").alias("other"), "subroot", "root", "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda seen, s: F.sha2(F.concat(s["left"], seen, s["right"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, from the leaf's up to those below the root."""
    return joined_digest(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def verify_rows(docs: DataFrame, fields: list[str], group: str, order: str, chosen: Column, tampered: dict[str, Column]) -> DataFrame:
    """Per row: the order column, leaf, subroot, root and proof_sha256 of the rows as they are, and folded_root and verified of
    the rows as they are after tampering."""
    rows = leaf_proofs(build_manifest(docs, fields, group, order, chosen, tampered))
    rows = rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("steps")))
    return rows.select(
        F.col("order").alias(order), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
