"""Graph operators: endpoint resolution, both-endpoint ownership, coverage-first caps, one-hop expansion.

Edges refer to nodes by id, or by label where a producer has no ids.  Both kinds
of reference are folded into one lookup keyed by the reference itself, so an
edge needs one join per endpoint instead of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.classify import lit_array, lookup
from wayfind.functions.paths import first_non_empty, normalized_path, owner_path_score, source_line_number
from wayfind.operators.skew import first_per_key, top_per_key
from wayfind.plans.query import QueryPlan
from wayfind.session import cut_lineage

#: Names up to this number are sent to every task; longer lists are joined by a shuffle.
FEW_NAMES = 100_000
_PAYLOAD = ["label", "source_file", "source_location"]


def _clean_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    return nodes.select(
        F.trim("node_id").alias("node_id"),
        F.trim(first_non_empty(F.col("label"), F.col("node_id"))).alias("label"),
        F.coalesce("source_file", F.lit("")).alias("source_file"),
        F.coalesce("source_location", F.lit("")).alias("source_location"),
        *order,
    )


def _names(names: DataFrame) -> DataFrame:
    """A one-column frame made distinct and written, for ``_among``."""
    kept = cut_lineage(names.toDF("_name").distinct())
    return F.broadcast(kept) if kept.count() <= FEW_NAMES else kept


def _among(df: DataFrame, value: Column, names: DataFrame) -> DataFrame:
    """The rows whose ``value`` is one of the names."""
    return df.join(names, value == F.col("_name"), "left_semi")


def endpoint_lookup(nodes: DataFrame, order: list[str], last_label_wins: bool = False, refs: DataFrame | None = None) -> DataFrame:
    """(ref, label, source_file, source_location): ids first, then labels.

    The last node of an id wins; of a label the first file wins (or the last).
    Everything is an aggregate with map-side combine, so a label carried by a
    third of all nodes is reduced before the shuffle.  ``refs`` (of ``_names``) restricts the lookup to those references.
    """
    clean = _clean_nodes(nodes, order)
    ids, labels = (clean, clean) if refs is None else (_among(clean, F.col(c), refs) for c in ("node_id", "label"))
    position = F.struct(*order)
    by_id = ids.where(F.col("node_id") != "").groupBy(F.col("node_id").alias("ref")).agg(
        F.max_by(F.struct(*_PAYLOAD), position).alias("node")
    )
    pick = F.max_by if last_label_wins else F.min_by
    by_label = (
        labels.where((F.col("label") != "") & (F.col("source_file") != ""))
        .groupBy(F.col("label").alias("ref"))
        .agg(pick("source_file", position).alias("file"))
        .select(
            "ref",
            F.struct(
                F.col("ref").alias("label"), F.col("file").alias("source_file"), F.lit("").alias("source_location")
            ).alias("node"),
        )
    )
    both = by_id.withColumn("tier", F.lit(0)).unionByName(by_label.withColumn("tier", F.lit(1)))
    return both.groupBy("ref").agg(F.min_by("node", "tier").alias("node"))


def _join_endpoints(refs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Both endpoint lookups."""
    # hubs are hot keys of the references, whose other side has one row per key: adaptive execution splits them
    return refs.join(sources, "source_ref", "left").join(targets, "target_ref", "left")


def resolve_edges(
    nodes: DataFrame, edges: DataFrame, order: list[str], node_order: list[str] | None = None,
    relations: tuple[str, ...] = C.CAPTURED_RELATIONS, refs: DataFrame | None = None,
) -> DataFrame:
    """Edges with both endpoints resolved (left outer: an unknown endpoint keeps its reference as label).

    ``order`` names the columns that give the edge order; they are kept.  ``refs`` (of ``_names``), if given, holds all references of the edges.
    """
    endpoints = endpoint_lookup(nodes, node_order or ["pos"], refs=refs)
    relation = F.lower(F.trim("relation"))
    has_file = "source_file" in edges.columns
    refs = edges.select(
        *order,
        F.trim("source_ref").alias("source_ref"),
        F.trim("target_ref").alias("target_ref"),
        relation.alias("relation"),
        F.coalesce("source_location", F.lit("")).alias("edge_location"),
        (F.coalesce("source_file", F.lit("")) if has_file else F.lit("")).alias("edge_file"),
    ).where(F.col("relation").isin(*relations) & (F.col("source_ref") != "") & (F.col("target_ref") != ""))
    sources = endpoints.select(F.col("ref").alias("source_ref"), F.col("node").alias("s"))
    targets = endpoints.select(F.col("ref").alias("target_ref"), F.col("node").alias("t"))
    # hubs are hot keys of the references, as in _join_endpoints; the source end is settled before the second shuffle
    located = first_non_empty(F.col("edge_location"), F.col("s.source_location"))
    started = refs.join(sources, "source_ref", "left").select(
        *order,
        "relation",
        first_non_empty(F.col("s.label"), F.col("source_ref")).alias("source_label"),
        first_non_empty(F.col("s.source_file"), F.col("edge_file")).alias("source_file"),
        located.alias("source_location"),
        "target_ref",
    )
    return started.join(targets, "target_ref", "left").select(
        *order,
        "relation",
        "source_label",
        "source_file",
        "source_location",
        source_line_number(F.col("source_location")).alias("source_line"),
        first_non_empty(F.col("t.label"), F.col("target_ref")).alias("target_label"),
        F.coalesce("t.source_file", F.lit("")).alias("target_file"),
        F.coalesce("t.source_location", F.lit("")).alias("target_location"),
        source_line_number(F.col("t.source_location")).alias("target_line"),
    )


def dependency_hints(resolved: DataFrame, order: list[str]) -> DataFrame:
    """Cross-file edges, first of each (source label, relation, target label, source file)."""
    cross = resolved.where(
        (F.col("source_file") == "")
        | (F.col("target_file") == "")
        | (F.lower("source_file") != F.lower("target_file"))
    )
    # dealt by the lower-cased names, which are made behind the shuffle: no name travels in two spellings
    names = {"_k1": "source_label", "_k3": "target_label", "_k4": "source_file"}
    dealt = cross.repartition(F.lower("source_label"), "relation", F.lower("target_label"), F.lower("source_file"))
    keyed = dealt.select("*", *[F.lower(name).alias(k) for k, name in names.items()])
    return first_per_key(keyed, ["_k1", "relation", "_k3", "_k4"], [F.col(c) for c in order], resolved.columns).select(*resolved.columns)


def hints_around(nodes: DataFrame, edges: DataFrame, own: DataFrame, order: list[str], node_order: list[str] | None = None) -> DataFrame:
    """``dependency_hints`` of all edges that may share a key with one of ``own``, a small part of ``edges``.

    So each of ``own`` stays or goes as among all edges; what else is returned is for the caller to leave out.  Edges with one
    key have source references of one label: the references that resolve to a label of ``own`` are found first, by that
    label, and only their edges and the nodes that these name are resolved.
    """
    own_refs = _names(own.select(F.trim("source_ref")))
    found = endpoint_lookup(nodes, node_order or ["pos"], refs=own_refs).select("ref", F.col("node.label").alias("label"))
    # a reference without a node is its own label; a label may also be referred to by itself
    labels = _names(found.select(F.lower("label")).union(own_refs.select(F.lower("_name"))))
    clean = _clean_nodes(nodes, node_order or ["pos"])
    ids = _among(clean, F.lower("label"), labels).select(F.lower("node_id"))
    near = cut_lineage(_among(edges, F.lower(F.trim("source_ref")), _names(ids.union(labels))))
    refs = _names(near.select(F.explode(F.array(F.trim("source_ref"), F.trim("target_ref")))))
    return dependency_hints(resolve_edges(nodes, near, order, node_order, refs=refs), order)


def edges_by_file(nodes: DataFrame, edges: DataFrame, order: list[str], node_order: list[str] | None = None) -> DataFrame:
    """(path, *order): every edge once for each of its endpoint files."""
    with_file = nodes.where(F.coalesce("source_file", F.lit("")) != "")
    files = endpoint_lookup(with_file, node_order or ["pos"], last_label_wins=True)
    sources = files.select(F.col("ref").alias("source_ref"), F.col("node.source_file").alias("sf"))
    targets = files.select(F.col("ref").alias("target_ref"), F.col("node.source_file").alias("tf"))
    refs = edges.select(*order, "source_ref", "target_ref")
    joined = _join_endpoints(refs, sources, targets)
    both = F.array_distinct(F.array_compact(F.array("sf", "tf")))
    return joined.select(F.explode(both).alias("path"), *order)


def anchored_hints(hints: DataFrame) -> DataFrame:
    """Hints once per file they touch: adds ``anchor`` and the file on the other side."""
    ends = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("source_file") != "", F.col("source_file")),
        F.when(F.col("target_file") != "", F.col("target_file")),
    )))
    return hints.withColumn("anchor", F.explode(ends)).withColumn(
        "other_file",
        F.when(F.lower("source_file") == F.lower("anchor"), F.col("target_file")).otherwise(F.col("source_file")),
    )


def _leading_of_batches(order: list[str], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every batch the rows that may be among the first ``limit`` of their anchor.

    A row that has ``limit`` others before it in coverage order within a batch has as many before it among all rows: those that are first
    of their other file there stand for that file's first of all, the others are deferred as well and come earlier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor = batch.column("anchor").dictionary_encode(null_encoding="encode").indices.to_numpy()
            known = pc.is_valid(batch.column("_other")).to_numpy(zero_copy_only=False)
            many = np.flatnonzero(known & (np.bincount(anchor[known], minlength=len(anchor) + 1)[anchor] > limit))
            if len(many):
                rows = batch.take(pa.array(many))
                by = [*order, "_turn"]
                place = pc.sort_indices(pa.table({c: rows.column(c) for c in by}), [(c, "ascending") for c in by], null_placement="at_start").to_numpy()
                hub, other = anchor[many][place], rows.column("_other").dictionary_encode().indices.to_numpy()[place]
                # the first of every (anchor, other file) in order; without another file a row is deferred anyway
                first = np.zeros(len(place), bool)
                first[np.unique(hub * np.int64(len(place)) + other, return_index=True)[1]] = True
                deferred = ~first | pc.equal(rows.column("_other"), "").to_numpy(zero_copy_only=False)[place]
                queue = np.lexsort((np.arange(len(place)), deferred, hub))
                nth = np.arange(len(queue)) - np.searchsorted(hub[queue], hub[queue])
                late = many[place[queue[nth >= limit]]]
                batch = batch.take(pa.array(np.setdiff1d(np.arange(batch.num_rows), late)))
            yield batch.drop_columns(["_other", "_turn"])

    return run


def coverage_first_cap(anchored: DataFrame, order: list[str], limit: int = C.MAX_DEPENDENCY_HINTS) -> DataFrame:
    """At most ``limit`` hints per anchor: one per distinct other file first, then in order.

    Hints travel once, to their anchor; of an anchor with very many hints each batch of rows sends ``limit`` at most.  Columns that are not
    needed should be gone before.  Hints of different files that ``order`` leaves open go by the part of the table that a shuffle by
    (anchor, other file) puts them in.
    """
    parts = int(anchored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_other", F.lower("other_file")).withColumn("_turn", F.pmod(F.hash("anchor", "_other"), F.lit(parts)))

    by = [*(F.col(c) for c in order), F.col("_turn")]
    few = keyed(anchored).mapInArrow(_leading_of_batches(order, limit), anchored.schema)
    # dealt by the anchor alone: one place also holds all rows of (anchor, other file)
    pruned = top_per_key(keyed(few.repartition("anchor")), ["anchor", "_other"], by, limit, rank="_nth")
    flagged = pruned.withColumn("deferred", (F.col("_nth") > 1) | (F.col("_other") == ""))
    return top_per_key(flagged, ["anchor"], [F.col("deferred"), *by], limit, rank="slot").drop("_nth", "_other", "_turn")


def broadest_chunk(chunks: DataFrame) -> DataFrame:
    """Per file the chunk with most dependencies, then most edges, then first in order."""
    rank = F.struct(F.col("dependency_count"), F.col("edge_count"), (-F.col("pos")).alias("p"))
    return chunks.groupBy(F.lower("source_file").alias("path")).agg(F.max_by("doc_id", rank).alias("doc_id"))


# --------------------------------------------------------------------------
# Edge scoring and one-hop expansion around ranked files
# --------------------------------------------------------------------------


def distinctive_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of a few constant words occur in a text."""
    if not words:
        return F.lit(0)
    return sum((F.when(text.contains(w), F.lit(1)).otherwise(F.lit(0)) for w in words), F.lit(0))


def with_file_ranks(df: DataFrame, path: str, ranked: DataFrame, rank: str) -> DataFrame:
    """Adds the rank of a path.  ``ranked`` (path_norm, rank) is a top-N list, hence small by construction."""
    small = F.broadcast(ranked.select(F.col("path_norm").alias("_p"), F.col("rank").alias(rank)))
    return df.join(small, normalized_path(F.col(path)) == F.col("_p"), "left").drop("_p")


def edge_score(plan: QueryPlan, source_rank: Column, target_rank: Column) -> Column:
    """Score of a dependency edge around ranked files; null ranks mean the file is not ranked."""
    source, target = normalized_path(F.col("source_file")), normalized_path(F.col("target_file"))
    far = F.lit(10_000)

    def nearness(rank: Column, top: float, step: float) -> Column:
        return F.greatest(F.lit(0.0), F.lit(top) - F.least(F.coalesce(rank, far), F.lit(30)) * step)

    text = F.lower(F.concat_ws(" ", "source_file", "target_file", "source_label", "target_label", "relation"))
    preferred = F.when(source_rank.isNotNull(), F.lit(180.0)).otherwise(F.lit(0.0)) + F.when(
        target_rank.isNotNull(), F.lit(180.0)
    ).otherwise(F.lit(0.0))
    loop = F.when((source != "") & (source == target), F.lit(420.0)).otherwise(F.lit(0.0))
    return (
        lookup(C.RELATION_WEIGHT, F.lower("relation"), C.RELATION_WEIGHT_DEFAULT)
        + nearness(source_rank, 450.0, 25.0)
        + nearness(target_rank, 420.0, 22.0)
        + owner_path_score(F.col("source_file")) * 0.7
        + owner_path_score(F.col("target_file")) * 0.65
        + preferred
        - loop
        + distinctive_hits(text, plan.distinctive) * 50.0
    )


def dependency_chain(hints: DataFrame, ranked: DataFrame, plan: QueryPlan, order: list[str], limit: int = 12) -> DataFrame:
    """Best edges that touch a ranked file at either end."""
    marked = with_file_ranks(with_file_ranks(hints, "source_file", ranked, "source_rank"), "target_file", ranked, "target_rank")
    touching = marked.where(F.col("source_rank").isNotNull() | F.col("target_rank").isNotNull())
    keyed = touching.select(
        "*",
        F.lower("source_label").alias("_k1"),
        F.lower("relation").alias("_k2"),
        F.lower("target_label").alias("_k3"),
        F.lower("source_file").alias("_k4"),
    )
    keys = ["_k1", "_k2", "_k3", "_k4"]
    unique = first_per_key(keyed, keys, [F.col(c) for c in order], touching.columns).drop(*keys)
    scored = unique.withColumn("edge_score", edge_score(plan, F.col("source_rank"), F.col("target_rank")))
    tail = [F.desc("score")] if "score" in hints.columns else []
    return scored.orderBy(F.desc("edge_score"), *tail, *[F.asc(c) for c in order]).limit(limit)


RELATED_BASE = {"related": 260.0, "files": 340.0, "source_file": 280.0, "edge_source": 220.0, "edge_target": 240.0}


def related_files(mentions: DataFrame, ranked: DataFrame, plan: QueryPlan, limit: int = 20) -> DataFrame:
    """One-hop neighbours of ranked files, summed over the documents that mention them.

    ``mentions``: result_path, path, anchor, role (a key of ``RELATED_BASE``), pos.
    A path is admitted if it or its anchor is ranked; each (result, path) counts once,
    its first mention deciding the base.
    """
    usable = mentions.where(F.trim("path") != "").select(
        F.lower("result_path").alias("result_key"), F.trim("path").alias("path"), "anchor", "role", "pos"
    )
    marked = with_file_ranks(with_file_ranks(usable, "path", ranked, "own_rank"), "anchor", ranked, "anchor_rank")
    admitted = marked.where(F.col("own_rank").isNotNull() | F.col("anchor_rank").isNotNull())
    admitted = admitted.withColumn("key", F.lower("path"))
    once = first_per_key(admitted, ["result_key", "key"], [F.col("pos")], ["path", "role", "own_rank"])
    gain = (
        lookup(RELATED_BASE, F.col("role"), 0.0)
        + F.greatest(F.lit(0.0), F.lit(300.0) - F.least(F.coalesce("own_rank", F.lit(10_000)), F.lit(40)) * 15.0)
        + owner_path_score(F.col("path")) * 0.6
        + F.when(F.col("own_rank").isNotNull(), F.lit(120.0)).otherwise(F.lit(0.0))
        + distinctive_hits(F.col("key"), plan.distinctive) * 35.0
    )
    total = once.groupBy("path").agg(F.sum(gain).alias("score"))
    return total.orderBy(F.desc("score"), F.asc("path")).limit(limit)


def pad_with_ranked(related: DataFrame, ranked: DataFrame, limit: int = 20) -> DataFrame:
    """Fills a related-file list up to ``limit`` with ranked files it lacks (both lists are short)."""
    missing = ranked.join(
        related.select(F.lower("path").alias("_k")), F.lower(ranked["path"]) == F.col("_k"), "left_anti"
    ).select("path", F.lit(None).cast("double").alias("score"), "rank")
    joined = related.select("path", "score", F.lit(-1).alias("rank")).unionByName(missing)
    return joined.orderBy(F.col("score").desc_nulls_last(), "rank", "path").limit(limit).select("path", "score")


def owner_companions(doc_related: DataFrame, doc_edges: DataFrame) -> DataFrame:
    """(doc_id, path): related files and both ends of the dependency hints of a document, distinct."""
    ends = doc_edges.select("doc_id", F.explode(F.array("source_file", "target_file")).alias("path"))
    both = doc_related.select("doc_id", "path").unionByName(ends)
    named = both.where(F.coalesce(F.trim("path"), F.lit("")) != "").select(
        "doc_id", F.translate(F.trim("path"), "\\", "/").alias("path")
    )
    # first spelling per lower-cased path
    return named.groupBy("doc_id", F.lower("path").alias("_k")).agg(F.min("path").alias("path")).drop("_k")
