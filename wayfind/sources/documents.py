"""Loaders: text files, node-link graphs and route lists become documents, symbols and edges.

Document columns: doc_id, path, title, text, source, source_type, kind, module,
pack, source_level, area, source_file, size_bytes, facts, node_count, edge_count.
Files, symbols, edges and related files are separate tables keyed by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import paths as pt
from wayfind.functions import text as tx
from wayfind.functions.classify import lit_array
from wayfind.operators import graph as g
from wayfind.operators import symbols as sy
from wayfind.operators.skew import first_per_key, top_per_key
from wayfind.sources.config import Settings
from wayfind.sources.graph_items import graph_items
from wayfind.sources.listing import is_ignored, only_files, relative_path, root_kind, scanned_path

DOCUMENT_COLUMNS = [
    "doc_id", "path", "title", "text", "source", "source_type", "kind", "module", "pack",
    "source_level", "area", "source_file", "size_bytes", "facts", "node_count", "edge_count",
]
NODE = "struct<id:string,label:string,source_file:string,file:string,source_location:string>"
LINK = (
    "struct<source:string,target:string,`from`:string,`to`:string,relation:string,label:string,"
    "confidence:string,source_file:string,source_location:string>"
)
GRAPH_GLOB = "{graph.json,*.enrichment.json}"
ROUTE_SCHEMA = "ui_file string, backend_controller string, backend string, route string"
#: live source files whose lines are indexed
SOURCE_GLOB = "*.{cs,tsx,ts,js}"
#: separates the graph a reference belongs to from the reference itself
_SCOPE = "\u0001"


#: Lines of a graph in one document: a graph with more of them becomes several documents
LINES_PER_DOCUMENT = 20_000


def _first(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of every key, or all of them, with their place ``rn`` from 1."""
    if limit is not None:
        return top_per_key(df, keys, order, limit)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


@dataclass
class Loaded:
    """What a loader yields."""

    documents: DataFrame
    doc_files: DataFrame
    doc_symbols: DataFrame | None = None
    doc_edges: DataFrame | None = None


def _named(df: DataFrame, settings: Settings) -> DataFrame:
    """Adds module, pack, source_level, area and doc_id from ``path``."""
    found = pt.module_and_pack(F.col("path"), settings.module_markers)
    module, pack, level = found.getField("module"), found.getField("pack"), F.lit("central")
    for root, (area, owner) in settings.ownership_roots.items():
        inside = (F.col("path") == root) | F.col("path").startswith(root + "/")
        module = F.when(inside, F.lit(area)).otherwise(module)
        pack = F.when(inside, F.lit(owner)).otherwise(pack)
        level = F.when(inside, F.lit("secondary")).otherwise(level)
    return df.withColumn("module", module).withColumn("pack", pack).withColumn("source_level", level).withColumn(
        "area", F.col("module")
    )


def source_root(path: Column, settings: Settings) -> Column:
    """Folder that files named by a secondary graph are relative to."""
    chain = F.lit(None).cast("string")
    for root in settings.ownership_roots:
        base = root.rsplit("/", 1)[0] if "/" in root else ""
        chain = F.when((path == root) | path.startswith(root + "/"), F.lit(base)).otherwise(chain)
    return chain


def canonical(value: Column, path: Column, settings: Settings) -> Column:
    return pt.canonical_source_file(
        value, known_prefixes=settings.source_root_prefixes, source_root=source_root(path, settings)
    )


def text_documents(files: DataFrame, settings: Settings) -> Loaded:
    """One document per text file; ``files`` is a listing with text (larger files are not in it)."""
    rows = _named(files.where(F.trim("text") != ""), settings)
    docs = rows.select(
        pt.stable_id(F.col("path")).alias("doc_id"), "path", pt.title_of(F.col("path")).alias("title"), "text",
        F.col("path").alias("source"), pt.source_type_of(F.col("path")).alias("source_type"), "kind", "module", "pack",
        "source_level", "area", F.lit(None).cast("string").alias("source_file"), F.col("length").alias("size_bytes"),
        tx.fact_lines(F.col("text")).alias("facts"), F.lit(0).alias("node_count"), F.lit(0).alias("edge_count"),
    )
    files_of = docs.select("doc_id", "source", F.posexplode(tx.source_file_lines(F.col("text"))).alias("pos", "path")).select(
        "doc_id", "pos", canonical(F.col("path"), F.col("source"), settings).alias("path")
    )
    return Loaded(docs, files_of)


def read_graphs(
    spark: SparkSession, base: str, settings: Settings, stage: Callable[[str, DataFrame], DataFrame], glob: str = GRAPH_GLOB,
    uris: tuple[str, ...] | None = None,
) -> DataFrame:
    """(path, length, array, pos, item) of graph files, each read by as many tasks as it is long; other JSON shapes and broken
    files drop out.  Edges come from ``links``; ``edges`` counts in files without any."""
    rows = graph_items(spark, base, glob, stage, uris=uris).where(root_kind(F.col("path"), list(settings.roots), settings).isNotNull())
    kinds = rows.where(F.col("array") == "links").select("path").distinct().withColumn("_linked", F.lit(True))
    return rows.join(kinds, "path", "left").where((F.col("array") != "edges") | F.col("_linked").isNull()).drop("_linked")


def graph_nodes(graphs: DataFrame, settings: Settings) -> DataFrame:
    """(graph, pos, node_id, label, source_file, raw_file, source_location)."""
    rows = graphs.where(F.col("array") == "nodes").select(F.col("path").alias("graph"), "pos", F.from_json("item", NODE).alias("n"))
    raw = F.translate(pt.first_non_empty(F.col("n.source_file"), F.col("n.file")), "\\", "/")
    return rows.select(
        "graph", "pos", F.coalesce(F.trim("n.id"), F.lit("")).alias("node_id"),
        F.trim(pt.first_non_empty(F.col("n.label"), F.col("n.id"))).alias("label"),
        canonical(raw, F.col("graph"), settings).alias("source_file"), raw.alias("raw_file"),
        F.coalesce("n.source_location", F.lit("")).alias("source_location"),
    )


def graph_edges(graphs: DataFrame, settings: Settings) -> DataFrame:
    """(graph, pos, source_ref, target_ref, relation, confidence, source_file, source_location)."""
    rows = graphs.where(F.col("array") != "nodes").select(F.col("path").alias("graph"), "pos", F.from_json("item", LINK).alias("e"))
    return rows.select(
        "graph", "pos",
        F.trim(pt.first_non_empty(F.col("e.source"), F.col("e.from"))).alias("source_ref"),
        F.trim(pt.first_non_empty(F.col("e.target"), F.col("e.to"))).alias("target_ref"),
        F.trim(pt.first_non_empty(F.col("e.relation"), F.col("e.label"))).alias("relation"),
        F.coalesce("e.confidence", F.lit("")).alias("confidence"),
        canonical(F.coalesce("e.source_file", F.lit("")), F.col("graph"), settings).alias("source_file"),
        F.coalesce("e.source_location", F.lit("")).alias("source_location"),
    )


def _scoped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References are only meaningful inside their graph: prefix them with it."""

    def mark(name: str) -> Column:
        return F.when(F.col(name) != "", F.concat("graph", F.lit(_SCOPE), name)).otherwise(F.lit("")).alias(name)

    kept_n = [c for c in nodes.columns if c not in ("node_id", "label")]
    kept_e = [c for c in edges.columns if c not in ("source_ref", "target_ref")]
    return (
        nodes.select(*kept_n, mark("node_id"), mark("label")),
        edges.select(*kept_e, mark("source_ref"), mark("target_ref")),
    )


def resolved_hints(nodes: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """Cross-file edges of all graphs with both endpoints resolved inside their graph."""
    scoped_nodes, scoped_edges = _scoped(nodes, edges)
    resolved = g.resolve_edges(scoped_nodes, scoped_edges, ["graph", "pos"], ["graph", "pos"], settings.relations)
    plain = resolved.withColumn("source_label", F.substring_index("source_label", _SCOPE, -1)).withColumn(
        "target_label", F.substring_index("target_label", _SCOPE, -1)
    )
    return plain


def _unique_edges(df: DataFrame, keys: list[str]) -> DataFrame:
    """First cross-file edge of each four-part key within ``keys``."""
    cross = df.where((F.col("source_file") == "") | (F.col("target_file") == "") | (F.lower("source_file") != F.lower("target_file")))
    marked = cross.select(
        "*", F.lower("source_label").alias("_k1"), F.lower("target_label").alias("_k2"), F.lower("source_file").alias("_k3")
    )
    columns = [c for c in df.columns if c not in keys and c != "relation"]
    return first_per_key(marked, [*keys, "relation", "_k1", "_k2", "_k3"], [F.col("pos")], columns).drop("_k1", "_k2", "_k3")


@dataclass
class GraphTables:
    """Nodes, edges and resolved cross-file hints of all graphs; written once, used by both graph loaders."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    hints: DataFrame


def graph_tables(graphs: DataFrame, settings: Settings, stage: Callable[[str, DataFrame], DataFrame]) -> GraphTables:
    """``stage`` writes a table and reads it back, so that parsing and resolution run once."""
    is_node = (F.col("array") == "nodes").cast("int")
    heads = stage("graphs", graphs.groupBy("path", "length").agg(F.sum(is_node).cast("int").alias("node_count"), F.sum(1 - is_node).cast("int").alias("edge_count")))
    nodes = stage("graph_nodes", graph_nodes(graphs, settings))
    edges = stage("graph_edges", graph_edges(graphs, settings))
    return GraphTables(heads, nodes, edges, stage("graph_hints", resolved_hints(nodes, edges, settings)))


def graph_documents(tables: GraphTables, settings: Settings) -> Loaded:
    """A document per graph with node and edge lines and facts, and its files, symbols and edges.

    Node lines come first.  Beyond ``LINES_PER_DOCUMENT`` nodes or edges the lines go on in further documents of the same path.
    """
    graphs, nodes, edges, limits = tables.graphs, tables.nodes, tables.edges, settings.limits
    head = nodes if limits.graph_nodes is None else nodes.where(F.col("pos") < limits.graph_nodes)
    tail = edges if limits.graph_edges is None else edges.where(F.col("pos") < limits.graph_edges)
    node_lines = head.where(F.col("label") != "").select(
        "graph", F.lit(0).alias("part"), "pos", F.concat_ws(" ", F.lit("NODE"), "label", "raw_file").alias("line")
    )
    edge_line = F.trim(F.concat_ws(" ", F.lit("EDGE"), "source_ref", "relation", "target_ref", "confidence"))
    lines = node_lines.unionByName(tail.select("graph", F.lit(1).alias("part"), "pos", edge_line.alias("line")))
    piece = F.floor(F.col("pos") / LINES_PER_DOCUMENT).cast("int").alias("piece")
    texts = lines.groupBy("graph", piece).agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("l")).select(
        "graph", "piece", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")
    )
    stated = tail.where((F.col("relation") != "") & (F.col("source_ref") != "") & (F.col("target_ref") != ""))
    fact = F.concat("source_ref", F.lit(" --"), "relation", F.lit("--> "), "target_ref")
    told = stated.select("graph", piece, "pos", fact.alias("fact"))
    if limits.facts is not None:
        told = top_per_key(told, ["graph"], [F.col("pos")], limits.facts)
    facts = told.groupBy("graph", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("f")).select(
        "graph", "piece", tx.ordered_distinct_ci(F.transform("f", lambda x: x["fact"])).alias("facts")
    )
    meta = _named(graphs, settings)
    joined = meta.join(texts.withColumnRenamed("graph", "path"), "path").join(facts.withColumnRenamed("graph", "path"), ["path", "piece"], "left")
    further = pt.stable_id(F.col("path"), F.concat(F.lit("part "), F.col("piece").cast("string")))
    docs = joined.select(
        F.when(F.col("piece") == 0, pt.stable_id(F.col("path"))).otherwise(further).alias("doc_id"), "path",
        F.concat(F.coalesce("pack", "module", F.lit("graph")), F.lit(" graph")).alias("title"), "text", F.col("path").alias("source"),
        pt.base_name(F.col("path")).alias("source_type"), F.lit("graph").alias("kind"), "module", "pack", "source_level", "area",
        F.lit(None).cast("string").alias("source_file"), F.col("length").alias("size_bytes"),
        F.coalesce("facts", lit_array([])).alias("facts"), "node_count", "edge_count",
    ).where(F.trim("text") != "")
    listed = head.where(F.col("source_file") != "").select("graph", "pos", F.col("source_file").alias("path"))
    unique = first_per_key(listed.withColumn("_k", F.lower("path")), ["graph", "_k"], [F.col("pos")], ["pos", "path"])
    files = _first(unique, ["graph"], [F.col("pos")], limits.files).select(
        pt.stable_id(F.col("graph")).alias("doc_id"), (F.col("rn") - 1).alias("pos"), "path"
    )
    symbols = _symbols(nodes, settings, ["graph"], F.col("graph"), None)
    hints = _unique_edges(tables.hints, ["graph"])
    capped = hints if limits.hints is None else top_per_key(hints, ["graph"], [F.col("pos")], limits.hints).drop("rn")
    doc_edges = capped.withColumn("doc_id", pt.stable_id(F.col("graph"))).drop("graph")
    return Loaded(docs, files, symbols, doc_edges)


def _symbols(nodes: DataFrame, settings: Settings, keys: list[str], graph: Column, anchor: Column | None) -> DataFrame:
    """Captured symbols per document, distinct by (label, file, line)."""
    rows = nodes.where((F.col("label") != "") & (F.col("source_file") != "")).withColumn(
        "line", pt.source_line_number(F.col("source_location"))
    ).withColumn("path", F.col("source_file"))
    kinds = sy.classified_symbols(rows).where(F.col("kind").isin(*settings.symbol_kinds))
    if not settings.enable_symbol_hints:
        kinds = kinds.where(F.lit(False))
    keyed = kinds.withColumn("_l", F.lower("label")).withColumn("_f", F.lower("source_file"))
    unique = first_per_key(
        keyed, [*keys, "_l", "_f", "line"], [F.col("pos")], ["pos", "label", "kind", *(["source_file"] if "source_file" not in keys else []), "source_location", "node_id"]
    )
    capped = unique if settings.limits.symbols is None else top_per_key(unique, keys, [F.col("pos")], settings.limits.symbols)
    return capped.select(
        pt.stable_id(graph, anchor).alias("doc_id"), "pos", "label", "kind", "source_file", "source_location", "line", "node_id"
    )


def chunk_graph_documents(tables: GraphTables, settings: Settings, stage: Callable[[str, DataFrame], DataFrame]) -> Loaded:
    """One document per source file of a graph (secondary graphs; central ones if configured)."""
    named = _named(tables.graphs.where(F.col("path").rlike(r"(^|/)graph\.json$")), settings)
    if not settings.chunk_central_graph:
        named = named.where(F.col("source_level") == "secondary")
    wanted = named.select(F.col("path").alias("graph"))
    nodes, edges, hints = (t.join(wanted, "graph", "left_semi") for t in (tables.nodes, tables.edges, tables.hints))
    with_file = nodes.where(F.col("source_file") != "")
    limits = settings.limits
    first_files = with_file.select("graph", "source_file").distinct()
    if limits.graph_chunks is not None:
        first_files = top_per_key(first_files, ["graph"], [F.col("source_file")], limits.graph_chunks).drop("rn")
    kept = with_file.join(first_files, ["graph", "source_file"], "left_semi")
    scoped_nodes, scoped_edges = _scoped(nodes, edges)
    owned = g.edges_by_file(scoped_nodes, scoped_edges, ["graph", "pos"], ["graph", "pos"]).withColumnRenamed("path", "source_file")
    owned = stage(
        "edges_by_file",
        owned.join(first_files, ["graph", "source_file"], "left_semi").join(edges.drop("source_file"), ["graph", "pos"]),
    )
    keys = ["graph", "source_file"]
    # bounded by what one source file declares
    node_rows = kept if limits.chunk_nodes is None else top_per_key(kept, keys, [F.col("pos")], limits.chunk_nodes).drop("rn")
    edge_rows = owned if limits.chunk_edges is None else top_per_key(owned, keys, [F.col("pos")], limits.chunk_edges).drop("rn")
    lines = node_rows.where(F.col("label") != "").select(
        *keys, F.lit(0).alias("part"), "pos", F.concat_ws(" ", F.lit("NODE"), "label", "source_file").alias("line")
    ).unionByName(edge_rows.select(
        *keys, F.lit(1).alias("part"), "pos", F.trim(F.concat_ws(" ", F.lit("EDGE"), "source_ref", "relation", "target_ref")).alias("line")
    ))
    texts = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("l")).select(
        *keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text")
    )
    fact = F.concat("source_ref", F.lit(" --"), "relation", F.lit("--> "), "target_ref")
    stated = edge_rows.where((F.col("relation") != "") & (F.col("source_ref") != "") & (F.col("target_ref") != ""))
    told = stated.select(*keys, "pos", fact.alias("fact"))
    if limits.facts is not None:
        told = top_per_key(told, keys, [F.col("pos")], limits.facts)
    facts = told.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("f")
    ).select(*keys, tx.ordered_distinct_ci(F.transform("f", lambda x: x["fact"])).alias("facts"))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    edge_sizes = owned.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("edge_count"))
    meta = named.select(F.col("path").alias("graph"), "module", "pack", "area")
    joined = texts.join(sizes, keys).join(edge_sizes, keys, "left").join(facts, keys, "left").join(meta, "graph")
    docs = joined.select(
        pt.stable_id(F.col("graph"), F.col("source_file")).alias("doc_id"), F.concat("graph", F.lit("::"), "source_file").alias("path"),
        F.concat(pt.base_name(F.col("source_file")), F.lit(" ownership graph")).alias("title"), "text", F.col("graph").alias("source"),
        F.lit("graph chunk").alias("source_type"), F.lit("graph_chunk").alias("kind"), "module", "pack", F.lit("secondary").alias("source_level"),
        "area", "source_file", F.lit(None).cast("bigint").alias("size_bytes"), F.coalesce("facts", lit_array([])).alias("facts"),
        "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
    ).where(F.trim("text") != "")
    files = docs.select("doc_id", F.lit(0).alias("pos"), F.col("source_file").alias("path"))
    symbols = _symbols(node_rows, settings, keys, F.col("graph"), F.col("source_file"))
    anchored = g.anchored_hints(hints).join(
        first_files.withColumnRenamed("source_file", "anchor"), ["graph", "anchor"], "left_semi"
    )
    unique = _unique_edges(anchored, ["graph", "anchor"])
    scoped_anchor = unique.withColumn("anchor_file", F.col("anchor")).withColumn("anchor", F.concat("graph", F.lit(_SCOPE), "anchor"))
    capped = scoped_anchor if limits.hints is None else g.coverage_first_cap(scoped_anchor, ["pos"], limits.hints)
    doc_edges = capped.select(
        "*", pt.stable_id(F.col("graph"), F.col("anchor_file")).alias("doc_id")
    ).drop("graph", "anchor", "anchor_file", "other_file", "deferred", "slot")
    return Loaded(docs, files, symbols, doc_edges)


def route_documents(
    spark: SparkSession, base: str, settings: Settings, glob: str = "dependency-edges.enrichment.json", uris: tuple[str, ...] | None = None
) -> Loaded:
    """Route lists (JSON arrays of screen -> backend entries): one document per list."""
    raw = (
        spark.read.schema(ROUTE_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).json(base)
    )

    def field(*names: str) -> Column:
        return tx.clipped(F.trim(pt.first_non_empty(*[F.col(n) for n in names])), C.ROUTE_FIELD_CHARS)

    # the rows of one file come from one task in order
    entries = only_files(raw, uris).select(
        relative_path(scanned_path(), base).alias("path"), F.col("_metadata.file_size").alias("length"),
        F.monotonically_increasing_id().alias("pos"), field("ui_file").alias("ui"),
        field("backend_controller", "backend").alias("backend"), field("route").alias("route"),
    ).where(root_kind(F.col("path"), list(settings.roots), settings).isNotNull())
    first = _first(entries, ["path"], [F.col("pos")], settings.limits.route_entries)
    usable = first.where((F.col("ui") != "") & (F.col("backend") != ""))
    line = F.concat("ui", F.lit(" calls "), "backend", F.when(F.col("route") != "", F.concat(F.lit(" via "), "route")).otherwise(F.lit("")))
    lines = usable.groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("l")).select(
        "path", "length", tx.ordered_distinct_ci(F.transform("l", lambda x: x["line"])).alias("lines")
    )
    docs = _named(lines, settings).select(
        pt.stable_id(F.col("path")).alias("doc_id"), "path",
        F.concat(F.coalesce("pack", "module", F.lit("dependency")), F.lit(" dependency edges")).alias("title"),
        F.array_join("lines", "\n").alias("text"), F.col("path").alias("source"), pt.base_name(F.col("path")).alias("source_type"),
        F.lit("dependency_edge").alias("kind"), "module", "pack", "source_level", "area", F.lit(None).cast("string").alias("source_file"),
        F.col("length").alias("size_bytes"), (F.col("lines") if settings.limits.facts is None else F.slice("lines", 1, settings.limits.facts)).alias("facts"), F.lit(0).alias("node_count"),
        F.size("lines").alias("edge_count"),
    )
    ends = usable.select("path", F.posexplode(F.array("ui", "backend")).alias("side", "file"), "rn").select(
        F.col("path").alias("doc_path"), (F.col("rn") * 2 + F.col("side")).alias("pos"), canonical(F.col("file"), F.col("path"), settings).alias("path")
    )
    unique = first_per_key(ends.withColumn("_k", F.lower("path")), ["doc_path", "_k"], [F.col("pos")], ["pos", "path"])
    files = _first(unique, ["doc_path"], [F.col("pos")], settings.limits.files).select(
        pt.stable_id(F.col("doc_path")).alias("doc_id"), (F.col("rn") - 1).alias("pos"), "path"
    )
    return Loaded(docs, files)


def source_lines(spark: SparkSession, base: str, settings: Settings, uris: tuple[str, ...] | None = None) -> DataFrame:
    """(path, line_no, text) of the live source files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SOURCE_GLOB).load(base)
    raw = only_files(found, uris)
    if settings.limits.text_bytes is not None:
        raw = raw.where(F.col("length") <= settings.limits.text_bytes)
    path = relative_path(F.col("path"), base)
    texts = raw.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~is_ignored(F.col("path"), settings))
    return texts.select("path", F.posexplode_outer(tx.lines_of(F.col("text"))).alias("i", "text")).select(
        "path", (F.col("i") + 1).cast("bigint").alias("line_no"), "text"
    )


def repo_file_index(listing: DataFrame) -> DataFrame:
    """(name, path): lower-cased file name to every path, one row each (never gathered)."""
    return listing.select(F.lower(pt.base_name(F.col("path"))).alias("name"), "path").distinct()


def pack_source_files(spark, urls: list[str]) -> DataFrame:
    """(pack, path) from the source lists of packs; the pack is the two folders above the list."""
    rows = spark.read.text(urls).select("value", "_metadata.file_path")
    parts = F.split(F.regexp_replace("file_path", r"/raw/[^/]*$", ""), "/")
    pack = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return rows.where(F.trim("value") != "").select(pack.alias("pack"), F.translate(F.trim("value"), "\\", "/").alias("path")).distinct()
