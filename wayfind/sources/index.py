"""The search index: a set of Parquet tables and how they are built, written and read."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import vectors as vec
from wayfind.operators.chunks import chunk_documents
from wayfind.operators.scoring import build_doc_terms
from wayfind.sources import documents as docs
from wayfind.sources.config import Settings
from wayfind.sources.listing import discovery_report, list_files, overall_status

SYMBOL_SCHEMA = "doc_id string, pos int, label string, kind string, source_file string, source_location string, line int, node_id string"
EDGE_SCHEMA = (
    "doc_id string, pos int, relation string, source_label string, source_file string, source_location string, source_line int, "
    "target_label string, target_file string, target_location string, target_line int"
)


@dataclass
class SearchIndex:
    """Tables of one index.  ``doc_terms`` is sorted by term, the others by document."""

    documents: DataFrame
    doc_terms: DataFrame
    doc_files: DataFrame
    doc_symbols: DataFrame
    doc_edges: DataFrame
    doc_related: DataFrame
    source_lines: DataFrame
    chunks: DataFrame
    meta: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> SearchIndex:
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(cls)})


def related_from_edges(doc_edges: DataFrame) -> DataFrame:
    """(doc_id, pos, path): both ends of a document's hints, first mention first."""
    ends = doc_edges.select("doc_id", F.posexplode(F.array("source_file", "target_file")).alias("side", "path"), F.col("pos").alias("at"))
    named = ends.where(F.coalesce("path", F.lit("")) != "").withColumn("p", F.col("at") * 2 + F.col("side"))
    first = named.groupBy("doc_id", F.lower("path").alias("_k")).agg(F.min_by(F.struct("p", "path"), "p").alias("f"))
    return first.select("doc_id", F.col("f.p").alias("pos"), F.col("f.path").alias("path"))


def build_index(
    spark: SparkSession, base: str, folder: str, settings: Settings | None = None, source_base: str | None = None, with_vectors: bool = True,
    uris: tuple[str, ...] | None = None, source_uris: tuple[str, ...] | None = None,
) -> SearchIndex:
    """Builds and writes all tables of an index from a folder of packs, docs and live sources.

    With ``uris`` and ``source_uris`` only the documents of these files and the lines of these sources are built; ``listing`` and
    ``meta`` always describe all files.

    Every table is written once and the tables after it are derived from what was
    written, so nothing is parsed or resolved twice and a lost executor repeats
    one table, not the whole build.
    """
    settings = settings or Settings()

    def stage(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    listing = stage("listing", list_files(spark, base, settings))
    texts = list_files(spark, base, settings, glob="*.{md,txt,json}", with_text=True, uris=uris)
    is_graph = F.col("path").rlike(r"(^|/)graph\.json$") | F.col("path").endswith(".enrichment.json")
    graphs = docs.read_graphs(spark, base, settings, stage, uris=uris)
    tables = docs.graph_tables(graphs, settings, stage)
    loaded = [
        docs.text_documents(texts.where(~is_graph), settings),
        docs.route_documents(spark, base, settings, uris=uris),
        docs.graph_documents(tables, settings),
        docs.chunk_graph_documents(tables, settings, stage),
    ]

    def united(name: str, columns: list[str]) -> DataFrame:
        parts = [getattr(x, name).select(*columns) for x in loaded if getattr(x, name) is not None]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def names(schema: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in schema.split(",")]

    documents = stage("documents", united("documents", docs.DOCUMENT_COLUMNS).dropDuplicates(["doc_id"]))
    doc_files = stage("doc_files", united("doc_files", ["doc_id", "pos", "path"]).withColumn("pos", F.col("pos").cast("int")))
    stage("doc_symbols", united("doc_symbols", names(SYMBOL_SCHEMA)))
    doc_edges = stage("doc_edges", united("doc_edges", names(EDGE_SCHEMA)))
    stage("doc_related", related_from_edges(doc_edges))
    # range-partitioned and sorted by term: a query skips all row groups but those of its terms
    terms = build_doc_terms(documents, doc_files)
    stage("doc_terms", terms.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
    stage("source_lines", docs.source_lines(spark, source_base or base, settings, source_uris))
    chunks = chunk_documents(documents, "doc_id", "text")
    if with_vectors:
        texts_of = stage("chunk_texts", chunks)
        chunks = texts_of.join(vec.hash_embeddings(texts_of, "chunk_id", "text", settings.dimensions), "chunk_id")
    else:
        chunks = chunks.withColumn("vector", F.lit(None).cast("array<double>"))
    stage("chunks", chunks)
    report = discovery_report(listing, list(settings.roots))
    # a one-row table: sources, their newest change, and how the vectors were made
    meta = listing.agg(
        F.count(F.lit(1)).alias("source_files"), F.max(F.unix_micros("modified") / F.lit(1e6)).alias("latest_source"),
        F.current_timestamp().alias("created_at"), F.lit("hash").alias("embedding_backend"), F.lit(settings.dimensions).alias("dimensions"),
    ).withColumn("discovery_status", report.agg(overall_status(report).alias("s")).scalar())
    stage("meta", meta)
    return SearchIndex.read(spark, folder)


def index_summary(index: SearchIndex) -> DataFrame:
    """Documents, symbols and edges per source type."""
    symbols = index.doc_symbols.groupBy("doc_id").agg(F.count(F.lit(1)).alias("symbols"))
    edges = index.doc_edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges"))
    joined = index.documents.select("doc_id", "source_type").join(symbols, "doc_id", "left").join(edges, "doc_id", "left")
    return joined.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")
    )


def index_health(index: SearchIndex, listing: DataFrame) -> DataFrame:
    """One row: status ok or stale, counts, and the newest source."""
    from wayfind.operators.drift import index_is_stale

    latest = listing.agg(F.max(F.unix_micros("modified") / F.lit(1e6)).alias("m")).scalar()
    documents = index.documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    stale = index_is_stale(latest, F.col("latest_source"))
    return index.meta.select(
        F.when(stale, "stale").otherwise("ok").alias("status"), documents.alias("document_count"), F.col("source_files").alias("source_file_count"),
        "created_at", latest.alias("latest_source"), stale.alias("is_stale"),
    )
