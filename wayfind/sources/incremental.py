"""An index that follows its files: what changed is built again, the rest stays as it was written.

An index folder holds generations.  Generation 0 is a full build; a later one holds the rows of new and changed files, and the
ids of all documents and the paths of all sources that older generations must no longer show.  Writing never touches an older
generation.  A generation counts once its row in ``published`` is written, which is the last thing a refresh does; a
refresh that fails leaves a folder nobody reads and the next one takes a new number.  Readers join the older generations with
what is gone, so a read costs one join with small rows; ``compact`` writes a full generation again, and after ``MAX_DELTAS`` of
them a refresh does so by itself.

Changes are found by (path, length, modified), as in a listing; contents are read for changed files only.  One process refreshes
an index at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.config import Settings
from wayfind.sources.documents import SOURCE_GLOB
from wayfind.sources.index import SearchIndex, build_index
from wayfind.sources.listing import list_files, relative_path

#: More changed files than this are built anew as a whole: their names would make the plan too long.
MAX_CHANGED = 5_000
MAX_DELTAS = 8
#: Seconds between two refreshes, at least.
MIN_INTERVAL = 15
PUBLISHED = "gen int, folder string, is_full boolean, changed long, removed long, published_at timestamp"
BY_PATH = ("source_lines",)
WHOLE = ("meta",)


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did: ``action`` is full, delta, none (nothing changed) or soon (called again too soon)."""

    action: str
    gen: int
    changed: int = 0
    removed: int = 0


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, uri) of the files that are new, changed or removed between two listings; ``uri`` is null for removed ones."""
    before = old.select("path", F.struct("length", "modified").alias("was"))
    now = new.select("path", "uri", F.struct("length", "modified").alias("is"))
    joined = before.join(now, "path", "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return joined.select("path", status.alias("status"), "uri").where(F.col("status").isNotNull())


def _sources(spark: SparkSession, base: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SOURCE_GLOB).load(base)
    return files.select(relative_path(F.col("path"), base).alias("path"), F.col("_metadata.file_path").alias("uri"), "length", F.col("modificationTime").alias("modified"))


def generations(spark: SparkSession, folder: str) -> list:
    """The published generations from the last full one on (at most ``MAX_DELTAS`` + 1 rows), oldest first."""
    if not _exists(spark, f"{folder}/published"):
        return []
    rows = spark.read.schema(PUBLISHED).parquet(f"{folder}/published")
    full = rows.where("is_full").agg(F.max("gen").alias("g")).scalar()
    return rows.where(F.col("gen") >= full).orderBy("gen").collect()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _publish(spark: SparkSession, folder: str, gen: int, name: str, is_full: bool, changed: int, removed: int) -> None:
    row = spark.range(1).select(
        F.lit(gen).alias("gen"), F.lit(name).alias("folder"), F.lit(is_full).alias("is_full"), F.lit(changed).cast("long").alias("changed"),
        F.lit(removed).cast("long").alias("removed"), F.current_timestamp().alias("published_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{folder}/published")


def read_table(spark: SparkSession, folder: str, gens: list, name: str) -> DataFrame:
    """The live rows of a table over all generations."""
    if name in WHOLE or len(gens) == 1:
        return spark.read.parquet(f"{folder}/{gens[-1].folder}/{name}")
    key, gone_name = ("path", "gone_sources") if name in BY_PATH else ("doc_id", "gone_documents")
    rows = gone = None
    for g in gens:
        part = spark.read.parquet(f"{folder}/{g.folder}/{name}").withColumn("_gen", F.lit(g.gen))
        rows = part if rows is None else rows.unionByName(part)
        if not g.is_full:
            lost = spark.read.parquet(f"{folder}/{g.folder}/{gone_name}").select(key, F.lit(g.gen).alias("_gone"))
            gone = lost if gone is None else gone.unionByName(lost)
    last = gone.groupBy(key).agg(F.max("_gone").alias("_gone"))
    alive: Column = F.col("_gone").isNull() | (F.col("_gen") >= F.col("_gone"))
    return rows.join(last, key, "left").where(alive).drop("_gen", "_gone").select(*[c for c in rows.columns if c != "_gen"])


def read_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The current state of an index that ``refresh_index`` keeps."""
    gens = generations(spark, folder)
    if not gens:
        raise FileNotFoundError(f"no published index in {folder}")
    return SearchIndex(**{f.name: read_table(spark, folder, gens, f.name) for f in fields(SearchIndex)})


def _full(spark: SparkSession, base: str, folder: str, gen: int, settings: Settings, source_base: str, changed: int, removed: int) -> Refreshed:
    name = f"gen-{gen}-{uuid.uuid4().hex[:8]}"
    _sources(spark, source_base).write.parquet(f"{folder}/{name}/sources")
    build_index(spark, base, f"{folder}/{name}", settings, source_base)
    _publish(spark, folder, gen, name, True, changed, removed)
    return Refreshed("full", gen, changed, removed)


def refresh_index(
    spark: SparkSession, base: str, folder: str, settings: Settings | None = None, source_base: str | None = None, min_interval: float = 0.0,
    max_changed: int = MAX_CHANGED, max_deltas: int = MAX_DELTAS,
) -> Refreshed:
    """Brings the index in ``folder`` up to the files below ``base``; see the module text."""
    settings, source_base = settings or Settings(), source_base or base
    gens = generations(spark, folder)
    if not gens:
        return _full(spark, base, folder, 0, settings, source_base, 0, 0)
    last = gens[-1]
    if min_interval:
        age = spark.range(1).select((F.unix_micros(F.current_timestamp()) - F.unix_micros(F.lit(last.published_at))) / 1e6).first()[0]
        if age < min_interval:
            return Refreshed("soon", last.gen)
    at = f"{folder}/{last.folder}"
    docs = changed_files(spark.read.parquet(f"{at}/listing"), list_files(spark, base, settings)).withColumn("part", F.lit("docs"))
    sources = changed_files(spark.read.parquet(f"{at}/sources"), _sources(spark, source_base)).withColumn("part", F.lit("sources"))
    # one row more than the limit tells that there are too many; the names become part of the reader's file pruning
    found = docs.unionByName(sources).limit(max_changed + 1).collect()
    if not found:
        return Refreshed("none", last.gen)
    gen = last.gen + 1
    changed, removed = (sum(r.status != "removed" for r in found), sum(r.status == "removed" for r in found))
    if len(found) > max_changed or len(gens) > max_deltas:
        return _full(spark, base, folder, gen, settings, source_base, changed, removed)
    name = f"gen-{gen}-{uuid.uuid4().hex[:8]}"
    stale = {part: [r.path for r in found if r.part == part and r.status != "new"] for part in ("docs", "sources")}
    uris = {part: tuple(sorted(r.uri for r in found if r.part == part and r.uri)) for part in ("docs", "sources")}
    _sources(spark, source_base).write.parquet(f"{folder}/{name}/sources")
    current = read_table(spark, folder, gens, "documents")
    gone = current.where(F.col("source").isin(*stale["docs"])) if stale["docs"] else current.where(F.lit(False))
    gone.select("doc_id").write.parquet(f"{folder}/{name}/gone_documents")
    spark.createDataFrame([(p,) for p in stale["sources"]], "path string").write.parquet(f"{folder}/{name}/gone_sources")
    build_index(spark, base, f"{folder}/{name}", settings, source_base, uris=uris["docs"], source_uris=uris["sources"])
    _publish(spark, folder, gen, name, False, changed, removed)
    return Refreshed("delta", gen, changed, removed)


def compact(spark: SparkSession, folder: str) -> Refreshed:
    """Writes the live rows of all generations as one full generation; nothing is parsed again."""
    gens = generations(spark, folder)
    if len(gens) < 2:
        return Refreshed("none", gens[-1].gen if gens else -1)
    gen = gens[-1].gen + 1
    name = f"gen-{gen}-{uuid.uuid4().hex[:8]}"
    for table in [f.name for f in fields(SearchIndex)]:
        rows = read_table(spark, folder, gens, table)
        if table == "doc_terms":  # as in a build: a query skips all row groups but those of its terms
            rows = rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        rows.write.parquet(f"{folder}/{name}/{table}")
    for table in ("listing", "sources"):
        spark.read.parquet(f"{folder}/{gens[-1].folder}/{table}").write.parquet(f"{folder}/{name}/{table}")
    _publish(spark, folder, gen, name, True, 0, 0)
    return Refreshed("full", gen)


def watch(spark: SparkSession, base: str, folder: str, settings: Settings | None = None, source_base: str | None = None, seconds: int = MIN_INTERVAL):
    """A streaming query that refreshes the index every so many seconds; stop it with ``stop()``."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()

    def refresh(_: DataFrame, __: int) -> None:
        refresh_index(spark, base, folder, settings, source_base)

    return ticks.writeStream.foreachBatch(refresh).trigger(processingTime=f"{seconds} seconds").start()
