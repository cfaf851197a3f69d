"""Content-hash manifests: what a folder or a pack held when it was built, and how it differs now.

A manifest is a table (path, length, modified, hash).  Contents are hashed where they are scanned; only paths and digests are
shuffled.  Packs are folders with a source list; their manifests are one table for all packs, so that checking a thousand packs
is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions.paths import base_name, escapes_root, slashed
from wayfind.operators.drift import stale_packs
from wayfind.operators.skew import first_per_key
from wayfind.sources.listing import relative_path

ENTRY = "struct<mtime:double,hash:string>"
SOURCE_LIST, STORED = "raw/source-files.txt", "raw/manifest.json"


def content_hash(content: Column) -> Column:
    """MD5 of the bytes, lower-case hex."""
    return F.md5(content)


def hash_files(spark: SparkSession, base: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified, hash) of all files below ``base``, binary ones too."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = relative_path(F.col("path"), base)
    return reader.load(base).select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), content_hash(F.col("content")).alias("hash"))


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old_path, old_hash, new_hash): added, removed, changed, same or renamed.

    A removed and an added path of equal content are a rename.  Among several of one content, those that keep their file name are
    paired first, then the rest by path; what is left over stays added or removed.  Each side has one row per path; of
    repeated paths the smallest hash counts.  A null hash (unreadable file) equals a null hash and is never a rename.
    """
    left = old.groupBy("path").agg(F.min("hash").alias("old_hash"), F.lit(True).alias("_old"))
    right = new.groupBy("path").agg(F.min("hash").alias("new_hash"), F.lit(True).alias("_new"))
    joined = left.join(right, "path", "full_outer")
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    )
    judged = joined.select("path", status.alias("status"), "old_hash", "new_hash")
    moving = F.col("status").isin("added", "removed")
    stays = judged.where(~moving).select("path", "status", F.lit(None).cast("string").alias("old_path"), "old_hash", "new_hash")
    moved = judged.where(moving).select("path", "status", F.coalesce("old_hash", "new_hash").alias("hash"), base_name(F.col("path")).alias("name"))
    named, rest = _paired(moved, ["hash", "name"])
    by_hash, alone = _paired(rest, ["hash"])
    renamed = named.unionByName(by_hash).select(
        "path", F.lit("renamed").alias("status"), "old_path", F.col("hash").alias("old_hash"), F.col("hash").alias("new_hash")
    )
    single = alone.select(
        "path", "status", F.lit(None).cast("string").alias("old_path"), F.when(F.col("status") == "removed", F.col("hash")).alias("old_hash"),
        F.when(F.col("status") == "added", F.col("hash")).alias("new_hash"),
    )
    return stays.unionByName(renamed).unionByName(single)


def _paired(moved: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(old_path, path, hash) of removed and added rows matched one to one within ``keys``, and the rows left over.

    The i-th removed path meets the i-th added one.  Both sides are numbered by one window and meet in one aggregate, so a
    content that thousands of files share is streamed and never gathered.
    """
    order = Window.partitionBy(*keys, "status").orderBy("path")
    numbered = moved.withColumn("_n", F.row_number().over(order))
    met = numbered.groupBy(*keys, "_n").agg(
        F.max(F.when(F.col("status") == "removed", F.col("path"))).alias("gone"), F.max(F.when(F.col("status") == "added", F.col("path"))).alias("came"),
        *([] if "name" in keys else [F.max(F.when(F.col("status") == "added", F.col("name"))).alias("name")]),
    )
    both = F.col("gone").isNotNull() & F.col("came").isNotNull() & F.col("hash").isNotNull()
    pairs = met.where(both).select(F.col("came").alias("path"), F.col("gone").alias("old_path"), "hash")
    alone = met.where(~both).select("hash", F.explode(F.array(
        F.struct(F.col("gone").alias("path"), F.lit("removed").alias("status")), F.struct(F.col("came").alias("path"), F.lit("added").alias("status")),
    )).alias("s"))
    alone = alone.where(F.col("s.path").isNotNull()).select("s.path", "s.status", "hash", base_name(F.col("s.path")).alias("name"))
    return pairs, alone


def diff_summary(diff: DataFrame) -> DataFrame:
    """(status, files)."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


# -- packs ------------------------------------------------------------------


def _pack_of(path: Column, tail: str) -> Column:
    parts = F.split(F.substr(path, F.lit(1), F.length(path) - len(tail) - 1), "/")
    return F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))


def _texts(spark: SparkSession, base: str, tail: str) -> DataFrame:
    """(path, text) of the files below ``base`` whose path ends with ``tail``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", tail.rsplit("/", 1)[-1]).load(base)
    rows = files.select(relative_path(F.col("path"), base).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where(F.col("path").endswith("/" + tail))


def pack_sources(spark: SparkSession, packs: str) -> DataFrame:
    """(pack, pos, path): the lines of every pack's source list, trimmed, empty ones left out."""
    rows = _texts(spark, packs, SOURCE_LIST).select(_pack_of(F.col("path"), SOURCE_LIST).alias("pack"), F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").select("pack", "pos", F.trim("line").alias("path"))


def stored_manifests(spark: SparkSession, packs: str) -> tuple[DataFrame, DataFrame]:
    """((pack, pos, key, hash), (pack, problem)) of the JSON manifests that packs hold.

    A manifest maps corpus paths to modification times and hashes.  One that is no JSON, or none of this kind, is a problem
    and has no rows.
    """
    texts = _texts(spark, packs, STORED).select(_pack_of(F.col("path"), STORED).alias("pack"), "text")
    parsed = texts.select("pack", "text", F.from_json("text", "map<string,string>").alias("raw"), F.from_json("text", f"map<string,{ENTRY}>").alias("entries"))
    hashes = (F.size("raw") > 0) & F.forall(F.map_values("raw"), lambda v: F.coalesce(v.startswith("{"), F.lit(False)))
    valid = F.coalesce(F.expr("try_parse_json(text)").isNotNull(), F.lit(False))
    problem = F.when(~valid, "manifest is no valid JSON").when(F.col("raw").isNull() | ~hashes, "manifest holds no hashes")
    judged = parsed.withColumn("problem", problem)
    rows = judged.where("problem IS NULL").select("pack", F.posexplode("entries").alias("pos", "key", "entry"))
    return rows.select("pack", "pos", "key", F.col("entry.hash").alias("hash")), judged.where("problem IS NOT NULL").select("pack", "problem")


def build_manifests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(pack, pos, key, modified, hash, problem): the manifest entry of every listed source.

    ``sources``: pack, pos, path.  ``files``: a hashed listing of the repository.  An entry that leaves the repository or
    whose file is missing has a problem and no hash; such a pack must not be published (see ``publishable``).
    """
    wanted = sources.select("pack", "pos", slashed(F.col("path")).alias("key"))
    live = files.select(F.col("path").alias("key"), "modified", "hash")
    joined = wanted.join(live, "key", "left")
    problem = F.when(escapes_root(F.col("key")), F.concat(F.lit("source escapes repository root: "), "key")).when(
        F.col("hash").isNull(), F.concat(F.lit("source file missing on disk: "), "key")
    )
    kept = F.when(problem.isNull(), F.col("hash"))
    return joined.select("pack", "pos", "key", F.when(problem.isNull(), F.col("modified")).alias("modified"), kept.alias("hash"), problem.alias("problem"))


def publishable(manifests: DataFrame) -> DataFrame:
    """Entries of the packs without any problem."""
    bad = manifests.where(F.col("problem").isNotNull()).select("pack").distinct()
    return manifests.join(bad, "pack", "left_anti").drop("problem")


def manifest_json(manifests: DataFrame) -> DataFrame:
    """(pack, json): one manifest per pack in the stored form; a pack's list is bounded by its source list.  Of a path
    listed twice the first entry counts."""
    once = first_per_key(manifests, ["pack", "key"], [F.col("pos")], ["pos", "modified", "hash"])
    entry = F.struct("pos", "key", F.struct((F.unix_micros("modified") / F.lit(1e6)).alias("mtime"), "hash").alias("value"))
    lists = once.groupBy("pack").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return lists.select("pack", F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x["value"])))).alias("json"))


def check_packs(spark: SparkSession, base: str, packs: str, files: DataFrame | None = None) -> DataFrame:
    """(pack, reason) of all packs below ``packs`` against the live files below ``base``: why each is stale, or ``up to date``."""
    sources = pack_sources(spark, packs)
    stored, problems = stored_manifests(spark, packs)
    live = hash_files(spark, base) if files is None else files
    reasons = stale_packs(sources, stored, live).join(problems, "pack", "left")
    return reasons.select("pack", F.coalesce("problem", "reason").alias("reason"))
