"""Discovery of indexable files: one distributed listing, include rules as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions.paths import any_of, base_name, slashed
from wayfind.sources.config import Settings


def merged_roots(*lists: tuple[dict, ...]) -> list[dict]:
    """Union of root lists, distinct by (path, kind), first wins."""
    seen: dict[tuple[str, str], dict] = {}
    for roots in lists:
        for root in roots:
            seen.setdefault((root["path"].strip("/").replace("\\", "/"), root["kind"]), root)
    return list(seen.values())


def is_ignored(path: Column, settings: Settings) -> Column:
    parts = F.split(F.lower(path), "/")
    ignored = F.lit(False)
    if settings.ignore_parts:
        ignored = F.arrays_overlap(parts, F.array(*[F.lit(p.lower()) for p in settings.ignore_parts]))
    return ignored | any_of([F.lower(path).endswith(e.lower()) for e in settings.ignore_extensions])


def is_included(path: Column, kind: str, settings: Settings) -> Column:
    """Include rule of a root kind; ignores beat includes."""
    name = base_name(path)
    if kind == "graph":
        wanted = (
            name.endswith(".enrichment.json")
            | name.isin(*settings.include_file_names)
            | any_of([path.contains(m.replace("\\", "/")) for m in settings.include_path_contains])
        )
    elif kind == "knowledge":
        wanted = any_of([F.lower(name).endswith(e) for e in settings.knowledge_extensions])
    elif kind == "docs":
        wanted = F.lower(name).endswith(".md")
    else:
        wanted = F.lit(False)
    return wanted & ~is_ignored(path, settings)


def scanned_path() -> Column:
    """The path of the file a row comes from, as the listing names it (a scan reports it with escaped characters)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def relative_path(url: Column, base: str) -> Column:
    """Path below ``base``, whatever the scheme of the file system."""
    plain = re.sub(r"^[A-Za-z0-9]+:/+", "/", base).rstrip("/")
    return F.substr(F.regexp_replace(url, "^[A-Za-z0-9]+:/+", "/"), F.lit(len(plain) + 2))


def only_files(raw: DataFrame, uris: tuple[str, ...] | None) -> DataFrame:
    """The rows of some files of a reader; Spark prunes the others before it opens them.  None means all files."""
    return raw if uris is None else raw.where(F.col("_metadata.file_path").isin(*uris)) if uris else raw.where(F.lit(False))


def list_files(
    spark: SparkSession, base: str, settings: Settings, roots: list[dict] | None = None,
    glob: str | None = None, with_text: bool = False, uris: tuple[str, ...] | None = None,
) -> DataFrame:
    """(path, url, uri, kind, length, modified[, text]): indexable files, one row per path.

    Without ``with_text`` the content column is not selected, so the scan only lists.
    ``glob`` limits the listing by file name.  A file under two roots appears once,
    with the kind of the first root that takes it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = only_files(reader.load(base), uris)
    chosen = roots if roots is not None else list(settings.roots)
    path = relative_path(F.col("path"), base)
    columns = [path.alias("path"), F.col("path").alias("url"), F.col("_metadata.file_path").alias("uri"), "length", F.col("modificationTime").alias("modified")]
    if with_text:
        if settings.limits.text_bytes is not None:  # pushed into the scan: larger files are never read
            files = files.where(F.col("length") <= settings.limits.text_bytes)
        columns.append(F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return files.select(*columns).withColumn("kind", root_kind(F.col("path"), chosen, settings)).where(F.col("kind").isNotNull())


def root_kind(path: Column, roots: list[dict], settings: Settings) -> Column:
    """Kind of the first root that includes a path; null if none does."""
    kind = F.lit(None).cast("string")
    for root in reversed(roots):
        prefix = root["path"].strip("/")
        under = path.startswith(prefix + "/") if prefix else F.lit(True)
        kind = F.when(under & is_included(path, root["kind"], settings), F.lit(root["kind"])).otherwise(kind)
    return kind


def discovery_report(files: DataFrame, roots: list[dict]) -> DataFrame:
    """(root, required, files, status): ok, warning for an empty optional root, error for an empty required one."""
    rows = files.sparkSession.createDataFrame(
        [(r["path"].strip("/"), bool(r.get("required"))) for r in roots], "root string, required boolean"
    )
    under = F.array_compact(F.array(*[
        F.when(F.col("path").startswith(r["path"].strip("/") + "/"), F.lit(r["path"].strip("/"))) for r in roots
    ]))
    counts = files.select(F.explode(under).alias("root")).groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    joined = rows.join(counts, "root", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    status = F.when(F.col("files") > 0, "ok").when(F.col("required"), "error").otherwise("warning")
    return joined.withColumn("status", status)


def overall_status(report: DataFrame) -> Column:
    """error > warning > ok, for ``report.agg(...)``."""
    return (
        F.when(F.max(F.when(F.col("status") == "error", 1)).isNotNull(), "error")
        .when(F.max(F.when(F.col("status") == "warning", 1)).isNotNull(), "warning")
        .otherwise("ok")
    )
