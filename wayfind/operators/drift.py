"""Repository drift: orphans, stale packs, stale graphs, root rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.paths import any_of, base_name, escapes_root, slashed
from wayfind.operators.dedup import proper_suffixes
from wayfind.operators.skew import top_per_key


def affinity_folder(path: Column) -> Column:
    """The folder two files are compared by: the second component, else the first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))


def repository_files(
    listing: DataFrame, roots: list[dict], ignore_dirs: tuple[str, ...] = (), ignore_patterns: tuple[str, ...] = (),
    modules_override: dict[str, str] | None = None,
) -> DataFrame:
    """(path, module) of the listed files under the configured roots.

    ``roots``: {name, path, extensions}; the last root that holds a file decides its module.
    Hidden and ignored folders are left out, as are names matching an ignore glob.
    """
    overrides = modules_override or {}
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = base_name(F.col("path"))
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*ignore_dirs) if ignore_dirs else p.startswith("."))
    globbed = any_of([name.rlike("^" + _glob(p) + "$") for p in ignore_patterns])
    module = F.lit(None).cast("string")
    for root in reversed(roots):
        prefix = root["path"].strip("./").rstrip("/")
        inside = F.col("path").startswith(prefix + "/") if prefix else F.lit(True)
        extensions = tuple(root.get("extensions") or ())
        typed = any_of([name.endswith(e) for e in extensions]) if extensions else F.lit(True)
        rest = F.split(F.substr("path", F.lit(len(prefix) + 2)) if prefix else F.col("path"), "/")
        derived = F.when(F.size(rest) > 1, F.get(rest, F.lit(0))).otherwise(F.lit(root["name"]))
        value = F.lit(overrides[root["name"]]) if root["name"] in overrides else derived
        module = F.when(inside & typed, F.coalesce(module, value)).otherwise(module)
    return listing.where(~hidden & ~globbed).select("path", module.alias("module")).where(F.col("module").isNotNull())


def _glob(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(ch, ("\\" + ch) if not ch.isalnum() else ch) for ch in pattern)


def orphans(real: DataFrame, pack_files: DataFrame) -> DataFrame:
    """Files no pack covers, each with the pack that holds most files of its folder.

    ``pack_files``: pack, path.  Counting happens per (pack, folder); the orphan
    join is by folder against one row per folder.
    """
    covered = pack_files.select(slashed(F.col("path")).alias("path")).distinct()
    lonely = real.select("path").distinct().join(covered, "path", "left_anti").withColumn("folder", affinity_folder(F.col("path")))
    sizes = pack_files.groupBy("pack", affinity_folder(slashed(F.col("path"))).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    # most files first; on ties the pack that comes first by name
    best = sizes.groupBy("folder").agg(F.min_by(F.struct("pack", "n"), F.struct((-F.col("n")).alias("m"), F.col("pack"))).alias("b"))
    return lonely.join(best, "folder", "left").select(
        "path", F.col("b.pack").alias("suggested_pack"), F.coalesce("b.n", F.lit(0)).alias("confidence")
    )


def stale_packs(sources: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """First reason why each pack is stale, or ``up to date``.

    ``sources``: pack, pos, path.  ``manifest``: pack, pos, key, hash.  ``listing``: path, hash.
    A manifest key matches a source if it ends with it: keys are exploded into
    their endings, so the match is an equi join.
    """
    wanted = sources.select("pack", "pos", slashed(F.col("path")).alias("path"))
    endings = manifest.select(
        "pack", F.col("pos").alias("key_pos"), "hash",
        F.explode(F.concat(F.array(slashed(F.col("key"))), proper_suffixes(slashed(F.col("key"))))).alias("path"),
    )
    first = endings.groupBy("pack", "path").agg(F.min_by("hash", "key_pos").alias("recorded"), F.count(F.lit(1)).alias("listed"))
    packs = manifest.select("pack").distinct().withColumn("has_manifest", F.lit(True))
    live = listing.select("path", F.col("hash").alias("live"))
    joined = (
        wanted.join(live, "path", "left").join(first, ["pack", "path"], "left").join(packs, "pack", "left")
    )
    reason = (
        F.when(F.col("has_manifest").isNull(), "no manifest yet")
        .when(escapes_root(F.col("path")), F.concat(F.lit("source escapes repository root: "), "path"))
        .when(F.col("live").isNull(), F.concat(F.lit("source file missing on disk: "), "path"))
        .when(F.col("listed").isNull(), F.concat(F.lit("file not present in manifest: "), "path"))
        .when(~F.col("recorded").eqNullSafe(F.col("live")), F.concat(F.lit("content changed since last build: "), "path"))
    )
    judged = joined.withColumn("reason", reason)
    first_reason = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos")))
    return judged.groupBy("pack").agg(F.coalesce(first_reason, F.lit("up to date")).alias("reason"))


def stale_graphs(files: DataFrame, graphs: DataFrame) -> DataFrame:
    """Folders whose newest source is later than their graph (or that have no graph).

    ``files``: folder, path, modified.  ``graphs``: folder, modified.
    """
    newest = files.groupBy("folder").agg(
        F.max("modified").alias("newest"), F.max_by("path", F.struct("modified", "path")).alias("newest_path")
    )
    joined = newest.join(graphs.select("folder", F.col("modified").alias("graph_modified")), "folder", "left")
    stale = F.col("graph_modified").isNull() | (F.col("newest") > F.col("graph_modified"))
    return joined.select("folder", "newest_path", stale.alias("is_stale"))


def index_is_stale(latest_source: Column, recorded: Column, tolerance: float = 1.0) -> Column:
    """Sources changed after the index was built, with a second of tolerance."""
    return F.coalesce(latest_source, F.lit(0.0)) > F.coalesce(recorded, F.lit(0.0)) + tolerance


def root_rollup(files: DataFrame, roots: list[str], sample: int = 20) -> DataFrame:
    """Indexed files under every configured root: count and the first paths by name.

    The roots are configuration (a short list), so the prefix test is an expression
    and not a join; a file counts once for every enclosing root.
    """
    under = F.array_compact(F.array(*[F.when(F.col("path").startswith(r), F.lit(r)) for r in roots]))
    rows = files.select("path", F.explode(under).alias("root"))
    totals = rows.groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    first = top_per_key(rows.distinct(), ["root"], [F.asc("path")], sample)
    listed = first.groupBy("root").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    used = totals.join(listed, "root")
    unused = files.sparkSession.createDataFrame([(r,) for r in roots], "root string").join(totals, "root", "left_anti")
    return used.unionByName(unused.select("root", F.lit(0).cast("bigint").alias("files"), F.array().cast("array<string>").alias("paths")))
