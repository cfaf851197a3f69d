"""Finding roots, packs and graph folders from a listing of paths alone.

A listing is a table with a ``path`` relative to the repository.  Folders are no rows of their own: they are the ancestors
of the files.  All of it is distributed; only the findings are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.paths import base_name
from wayfind.operators.drift import _glob, orphans, repository_files

#: Marker files in the order they are looked for, and the source endings of their projects.
MARKERS = (
    ("package.json", (".ts", ".tsx", ".js", ".jsx")),
    ("*.csproj", (".cs",)),
    ("pyproject.toml", (".py",)),
    ("go.mod", (".go",)),
    ("pom.xml", (".java",)),
)
ANY_PROJECT = (".ts", ".tsx", ".js", ".jsx", ".cs", ".py", ".go", ".java")


def ancestors(path: Column) -> Column:
    """All folders above a path, the nearest last; the root is not among them."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def _skipped(folder: Column, ignore_dirs: tuple[str, ...]) -> Column:
    hidden = folder.startswith(".")
    return hidden | folder.isin(*ignore_dirs) if ignore_dirs else hidden


def detect_roots(listing: DataFrame, ignore_dirs: tuple[str, ...] = (), markers: tuple[tuple[str, tuple[str, ...]], ...] = MARKERS) -> DataFrame:
    """(name, path, extensions): top-level folders with a marker file in them or in one of their folders.

    The first marker in order decides the endings.  Without any such folder the whole repository is one root.
    """
    parts = F.split("path", "/")
    name = base_name(F.col("path"))
    place = F.lit(None).cast("int")
    for i, (marker, _) in reversed(list(enumerate(markers))):
        place = F.when(name.rlike("^" + _glob(marker) + "$"), F.lit(i)).otherwise(place)
    rows = listing.where(F.size(parts).between(2, 3)).select(F.get(parts, F.lit(0)).alias("name"), place.alias("place"))
    best = rows.where(F.col("place").isNotNull() & ~_skipped(F.col("name"), ignore_dirs)).groupBy("name").agg(F.min("place").alias("place"))
    endings = F.array(*[F.array(*[F.lit(e) for e in found]) for _, found in markers])
    roots = best.select("name", F.col("name").alias("path"), F.get(endings, F.col("place")).alias("extensions"))
    whole = listing.sparkSession.createDataFrame([("root", ".", list(ANY_PROJECT))], roots.schema)
    none = roots.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return roots.unionByName(whole.where(none))


def discover_packs(listing: DataFrame, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(module, pack): packs with a source list two folders below ``folder``, but for the excluded modules."""
    parts = F.split(F.substr("path", F.lit(len(folder.rstrip("/")) + 2)), "/")
    inside = listing.where(F.col("path").startswith(folder.rstrip("/") + "/")).select(parts.alias("p"))
    lists = inside.where((F.size("p") == 4) & (F.get("p", F.lit(2)) == "raw") & (F.get("p", F.lit(3)) == "source-files.txt"))
    found = lists.select(F.get("p", F.lit(0)).alias("module"), F.get("p", F.lit(1)).alias("pack")).distinct()
    return found.where(~F.col("module").isin(*excluded)) if excluded else found


def graph_folders(listing: DataFrame, roots: list[dict], name: str, ignore_dirs: tuple[str, ...] = ()) -> DataFrame:
    """(folder, parent, root, extensions): folders called ``name`` below the roots, the top-most on every path only.

    Folders below hidden or ignored ones are not searched, nor what lies below a folder found.  A root that holds another
    root's folder finds it too; it is listed with the first of them.
    """
    parts = F.split("path", "/")
    rows = listing.select("path", parts.alias("p"))
    found = []
    for place, root in enumerate(roots):
        prefix = root["path"].strip("./").rstrip("/")
        depth = len(prefix.split("/")) if prefix else 0
        inside = rows.where(F.col("path").startswith(prefix + "/")) if prefix else rows
        rest = inside.select("p", F.slice("p", depth + 1, F.greatest(F.size("p") - depth - 1, F.lit(0))).alias("below"))
        at = F.array_position("below", name)  # the first of that name: the top-most
        rest = rest.withColumn("at", at.cast("int")).where("at > 0")
        above = F.slice("below", 1, F.col("at") - 1)
        rest = rest.where(~F.exists(above, lambda d: _skipped(d, ignore_dirs)))
        folder = F.array_join(F.slice("p", 1, F.col("at") + depth), "/")
        parent = F.array_join(F.slice("p", 1, F.col("at") + depth - 1), "/")
        extensions = F.array(*[F.lit(e) for e in root.get("extensions") or ()]).cast("array<string>")
        found.append(rest.select(folder.alias("folder"), parent.alias("parent"), F.lit(place).alias("place"), F.lit(root["name"]).alias("root"), extensions.alias("extensions")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    best = out.groupBy("folder").agg(F.min_by(F.struct("parent", "root", "extensions"), "place").alias("b"))
    return best.select("folder", "b.parent", "b.root", "b.extensions")


def stale_graph_folders(listing: DataFrame, folders: DataFrame, ignore_dirs: tuple[str, ...] = (), graph: str = "graph.json") -> DataFrame:
    """(folder, is_stale, reason): graph folders without a graph, or with a source beside them that is newer than it.

    ``listing``: path, modified.  Every file is joined with its own ancestors that hold a graph folder (an equi join, depth
    rows a file), so nested folders see the files of the ones below them.
    """
    files = listing.select("path", "modified", F.split("path", "/").alias("p"))
    ways = files.select("path", "modified", "p", F.posexplode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("depth", "parent"))
    met = ways.join(folders.select("parent", "folder", "extensions"), "parent")
    below = F.slice("p", F.col("depth") + 1, F.size("p") - F.col("depth") - 1)
    typed = (F.size("extensions") == 0) | F.exists("extensions", lambda e: F.col("path").endswith(e))
    sources = met.where(typed & ~F.exists(below, lambda d: _skipped(d, ignore_dirs)))
    newest = sources.groupBy("folder").agg(F.max_by(F.struct("modified", "path"), F.struct("modified", "path")).alias("n"))
    graphs = listing.select(F.regexp_extract("path", f"^(?:(.*)/)?{_glob(graph)}$", 1).alias("folder"), F.col("path").alias("g"), "modified")
    graphs = graphs.where(F.col("g") == F.concat("folder", F.lit("/" + graph))).select("folder", F.col("modified").alias("built"))
    joined = folders.select("folder").join(graphs, "folder", "left").join(newest, "folder", "left")
    reason = F.when(F.col("built").isNull(), "no graph yet").when(
        F.col("n.modified") > F.col("built"), F.concat(F.lit("source changed after the graph (newest: "), F.col("n.path"), F.lit(")"))
    )
    return joined.select("folder", reason.isNotNull().alias("is_stale"), F.coalesce(reason, F.lit("up to date")).alias("reason"))


def drift_report(
    listing: DataFrame, roots: list[dict], pack_files: DataFrame, pack_reasons: DataFrame, graph_name: str, ignore_dirs: tuple[str, ...] = (),
    ignore_patterns: tuple[str, ...] = (), modules_override: dict[str, str] | None = None,
) -> DataFrame:
    """(section, target, needs_work, detail): uncovered files with the pack they may belong to, stale packs, stale graph folders.

    ``listing``: path, modified.  ``pack_files``: pack, path.  ``pack_reasons``: pack, reason, as ``check_packs`` gives them.
    """
    real = repository_files(listing, roots, ignore_dirs, ignore_patterns, modules_override)
    guess = F.when(F.col("suggested_pack").isNotNull(), F.concat("suggested_pack", F.lit(" ("), F.col("confidence").cast("string"), F.lit(" related files)")))
    lonely = orphans(real, pack_files).select(
        F.lit("uncovered file").alias("section"), F.col("path").alias("target"), F.lit(True).alias("needs_work"), F.coalesce(guess, F.lit("no pack looks related")).alias("detail")
    )
    packs = pack_reasons.select(F.lit("pack").alias("section"), F.col("pack").alias("target"), (F.col("reason") != "up to date").alias("needs_work"), F.col("reason").alias("detail"))
    folders = graph_folders(listing, roots, graph_name, ignore_dirs)
    graphs = stale_graph_folders(listing, folders, ignore_dirs)
    graphs = graphs.select(F.lit("graph folder").alias("section"), F.col("folder").alias("target"), F.col("is_stale").alias("needs_work"), F.col("reason").alias("detail"))
    return lonely.unionByName(packs).unionByName(graphs)


def drift_summary(report: DataFrame) -> DataFrame:
    """(section, checked, needs_work)."""
    return report.groupBy("section").agg(F.count(F.lit(1)).alias("checked"), F.sum(F.col("needs_work").cast("long")).alias("needs_work"))


def write_orphan_report(found: DataFrame, path: str) -> None:
    """Uncovered files as JSON lines for review: file, suggested_pack, confidence and an empty ``decision``.

    A decision is an existing pack, ``NEW:<pack>`` for a new one, or nothing; ``read_decisions`` takes them up.
    """
    rows = found.select(F.col("path").alias("file"), "suggested_pack", "confidence", F.lit("").alias("decision"))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_decisions(spark, path: str) -> DataFrame:
    """(pack, path, is_new) of the reviewed rows of an orphan report that name a pack."""
    rows = spark.read.schema("file string, suggested_pack string, confidence long, decision string").json(path)
    decision = F.trim("decision")
    named = rows.where((decision != "") & (F.lower(decision) != "skip"))
    is_new = decision.startswith("NEW:")
    pack = F.when(is_new, F.trim(F.substr(decision, F.lit(5)))).otherwise(decision)
    return named.select(pack.alias("pack"), F.col("file").alias("path"), is_new.alias("is_new")).where(F.col("pack") != "")

