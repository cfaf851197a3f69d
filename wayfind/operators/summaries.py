"""Module and pack summaries, and checks on a finished answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.classify import source_priority
from wayfind.functions.paths import any_of, normalized_path
from wayfind.functions.text import first_useful_lines
from wayfind.operators.dedup import distinct_ci
from wayfind.operators.skew import ranked_top


def _by_priority(docs: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` documents with their ``rank``; without limit all, ranked by an orderable pair instead of a number."""
    rated = docs.withColumn("priority", source_priority(F.col("source_type")))
    if limit is None:
        return rated.withColumn("rank", F.struct((-F.col("priority")).alias("place"), F.col("doc_id").alias("doc_id")))
    return ranked_top(rated, [F.desc("priority"), F.asc("doc_id")], limit)


def module_documents(documents: DataFrame, module: str, pack: str | None = None, limit: int = 12) -> DataFrame:
    """Documents of a module by source priority; without any (and no pack given), documents whose path mentions it."""
    wanted = module.strip().lower()
    of_module = documents.where(F.lower("module") == wanted)
    if pack:
        return _by_priority(of_module.where(F.lower("pack") == pack.strip().lower()), limit)
    # both branches are limited lists; the second only counts if the first is empty
    own = _by_priority(of_module, limit).withColumn("tier", F.lit(0))
    mentioned = _by_priority(documents.where(F.lower("path").contains(wanted)), limit).withColumn("tier", F.lit(1))
    both = own.unionByName(mentioned)
    return both.withColumn("best", F.min("tier").over(Window.partitionBy())).where(F.col("tier") == F.col("best")).drop("tier", "best")


def pack_documents(documents: DataFrame, pack: str, module: str | None = None, limit: int | None = 20) -> DataFrame:
    """Documents of a pack, or with the pack name in their path, by source priority."""
    wanted = pack.strip().lower()
    found = documents.where((F.lower("pack") == wanted) | F.lower("path").contains(wanted))
    if module:
        found = found.where(F.lower("module") == module.strip().lower())
    return _by_priority(found, limit)


def summary_files(ranked_docs: DataFrame, doc_files: DataFrame, limit: int = 80) -> DataFrame:
    """Distinct files of the ranked documents in order."""
    rows = doc_files.join(F.broadcast(ranked_docs.select("doc_id", "rank")), "doc_id")
    unique = distinct_ci(rows, "path", [F.col("rank"), F.col("pos"), F.col("path")])
    return ranked_top(unique, [F.asc("rank"), F.asc("pos"), F.asc("path")], limit, rank="place")


def summary_facts(ranked_docs: DataFrame, limit: int = 40) -> DataFrame:
    rows = ranked_docs.select("rank", "doc_id", F.posexplode("facts").alias("pos", "fact"))
    unique = distinct_ci(rows, "fact", [F.col("rank"), F.col("pos")])
    return ranked_top(unique, [F.asc("rank"), F.asc("pos")], limit, rank="place")


def summary_texts(ranked_docs: DataFrame, limit: int = 5) -> DataFrame:
    """First useful lines of the narrative documents."""
    rows = ranked_docs.where(F.col("source_type").isin(*C.SUMMARY_SOURCE_TYPES)).select(
        "rank", "doc_id", first_useful_lines(F.col("text")).alias("summary")
    )
    return rows.where(F.col("summary") != "").orderBy("rank").limit(limit)


# --------------------------------------------------------------------------
# Checks on an answer
# --------------------------------------------------------------------------


def restrict_to_paths(df: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """Rows any of whose path columns is in ``paths`` (a ranked list, one ``path_norm`` column); equal rows all stay."""
    small = F.broadcast(paths.select("path_norm").where(F.col("path_norm").isNotNull()).distinct())
    rows, flags = df, []
    for i, column in enumerate(columns):
        flag = f"_hit{i}"
        end = small.select(F.col("path_norm").alias(f"_end{i}"), F.lit(True).alias(flag))
        rows = rows.join(end, normalized_path(F.col(column)) == F.col(f"_end{i}"), "left")
        flags.append(F.coalesce(F.col(flag), F.lit(False)))
    return rows.where(any_of(flags)).select(*df.columns)


def uncovered_packs(packs: DataFrame, doc_paths: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Packs of an answer none of whose files was retrieved."""
    found = doc_paths.join(F.broadcast(retrieved.select("path_norm").distinct()), normalized_path(F.col("path")) == F.col("path_norm"), "left_semi")
    return packs.join(found.select("pack").distinct(), "pack", "left_anti")


def dependency_gaps(chain: DataFrame, retrieved: DataFrame, limit: int = 10) -> DataFrame:
    """Targets of the dependency chain that were not retrieved, first by name."""
    targets = chain.select(normalized_path(F.col("target_file")).alias("target")).where(F.col("target") != "").distinct()
    small = F.broadcast(retrieved.select("path_norm").distinct())
    return targets.join(small, F.col("target") == F.col("path_norm"), "left_anti").orderBy("target").limit(limit)


def verified_topics(topics: DataFrame, hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Topics with ``file_match`` overruled where their method or file is unknown.

    ``topics``: topic_id, primary_file, entry_method, file_match.  ``hits``: path, label.
    """
    known = hits.select(normalized_path(F.col("path")).alias("_p"), F.lower(F.trim("label")).alias("_m")).distinct()
    files = known.select("_p").distinct().withColumn("has_symbols", F.lit(True))
    offered = candidates.select(normalized_path(F.col("path")).alias("_p")).distinct().withColumn("is_candidate", F.lit(True))
    keyed = topics.withColumn("_p", normalized_path(F.col("primary_file"))).withColumn("_m", F.lower(F.trim("entry_method")))
    joined = (
        keyed.join(known.withColumn("has_method", F.lit(True)), ["_p", "_m"], "left")
        .join(files, "_p", "left").join(offered, "_p", "left")
    )
    open_topic = F.coalesce("file_match", F.lit(True)) & (F.col("_p") != "") & ~F.coalesce("_m", F.lit("")).isin("", "unknown", "—")
    wrong = open_topic & (
        (F.col("has_symbols").isNull() & F.col("is_candidate").isNull())
        | (F.col("has_symbols").isNotNull() & F.col("has_method").isNull())
    )
    return joined.select(
        "topic_id", "primary_file", "entry_method",
        F.when(wrong, F.lit(False)).otherwise(F.col("file_match")).alias("file_match"), wrong.alias("overruled"),
    )


def selected_blocks(blocks: DataFrame, chosen: DataFrame, fallback: int = 3) -> DataFrame:
    """Blocks whose id was chosen, else the first ``fallback`` (a short list)."""
    marked = blocks.join(F.broadcast(chosen.select("block_id").distinct().withColumn("chosen", F.lit(True))), "block_id", "left")
    any_chosen = F.max("chosen").over(Window.partitionBy())
    kept = marked.withColumn("_any", any_chosen).where(F.col("chosen") | (F.col("_any").isNull() & (F.col("pos") <= fallback)))
    return kept.drop("chosen", "_any")


def within_budget(sections: DataFrame, size: Column, budget: int, max_rows: int = 8) -> DataFrame:
    """Leading rows whose sizes fit a budget; the first overflow ends the list."""
    short = sections.where(F.col("pos") <= max_rows)
    order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return short.withColumn("used", F.sum(size).over(order)).where(F.col("used") <= budget)


def fingerprint(paths: DataFrame) -> DataFrame:
    """MD5 over the sorted paths of an answer (a short list)."""
    return paths.agg(F.md5(F.array_join(F.array_sort(F.collect_list("path")), "\n")).alias("fingerprint"))


def parsed_analysis(raw: Column, required: tuple[str, ...]) -> Column:
    """Struct (is_valid, missing): code fences stripped, JSON object parsed, missing required fields listed."""
    body = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    fields = F.json_object_keys(body)
    return F.struct(
        fields.isNotNull().alias("is_valid"),
        F.when(fields.isNotNull(), F.array_except(F.array(*[F.lit(r) for r in required]), fields)).alias("missing"),
    )


def upper_median(df: DataFrame, key: str, value: str, buckets: int = 1000) -> DataFrame:
    """Upper median (element n // 2 of the ascending list) of every key, without gathering a key.

    Values are counted per bucket between the key's extremes; only the bucket that
    holds the middle is looked into, and there by distinct value.
    """
    rows = df.select(key, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = rows.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)).otherwise(F.lit(0))
    cells = rows.join(span, key).select(key, "v", F.floor(F.col("n") / 2).alias("target"), bucket.cast("bigint").alias("b"))
    sizes = cells.groupBy(key, "target", "b").agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(key).orderBy("b")
    placed = sizes.withColumn("end", F.sum("c").over(running)).where((F.col("end") > F.col("target")) & (F.col("end") - F.col("c") <= F.col("target")))
    chosen = placed.select(key, "b", (F.col("target") - (F.col("end") - F.col("c"))).alias("offset"))
    values = cells.join(chosen, [key, "b"]).groupBy(key, "v", "offset").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("v"))
    return values.withColumn("end", upto).where(F.col("end") > F.col("offset")).groupBy(key).agg(F.min("v").alias("median"))


#: The parts of an answer that a reader acts on; the rest explains how it was found.
ACTIONABLE_PARTS = (
    "files", "primary_owner", "symbols", "locations", "code_blocks", "dependencies", "related", "modules", "packs", "facts", "confidence",
)
ACTIONABLE_SYMBOLS = 80


def actionable_parts(answer: object, symbols: int = ACTIONABLE_SYMBOLS) -> dict[str, DataFrame]:
    """The actionable parts of an answer, one DataFrame each; symbols are cut to the leading ones and ``symbol_count`` tells how many
    there were."""
    parts = {name: getattr(answer, name) for name in ACTIONABLE_PARTS if getattr(answer, name, None) is not None}
    if "symbols" in parts:
        every = parts["symbols"]
        order = [F.col(c).desc() if c == "score" else F.col(c).asc_nulls_first() for c in ("score", "path", "line", "label") if c in every.columns]
        parts["symbols"] = every.orderBy(*order).limit(symbols)
        parts["symbol_count"] = every.agg(F.count(F.lit(1)).alias("symbols"))
    return parts


def write_statistics(parts: dict[str, DataFrame], folder: str) -> None:
    """Every statistic of a usage summary as JSON lines in a folder of its own, nulls written out; a rerun replaces them."""
    for name, rows in parts.items():
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
