"""Keyword search: one query against the index, as a set of DataFrames.

The matching documents are cut to the file candidates (some hundred rows) early.
These short lists, and the ranked files, hint documents, symbols and edges after
them, are checkpointed in the shared folder: every later part joins to them, so
without the cut each part would carry the plans of all parts before it.
Everything after the first cut is small whatever the index holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import classify as cl
from wayfind.functions.paths import is_code_file, normalized_path
from wayfind.functions.text import best_snippets
from wayfind.operators import files as fl
from wayfind.operators import graph as g
from wayfind.operators import symbols as sy
from wayfind.operators.scoring import score_documents, score_reasons
from wayfind.operators.skew import first_per_key, ranked_top
from wayfind.plans.query import QueryPlan, clean_query, plan_query
from wayfind.session import cut_lineage
from wayfind.sources.config import Settings
from wayfind.sources.index import SearchIndex
from wayfind.sources.profile import Profile


@dataclass
class Answer:
    """Parts of an answer.  ``files`` has rank from 0; all lists are short."""

    plan: QueryPlan
    results: DataFrame
    files: DataFrame
    symbols: DataFrame
    locations: DataFrame
    code_blocks: DataFrame
    dependencies: DataFrame
    related: DataFrame
    primary_owner: DataFrame
    modules: DataFrame
    packs: DataFrame
    facts: DataFrame
    confidence: DataFrame


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def match_signal(plan: QueryPlan, owner: DataFrame, files: DataFrame) -> Column:
    """Share of informative query words found in the owner and the first files (scalar)."""
    words = plan.informative
    if not words:
        return F.lit(0.0)
    owner_text = owner.select(F.concat_ws(" ", "label", "path").alias("t"))
    file_text = files.where(F.col("rank") < 5).select(F.concat_ws(" ", "path", F.array_join("source", " ")).alias("t"))
    found = owner_text.unionByName(file_text).agg(
        *[F.max(F.lower("t").contains(w).cast("int")).alias(f"w{i}") for i, w in enumerate(words)]
    )
    total = sum((F.coalesce(F.col(f"w{i}"), F.lit(0)) for i in range(len(words))), F.lit(0))
    hits = found.select(total.alias("hits")).scalar()
    return cl.saturating(hits, max(1, min(len(words), 4)))


def confidence_of(
    base: Column, plan: QueryPlan, owner: DataFrame, blocks: DataFrame, symbols: DataFrame, locations: DataFrame, edges: DataFrame, files: DataFrame
) -> DataFrame:
    """One row with the confidence of an answer."""

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    one = files.sparkSession.range(1).select(
        base.alias("base"), (size(owner) > 0).alias("owner"), size(blocks).alias("blocks"), size(symbols).alias("symbols"),
        size(locations).alias("locations"), size(edges).alias("edges"), match_signal(plan, owner, files).alias("match"),
    )
    c = F.col
    return one.select(
        cl.result_confidence(c("base"), c("owner"), c("blocks"), c("symbols"), c("locations"), c("edges"), c("match")).alias("confidence")
    )


def hint_documents(index: SearchIndex, candidates: DataFrame, scored: DataFrame, ranked: DataFrame, settings: Settings) -> DataFrame:
    """Documents whose symbols and edges are used: those that mention a ranked file, the first
    candidates, and the broadest chunk of the five best files.  (doc_id, score, module, pack)."""
    paths = F.broadcast(ranked.select("path_norm"))
    mentions = (
        index.doc_files.select("doc_id", F.col("path").alias("p"))
        .unionByName(index.documents.where(F.col("source_file").isNotNull()).select("doc_id", F.col("source_file").alias("p")))
        .unionByName(index.doc_symbols.select("doc_id", F.col("source_file").alias("p")))
        .unionByName(index.doc_edges.select("doc_id", F.explode(F.array("source_file", "target_file")).alias("p")))
    )
    mentioning = mentions.join(paths, normalized_path(F.col("p")) == F.col("path_norm"), "left_semi").select("doc_id").distinct()
    count = max(settings.file_candidate_documents, settings.max_results)
    columns = ["doc_id", "score", "module", "pack", "source_type", "source"]
    exact = scored.select(*columns).join(mentioning, "doc_id", "left_semi")
    if settings.limits.hint_documents is not None:
        exact = exact.orderBy(*_order()).limit(max(count, settings.limits.hint_documents))
    first = candidates.where(F.col("rank") <= count).select(*columns)
    deps = index.doc_edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dependency_count"))
    top_paths = F.broadcast(ranked.where(F.col("rank") < 5).select("path_norm"))
    chunks = index.documents.where(F.col("kind") == "graph_chunk").join(
        top_paths, normalized_path(F.col("source_file")) == F.col("path_norm"), "left_semi"
    ).join(deps, "doc_id", "left").select(
        "source_file", "doc_id", "edge_count", F.coalesce("dependency_count", F.lit(0)).alias("dependency_count"), F.xxhash64("doc_id").alias("pos")
    )
    broad = g.broadest_chunk(chunks).select("doc_id")
    broad_docs = index.documents.join(broad, "doc_id", "left_semi").select(
        "doc_id", F.lit(0.0).alias("score"), "module", "pack", "source_type", "source"
    )
    every = exact.unionByName(first).unionByName(broad_docs)
    return first_per_key(every, ["doc_id"], [-F.col("score")], ["score", "module", "pack", "source_type", "source"])


def fallback_symbols(symbols: DataFrame, ranked: DataFrame, source_lines: DataFrame, limit: int = 24) -> DataFrame:
    """Adds one live-source symbol for ranked files without symbols or without their anchor."""
    path = normalized_path(F.col("path"))
    have = symbols.groupBy(path.alias("path_norm")).agg(
        F.collect_set("kind").alias("kinds"), F.collect_set(F.lower(F.replace("label", F.lit("()"), F.lit("")))).alias("labels")
    )
    files = ranked.where(is_code_file(F.col("path_norm"))).join(have, "path_norm", "left").withColumn(
        "kinds", F.coalesce("kinds", cl.lit_array([]))
    ).withColumn("labels", F.coalesce("labels", cl.lit_array([])))
    no_component = F.col("path_norm").endswith(".tsx") & ~F.array_contains("kinds", "ui_component")
    anchored = F.arrays_overlap("labels", cl.anchor_labels(F.col("path")))
    no_class = F.lit(False)
    for folder, kind in (
        ("/controllers/", "controller_class"), ("/services/", "service_class"), ("/jobs/", "job_class"),
        ("/entities/", "entity_type"), ("/dtos/", "dto_type"),
    ):
        no_class = no_class | (F.col("path_norm").contains(folder) & (~F.array_contains("kinds", kind) | ~anchored))
    no_class = F.col("path_norm").endswith(".cs") & no_class
    wanting = files.where((F.size("kinds") == 0) | no_component | no_class).select(
        "path_norm", F.col("score").alias("file_score"), no_component.alias("want_component"), no_class.alias("want_class")
    )
    lines = source_lines.join(F.broadcast(wanting.select("path_norm")), normalized_path(F.col("path")) == F.col("path_norm"), "left_semi")
    found = sy.source_symbols(lines).withColumn("path_norm", normalized_path(F.col("path")))
    usable = found.join(F.broadcast(wanting), "path_norm").where(
        (~F.col("want_component") | (F.col("kind") == "ui_component")) & (~F.col("want_class") | F.col("kind").isin(*sy.C.ANCHOR_KINDS))
    )
    known = symbols.select(F.lower("label").alias("_l"), path.alias("path_norm"), F.col("line").cast("bigint").alias("line_no"))
    fresh = usable.withColumn("_l", F.lower("label")).join(known, ["_l", "path_norm", "line_no"], "left_anti")
    first = first_per_key(fresh, ["path_norm"], [F.col("rn")], ["label", "kind", "path", "line_no", "file_score"])
    added = first.select("label", "kind", "path", F.col("line_no").cast("int").alias("line"), F.col("file_score").alias("score"))
    both = symbols.select("label", "kind", "path", "line", "score").unionByName(added)
    priority = cl.lookup(sy.C.SYMBOL_KIND_PRIORITY, F.col("kind"), sy.C.SYMBOL_KIND_PRIORITY_DEFAULT)
    return both.orderBy(priority, F.desc("score"), "path", "line", "label").limit(limit)


def enriched_symbols(
    hits: DataFrame, ranked: DataFrame, source_lines: DataFrame, plan: QueryPlan, settings: Settings, profile: Profile,
    identifiers: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(symbols, code blocks): hits scored as owners, verified, and blocks within the budget."""
    spots = F.broadcast(hits.select(normalized_path(F.col("path")).alias("path_norm")).distinct())
    lines = source_lines.join(spots, normalized_path(F.col("path")) == F.col("path_norm"), "left_semi")
    scored = g.with_file_ranks(hits, "path", ranked, "file_rank").withColumn("line_status", F.lit(None).cast("string"))
    order = [F.desc("owner_score"), F.asc_nulls_first("line"), F.asc("path"), F.asc("label")]
    owner = profile.adjust_primary_owner_score(sy.owner_score(plan, F.col("file_rank"), identifiers), plan, normalized_path(F.col("path")))
    placed = scored.withColumn("owner_score", owner)
    placed = cut_lineage(placed.withColumn("place", F.row_number().over(Window.orderBy(*order))))
    first = ranked.where(F.col("rank") == 0).select("path_norm").scalar()
    slots = sy.reserve_top_file(placed, first, "place").drop("line_status")
    checked = cut_lineage(sy.verify_symbols(slots, lines, ["slot"], settings.line_window))
    blocks = sy.code_blocks(checked.where(F.col("line").isNotNull()), lines, ["slot"], settings.block_before, settings.block_after)
    joined = checked.join(blocks.withColumn("has_block", F.lit(True)), "slot", "left")
    budget = cut_lineage(sy.within_block_budget(joined, F.coalesce("has_block", F.lit(False)), "slot", settings.max_blocks))
    symbols = budget.select("slot", "label", "kind", "path", "line", "graph_line", "line_status", "line_delta", "score", "file_rank", "gets_block")
    from wayfind.functions.paths import code_block_id

    shown = budget.where("gets_block").select(
        "slot", code_block_id(F.col("path"), F.col("label"), F.col("line")).alias("block_id"), "path", F.col("label").alias("symbol"), "kind", "line",
        "line_status", "line_start", "line_end", "text",
    )
    return symbols, shown


def locations_of(symbols: DataFrame, limit: int = 12) -> DataFrame:
    """Distinct (path, line) of the symbols in order."""
    keyed = symbols.withColumn("_p", F.lower("path"))
    first = first_per_key(keyed, ["_p", "line"], [F.col("slot")], ["slot", "path", "label", "kind", "line_status", "line_delta"])
    return first.drop("_p").orderBy("slot").limit(limit)


def keyword_search(
    index: SearchIndex, text: str, settings: Settings | None = None, profile: Profile | None = None,
    max_results: int | None = None, max_files: int | None = None,
) -> Answer:
    """Ranked documents, files, symbols, edges, blocks and confidence for one query."""
    settings, profile = settings or Settings(), profile or Profile()
    plan = plan_query(clean_query(text), profile)
    if not plan.tokens:
        raise ValueError("Query had no searchable terms.")
    max_results, max_files = max_results or settings.max_results, max_files or settings.max_files
    scored = score_documents(index.documents, index.doc_terms, plan, profile, index.doc_files)
    scored = cut_lineage(scored)  # scored once; the candidates and the hints read it
    results = cut_lineage(fl.candidate_documents(scored, _order()))
    companions = g.owner_companions(index.doc_related, index.doc_edges.join(results.select("doc_id"), "doc_id", "left_semi"))
    ranked = fl.ranked_files(
        results, index.doc_files, plan, profile, companions, max_files, settings.max_files_per_document
    )
    evidence = fl.pack_evidence(fl.per_pack_peaks(results, index.doc_files.join(results.select("doc_id"), "doc_id", "left_semi")))
    files = cut_lineage(fl.rebalance(cut_lineage(ranked), evidence).withColumn("path_norm", normalized_path(F.col("path"))))

    hints = cut_lineage(hint_documents(index, results, scored, files, settings))
    paths = F.broadcast(files.select("path_norm"))
    symbols = index.doc_symbols.join(paths, normalized_path(F.col("source_file")) == F.col("path_norm"), "left_semi")
    symbols = symbols.join(hints, "doc_id").withColumnRenamed("source_file", "path").select(
        "label", "kind", "path", "line", "score", (-F.col("score")).alias("seq"), F.col("doc_id").alias("owner_doc"), "pos"
    )
    hits = sy.symbol_hits(symbols, plan, ["seq", "owner_doc", "pos"], per_path=8, identifiers=plan.identifiers,
                          strict=tuple(i for i in plan.identifiers if i in _strict(plan)))
    hits = cut_lineage(fallback_symbols(cut_lineage(hits), files, index.source_lines))
    symbol_rows, blocks = enriched_symbols(hits, files, index.source_lines, plan, settings, profile)
    edges = index.doc_edges.join(hints.select("doc_id", "score", (-F.col("score")).alias("seq")), "doc_id").withColumnRenamed("doc_id", "owner_doc")
    chain = cut_lineage(g.dependency_chain(edges, files, plan, ["seq", "owner_doc", "pos"]))
    related = g.pad_with_ranked(g.related_files(related_mentions(index, hints), files, plan), files.select("path", "rank"))
    owner = cut_lineage(primary_owner(symbol_rows, plan, profile))
    locations = locations_of(symbol_rows)
    top_score = results.agg(F.max("score").alias("m")).scalar()
    base = cl.raw_score_confidence(F.coalesce(top_score, F.lit(0.0)), settings.confidence_scale)
    routing = results.where(F.col("rank") <= max_results).unionByName(results.where(F.col("rank") <= 80))
    leading = results.where(F.col("rank") <= max_results)
    texts = index.documents.select("doc_id", "text", "facts").join(F.broadcast(leading.select("doc_id")), "doc_id", "left_semi")
    leading = leading.join(texts, "doc_id")
    shown = leading.select(
        "rank", "doc_id", "title", "kind", "module", "pack", "path", "source", "source_type", F.round("score", 2).alias("score"), "facts",
        best_snippets(F.col("facts"), F.col("text"), list(plan.tokens)).alias("snippets"), score_reasons(plan).alias("reasons"),
    )
    facts = leading.select(
        "rank", F.posexplode(F.slice("facts", 1, 4)).alias("pos", "fact"), "source", "source_type"
    ).orderBy("rank", "pos").limit(20)
    confidence = confidence_of(base, plan, owner, blocks, symbol_rows, locations, chain, files)
    return Answer(
        plan=plan, results=shown, files=files, symbols=symbol_rows, locations=locations, code_blocks=blocks, dependencies=chain,
        related=related, primary_owner=owner, modules=fl.named_rollup(routing, "module", 8), packs=fl.named_rollup(routing, "pack", 12),
        facts=facts, confidence=confidence,
    )


def _strict(plan: QueryPlan) -> list[str]:
    return list(plan.strict)


def primary_owner(symbols: DataFrame, plan: QueryPlan, profile: Profile, identifiers: tuple[str, ...] | None = None) -> DataFrame:
    """Best symbol as owner of the answer (one row)."""
    score = profile.adjust_primary_owner_score(sy.owner_score(plan, F.col("file_rank"), identifiers), plan, normalized_path(F.col("path")))
    best = symbols.withColumn("owner_score", score)
    return best.orderBy(F.desc("owner_score"), F.asc_nulls_first("line"), "slot").limit(1)


def related_mentions(index: SearchIndex, hints: DataFrame) -> DataFrame:
    """All paths the hint documents mention, by role, in the order in which they are considered."""
    docs = index.documents.select("doc_id", F.col("path").alias("result_path"), "source_file").join(hints.select("doc_id"), "doc_id", "left_semi")
    columns = ["result_path", "path", "anchor", "role", "pos"]

    def role(df: DataFrame, name: str, tier: int, anchor: Column | None = None) -> DataFrame:
        return df.withColumn("anchor", anchor if anchor is not None else F.col("result_path")).withColumn("role", F.lit(name)).withColumn(
            "pos", F.lit(tier * 1_000_000_000).cast("bigint") + F.col("pos")
        ).select(*columns)

    listed = role(docs.join(index.doc_related, "doc_id"), "related", 0)
    files = role(docs.join(index.doc_files, "doc_id"), "files", 1)
    own = role(docs.where(F.coalesce("source_file", F.lit("")) != "").select("result_path", F.col("source_file").alias("path"), F.lit(0).alias("pos")), "source_file", 2)
    edges = docs.drop("source_file").join(index.doc_edges, "doc_id")
    source = role(edges.withColumn("path", F.col("source_file")).withColumn("pos", F.col("pos") * 2), "edge_source", 3, F.col("target_file"))
    target = role(edges.withColumn("path", F.col("target_file")).withColumn("pos", F.col("pos") * 2 + 1), "edge_target", 3, F.col("source_file"))
    return listed.unionByName(files).unionByName(own).unionByName(source).unionByName(target)
