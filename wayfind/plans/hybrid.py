"""Hybrid search: keyword candidates, vector candidates, fusion, pins and the final evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import classify as cl
from wayfind.functions import vectors as vec
from wayfind.functions.paths import base_name, normalized_path
from wayfind.operators import fusion as fu
from wayfind.operators import graph as g
from wayfind.operators import summaries as sm
from wayfind.operators import symbols as sy
from wayfind.plans import search as kw
from wayfind.session import cut_lineage
from wayfind.sources.config import Settings
from wayfind.sources.index import SearchIndex
from wayfind.sources.profile import Profile


@dataclass
class HybridAnswer:
    """A keyword answer, the fused file order, and the evidence restricted to it."""

    keyword: kw.Answer
    mode: str
    files: DataFrame
    vectors: DataFrame
    suppressed: DataFrame
    symbols: DataFrame
    locations: DataFrame
    code_blocks: DataFrame
    dependencies: DataFrame
    related: DataFrame
    primary_owner: DataFrame
    confidence: DataFrame


def keyword_candidates(answer: kw.Answer, profile: Profile, limit: int) -> DataFrame:
    """Ranked files as fusion candidates (rank from 1)."""
    return answer.files.where(F.col("rank") < limit).select(
        (F.col("rank") + 1).alias("rank"), "path", base_name(F.col("path")).alias("title"), F.array_join("source", " ").alias("source"),
        F.lit("").alias("source_type"), "score", profile.module_of(F.col("path")).alias("module"), F.lit(None).cast("string").alias("pack"),
        F.array("path").alias("files"),
    )


def query_vector(index: SearchIndex, text: str, settings: Settings) -> list[float]:
    """Embedding of the query text, made by the expressions that made the index (one row)."""
    one = index.spark.createDataFrame([(0, text)], "q int, text string")
    return vec.hash_embeddings(one, "q", "text", settings.dimensions).first()["vector"]


def vector_candidates(index: SearchIndex, text: str, settings: Settings) -> DataFrame:
    """Nearest chunks as fusion candidates: the query is a constant, the scan is narrow.

    The gates look at the whole text of a chunk and at all files of its document.
    """
    weights = query_vector(index, text, settings)
    usable = index.chunks.where(F.col("vector").isNotNull()).select("chunk_id", "doc_id", "vector")
    top = fu.vector_search(usable, vec.dot_with(F.col("vector"), weights), settings.top_k_vector, settings.min_vector_score, "chunk_id")
    small = F.broadcast(top.select("chunk_id", "doc_id", "score", "rank"))
    texts = index.chunks.join(small.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("snippet"))
    docs = index.documents.select("doc_id", "path", "title", "source", "source_type", "module", "pack")
    files = index.doc_files.join(small.select("doc_id").distinct(), "doc_id", "left_semi")
    lists = files.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    joined = docs.join(small, "doc_id").join(texts, "chunk_id").join(lists, "doc_id", "left")
    return joined.withColumn("files", F.coalesce("files", cl.lit_array([])))


def hybrid_search(
    index: SearchIndex, text: str, settings: Settings | None = None, profile: Profile | None = None, rules: list[dict] | None = None,
    mode: str = "hybrid", max_files: int | None = None, pack_files: list[str] | None = None,
) -> HybridAnswer:
    """Search in one of the modes keyword, semantic or hybrid."""
    settings, profile = settings or Settings(), profile or Profile()
    limit = max(max_files or settings.max_files, settings.top_k_keyword)
    answer = kw.keyword_search(index, text, settings, profile, max(settings.max_results, limit), limit)
    plan = answer.plan
    rules, noise, low = rules or [], profile.noise_files(), profile.low_signal_terms()
    keyword = cut_lineage(keyword_candidates(answer, profile, limit))
    empty = index.spark.createDataFrame([], "chunk_id string, path string, score double, rank int, guard_reason string")
    vectors, suppressed = empty, empty
    if mode == "keyword":
        fused = fu.apply_rules(keyword, rules, plan.tokens, plan.query_profile)
        fused = fused.select("rank", "path", "score", F.lit("keyword").alias("retrieval"))
    else:
        vectors = cut_lineage(vector_candidates(index, text, settings))
        fused, suppressed = _fused(keyword, vectors, answer, settings, rules, noise, low, mode)
    fused = _with_pack_files(fused, pack_files or profile.pack_files_for_intents(list(plan.tokens)))
    if settings.final_order_by_score:
        fused = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "rank")))
    files = fu.pins_first(fused, plan.pins).withColumn("path_norm", normalized_path(F.col("path")))
    files = cut_lineage(files.withColumn("rank", F.col("rank") - 1))
    return _evidence(index, answer, files, vectors, suppressed, settings, profile, mode, max_files or settings.max_files)


def _fused(keyword, vectors, answer, settings, rules, noise, low, mode):
    plan = answer.plan
    size = max(settings.top_k_keyword, settings.top_k_vector)
    lock = fu.as_struct(fu.keyword_lock(keyword, plan.query_profile))
    have_keyword, have_vectors = not keyword.isEmpty(), not vectors.isEmpty()
    columns = ["rank", "path", "score", "retrieval"]
    if not have_keyword:
        only = fu.code_first(vectors.withColumn("retrieval", F.lit("vector")), plan.query_profile, size)
        return only.select(*columns), vectors.where(F.lit(False)).select("chunk_id", "path", "score", "rank", F.lit("").alias("guard_reason"))
    if mode == "semantic":
        if not have_vectors:
            same = fu.code_first(keyword.withColumn("retrieval", F.lit("keyword")), plan.query_profile, size)
            return same.select(*columns), vectors.select("chunk_id", "path", "score", "rank", F.lit("").alias("guard_reason"))
        held = cut_lineage(vectors.withColumn("ok", fu.matches_lock(lock)))
        any_ok = held.agg(F.coalesce(F.max("ok"), F.lit(False)).alias("a")).scalar()
        effective = held.where(F.col("ok") | ~any_ok).withColumn("rank", F.row_number().over(Window.orderBy("rank")))
        scope = fu.candidate_scope(effective)
        gate = fu.keyword_gate(scope, lock, plan.tokens, plan.query_profile, plan.identifiers, settings.allow_endings)
        allowed = keyword.withColumn("guard_reason", gate).where(fu.is_allowed(F.col("guard_reason")))
        score = fu.semantic_score("near", scope, lock, plan.tokens, plan.query_profile, plan.identifiers, rules, noise, low)
        rated = allowed.withColumn("near", fu.vector_list(effective)).withColumn("fusion_score", score)
        placed = cut_lineage(rated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("fusion_score"), "rank"))).drop("near"))
        tail = vectors.withColumn("retrieval", F.lit("vector")).select("rank", "path", "score", "retrieval", "source_type", "source")
        none_allowed = placed.isEmpty()
        chosen = tail if none_allowed else placed.withColumn("retrieval", F.lit("semantic+keyword")).select("rank", "path", "score", "retrieval", "source_type", "source")
        dropped = held.where(~F.col("ok") & any_ok).select("chunk_id", "path", "score", "rank", F.lit("dominant-module-lock").alias("guard_reason"))
        return fu.code_first(chosen, plan.query_profile, size).select(*columns), dropped
    reason = fu.vector_gate(fu.candidate_scope(keyword), lock, plan.query_profile, plan.identifiers, settings.require_scope_match)
    gated = cut_lineage(vectors.withColumn("guard_reason", reason))
    allowed = gated.where(fu.is_allowed(F.col("guard_reason"))).withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    suppressed = gated.where(~fu.is_allowed(F.col("guard_reason"))).select("chunk_id", "path", "score", "rank", "guard_reason")
    fused = fu.fuse(
        keyword, allowed, plan.tokens, plan.query_profile, plan.identifiers, rules, noise, low,
        settings.keyword_weight, settings.vector_weight, settings.protected_keywords, size,
    )
    guarded = fu.code_first(fused, plan.query_profile, size)
    if rules and have_vectors and allowed.isEmpty():
        # every vector was suppressed: let the rules move the protected candidates too
        guarded = fu.apply_rules(guarded, rules, plan.tokens, plan.query_profile)
    return guarded.select(*columns), suppressed


def _with_pack_files(fused: DataFrame, pack_files: list[str]) -> DataFrame:
    """Adds files a profile injects, at the upper median score of the fused list, after it."""
    if not pack_files:
        return fused
    spark = fused.sparkSession
    extra = spark.createDataFrame([(i, p) for i, p in enumerate(pack_files)], "at int, path string")
    missing = extra.withColumn("_k", normalized_path(F.col("path"))).join(
        fused.select(normalized_path(F.col("path")).alias("_k")), "_k", "left_anti"
    )
    scores = F.sort_array(F.collect_list(F.when(F.col("score") != 0, F.col("score"))))
    median = fused.agg(F.coalesce(F.get(scores, F.floor(F.size(scores) / 2).cast("int")), F.lit(1.0)).alias("m")).scalar()
    size = fused.agg(F.max("rank").alias("m")).scalar()
    added = missing.select((size + F.row_number().over(Window.orderBy("at"))).alias("rank"), "path", median.alias("score"), F.lit("pack").alias("retrieval"))
    return fused.unionByName(added)


def _evidence(index, answer, files, vectors, suppressed, settings, profile, mode, max_files) -> HybridAnswer:
    """Evidence of the keyword answer restricted to the fused files, completed where they lack any."""
    plan = answer.plan
    paths = files.select("path_norm")
    kept = sm.restrict_to_paths(answer.symbols, files, ["path"])
    top = files.where(F.col("rank") < settings.symbol_injection_window)
    unseen = top.select("path_norm", "path").join(kept.select(normalized_path(F.col("path")).alias("path_norm")), "path_norm", "left_anti")
    injected = index.doc_symbols.join(F.broadcast(unseen.select("path_norm")), normalized_path(F.col("source_file")) == F.col("path_norm"), "left_semi")
    injected = injected.where(~cl.is_low_value_symbol(F.col("label"), F.col("kind")))
    first = injected.groupBy(F.lower("label").alias("_l"), F.lower("source_file").alias("_p")).agg(
        F.min_by(F.struct("label", "kind", F.col("source_file").alias("path"), "line"), F.struct("doc_id", "pos")).alias("s")
    ).select("s.*").withColumn("score", F.lit(0.0))
    # the short list of an answer: hits of the keyword pass first, then injected ones
    pool = kept.select("label", "kind", "path", F.col("graph_line").cast("int").alias("line"), "score").unionByName(first)
    pool = cut_lineage(pool.orderBy(F.desc("score"), "path", F.asc_nulls_first("line"), "label").limit(80))
    if pool.isEmpty():
        pool = answer.symbols.select("label", "kind", "path", F.col("graph_line").cast("int").alias("line"), "score")
    symbols, blocks = kw.enriched_symbols(pool, files, index.source_lines, plan, settings, profile, plan.affirmed)
    owner = cut_lineage(_owner(symbols, plan, profile))
    locations = kw.locations_of(symbols)
    edges = sm.restrict_to_paths(answer.dependencies, files, ["source_file", "target_file"])
    related = answer.related.join(F.broadcast(paths), normalized_path(F.col("path")) == F.col("path_norm"), "left_semi")
    base = answer.confidence.select("confidence").scalar()
    listed = files.where(F.col("rank") < max_files).withColumn("source", F.array("retrieval"))
    confidence = kw.confidence_of(base, plan, owner, blocks, symbols, locations, edges, listed)
    return HybridAnswer(
        keyword=answer, mode=mode, files=files, vectors=vectors, suppressed=suppressed, symbols=symbols, locations=locations,
        code_blocks=blocks, dependencies=edges, related=related, primary_owner=owner, confidence=confidence,
    )


def _owner(symbols: DataFrame, plan, profile: Profile) -> DataFrame:
    """Owner after the bounded second pass; negated identifiers neither score nor lend their words."""
    score = profile.adjust_primary_owner_score(sy.owner_score(plan, F.col("file_rank"), plan.affirmed), plan, normalized_path(F.col("path")))
    rated = symbols.withColumn("owner_score", score)
    second = sy.rerank_score(plan, plan.owner_words, plan.strict_affirmed)
    return sy.rescored_winner(rated, "owner_score", second, [F.asc_nulls_first("line"), F.asc("slot")])


def gap_search(index: SearchIndex, issues: list[str], known: DataFrame, settings: Settings, profile: Profile, limit: int = 3) -> DataFrame:
    """Files that searches for unmatched issues find beyond the known ones (at most ``limit`` issues)."""
    from wayfind.plans.query import clean_query

    found = None
    for issue in issues[:limit]:
        text = _gap_text(issue, profile)
        if not text:
            continue
        answer = hybrid_search(index, clean_query(text), settings, profile, mode="hybrid", max_files=6)
        rows = answer.files.where(F.col("rank") < 6).select("path", "path_norm", F.lit(text).alias("query"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return index.spark.createDataFrame([], "path string, path_norm string, query string")
    fresh = found.join(known.select("path_norm"), "path_norm", "left_anti")
    return fresh.groupBy("path_norm").agg(F.first("path").alias("path"), F.first("query").alias("query"))


def _gap_text(issue: str, profile: Profile) -> str:
    import re

    from wayfind.constants import GAP_QUERY_STOP_WORDS

    lowered = issue.lower()
    for triggers, query in profile.gap_queries():
        if any(t in lowered for t in triggers):
            return query
    words = [w for w in re.findall(r"[a-zA-Z]+", lowered) if w not in GAP_QUERY_STOP_WORDS and len(w) > 2]
    return " ".join(words[:6])
