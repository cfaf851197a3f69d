"""From ranked documents to ranked files: contributions, pack evidence, companions, rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import classify as cl
from wayfind.functions.identifiers import named_file_strength
from wayfind.functions.paths import (
    base_name,
    contains_any,
    file_stem,
    is_code_file,
    is_rankable_owner,
    is_relationship_text,
    normalized_path,
    owner_path_score,
    position_divisor,
    slashed,
)
from wayfind.functions.text import search_tokens
from wayfind.operators.dedup import suffix_dedup_short
from wayfind.operators.graph import distinctive_hits
from wayfind.plans.query import QueryPlan
from wayfind.session import cut_lineage
from wayfind.sources.profile import Profile


def candidate_documents(scored: DataFrame, order: list[Column], leading: int = 500, max_documents: int | None = None) -> DataFrame:
    """All matching documents, with ``rank`` from 1 for the ``leading`` ones (the rest have none).

    Only the leading rows are ordered (take-ordered, then a window over them), so the
    matches are never sorted as a whole.  ``max_documents`` keeps that many instead.
    """
    first = scored.orderBy(*order).limit(max_documents or leading).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if max_documents is not None:
        return first
    # at most ``leading`` ids and ranks
    return scored.join(F.broadcast(first.select("doc_id", "rank")), "doc_id", "left")


def top_specific_packs(results: DataFrame, limit: int = 4, window: int = 80) -> DataFrame:
    """Packs (lower case) that lead among the first owner-type results; at most ``limit`` rows."""
    evidence = results.where(
        (F.col("rank") <= window)
        & F.lower("source_type").isin(*C.PACK_EVIDENCE_SOURCE_TYPES)
        & (F.coalesce("pack", F.lit("")) != "")
        & (F.lower("pack") != C.SECONDARY_PACK)
    )
    sums = evidence.groupBy(F.lower("pack").alias("top_pack")).agg(F.sum("score").alias("pack_score"))
    return sums.orderBy(F.desc("pack_score"), F.asc("top_pack")).limit(limit)


def secondary_file_limit(source_type: Column) -> Column:
    kind = F.lower(source_type)
    return F.when(kind == "graph chunk", 2).when(kind.isin(*C.OWNER_GRAPH_SOURCE_TYPES), 8).otherwise(5)


def with_top_packs(results: DataFrame, packs: DataFrame) -> DataFrame:
    """Adds ``in_top_pack`` and ``any_top_pack``; ``packs`` holds at most four rows."""
    small = F.broadcast(packs.select("top_pack", F.lit(True).alias("_hit")))
    flagged = results.join(small, F.lower("pack") == F.col("top_pack"), "left")
    any_pack = packs.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    return flagged.select(
        *results.columns, F.coalesce("_hit", F.lit(False)).alias("in_top_pack"), any_pack.alias("any_top_pack")
    )


def _token_hits(path: Column, plan: QueryPlan) -> Column:
    """Occurrences of query tokens in a path, a repeated token counting again."""
    total = F.lit(0)
    for token, times in plan.token_counts().items():
        total = total + F.when(path.contains(token), F.lit(times)).otherwise(F.lit(0))
    return total


def file_contribution(plan: QueryPlan, profile: Profile | None = None) -> Column:
    """Score one document gives one of its files; multiply and add steps in order.

    Row columns: score, pos, path, source_type, source_level, pack, in_top_pack, any_top_pack.
    A path contains every token that tokenising it would give, so containment alone decides hits.
    """
    profile = profile or Profile()
    path, intents = F.lower(slashed(F.col("path"))), plan.intents
    kind, secondary = F.lower("source_type"), F.lower("source_level") == "secondary"
    words = plan.distinctive
    hits, own = _token_hits(path, plan), distinctive_hits(path, words)

    def step(value: Column, condition: Column, factor: Column | float, plus: Column | float = 0.0) -> Column:
        # `value` must occur once only: steps nest, and a second use would double the expression each time
        times = factor if isinstance(factor, Column) else F.lit(float(factor))
        scaled = value * F.when(condition, times).otherwise(F.lit(1.0))
        if isinstance(plus, float) and plus == 0.0:
            return scaled
        more = plus if isinstance(plus, Column) else F.lit(float(plus))
        return scaled + F.when(condition, more).otherwise(F.lit(0.0))

    s = F.col("score") / position_divisor(F.col("pos"))
    s = step(s, hits > 0, 1.0 + F.least(hits, F.lit(8)) * 0.22, hits * 35.0)
    s = step(s, own > 0, 1.0 + F.least(own, F.lit(5)) * 0.55, own * 90.0)
    if plan.named_files:
        strength = named_file_strength(base_name(slashed(F.col("path"))), cl.lit_array(list(plan.tokens)), tuple(plan.generic))
        s = step(s, base_name(path).isin(*plan.named_files), 1.0 + strength * 2.0, strength * 1500.0)
    patterns = profile.extra_owner_file_patterns()
    if "ownership" in intents:
        s = step(s, contains_any(path, C.OWNERSHIP_LAYER_MARKERS) | contains_any(path, patterns), 1.18)
        s = step(s, F.col("source_type") == "graph chunk", 1.55)
    code = is_code_file(path)
    if "implementation_trace" in intents:
        stem_tokens = search_tokens(file_stem(slashed(F.col("path"))))
        classes = F.size(F.array_intersect(stem_tokens, cl.lit_array(list(words))))
        s = step(s, code, 1.35, 120.0)
        s = step(s, contains_any(path, C.OWNER_PATH_MARKERS), 1.75, 220.0)
        s = step(s, contains_any(path, C.OWNER_FILE_PATTERNS + tuple(patterns)), 1.45, 120.0)
        s = step(s, kind.isin("source-files.txt", "graph chunk", *C.OWNER_GRAPH_SOURCE_TYPES), 1.35)
        s = step(s, secondary, 1.45)
        s = step(s, own > 0, 1.0 + F.least(own, F.lit(5)) * 0.75, own * 140.0)
        s = step(s, classes > 0, 1.0 + F.least(classes, F.lit(6)) * 0.9, classes * 220.0)
        for spoken, ending, factor, plus in (
            (("controller",), "controller.cs", 1.6, 180.0),
            (("service",), "service.cs", 1.45, 140.0),
            (("job", "scheduler"), "job.cs", 1.8, 220.0),
        ):
            if plan.token_set & set(spoken):
                s = step(s, path.endswith(ending), factor, plus)
        s = profile.adjust_owner_score(s, plan, path)
        s = profile.adjust_scoped_score(s, path, F.col("scoped_modules"), F.col("scoped_packs")) if _scopes(profile) else s
        s = step(s, is_relationship_text(F.col("path")), 0.22)
        s = step(s, contains_any(path, C.BROAD_FILE_PATTERNS), 0.18)
        s = step(s, ~code, 0.45)
    else:
        if "ownership" in intents:
            s = step(s, is_relationship_text(F.col("path")), 0.42)
            s = step(s, ~path.rlike(C.KNOWN_FILE_PATTERN), 0.65)
        s = profile.adjust_owner_score(s, plan, path)
    listed = F.col("in_top_pack")
    s = step(s, listed & (kind == "source-files.txt"), 3.2, 900.0)
    s = step(s, listed & kind.isin(*C.OWNER_GRAPH_SOURCE_TYPES) & ~secondary, 2.2, 450.0)
    s = step(s, listed & (kind == "behavior pack"), 1.35)
    outside = ~listed & F.col("any_top_pack") & (F.lower("pack") == C.SECONDARY_PACK) & secondary
    return step(s, outside, 0.45)


#: Results whose modules and packs a profile may score files by.
SCOPE_RESULTS = 25


def _scopes(profile: Profile) -> bool:
    return type(profile).adjust_scoped_score is not Profile.adjust_scoped_score


def file_contributions(
    results: DataFrame, doc_files: DataFrame, plan: QueryPlan, profile: Profile | None = None,
    packs: DataFrame | None = None, max_files_per_document: int = 0,
) -> DataFrame:
    """(path, contribution, source) for every (document, file) of the ranked results."""
    listed = packs if packs is not None else top_specific_packs(results)
    rows = with_top_packs(results.drop("path"), listed).join(doc_files.select("doc_id", "pos", "path"), "doc_id")
    if _scopes(profile or Profile()):
        # the modules and packs of the leading results, two short lists
        leading = results.where(F.col("rank") <= SCOPE_RESULTS)
        for name in ("module", "pack"):
            scope = leading.agg(F.collect_set(F.lower(F.when(F.col(name) != "", F.col(name)))).alias("s")).scalar()
            rows = rows.withColumn(f"scoped_{name}s", scope)
    secondary = (F.col("pack") == C.SECONDARY_PACK) & (F.lower("source_level") == "secondary")
    rows = rows.where(~secondary | (F.col("pos") < secondary_file_limit(F.col("source_type"))))
    if max_files_per_document:
        # optional cap: the files of a document that match most query tokens survive
        order = [F.desc("_match"), F.asc("pos"), F.asc("path")]
        rows = rows.withColumn("_match", _token_hits(F.lower("path"), plan))
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
        rows = rows.withColumn("_nth", nth).where(F.col("_nth") <= max_files_per_document)
        rows = rows.withColumn("pos", F.col("_nth") - 1).drop("_nth", "_match")
    rows = rows.where((F.coalesce("path", F.lit("")) != "") & ~is_relationship_text(F.col("path")))
    return rows.select("path", file_contribution(plan, profile).alias("contribution"), "source")


def sum_by_file(contributions: DataFrame, sources: int = 5) -> DataFrame:
    """(path, score, source): summed score and the first distinct sources.

    Sources are reduced to distinct pairs and ranked per path before they are
    gathered, so the gathered list never exceeds ``sources`` entries.
    """
    from wayfind.operators.skew import top_per_key

    totals = contributions.groupBy("path").agg(F.sum("contribution").alias("score"))
    named = top_per_key(contributions.select("path", "source").distinct(), ["path"], [F.asc("source")], sources, rank="_n")
    lists = named.groupBy("path").agg(F.array_sort(F.collect_list("source")).alias("source"))
    return totals.join(lists, "path")


def pinned_contributions(spark, plan: QueryPlan) -> DataFrame:
    """One row per gated pin: ordered bands one million apart, a nudge for matching words."""
    words = cl.lit_array(plan.distinctive or tuple(sorted(plan.token_set)))
    bands = [(path, 100_000_000.0 - index * 1_000_000.0) for index, path in enumerate(plan.pins)]
    spelled = F.array_distinct(search_tokens(F.translate("path", "\\/", "  ")))
    nudge = F.least(F.size(F.array_intersect(words, spelled)), F.lit(9)) * 50_000.0
    rows = spark.createDataFrame(bands, "path string, band double")
    return rows.select("path", (F.col("band") + nudge).alias("contribution"), F.lit("deterministic-owner-routing-confidence").alias("source"))


#: Leading results whose companions get a bonus.
COMPANION_RESULTS = 120


def companion_contributions(
    scores: DataFrame, results: DataFrame, doc_files: DataFrame, companions: DataFrame, plan: QueryPlan,
    packs: DataFrame, anchors: int = 6, window: int = COMPANION_RESULTS,
) -> DataFrame:
    """Bonus rows for files connected to the best owner files (one hop)."""
    owners = scores.where(is_rankable_owner(F.col("path"))).orderBy(F.desc("score"), F.asc("path")).limit(anchors)
    anchor = F.broadcast(owners.select(normalized_path(F.col("path")).alias("anchor")))
    considered = with_top_packs(results.where(F.col("rank") <= window), packs)
    lists_anchor = (
        doc_files.join(anchor, normalized_path(F.col("path")) == F.col("anchor")).select("doc_id").distinct()
        .withColumn("lists_anchor", F.lit(True))
    )
    source_file = F.col("source_file") if "source_file" in results.columns else F.lit(None).cast("string")
    marked = (
        considered.withColumn("_own", normalized_path(source_file))
        .join(anchor.select(F.col("anchor").alias("_own"), F.lit(True).alias("own_anchor")), "_own", "left")
        .join(lists_anchor, "doc_id", "left")
    )
    own_anchor = F.coalesce("own_anchor", F.lit(False))
    scope_modules = F.broadcast(
        results.where((F.col("rank") <= 25) & (F.coalesce("module", F.lit("")) != ""))
        .select(F.lower("module").alias("_module")).distinct().withColumn("in_scope", F.lit(True))
    )
    marked = (
        marked.where(own_anchor | F.coalesce("lists_anchor", F.lit(False)) | F.col("in_top_pack"))
        .select("doc_id", F.lower("module").alias("_module"), "in_top_pack", own_anchor.alias("own_anchor"))
        .join(scope_modules, "_module", "left")
    )
    rows = marked.join(companions.select("doc_id", "path"), "doc_id")
    path = normalized_path(F.col("path"))
    rows = rows.join(anchor.select(F.col("anchor").alias("_a")), path == F.col("_a"), "left_anti")
    rows = rows.where(is_rankable_owner(F.col("path")))
    bonus = (
        F.lit(180.0)
        + F.when(F.col("in_top_pack"), F.lit(160.0)).otherwise(F.lit(0.0))
        + F.when(F.col("in_scope"), F.lit(110.0)).otherwise(F.lit(0.0))
        + F.when(distinctive_hits(path, plan.distinctive) > 0, F.lit(120.0)).otherwise(F.lit(0.0))
        + owner_path_score(F.col("path")) * 1.2
        + F.when(F.col("own_anchor"), F.lit(140.0)).otherwise(F.lit(0.0))
    )
    return rows.select("path", bonus.alias("contribution"), F.lit("owner-group-completeness").alias("source"))


def _leading_distinct(files: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The leading files without those that a better one spells out or shortens.

    Whether a file stays depends only on better ones, so a leading part of the list decides its own files; the part
    grows until it holds ``count`` of them or is the whole list.
    """
    size = 8 * count
    while True:
        head = cut_lineage(files.orderBy(*order).limit(size))
        unique = suffix_dedup_short(head, "path", [-F.col("score"), F.col("path")])
        if unique.count() >= count or head.count() < size:
            return unique
        size *= 4


def ranked_files(
    results: DataFrame, doc_files: DataFrame, plan: QueryPlan, profile: Profile | None = None,
    companions: DataFrame | None = None, max_files: int = 25, max_files_per_document: int = 0,
) -> DataFrame:
    """Best files of the ranked documents: (path, score, source, rank from 0)."""
    packs = top_specific_packs(results)
    parts = file_contributions(results, doc_files, plan, profile, packs, max_files_per_document)
    if plan.pins:
        parts = parts.unionByName(pinned_contributions(results.sparkSession, plan))
    if companions is not None:
        totals = parts.groupBy("path").agg(F.sum("contribution").alias("score"))
        parts = parts.unionByName(companion_contributions(totals, results, doc_files, companions, plan, packs))
    order = [F.desc("score"), F.asc("path")]
    top = _leading_distinct(sum_by_file(parts), order, max_files).orderBy(*order).limit(max_files)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


# --------------------------------------------------------------------------
# Pack evidence and rebalancing of the best files
# --------------------------------------------------------------------------


def pack_key(pack: Column, source_type: Column) -> Column:
    """Pack of a document; documents without one count per source type."""
    clean = F.lower(F.trim(F.coalesce(pack, F.lit(""))))
    return F.when(clean != "", clean).otherwise(F.concat(F.lit("__nopack__:"), source_type))


def per_pack_peaks(results: DataFrame, doc_files: DataFrame) -> DataFrame:
    """(path, pack_key, peak): strongest document of every pack that lists a file."""
    rows = results.select("doc_id", "score", pack_key(F.col("pack"), F.col("source_type")).alias("pack_key"))
    joined = doc_files.select("doc_id", normalized_path(F.col("path")).alias("path")).distinct().join(rows, "doc_id")
    return joined.groupBy("path", "pack_key").agg(F.max("score").alias("peak")).where(F.col("peak") > 0)


def pack_evidence(peaks: DataFrame) -> DataFrame:
    """(path, evidence): peaks in descending order, each further pack counting for less.

    All peaks count with the floor weight (a plain sum); only the few that weigh more
    are ranked, so a file listed by very many packs is pruned before the shuffle.
    """
    from wayfind.operators.skew import top_per_key

    base = peaks.groupBy("path").agg(F.sum(F.col("peak") * C.PACK_PEAK_WEIGHT_FLOOR).alias("base"))
    first = top_per_key(peaks, ["path"], [F.desc("peak"), F.asc("pack_key")], len(C.PACK_PEAK_WEIGHTS), rank="nth")
    extra = cl.lookup({i: w - C.PACK_PEAK_WEIGHT_FLOOR for i, w in enumerate(C.PACK_PEAK_WEIGHTS, start=1)}, F.col("nth"), 0.0)
    more = first.groupBy("path").agg(F.sum(F.col("peak") * extra).alias("more"))
    return base.join(more, "path").select("path", (F.col("base") + F.col("more")).alias("evidence"))


def rebalance(ranked: DataFrame, evidence: DataFrame, window: int = C.RESCORE_WINDOW, margin: float = C.RESCORE_MARGIN) -> DataFrame:
    """Re-sorts the first ``window`` files by pack evidence if that clearly disagrees with the top file."""
    key = normalized_path(F.col("path"))
    joined = ranked.withColumn("_k", key).join(
        evidence.select(F.col("path").alias("_k"), "evidence"), "_k", "left"
    ).withColumn("evidence", F.coalesce("evidence", F.col("score"))).drop("_k")
    everything = Window.partitionBy()  # a ranked list, at most max_files rows
    inside = F.col("rank") < window
    best = F.max(F.when(inside, F.col("evidence"))).over(everything)
    first = F.max(F.when(F.col("rank") == 0, F.col("evidence"))).over(everything)
    shaken = joined.withColumn("_swap", (best > 0) & ((best - first) / best >= margin))
    key_order = F.when(F.col("_swap") & inside, -F.col("evidence")).otherwise(F.lit(0.0))
    placed = shaken.withColumn(
        "rank",
        F.row_number().over(Window.orderBy(F.when(inside, 0).otherwise(1), key_order, F.col("rank"))) - 1,
    )
    return placed.drop("_swap")


def named_rollup(results: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Score per module or pack with document counts per source type; best ``limit``.

    Counted by (key, source type) first, so the second step sees a handful of rows per key.
    """
    cells = results.where(F.coalesce(key, F.lit("")) != "").groupBy(F.col(key).alias("name"), "source_type").agg(
        F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")
    )
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n"))))
    rolled = cells.groupBy("name").agg(F.sum("s").alias("score"), kinds.alias("source_types"))
    return rolled.orderBy(F.desc("score"), F.asc("name")).limit(limit)
