"""Document scoring: an inverted table of field terms, and the ordered multipliers.

``doc_terms`` holds one row (term, doc_id, field, tf).  A query reads only the
rows of its own terms, so the scan is pruned by the parquet filter on ``term``
(the table is written sorted by term); the text of a document is looked at only
for phrase and identifier containment, in one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import text as tx
from wayfind.functions.classify import lit_array, lookup, overlaps
from wayfind.functions.paths import any_of, contains_any
from wayfind.plans.query import QueryPlan
from wayfind.sources.profile import Profile

TERM_FIELDS = ("title", "path", "module", "pack", "source_type", "text", "files", "facts")


def field_texts(documents: DataFrame, doc_files: DataFrame | None = None) -> DataFrame:
    """Long form (doc_id, field, content) of all searchable fields.

    Files stay one row per file; nothing is concatenated, so a document with a
    very long file list never becomes one huge string.
    """
    types = dict(documents.dtypes)
    present = [f for f in TERM_FIELDS if f in types]
    content = {f: F.array_join(f, " ") if types[f].startswith("array") else F.col(f) for f in present}
    long_form = documents.select(
        "doc_id",
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), content[f].alias("content")) for f in present])
        ).alias("f"),
    ).select("doc_id", "f.field", "f.content")
    if doc_files is not None:
        long_form = long_form.unionByName(
            doc_files.select("doc_id", F.lit("files").alias("field"), F.col("path").alias("content"))
        )
    return long_form


def build_doc_terms(documents: DataFrame, doc_files: DataFrame | None = None) -> DataFrame:
    """Inverted table (term, doc_id, field, tf); counts are combined map-side."""
    raw = field_texts(documents, doc_files).select(
        "doc_id", "field", tx.explode_costly(tx.raw_search_tokens(F.col("content"))).alias("token")
    )
    kept = raw.where(tx.is_search_token(F.col("token")))
    terms = kept.select("doc_id", "field", tx.explode_costly(tx.token_forms(F.col("token"))).alias("term"))
    return terms.groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("tf"))


def term_scores(doc_terms: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id, gain): field weight x capped tf, once per occurrence of the token in the query; one row per hit."""
    counts = plan.token_counts()
    hits = doc_terms.where(F.col("term").isin(*counts))
    weight = lookup(C.FIELD_WEIGHTS, F.col("field"), 0.0)
    times = lookup({t: float(n) for t, n in counts.items()}, F.col("term"), 0.0)
    return hits.select("doc_id", (weight * F.least(F.col("tf"), F.lit(C.TF_CAP)) * times).alias("gain"))


def containment(documents: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id, gain, named<i>, told<i>): phrase bonus, and which identifiers the fields and the text contain.

    A narrow pass over the documents; only rows with something to say leave it, without their text.
    """

    def lowered(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name), F.lit("")))

    haystack = {name: lowered(name) for name in ("title", "path", "module", "pack", "text")}
    haystack["facts"] = F.lower(F.array_join("facts", " ")) if "facts" in documents.columns else F.lit("")
    haystack["files"] = F.lit("")
    gain = F.lit(0.0)
    if len(plan.phrase) >= 4:
        for name in C.PHRASE_FIELDS:
            gain = gain + F.when(haystack[name].contains(plan.phrase), F.lit(C.PHRASE_BONUS)).otherwise(F.lit(0.0))
    flags: list[Column] = []
    for i, identifier in enumerate(plan.identifiers):
        word = identifier.lower()
        flags.append(any_of([haystack[name].contains(word) for name in ("path", "title")]).cast("int").alias(f"named{i}"))
        flags.append(haystack["text"].contains(word).cast("int").alias(f"told{i}"))
    rows = documents.select("doc_id", gain.alias("gain"), *flags)
    return rows.where(any_of([F.col(c) > 0 for c in rows.columns[1:]]))


@dataclass(frozen=True)
class Asked:
    """What a query asks for, as Columns: literals of one plan, or the columns of a table of planned questions."""

    tokens: Column
    modules: Column
    intents: Column

    @classmethod
    def of(cls, plan: QueryPlan) -> Asked:
        return cls(*(lit_array(sorted(x)) for x in (plan.token_set, plan.modules, plan.intents)))

    @classmethod
    def columns(cls) -> Asked:
        return cls(F.col("tokens"), F.col("modules"), F.col("intents"))

    def wants(self, intent: str) -> Column:
        return F.array_contains(self.intents, intent)


def score_multipliers(plan: QueryPlan | Asked) -> list[tuple[str, Column, float]]:
    """(reason, condition, factor) in the order in which they apply; for one plan the optimizer folds what its query settles."""
    asked = plan if isinstance(plan, Asked) else Asked.of(plan)
    kind = F.col("source_type")
    owner = kind.isin(*C.OWNER_GRAPH_SOURCE_TYPES)
    broad = kind.isin("index.md", "scope-summary.md")
    secondary = F.lower(F.col("source_level")) == "secondary"
    module = F.lower(F.coalesce(F.col("module"), F.lit("")))
    path = F.lower(F.col("path"))
    context = F.lower(F.concat_ws(" ", "path", F.coalesce(F.col("pack"), F.lit("")), "title"))
    inside = F.array_contains(asked.modules, module)
    outside = (F.size(asked.modules) > 0) & ~inside & (module != "")
    ownership, trace, flow, cross = (asked.wants(x) for x in ("ownership", "implementation_trace", "business_flow", "cross_module"))
    return [
        ("narrative source", kind.isin(*C.NARRATIVE_SOURCE_TYPES), 1.12),
        ("graph owner source", owner, 0.95),
        ("graph chunk", kind == "graph chunk", 1.08),
        ("module intent", inside, 1.45),
        ("outside module intent", outside & ~cross, 0.82),
        ("secondary ownership", ownership & secondary, 1.45),
        ("ownership source", ownership & (owner | kind.isin("graph chunk", "GRAPH_REPORT.md", "source-files.txt")), 1.18),
        ("broad source for ownership", ownership & broad, 0.72),
        ("source-owner document", trace & (owner | kind.isin("source-files.txt", "graph chunk")), 1.5),
        ("secondary trace", trace & secondary, 1.35),
        ("broad doc for trace", trace & (broad | (kind == ".md")), 0.68),
        ("generic behavior for trace", trace & (kind == "behavior pack") & ~contains_any(path, C.TRACE_BEHAVIOR_MARKERS), 0.78),
        ("behavior for flow", flow & (kind == "behavior pack"), 1.35),
        ("secondary for flow", flow & secondary, 0.88),
        ("runtime verification", asked.wants("runtime_debug") & path.contains("runtime-verification"), 1.5),
        ("code-level source", asked.wants("code_level") & (owner | kind.isin("graph chunk", "source-files.txt", "GRAPH_REPORT.md")), 1.35),
        ("broad source for code level", asked.wants("code_level") & broad, 0.58),
        ("cross-module source", cross & contains_any(context, C.CROSS_MODULE_MARKERS), 1.55),
    ]


def own_factors(asked: Asked) -> list[Column]:
    """What every multiplier does to a score, in order."""
    return [F.when(condition, F.lit(factor)).otherwise(F.lit(1.0)) for _, condition, factor in score_multipliers(asked)]


def final_multipliers(asked: Asked) -> list[tuple[Column, float]]:
    """(condition, factor) behind the profile's own adjustment, in order."""
    area = F.lower(F.concat_ws(" ", F.coalesce(F.col("area"), F.lit("")), "path", "title"))
    layers = [overlaps(asked.tokens, words) & area.contains(layer) for layer, words in C.LAYER_MARKERS]
    return [(any_of(layers), 1.12), (F.col("source_type").isin(*C.BROAD_SOURCE_TYPES), 0.78), (F.col("source_type") == "behavior pack", 1.15)]


def final_factors(asked: Asked) -> list[Column]:
    """What the last multipliers do to a score, in order."""
    return [F.when(condition, F.lit(factor)).otherwise(F.lit(1.0)) for condition, factor in final_multipliers(asked)]


def apply_multipliers(score: Column, plan: QueryPlan | Asked, profile: Profile | None = None) -> Column:
    """Score after every multiplier, profile hook and final source adjustment, in order."""
    profile = profile or Profile()
    asked = plan if isinstance(plan, Asked) else Asked.of(plan)
    for factor in own_factors(asked):
        score = score * factor
    score = profile.adjust_document_score(score, plan, F.col("path"), F.col("pack"), F.col("title"))
    for factor in final_factors(asked):
        score = score * factor
    return score


def score_reasons(plan: QueryPlan) -> Column:
    """Which multipliers applied, as an array of reasons (first six, as in a result row)."""
    fired = [F.when(condition, F.lit(reason)) for reason, condition, _ in score_multipliers(plan)]
    return F.slice(F.array_compact(F.array(*fired)), 1, 6)


def file_mentions(doc_files: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id, named<i>): identifiers found in a listed file."""
    flags = [F.lower("path").contains(w.lower()).cast("int").alias(f"named{i}") for i, w in enumerate(plan.identifiers)]
    rows = doc_files.select("doc_id", *flags)
    return rows.where(any_of([F.col(c) > 0 for c in rows.columns[1:]]))


def score_documents(
    documents: DataFrame,
    doc_terms: DataFrame,
    plan: QueryPlan,
    profile: Profile | None = None,
    doc_files: DataFrame | None = None,
) -> DataFrame:
    """Documents with ``score`` > 0, without ``text`` and ``facts`` (join those for the rows that are shown).

    Term hits, containment and file mentions are narrow rows that meet in one aggregate on doc_id; the documents that
    match are then joined without their texts.
    """
    parts = [term_scores(doc_terms, plan)]
    if plan.identifiers or len(plan.phrase) >= 4:
        parts.append(containment(documents, plan))
    if doc_files is not None and plan.identifiers:
        parts.append(file_mentions(doc_files, plan))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    count = range(len(plan.identifiers))
    flags = [F.max(f"{name}{i}").alias(f"{name}{i}") for name in ("named", "told") for i in count]
    met = rows.groupBy("doc_id").agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("_additive"), *flags)
    additive = F.col("_additive")
    for i in count:
        named, told = F.coalesce(F.col(f"named{i}"), F.lit(0)) > 0, F.coalesce(F.col(f"told{i}"), F.lit(0)) > 0
        additive = additive + F.when(named, F.lit(C.IDENTIFIER_FIELD_BONUS)).when(told, F.lit(C.IDENTIFIER_TEXT_BONUS)).otherwise(F.lit(0.0))
    met = met.select("doc_id", additive.alias("_additive")).where(F.col("_additive") > 0)
    scored = documents.drop("text", "facts").join(met, "doc_id")
    return scored.withColumn("score", apply_multipliers(F.col("_additive"), plan, profile)).drop("_additive").where(F.col("score") > 0)
