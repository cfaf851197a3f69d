"""Classification expressions: symbol kinds, buckets, intents, query profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.paths import any_of, file_stem, normalized_path, normalized_scope, slashed


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def overlaps(tokens: Column, vocabulary) -> Column:
    return F.arrays_overlap(tokens, lit_array(list(vocabulary))) if vocabulary else F.lit(False)


def starts_upper(label: Column) -> Column:
    first = F.substring(label, 1, 1)
    return (first != F.lower(first)) & (first == F.upper(first))


def bind(body: Callable[[Column], Column], **inputs: Column) -> Column:
    """Evaluates inputs once and hands them to a long expression.

    Conditions nest and are copied by filter push-down; without this every copy
    would repeat the expressions of its inputs.
    """
    row = F.struct(*[value.alias(name) for name, value in inputs.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))


# --------------------------------------------------------------------------
# Symbols
# --------------------------------------------------------------------------


def is_method_label(label: Column) -> Column:
    return label.startswith(".") & label.endswith("()")


def symbol_kind(label: Column, source_file: Column, declared: Column | None = None) -> Column:
    """Kind of a graph symbol from label shape, folder and extension.

    ``declared`` is the keyword of the declaration found in live source (or null);
    it settles type-versus-component questions for TypeScript labels.
    """
    keyword = declared if declared is not None else F.lit(None).cast("string")
    return bind(
        lambda b: _symbol_kind(b["name"], b["path"], b["keyword"]), name=F.trim(label), path=F.lower(source_file), keyword=keyword
    )


def _symbol_kind(name: Column, path: Column, keyword: Column) -> Column:
    is_type = keyword.isin("type", "interface", "enum")
    tsx = (
        F.when(name.endswith("Props") | is_type, F.lit("dto_type"))
        .when(keyword.isNotNull(), F.when(starts_upper(name), F.lit("ui_component")).otherwise(F.lit("ui_function")))
        .when(name.endswith("State"), F.lit("dto_type"))
        .when(starts_upper(name), F.lit("ui_component"))
        .otherwise(F.lit("ui_function"))
    )
    method = (
        F.when(path.contains("/controllers/"), F.lit("controller_action"))
        .when(path.contains("/services/"), F.lit("service_method"))
        .when(path.contains("/jobs/"), F.lit("job_method"))
        .when(path.contains("/src/") | path.rlike(r"\.(tsx|ts|js|jsx)$"), F.lit("ui_function"))
        .otherwise(F.lit("method"))
    )
    return (
        F.when((name == "") | (path == "") | name.isNull() | path.isNull(), F.lit(None).cast("string"))
        .when(name.rlike(r"\.(cs|tsx|ts)$"), F.lit("file"))
        .when(is_method_label(name), method)
        .when(name.endswith("Controller") & path.contains("/controllers/"), F.lit("controller_class"))
        .when(name.endswith("Service") & path.contains("/services/"), F.lit("service_class"))
        .when(name.endswith("Job") & path.contains("/jobs/"), F.lit("job_class"))
        .when(path.endswith(".tsx"), tsx)
        .when(path.endswith(".ts"), F.when(is_type, F.lit("dto_type")).otherwise(F.lit("ui_function")))
        .when(path.rlike(r"\.(js|jsx)$"), F.lit("ui_function"))
        .when(name.rlike("Dtos?$"), F.lit("dto_type"))
        .when(name.endswith("Entity") | path.contains("/entities/"), F.lit("entity_type"))
        .when(name.endswith("()"), F.lit("method"))
    )


def kind_from_source(path: Column, name: Column, line_text: Column) -> Column:
    """Kind of a symbol found in a live source line."""
    return bind(
        lambda b: _kind_from_source(b["path"], b["name"], b["line"]), path=F.lower(slashed(path)), name=name, line=line_text
    )


def _kind_from_source(p: Column, name: Column, line_text: Column) -> Column:
    is_class = line_text.contains("class ")

    def either(class_kind: str, other: str) -> Column:
        return F.when(is_class, F.lit(class_kind)).otherwise(F.lit(other))

    return (
        F.when(p.endswith(".tsx"), F.when(starts_upper(name), F.lit("ui_component")).otherwise(F.lit("ui_function")))
        .when(p.rlike(r"\.(ts|js)$"), F.lit("ui_function"))
        .when(
            p.endswith(".cs"),
            F.when(p.contains("/controllers/"), either("controller_class", "controller_action"))
            .when(p.contains("/services/"), either("service_class", "service_method"))
            .when(p.contains("/jobs/"), either("job_class", "job_method"))
            .when(p.contains("/entities/"), either("entity_type", "method"))
            .when(p.contains("/dtos/"), either("dto_type", "method"))
            .otherwise(F.lit("method")),
        )
        .otherwise(F.lit("file"))
    )


def symbol_name(label: Column, kind: Column) -> Column:
    """Bare name of a label: method wrapper removed where the kind has one."""
    name = F.trim(label)
    wrapped = kind.isin("controller_action", "service_method", "job_method", "method") & is_method_label(name)
    return (
        F.when(wrapped, F.substr(name, F.lit(2), F.length(name) - 3))
        .when((kind == "ui_function") & name.endswith("()"), F.substr(name, F.lit(1), F.length(name) - 2))
        .otherwise(name)
    )


def is_low_value_symbol(label: Column, kind: Column) -> Column:
    """Empty names, CONSTANT_CASE names, and UI labels that are not identifiers."""
    return bind(lambda b: bind(lambda c: _is_low_value(c["name"], c["kind"]), name=symbol_name(b["label"], b["kind"]), kind=b["kind"]),
                label=label, kind=kind)


def _is_low_value(name: Column, kind: Column) -> Column:
    not_identifier = kind.isin("ui_function", "ui_component") & ~name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return (name == "") | ((F.upper(name) == name) & name.contains("_")) | not_identifier


def bare_label(label: Column) -> Column:
    """Lower-cased label without leading dot and trailing call brackets."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"^\.", ""), r"\(\)$", ""))


def anchor_labels(path: Column) -> Column:
    """Names a file's own class would have: its stem, and the interface form for services."""
    stem = file_stem(slashed(path))
    lowered = F.lower(stem)
    service = F.lower(slashed(path)).contains("/services/") & ~stem.startswith("I")
    return F.when(service, F.array(lowered, F.concat(F.lit("i"), lowered))).otherwise(F.array(lowered))


def lookup(values: dict, key: Column, default) -> Column:
    """Constant map lookup with a default, without a join."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, key), F.lit(default))


# --------------------------------------------------------------------------
# Candidates
# --------------------------------------------------------------------------


def source_bucket(source_type: Column, path: Column, source: Column | None = None) -> Column:
    """``code``, ``doc`` or ``other`` from the source type, else from the extension."""
    kind = normalized_scope(source_type)
    where = path if source is None else F.coalesce(F.when(path != "", path), source)
    p = normalized_path(where)
    return (
        F.when(kind.isin(*C.CODE_SOURCE_TYPES), F.lit("code"))
        .when(kind.isin(*C.DOC_SOURCE_TYPES), F.lit("doc"))
        .when(p.rlike(C.CODE_FILE_PATTERN), F.lit("code"))
        .when(p.rlike(r"\.(md|json)$"), F.lit("doc"))
        .otherwise(F.lit("other"))
    )


def source_priority(source_type: Column) -> Column:
    return lookup(C.SOURCE_PRIORITY, source_type, C.SOURCE_PRIORITY_DEFAULT)


# --------------------------------------------------------------------------
# Queries (for logs of queries; one query is planned by ``plans.query``)
# --------------------------------------------------------------------------


def module_votes(tokens: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """Array of (module, votes): distinct tokens that are in the module's vocabulary."""
    return F.array(
        *[
            F.struct(F.lit(m).alias("module"), F.size(F.array_intersect(tokens, lit_array(words))).alias("votes"))
            for m, words in vocabulary.items()
        ]
    )


def module_intents(tokens: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    if not vocabulary:
        return F.array().cast("array<string>")
    voted = F.filter(module_votes(tokens, vocabulary), lambda v: v["votes"] > 0)
    return F.transform(voted, lambda v: v["module"])


def dominant_modules(tokens: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """Modules that lead the vote; an empty array switches the domain gate off."""
    if not vocabulary:
        return F.array().cast("array<string>")
    votes = module_votes(tokens, vocabulary)
    top = F.array_max(F.transform(votes, lambda v: v["votes"]))
    ratio = F.when(overlaps(tokens, C.RUNTIME_TOKENS), F.lit(0.75)).otherwise(F.lit(0.45))
    threshold = F.greatest(F.lit(2.0), top * ratio)
    leading = F.filter(votes, lambda v: v["votes"] >= threshold)
    return F.transform(leading, lambda v: v["module"])


def query_intents(tokens: Column, vocabulary: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Intents a token list signals; ``general`` if none."""
    crosses = overlaps(tokens, C.CROSS_MODULE_TOKENS)
    if vocabulary:
        crosses = crosses | (F.size(module_intents(tokens, vocabulary)) >= 2)
    named = (
        ("ownership", overlaps(tokens, C.OWNERSHIP_TOKENS)),
        ("business_flow", overlaps(tokens, C.BUSINESS_FLOW_TOKENS)),
        ("runtime_debug", overlaps(tokens, C.RUNTIME_TOKENS)),
        ("implementation_trace", overlaps(tokens, C.IMPLEMENTATION_TRACE_TOKENS)),
        ("code_level", overlaps(tokens, C.CODE_LEVEL_TOKENS)),
        ("cross_module", crosses),
    )
    found = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in named]))
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def query_profile(terms: Column, intents: Column) -> Column:
    """Four-way profile, rules in order."""
    technical = overlaps(intents, ("implementation_trace", "runtime_debug", "code_level", "ownership"))
    return (
        F.when(overlaps(terms, C.BRIDGE_TERMS), F.lit("cross_module_bridge"))
        .when(overlaps(terms, C.INFRA_RUNTIME_TERMS), F.lit("infra_runtime"))
        .when(F.array_contains(intents, "business_flow") & ~technical, F.lit("workflow_discovery"))
        .when(technical | overlaps(terms, C.CODE_DEBUG_QUERY_TERMS), F.lit("code_debug"))
        .when(overlaps(terms, C.WORKFLOW_DISCOVERY_TERMS), F.lit("workflow_discovery"))
        .otherwise(F.lit("code_debug"))
    )


def prefers_api(terms: Column, identifiers: Column) -> Column:
    """The query asks for an API surface by word or by identifier."""
    lowered = F.transform(identifiers, lambda w: F.lower(F.trim(w)))
    by_name = F.exists(
        lowered, lambda w: w.rlike("(controller|api|client)$") | w.isin(*C.EXPLICIT_API_QUERY_TERMS)
    )
    return overlaps(terms, C.EXPLICIT_API_QUERY_TERMS) | by_name


def is_informative(token: Column, generic: tuple[str, ...] = C.GENERIC_FILE_TOKENS) -> Column:
    """A token that says something about the answer."""
    t = F.lower(token)
    return (F.length(t) >= 3) & ~t.isin(*C.STOP_WORDS) & ~t.isin(*C.OWNER_EXCLUDED_TOKENS) & ~t.isin(*generic)


# --------------------------------------------------------------------------
# Confidence arithmetic
# --------------------------------------------------------------------------


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def raw_score_confidence(top_score: Column, scale: float = C.CONFIDENCE_SCALE) -> Column:
    return F.when(top_score <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.95), top_score / (top_score + F.lit(scale))))


def saturating(value: Column, target: float) -> Column:
    return clamp01(value.cast("double") / F.lit(float(target))) if target > 0 else F.lit(0.0)


def result_confidence(
    base: Column, has_owner: Column, blocks: Column, symbols: Column, locations: Column, edges: Column, match: Column
) -> Column:
    """Confidence of an answer from its evidence, with caps for weak matches; three digits."""
    evidence = (
        F.when(has_owner, F.lit(1.0)).otherwise(F.lit(0.0)) * 0.28
        + saturating(blocks, 4) * 0.24
        + saturating(symbols, 30) * 0.20
        + saturating(locations, 8) * 0.14
        + saturating(edges, 6) * 0.14
    )
    mixed = base * 0.20 + evidence * 0.55 + match * 0.25
    by_match = (
        F.when(match < 0.20, F.least(mixed, F.lit(0.35)))
        .when(match < 0.40, F.least(mixed, F.lit(0.55)))
        .otherwise(mixed)
    )
    capped = F.when(~has_owner | (blocks <= 0), F.least(by_match, F.lit(0.45))).otherwise(by_match)
    return F.round(F.least(F.lit(0.95), clamp01(capped)), 3)
