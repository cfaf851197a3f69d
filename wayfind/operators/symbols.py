"""Symbol operators: kinds, verification against live lines, code blocks, owner scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wayfind import constants as C
from wayfind.functions import classify as cl
from wayfind.functions import identifiers as ids
from wayfind.functions.paths import any_of, code_block_id, normalized_path, owner_path_score, slashed, source_line_number
from wayfind.functions.text import explode_costly, search_tokens
from wayfind.operators.graph import distinctive_hits
from wayfind.operators.skew import first_per_key, top_per_key
from wayfind.plans.query import QueryPlan
from wayfind.session import cut_lineage

_NAME = "([A-Za-z_][A-Za-z0-9_]*)"

# --------------------------------------------------------------------------
# Names found in live source lines: one pass over the lines, then equi joins
# --------------------------------------------------------------------------

#: shape of an occurrence -> pattern with the name in group 1; a call's name never gives characters back, which could not match
OCCURRENCE_PATTERNS = {
    "call": r"\b([A-Za-z_][A-Za-z0-9_]*+)\s*+[(<=]",
    "function": rf"\bfunction\s+{_NAME}\b",
    "const": rf"\bconst\s+{_NAME}\b",
    "class": rf"\bclass\s+{_NAME}\b",
    "interface": rf"\binterface\s+{_NAME}\b",
    "type": rf"\btype\s+{_NAME}\b",
}
#: sets of shapes that confirm a symbol, and the bits of their shapes; the last bit of a set marks what a pattern of its own has found
SHAPE_SETS = ((), ("class",), ("function", "const"), ("call", "function", "const"), ("interface", "type", "class", "const"))
_BITS = {shape: 1 << i for i, shape in enumerate(OCCURRENCE_PATTERNS)}
_OWN = [1 << (len(_BITS) + i) for i in range(len(SHAPE_SETS))]
_MASKS = [sum(_BITS[shape] for shape in shapes) + own for shapes, own in zip(SHAPE_SETS, _OWN, strict=True)]


def shape_set(kind: Column) -> Column:
    """Which set of occurrence shapes confirms a symbol of a kind; a file has none."""
    of_kind = {
        **dict.fromkeys(C.CLASS_KINDS, 1), "ui_component": 2, "file": 0,
        **dict.fromkeys(("controller_action", "service_method", "job_method", "ui_function", "method"), 3),
    }
    return cl.lookup(of_kind, kind, 4)


def name_occurrences(source_lines: DataFrame) -> DataFrame:
    """(path, name, shape, line_no): names a line calls or declares, ``shape`` as a bit; one row without a name for a line without any."""

    def of_shape(shape: str, pattern: str) -> Column:
        names = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        found = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(_BITS[shape]).alias("shape")))
        if shape == "call":
            return found
        # most lines hold no keyword: looking for it is much cheaper than the pattern
        return F.when(F.col("text").contains(shape), found).otherwise(F.array().cast("array<struct<name:string,shape:int>>"))

    found = F.concat(*[of_shape(shape, pattern) for shape, pattern in OCCURRENCE_PATTERNS.items()])
    return source_lines.select("path", "line_no", explode_costly(found).alias("o")).select("path", "o.name", "o.shape", "line_no")


def searched_name(label: Column) -> Column:
    """The bare name a label is looked up by."""
    name = F.trim(label)
    return F.trim(
        F.when(cl.is_method_label(name), F.substr(name, F.lit(2), F.length(name) - 3))
        .when(name.endswith("()"), F.substr(name, F.lit(1), F.length(name) - 2))
        .otherwise(name)
    )


def verify_symbols(symbols: DataFrame, source_lines: DataFrame, keys: list[str], window: int = 12) -> DataFrame:
    """Locates every symbol in its file and reports how the hinted line compares.

    ``symbols``: keys, path, label, kind, line.  Adds graph_line, line (verified),
    line_status and line_delta.  The first match inside the window wins, else the
    first match of the file.  Symbols and the names found in lines are dealt by file,
    once, and meet in windows over (file, name), so that a name used n times by n symbols
    makes no n x n rows; only labels that are not plain identifiers are matched by pattern.
    """
    named = symbols.withColumnRenamed("line", "graph_line").withColumns({
        "_name": searched_name(F.col("label")), "_set": shape_set(F.col("kind")), "_at": F.col("graph_line").cast("long"),
    }).withColumn("_symbol", F.lit(True))
    lines = source_lines.where(F.col("path").isNotNull())
    plain = F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    odd = named.select("path", F.col("_name").alias("name"), F.col("_set").alias("set")).where(~plain & (F.col("name") != "") & (F.col("set") > 0))
    quoted = F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E"))
    words = F.get(cl.lit_array(["|".join(shapes) for shapes in SHAPE_SETS]), F.col("set"))
    pattern = (
        F.when(F.col("set") == 3, F.concat(quoted, F.lit(r"\s*[(<=]|\b(function|const)\s+"), quoted, F.lit(r"\b")))
        .otherwise(F.concat(F.lit(r"\b("), words, F.lit(r")\s+"), quoted, F.lit(r"\b")))
    )
    # the lines travel for patterns only if there is a label that needs one
    any_odd = odd.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    by_pattern = odd.distinct().withColumn("pattern", pattern).join(lines.where(any_odd), "path").where(F.expr("text RLIKE pattern"))
    found = name_occurrences(lines).unionByName(
        by_pattern.select("path", "name", F.get(F.array(*[F.lit(x) for x in _OWN]), F.col("set")).alias("shape"), "line_no")
    )
    found = found.select("path", F.col("name").alias("_name"), F.col("shape").alias("_shape"), F.col("line_no").alias("_line"))
    met = named.unionByName(found.withColumn("_at", F.col("_line").cast("long")), allowMissingColumns=True)
    # sorted by a number first, because paths begin alike
    met = met.repartition("path").withColumn("_code", F.xxhash64("path")).sortWithinPartitions("_code", "path", "_name", "_at")
    by_name = Window.partitionBy("_code", "path", "_name").orderBy("_at")
    around, anywhere = by_name.rangeBetween(-max(1, window), max(1, window)), by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sets = range(1, len(SHAPE_SETS))
    hit = {i: F.when(F.col("_shape").bitwiseAND(_MASKS[i]) != 0, F.col("_line")) for i in sets}
    located = met.withColumns({
        **{f"_near{i}": F.min(hit[i]).over(around) for i in sets}, **{f"_any{i}": F.min(hit[i]).over(anywhere) for i in sets},
        "has_lines": F.count(F.when(F.col("_symbol").isNull(), 1)).over(Window.partitionBy("_code", "path")) > 0,
    }).where(F.col("_symbol"))
    near_line, any_line = (F.coalesce(*[F.when(F.col("_set") == i, F.col(f"{name}{i}")) for i in sets]) for name in ("_near", "_any"))
    joined = located.withColumns({
        "near_line": F.when(F.col("graph_line").isNotNull(), near_line), "any_line": any_line,
        "verifiable": (F.col("_name") != "") & (F.col("_set") > 0),
    })
    line = F.coalesce("near_line", "any_line")
    status = (
        F.when(~F.col("has_lines"), F.lit("file_missing"))
        .when(~F.col("verifiable"), F.lit("not_verifiable"))
        .when(line.isNull(), F.lit("not_found"))
        .when(F.col("graph_line").isNull(), F.lit("located"))
        .when(F.col("near_line") == F.col("graph_line"), F.lit("exact"))
        .otherwise(F.lit("adjusted"))
    )
    return joined.select(
        *["graph_line" if c == "line" else c for c in symbols.columns],
        F.coalesce(line, F.col("graph_line")).alias("line"),
        status.alias("line_status"),
        (line - F.col("graph_line")).alias("line_delta"),
    )


def declared_keywords(symbols: DataFrame, source_lines: DataFrame, keys: list[str], window: int = 12) -> DataFrame:
    """(keys, declared): keyword of the first line near the hint that declares the label."""
    pattern = r"^\s*(?:export\s+)?(?:default\s+)?(" + "|".join(C.DECLARATION_KEYWORDS) + rf")\s+{_NAME}\b"
    declared = source_lines.select(
        "path",
        "line_no",
        F.regexp_extract("text", pattern, 1).alias("keyword"),
        F.regexp_extract("text", pattern, 2).alias("label"),
    ).where(F.col("keyword") != "")
    near = F.abs(F.col("line_no") - F.col("line")) <= max(1, window)
    return (
        symbols.select(*keys, "path", F.trim("label").alias("label"), "line")
        .join(declared, ["path", "label"])
        .where(near)
        .groupBy(*keys)
        .agg(F.min_by("keyword", "line_no").alias("declared"))
    )


def code_blocks(hits: DataFrame, source_lines: DataFrame, keys: list[str], before: int = 4, after: int = 8) -> DataFrame:
    """Numbered source window around a line, the line itself marked.

    A window spans at most two blocks of ``before + after + 1`` lines, so lines are
    joined on (path, block) and never all lines of a file with all its symbols.
    """
    span = before + after + 1
    lo, hi = F.col("line") - before, F.col("line") + after
    wanted = hits.where(F.col("line") >= 1).select(
        *keys, "path", "line", F.explode(F.sequence(F.floor(lo / span), F.floor(hi / span))).alias("block")
    )
    lines = source_lines.withColumn("block", F.floor(F.col("line_no") / span))
    shown = wanted.join(lines, ["path", "block"]).where(F.col("line_no").between(lo, hi))
    marker = F.when(F.col("line_no") == F.col("line"), F.lit(">")).otherwise(F.lit(" "))
    row = F.struct(
        F.col("line_no"), F.concat(marker, F.col("line_no").cast("string"), F.lit(": "), F.col("text")).alias("t")
    )
    # at most `span` lines per key are gathered
    packed = shown.groupBy(*keys).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.max((F.col("line_no") == F.col("line"))).alias("hit")
    )
    return packed.where("hit").select(
        *keys,
        F.col("rows")[0]["line_no"].alias("line_start"),
        F.element_at("rows", -1)["line_no"].alias("line_end"),
        F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("text"),
    )


def source_symbols(source_lines: DataFrame, limit: int = 6) -> DataFrame:
    """Symbols declared in live lines, best ``limit`` per file by (priority, line)."""
    path = F.col("_p")
    lines = source_lines.select("path", "line_no", "text", F.lower(slashed(F.col("path"))).alias("_p"))
    script = path.rlike(r"\.(tsx|ts|js)$")

    def names(patterns: tuple[str, ...]) -> Column:
        found = [F.regexp_extract("text", p, 1) for p in patterns]
        return F.filter(F.array_distinct(F.array(*found)), lambda n: n != "")

    candidates = F.when(script, names(C.TS_DECLARATIONS)).when(path.endswith(".cs"), names(C.CS_DECLARATIONS))
    rows = lines.select("path", "_p", "line_no", "text", explode_costly(candidates).alias("name")).where(F.col("name").isNotNull())
    rows = rows.withColumn("kind", cl.kind_from_source(F.col("_p"), F.col("name"), F.col("text")))
    rows = rows.where(~cl.is_low_value_symbol(F.col("name"), F.col("kind")))
    bare = F.ltrim("text")
    tsx = path.endswith(".tsx")
    priority = (
        F.when(F.array_contains(cl.anchor_labels(F.col("path")), F.lower("name")), -1)
        .when(tsx & bare.startswith("export const ") & cl.starts_upper(F.col("name")), 0)
        .when(tsx & bare.startswith("export default function "), 0)
        .when(tsx & (F.col("kind") == "ui_component"), 1)
        .when(script & (F.col("kind") == "ui_function"), 2)
        .when(path.endswith(".cs") & F.col("kind").isin("controller_action", "service_method", "job_method"), 0)
        .when(path.endswith(".cs") & F.col("kind").isin(*C.CLASS_KINDS), 1)
        .otherwise(3)
    )
    label = F.when(F.col("kind").rlike("(function|method|action)$"), F.concat("name", F.lit("()"))).otherwise(F.col("name"))
    ranked = rows.select("path", "line_no", "name", label.alias("label"), "kind", priority.alias("priority"))
    return top_per_key(ranked, ["path"], [F.col("priority"), F.col("line_no"), F.col("name")], limit)


# --------------------------------------------------------------------------
# Selection
# --------------------------------------------------------------------------


def classified_symbols(nodes: DataFrame, declared: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Nodes with a captured kind; ``declared`` adds live-source keywords by ``keys``."""
    base = nodes if declared is None else nodes.join(declared, keys or [], "left")
    keyword = F.col("declared") if declared is not None else None
    kind = cl.symbol_kind(F.col("label"), F.col("path"), keyword)
    return base.withColumn("kind", kind).where(F.col("kind").isin(*C.CAPTURED_SYMBOL_KINDS))


def symbol_hints(nodes: DataFrame, order: list[str], limit: int = C.MAX_SYMBOL_HINTS) -> DataFrame:
    """First ``limit`` distinct (label, file, line) symbols of every file."""
    line = nodes.withColumn("line", source_line_number(F.col("source_location"))).withColumnRenamed("source_file", "path")
    kinds = classified_symbols(line)
    keyed = kinds.withColumn("_k", F.lower("label"))
    columns = [c for c in kinds.columns if c not in ("path", "line")]
    unique = first_per_key(keyed, ["_k", "path", "line"], [F.col(c) for c in order], columns).drop("_k")
    return top_per_key(unique, ["path"], [F.col(c) for c in order], limit, rank="nth")


def relevance(label: Column, words: tuple[str, ...]) -> Column:
    """Distinctive query words (three letters or more) that are whole tokens of a label."""
    long_words = [w for w in words if len(w) >= 3]
    counted = F.size(F.array_intersect(search_tokens(label), cl.lit_array(long_words)))
    # a token is a part of its lower-cased label, so that most labels need no tokens
    lowered = F.lower(label)
    return F.when(any_of([lowered.contains(w) for w in long_words]), counted).otherwise(F.lit(0))


def symbol_hits(
    symbols: DataFrame,
    plan: QueryPlan,
    order: list[str],
    per_path: int = 4,
    limit: int = 20,
    identifiers: tuple[str, ...] = (),
    strict: tuple[str, ...] = (),
) -> DataFrame:
    """Best symbols overall after a per-file cap by relevance.

    ``symbols``: label, kind, path, line, score and the order columns.  A file in
    which a strict identifier occurs gets a wider cap; an exactly named symbol is
    kept in any case.
    """
    useful = symbols.where((F.col("path") != "") & ~cl.is_low_value_symbol(F.col("label"), F.col("kind")))
    keyed = useful.withColumn("_l", F.lower("label")).withColumn("_p", F.lower("path"))
    columns = [c for c in useful.columns if c != "line"]
    # read three times below: for the cap, for confirmed files and for named symbols
    unique = cut_lineage(first_per_key(keyed, ["_l", "_p", "line"], [F.col(c) for c in order], columns))
    unique = unique.withColumn("relevance", relevance(F.col("label"), plan.distinctive)).withColumn(
        "bare", cl.bare_label(F.col("label"))
    )
    widest = max(per_path, C.CONFIRMED_FILE_SYMBOL_CAP) if strict else per_path
    by = [F.desc("relevance"), *[F.col(c) for c in order]]
    capped = top_per_key(unique, ["_p"], by, widest, rank="nth")
    if strict:
        confirmed = unique.where(F.col("bare").isin(*[s.lower() for s in strict])).select("_p").distinct()
        capped = capped.join(confirmed.withColumn("wide", F.lit(True)), "_p", "left").where(
            (F.col("nth") <= per_path) | F.col("wide")
        ).drop("wide")
    if identifiers:
        named = unique.where(F.col("bare").isin(*[i.lower() for i in identifiers]))
        extra = named.join(capped.select("_l", "_p", "line"), ["_l", "_p", "line"], "left_anti")
        capped = capped.unionByName(extra.withColumn("nth", F.lit(widest + 1)))
    priority = cl.lookup(C.SYMBOL_KIND_PRIORITY, F.col("kind"), C.SYMBOL_KIND_PRIORITY_DEFAULT)
    ranked = capped.withColumn("priority", priority).orderBy(
        "priority", F.desc("score"), "path", "line", "label", *order
    )
    return ranked.limit(limit).drop("_l", "_p", "bare", "nth")


def owner_score(plan: QueryPlan, rank: Column, identifiers: tuple[str, ...] | None = None) -> Column:
    """Additive score of a symbol as primary owner.  ``rank`` is null for unranked files."""
    path = normalized_path(F.col("path"))
    label = F.lower("label")
    kind = F.col("kind")
    preferred = rank.isNotNull()
    place = F.coalesce(rank, F.lit(10_000))
    spoken = set(plan.token_set)
    counted = tuple(w for w in plan.distinctive if w not in C.OWNER_EXCLUDED_TOKENS)
    either = F.lit(0)
    for word in counted:
        either = either + F.when(label.contains(word) | path.contains(word), F.lit(1)).otherwise(F.lit(0))
    score = (
        cl.lookup(C.SYMBOL_OWNER_WEIGHT, kind, C.SYMBOL_OWNER_WEIGHT_DEFAULT)
        + F.greatest(F.lit(0.0), F.lit(1100.0) - F.least(place, F.lit(50)) * 85.0)
        + owner_path_score(F.col("path"))
        + F.when(preferred, F.lit(220.0)).otherwise(F.lit(0.0))
        - F.when((place > 5) & ~preferred, F.least(F.lit(400.0), (place - 5) * 55.0)).otherwise(F.lit(0.0))
        + F.when(F.col("line_status") == "exact", F.lit(120.0))
        .when(F.col("line_status") == "adjusted", F.lit(60.0))
        .otherwise(F.lit(0.0))
    )
    is_anchor = F.array_contains(cl.anchor_labels(F.col("path")), F.lower(F.replace("label", F.lit("()"), F.lit(""))))
    score = score + F.when(kind.isin(*C.CLASS_KINDS) & is_anchor, F.lit(820.0)).otherwise(F.lit(0.0))
    score = score + either * 90.0 + distinctive_hits(path, counted) * 160.0
    names = plan.identifiers if identifiers is None else identifiers
    for name in names:
        word = name.lower()
        if word in C.OWNER_EXCLUDED_TOKENS:
            continue
        strength = ids.corroboration_strength(F.lit(name), cl.lit_array(plan.tokens), cl.lit_array(names), tuple(sorted(plan.generic)))
        score = score + (
            F.when(path.contains(word), 900.0 * strength)
            .when(label.contains(word), 650.0 * strength)
            .otherwise(F.lit(0.0))
        )
    score = score + F.when(kind.isin(*C.EXECUTABLE_KINDS) & (either > 0), F.lit(180.0)).otherwise(F.lit(0.0))
    distinct = set(plan.distinctive)
    if not distinct & set(C.HELPER_WORDS):
        helper = path.contains("/helpers/") | path.endswith("helper.cs") | path.contains("statushelper")
        score = score - F.when(helper, F.lit(720.0)).otherwise(F.lit(0.0))
    if not distinct & set(C.STATUS_WORDS):
        getter = (kind == "service_method") & label.startswith(".is")
        score = score - F.when(getter, F.lit(520.0)).otherwise(F.lit(0.0))
    for word, folder in (("service", "/services/"), ("controller", "/controllers/")):
        if word in distinct and word in spoken:
            score = score + F.when(path.contains(folder), F.lit(260.0)).otherwise(F.lit(0.0))
    return score


def rerank_score(plan: QueryPlan, words: tuple[str, ...], identifiers: tuple[str, ...]) -> Column:
    """0-1 score of an owner candidate from label-grounded signals only."""
    path, label = normalized_path(F.col("path")), F.lower("label")
    kept = [w for w in words if len(w) >= 3 and w not in plan.generic]
    in_label, in_path_only = F.lit(0), F.lit(0)
    for word in kept:
        own = label.contains(word)
        in_label = in_label + F.when(own, F.lit(1)).otherwise(F.lit(0))
        in_path_only = in_path_only + F.when(path.contains(word) & ~own, F.lit(1)).otherwise(F.lit(0))
    named = F.lit(False)
    for name in identifiers:
        named = named | path.contains(name.lower()) | label.contains(name.lower())
    top_weight = max(C.SYMBOL_OWNER_WEIGHT.values())
    signals = {
        "identifier_match": F.when(named, F.lit(1.0)).otherwise(F.lit(0.0)),
        "kind": cl.lookup(C.SYMBOL_OWNER_WEIGHT, F.col("kind"), C.SYMBOL_OWNER_WEIGHT_DEFAULT) / F.lit(top_weight),
        "label_token_match": F.least(F.lit(1.0), in_label / F.lit(3.0)),
        "path_token_match": F.least(F.lit(1.0), in_path_only / F.lit(3.0)),
    }
    return sum((signals[name] * weight for name, weight in C.RERANK_WEIGHTS.items()), F.lit(0.0))


def rescored_winner(
    df: DataFrame, score: str, second: Column, tie: list[Column], window: int = C.RERANK_WINDOW, margin: float = C.RERANK_MARGIN
) -> DataFrame:
    """Winner by ``score`` unless, among the best ``window`` rows, another leads on ``second`` by the margin."""
    top = df.orderBy(F.desc(score), *tie).limit(window)
    order = Window.orderBy(F.desc(score), *tie)
    # the frame holds at most `window` rows
    rated = top.withColumn("rank", F.row_number().over(order)).withColumn("second", second)
    rated = rated.withColumn("first_second", F.max(F.when(F.col("rank") == 1, F.col("second"))).over(Window.partitionBy()))
    challenger = F.when(F.col("second") - F.col("first_second") >= margin, F.col("second"))
    best = rated.withColumn("lead", F.when(F.col("rank") > 1, challenger))
    return best.orderBy(F.col("lead").desc_nulls_last(), "rank").limit(1).drop("lead", "first_second")


def reserve_top_file(hits: DataFrame, top_path: str | Column, rank: str, reserve: int = 2) -> DataFrame:
    """Moves up to ``reserve`` hits of the top file to the front; ``hits`` is a short ranked list."""
    mine = normalized_path(F.col("path")) == top_path
    nth = F.row_number().over(Window.partitionBy(mine).orderBy(rank))
    marked = hits.withColumn("reserved", mine & (nth <= reserve))
    return marked.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("reserved"), F.col(rank))))


def within_block_budget(hits: DataFrame, ok: Column, order: str, budget: int = 6) -> DataFrame:
    """Marks the hits that get a code block: in order, only successful ones consume the budget."""
    used = F.sum(F.when(ok, F.lit(1)).otherwise(F.lit(0))).over(
        Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return hits.withColumn("gets_block", ok & (used <= budget))
