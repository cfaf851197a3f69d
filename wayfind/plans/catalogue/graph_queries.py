"""Graph, symbol and live-source queries over the derived code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import classify as cl
from wayfind.functions.paths import normalized_path
from wayfind.operators import graph as g
from wayfind.operators import symbols as sy
from wayfind.operators.skew import first_per_key, ranked_top
from wayfind.plans.catalogue.registry import query
from wayfind.plans.catalogue.settings import PLAN, SYMBOL_PLAN, SYMBOL_STRENGTH
from wayfind.sources.starschema import StarTables, sql_in, with_ctes

ORDER = ["pos", "tie"]
#: Query of the symbol scoring examples: names one order method and one order class.

ENDPOINTS = {
    "endpoints": """SELECT ref, arg_min(label, tier) AS label, arg_min(source_file, tier) AS source_file, arg_min(source_location, tier) AS source_location FROM (
  SELECT node_id AS ref, 0 AS tier, arg_max(label, pos) AS label, arg_max(source_file, pos) AS source_file, arg_max(source_location, pos) AS source_location FROM nodes GROUP BY node_id
  UNION ALL SELECT label, 1, label, arg_min(source_file, pos), '' FROM nodes WHERE source_file <> '' GROUP BY label) GROUP BY ref""",
    "resolved": f"""SELECT pos, tie, lower(relation) AS relation, coalesce(s.label, source_ref) AS source_label, coalesce(s.source_file,'') AS source_file,
  CAST(regexp_extract(e.source_location,'\\d+') AS INTEGER) AS source_line,
  coalesce(t.label, target_ref) AS target_label, coalesce(t.source_file,'') AS target_file,
  CAST(nullif(regexp_extract(coalesce(t.source_location,''),'\\d+'),'') AS INTEGER) AS target_line
FROM edges e LEFT JOIN endpoints s ON source_ref = s.ref LEFT JOIN endpoints t ON target_ref = t.ref
WHERE lower(relation) IN {sql_in(C.CAPTURED_RELATIONS)}""",
    "hints": """SELECT * FROM resolved WHERE source_file = '' OR target_file = '' OR lower(source_file) <> lower(target_file)
QUALIFY row_number() OVER (PARTITION BY lower(source_label), relation, lower(target_label), lower(source_file) ORDER BY pos, tie) = 1""",
}
GRAPH = ["nodes", "edges"]
RANKED_SQL = {
    "ranked": """SELECT lower(path) AS path_norm, path, row_number() OVER (ORDER BY q DESC, file_key) - 1 AS rank
FROM (SELECT file_key, path, sum(l_quantity) AS q FROM lineitem JOIN files ON l_partkey = file_key GROUP BY ALL) QUALIFY rank < 25"""
}


def resolved_edges(t: StarTables) -> DataFrame:
    return g.resolve_edges(t.nodes(), t.edges(), ORDER)


def cross_file_hints(t: StarTables) -> DataFrame:
    return g.dependency_hints(resolved_edges(t), ORDER)


def ranked_files(t: StarTables) -> DataFrame:
    """The 25 files with the largest ordered quantity, rank from 0."""
    volume = t.read("lineitem").groupBy(F.col("l_partkey").alias("file_key")).agg(F.sum("l_quantity").alias("q"))
    top = ranked_top(volume.join(t.files(), "file_key").select("file_key", "path", "q"), [F.desc("q"), F.asc("file_key")], 25)
    return top.select("path", F.lower("path").alias("path_norm"), (F.col("rank") - 1).alias("rank"))


@query(
    "edge_resolution",
    with_ctes(
        GRAPH,
        "SELECT pos, tie, relation, source_label, source_file, source_line, target_label, target_file, target_line FROM resolved",
        ENDPOINTS,
    ),
)
def edge_resolution(t: StarTables) -> DataFrame:
    """Both endpoints of every edge: id first, label fallback, left outer."""
    return resolved_edges(t).select(
        "pos", "tie", "relation", "source_label", "source_file", "source_line", "target_label", "target_file", "target_line"
    )


@query("endpoint_lookup", with_ctes(GRAPH, "SELECT ref, label, source_file FROM endpoints", ENDPOINTS))
def endpoint_lookup(t: StarTables) -> DataFrame:
    """Reference -> node: last node of an id, first file of a label."""
    return g.endpoint_lookup(t.nodes(), ["pos"]).select("ref", "node.label", "node.source_file")


@query(
    "dependency_hints",
    with_ctes(GRAPH, "SELECT pos, tie, relation, source_label, source_file, target_label, target_file FROM hints", ENDPOINTS),
)
def dependency_hints(t: StarTables) -> DataFrame:
    """Cross-file edges, first of each four-part key."""
    return cross_file_hints(t).select(
        "pos", "tie", "relation", "source_label", "source_file", "target_label", "target_file"
    )


@query(
    "edges_both_endpoints",
    with_ctes(
        GRAPH,
        """SELECT path, count(*) AS edges, min(pos) AS first_pos FROM (
  SELECT DISTINCT pos, tie, unnest([s.source_file, t.source_file]) AS path FROM edges e LEFT JOIN ep s ON source_ref = s.ref LEFT JOIN ep t ON target_ref = t.ref)
WHERE path <> '' GROUP BY path""",
        {
            "ep": """SELECT ref, arg_min(source_file, tier) AS source_file FROM (
  SELECT node_id AS ref, 0 AS tier, arg_max(source_file, pos) AS source_file FROM nodes GROUP BY node_id
  UNION ALL SELECT label, 1, arg_max(source_file, pos) FROM nodes GROUP BY label) GROUP BY ref"""
        },
    ),
)
def edges_both_endpoints(t: StarTables) -> DataFrame:
    """Edges per endpoint file, an edge counting for both its files."""
    owned = g.edges_by_file(t.nodes(), t.edges(), ORDER)
    return owned.groupBy("path").agg(F.count(F.lit(1)).alias("edges"), F.min("pos").alias("first_pos"))


@query(
    "coverage_first_cap",
    with_ctes(
        GRAPH,
        """SELECT anchor, slot, pos, tie, other_file FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY (nth > 1 OR other_file = ''), pos, tie) AS slot FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor, lower(other_file) ORDER BY pos, tie) AS nth FROM (
      SELECT *, CASE WHEN lower(source_file) = lower(anchor) THEN target_file ELSE source_file END AS other_file FROM (
        SELECT *, unnest(list_distinct(list_filter([source_file, target_file], lambda f: f <> ''))) AS anchor FROM hints)))) WHERE slot <= 20""",
        ENDPOINTS,
    ),
)
def coverage_first_cap(t: StarTables) -> DataFrame:
    """Twenty edges per hub file, one per distinct neighbour first."""
    capped = g.coverage_first_cap(g.anchored_hints(cross_file_hints(t)).select(*ORDER, "anchor", "other_file"), ORDER, 20)
    return capped.select("anchor", F.col("slot").cast("bigint"), "pos", "tie", "other_file")


@query(
    "broadest_chunk",
    with_ctes(
        ["files"],
        """SELECT lower(path) AS path, arg_max(doc_id, (deps, edges, -doc_id)) AS doc_id FROM (
  SELECT path, l_partkey*8 + l_linenumber AS doc_id, count(*) FILTER (l_suppkey % 10 <> 0) AS deps, count(*) AS edges
  FROM lineitem JOIN files ON l_partkey = file_key GROUP BY ALL) GROUP BY ALL""",
    ),
)
def broadest_chunk(t: StarTables) -> DataFrame:
    """Most complete chunk of every file: lexicographic arg-max with a position tie-break."""
    chunks = (
        t.read("lineitem")
        .groupBy("l_partkey", "l_linenumber")
        .agg(
            F.count(F.when(F.col("l_suppkey") % 10 != 0, 1)).alias("dependency_count"),
            F.count(F.lit(1)).alias("edge_count"),
        )
        .withColumn("doc_id", F.col("l_partkey") * 8 + F.col("l_linenumber"))
        .withColumn("pos", F.col("doc_id"))
    )
    files = t.files().select(F.col("file_key").alias("l_partkey"), F.col("path").alias("source_file"))
    return g.broadest_chunk(chunks.join(files, "l_partkey"))


def _sql_words(text: str, words) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END" for w in words) or "0"


SQL_OWNER_PATH = """CASE WHEN contains(lower({p}),'/controllers/') THEN 180.0 WHEN contains(lower({p}),'/services/') THEN 170.0
 WHEN contains(lower({p}),'/jobs/') THEN 165.0 WHEN suffix(lower({p}),'.tsx') THEN 155.0 WHEN suffix(lower({p}),'.ts') THEN 125.0
 WHEN contains(lower({p}),'/dtos/') THEN 90.0 WHEN contains(lower({p}),'/entities/') THEN 80.0 ELSE 40.0 END"""


def sql_owner_path(p: str) -> str:
    return SQL_OWNER_PATH.format(p=p)


@query("owner_path_score", with_ctes(["files"], f"SELECT file_key, ({sql_owner_path('path')})::DOUBLE AS score, regexp_matches(lower(path), '/(controllers|services|jobs|dtos|entities|api|components|pages|hooks|utils)/') AS rankable FROM files"))
def owner_path_score(t: StarTables) -> DataFrame:
    """Folder score and owner eligibility of every file."""
    from wayfind.functions.paths import is_rankable_owner, owner_path_score as score

    return t.files().select("file_key", score(F.col("path")).alias("score"), is_rankable_owner(F.col("path")).alias("rankable"))


_EDGE_SCORE = f"""CASE relation WHEN 'calls' THEN 600.0 WHEN 'uses' THEN 520.0 WHEN 'imports' THEN 480.0 ELSE 250.0 END
 + greatest(0.0, 450.0 - least(coalesce(s.rank,10000),30)*25.0) + greatest(0.0, 420.0 - least(coalesce(t.rank,10000),30)*22.0)
 + 0.7*{sql_owner_path('source_file')} + 0.65*{sql_owner_path('target_file')}
 + CASE WHEN s.rank IS NOT NULL THEN 180.0 ELSE 0 END + CASE WHEN t.rank IS NOT NULL THEN 180.0 ELSE 0 END
 - CASE WHEN source_file <> '' AND lower(source_file) = lower(target_file) THEN 420.0 ELSE 0 END
 + 50.0*({_sql_words("lower(source_file || ' ' || target_file || ' ' || source_label || ' ' || target_label || ' ' || relation)", SYMBOL_PLAN.distinctive)})"""


@query(
    "dependency_chain",
    with_ctes(
        GRAPH + ["files"],
        f"""SELECT rn, pos, tie, relation, source_label, target_label, round(edge_score::DOUBLE, 6) AS edge_score FROM (
  SELECT *, row_number() OVER (ORDER BY edge_score DESC, pos, tie) AS rn FROM (
    SELECT h.*, {_EDGE_SCORE} AS edge_score FROM hints h LEFT JOIN ranked s ON lower(source_file) = s.path_norm LEFT JOIN ranked t ON lower(target_file) = t.path_norm
    WHERE s.rank IS NOT NULL OR t.rank IS NOT NULL)) WHERE rn <= 12""",
        {**ENDPOINTS, **RANKED_SQL},
    ),
)
def dependency_chain(t: StarTables) -> DataFrame:
    """Twelve best edges touching the ranked files."""
    chain = g.dependency_chain(cross_file_hints(t), ranked_files(t), SYMBOL_PLAN, ORDER)
    top = ranked_top(chain, [F.desc("edge_score"), F.asc("pos"), F.asc("tie")], 12, rank="rn")
    return top.select(
        F.col("rn").cast("bigint"), "pos", "tie", "relation", "source_label", "target_label", F.round("edge_score", 6).alias("edge_score")
    )


@query(
    "related_files",
    with_ctes(
        GRAPH + ["files"],
        f"""SELECT path, round(score::DOUBLE, 6) AS score FROM (SELECT path, sum(base + greatest(0.0, 300.0 - least(coalesce(own,10000),40)*15.0) + 0.6*{sql_owner_path('path')}
   + CASE WHEN own IS NOT NULL THEN 120.0 ELSE 0.0 END + 35.0*({_sql_words('lower(path)', SYMBOL_PLAN.distinctive)})) AS score FROM (
  SELECT m.*, o.rank AS own, row_number() OVER (PARTITION BY lower(result_path), lower(m.path) ORDER BY mpos) AS rn FROM (
    SELECT source_label AS result_path, source_file AS path, target_file AS anchor, 220.0 AS base, pos*2 AS mpos FROM hints
    UNION ALL SELECT source_label, target_file, source_file, 240.0, pos*2 + 1 FROM hints) m
  LEFT JOIN ranked o ON lower(m.path) = o.path_norm LEFT JOIN ranked a ON lower(m.anchor) = a.path_norm
  WHERE m.path <> '' AND (o.rank IS NOT NULL OR a.rank IS NOT NULL)) WHERE rn = 1 GROUP BY path ORDER BY score DESC, path LIMIT 20)""",
        {**ENDPOINTS, **RANKED_SQL},
    ),
)
def related_files(t: StarTables) -> DataFrame:
    """One-hop neighbours of the ranked files through edges, best 20."""
    hints = cross_file_hints(t)
    ends = F.array(
        F.struct(F.col("source_file").alias("path"), F.col("target_file").alias("anchor"), F.lit("edge_source").alias("role"), (F.col("pos") * 2).alias("pos")),
        F.struct(F.col("target_file").alias("path"), F.col("source_file").alias("anchor"), F.lit("edge_target").alias("role"), (F.col("pos") * 2 + 1).alias("pos")),
    )
    mentions = hints.select(F.col("source_label").alias("result_path"), F.explode(ends).alias("m")).select("result_path", "m.*")
    return g.related_files(mentions, ranked_files(t), SYMBOL_PLAN).select("path", F.round("score", 6).alias("score"))


@query(
    "owner_companions",
    with_ctes(
        GRAPH + ["doc_files"],
        """SELECT DISTINCT doc_id, path FROM (SELECT doc_id, path FROM doc_files UNION ALL
  SELECT pos // 8, unnest([source_file, target_file]) FROM hints) WHERE path <> ''""",
        ENDPOINTS,
    ),
)
def owner_companions(t: StarTables) -> DataFrame:
    """One-hop companions of every document: listed files and both ends of its edges."""
    edges = cross_file_hints(t).select(F.floor(F.col("pos") / 8).alias("doc_id"), "source_file", "target_file")
    return g.owner_companions(t.doc_files(), edges)


# --------------------------------------------------------------------------
# Symbols
# --------------------------------------------------------------------------

_SQL_KIND = """CASE WHEN starts_with(label,'.') AND suffix(label,'()') THEN
    CASE WHEN contains(lower(path),'/controllers/') THEN 'controller_action' WHEN contains(lower(path),'/services/') THEN 'service_method'
      WHEN contains(lower(path),'/jobs/') THEN 'job_method' WHEN contains(lower(path),'/src/') OR regexp_matches(lower(path),'\\.(tsx|ts|js|jsx)$') THEN 'ui_function' ELSE 'method' END
  WHEN suffix(label,'Controller') AND contains(lower(path),'/controllers/') THEN 'controller_class'
  WHEN suffix(label,'Service') AND contains(lower(path),'/services/') THEN 'service_class'
  WHEN suffix(label,'Job') AND contains(lower(path),'/jobs/') THEN 'job_class'
  WHEN suffix(lower(path),'.tsx') THEN CASE WHEN suffix(label,'Props') OR {kw} IN ('type','interface','enum') THEN 'dto_type'
      WHEN {kw} IS NULL AND suffix(label,'State') THEN 'dto_type' WHEN regexp_matches(label,'^[A-Z]') THEN 'ui_component' ELSE 'ui_function' END
  WHEN suffix(lower(path),'.ts') THEN CASE WHEN {kw} IN ('type','interface','enum') THEN 'dto_type' ELSE 'ui_function' END
  WHEN suffix(label,'Dto') OR suffix(label,'Dtos') THEN 'dto_type'
  WHEN suffix(label,'Entity') OR contains(lower(path),'/entities/') THEN 'entity_type'
  WHEN suffix(label,'()') THEN 'method' END"""


@query(
    "classify_symbol_kind",
    with_ctes(["nodes", "symbols"], f"SELECT kind, folder, count(*) AS n FROM (SELECT {_SQL_KIND.format(kw='NULL::VARCHAR')} AS kind, split_part(path,'/',3) AS folder FROM (SELECT label, source_file AS path FROM nodes UNION ALL SELECT label, path FROM symbols)) GROUP BY ALL"),
)
def classify_symbol_kind(t: StarTables) -> DataFrame:
    """Kinds of all graph nodes and symbols by label shape and folder."""
    both = t.nodes().select("label", F.col("source_file").alias("path")).unionByName(t.symbols().select("label", "path"))
    kinds = both.select(cl.symbol_kind(F.col("label"), F.col("path")).alias("kind"), F.split_part("path", F.lit("/"), F.lit(3)).alias("folder"))
    return kinds.groupBy("kind", "folder").agg(F.count(F.lit(1)).alias("n"))


_DECL = r"^\s*(?:export\s+)?(?:default\s+)?(type|interface|class|function|const|let|var|enum)\s+([A-Za-z_][A-Za-z0-9_]*)\b"


@query(
    "declared_kind",
    with_ctes(
        ["symbols", "source_lines"],
        f"""SELECT pos, tie, {_SQL_KIND.format(kw='kw')} AS kind FROM symbols LEFT JOIN (
  SELECT s.pos, s.tie, arg_min(l.kw, l.line_no) AS kw FROM symbols s JOIN (
    SELECT path, line_no, regexp_extract(text, '{_DECL}', 1) AS kw, regexp_extract(text, '{_DECL}', 2) AS name FROM source_lines) l
  ON s.path = l.path AND s.label = l.name AND abs(l.line_no - s.line) <= 12 GROUP BY ALL) d USING (pos, tie)""",
    ),
)
def declared_kind(t: StarTables) -> DataFrame:
    """Symbol kinds settled by the declaration found within twelve live source lines."""
    symbols = t.symbols()
    declared = sy.declared_keywords(symbols, t.source_lines(), ORDER)
    joined = symbols.join(declared, ORDER, "left")
    return joined.select("pos", "tie", cl.symbol_kind(F.col("label"), F.col("path"), F.col("declared")).alias("kind"))


_SYMBOL_KINDS = {"sk": f"SELECT *, {_SQL_KIND.format(kw='NULL::VARCHAR')} AS kind, regexp_replace(regexp_replace(label,'^\\.',''),'\\(\\)$','') AS name FROM symbols"}


def kinded_symbols(t: StarTables) -> DataFrame:
    return t.symbols().withColumn("kind", cl.symbol_kind(F.col("label"), F.col("path")))


@query(
    "verify_symbol_lines",
    with_ctes(
        ["symbols", "source_lines"],
        r"""SELECT pos, tie, coalesce(near_line, any_line, line) AS line,
  CASE WHEN near_line IS NULL AND any_line IS NULL THEN 'not_found' WHEN near_line = line THEN 'exact' ELSE 'adjusted' END AS line_status,
  coalesce(near_line, any_line) - line AS line_delta
FROM sk LEFT JOIN (SELECT pos, tie, min(line_no) AS any_line, min(line_no) FILTER (abs(line_no - line) <= 12) AS near_line FROM (
  SELECT sk.*, line_no, text FROM sk JOIN source_lines l ON sk.path = l.path AND contains(text, name))
  WHERE CASE WHEN kind IN ('controller_class','service_class','job_class') THEN regexp_matches(text, '\bclass\s+' || name || '\b')
    WHEN kind = 'ui_component' THEN regexp_matches(text, '\b(function|const)\s+' || name || '\b')
    WHEN kind IN ('controller_action','service_method','job_method','ui_function','method') THEN regexp_matches(text, '\b' || name || '\s*[(<=]|\b(function|const)\s+' || name || '\b')
    ELSE regexp_matches(text, '\b(interface|type|class|const)\s+' || name || '\b') END GROUP BY ALL) USING (pos, tie)""",
        _SYMBOL_KINDS,
    ),
)
def verify_symbol_lines(t: StarTables) -> DataFrame:
    """Every symbol located in its live file, with status and drift."""
    symbols = kinded_symbols(t).withColumn("kind", F.coalesce("kind", F.lit("")))
    checked = sy.verify_symbols(symbols, t.source_lines(), ORDER)
    return checked.select("pos", "tie", "line", "line_status", "line_delta")


@query(
    "code_blocks",
    with_ctes(
        ["symbols", "source_lines"],
        """SELECT s.pos, s.tie, min(line_no) AS line_start, max(line_no) AS line_end,
  md5(string_agg((CASE WHEN line_no = s.pos THEN '>' ELSE ' ' END) || line_no || ': ' || text, chr(10) ORDER BY line_no, text)) AS digest
FROM symbols s JOIN source_lines l ON s.path = l.path AND line_no BETWEEN s.pos - 4 AND s.pos + 8 GROUP BY ALL""",
    ),
)
def code_blocks(t: StarTables) -> DataFrame:
    """Numbered source window around every symbol's line."""
    hits = t.symbols().select("pos", "tie", "path", F.col("pos").alias("line"))
    blocks = sy.code_blocks(hits, t.source_lines(), ORDER)
    return blocks.select("pos", "tie", "line_start", "line_end", F.md5("text").alias("digest"))


_TS = [p.replace("'", "''") for p in C.TS_DECLARATIONS]
_CS = [p.replace("'", "''") for p in C.CS_DECLARATIONS]


@query(
    "source_symbols",
    with_ctes(
        ["source_lines"],
        f"""SELECT path, line_no, label, kind, rn FROM (SELECT *, CASE WHEN regexp_matches(kind,'(function|method|action)$') THEN name || '()' ELSE name END AS label,
  row_number() OVER (PARTITION BY path ORDER BY prio, line_no, name) AS rn FROM (SELECT *, CASE
    WHEN lower(name) = regexp_replace(lower(split_part(path,'/',-1)),'\\.[^.]*$','') OR (contains(lower(path),'/services/') AND lower(name) = 'i' || regexp_replace(lower(split_part(path,'/',-1)),'\\.[^.]*$','')) THEN -1
    WHEN suffix(path,'.tsx') AND starts_with(ltrim(text),'export const ') AND regexp_matches(name,'^[A-Z]') THEN 0
    WHEN suffix(path,'.tsx') AND starts_with(ltrim(text),'export default function ') THEN 0
    WHEN suffix(path,'.tsx') AND kind = 'ui_component' THEN 1 WHEN kind = 'ui_function' THEN 2
    WHEN kind IN ('controller_action','service_method','job_method') THEN 0 WHEN kind IN ('controller_class','service_class','job_class') THEN 1 ELSE 3 END AS prio FROM (
  SELECT *, CASE WHEN suffix(path,'.tsx') THEN CASE WHEN regexp_matches(name,'^[A-Z]') THEN 'ui_component' ELSE 'ui_function' END WHEN suffix(path,'.ts') THEN 'ui_function'
    WHEN contains(lower(path),'/controllers/') THEN CASE WHEN contains(text,'class ') THEN 'controller_class' ELSE 'controller_action' END
    WHEN contains(lower(path),'/services/') THEN CASE WHEN contains(text,'class ') THEN 'service_class' ELSE 'service_method' END
    WHEN contains(lower(path),'/jobs/') THEN CASE WHEN contains(text,'class ') THEN 'job_class' ELSE 'job_method' END
    WHEN contains(lower(path),'/entities/') THEN CASE WHEN contains(text,'class ') THEN 'entity_type' ELSE 'method' END
    WHEN contains(lower(path),'/dtos/') THEN CASE WHEN contains(text,'class ') THEN 'dto_type' ELSE 'method' END ELSE 'method' END AS kind
  FROM (SELECT path, line_no, text, unnest(list_distinct(list_filter(CASE WHEN suffix(path,'.cs') THEN [{', '.join(f"regexp_extract(text,'{p}',1)" for p in _CS)}]
    ELSE [{', '.join(f"regexp_extract(text,'{p}',1)" for p in _TS)}] END, lambda n: n <> ''))) AS name FROM source_lines)))) WHERE rn <= 6""",
    ),
)
def source_symbols(t: StarTables) -> DataFrame:
    """Up to six declared symbols of every live file."""
    found = sy.source_symbols(t.source_lines())
    return found.select("path", "line_no", "label", "kind", F.col("rn").cast("bigint").alias("rn"))


@query(
    "symbol_hints",
    with_ctes(
        ["nodes"],
        f"""SELECT path, line, label, kind, nth FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS nth FROM (
  SELECT pos, label, source_file AS path, CAST(regexp_extract(source_location,'\\d+') AS INTEGER) AS line, {_SQL_KIND.format(kw='NULL::VARCHAR')} AS kind FROM (SELECT *, source_file AS path FROM nodes)
  WHERE kind IN {sql_in(C.CAPTURED_SYMBOL_KINDS)} QUALIFY row_number() OVER (PARTITION BY lower(label), source_file, line ORDER BY pos) = 1)) WHERE nth <= 40""",
    ),
)
def symbol_hints(t: StarTables) -> DataFrame:
    """Captured symbols of every file, first forty distinct ones."""
    hints = sy.symbol_hints(t.nodes(), ["pos"])
    return hints.select("path", "line", "label", "kind", F.col("nth").cast("bigint"))


@query(
    "low_value_symbols",
    with_ctes(
        ["files"],
        """SELECT low, count(*) AS n FROM (SELECT (CASE variant WHEN 0 THEN class_label WHEN 1 THEN upper(replace(class_label,'e','_')) WHEN 2 THEN class_label || '{x}' WHEN 3 THEN '' ELSE '.' || class_label || '()' END) AS label, variant, file_key FROM (SELECT *, file_key % 5 AS variant FROM files)),
  LATERAL (SELECT CASE WHEN label = '' THEN true WHEN variant = 1 AND contains(label,'_') THEN true WHEN variant = 2 THEN true ELSE false END AS low) GROUP BY low""",
    ),
)
def low_value_symbols(t: StarTables) -> DataFrame:
    """How many labels are dropped as empty, constant-case or not an identifier."""
    variant = F.col("file_key") % 5
    label = (
        F.when(variant == 0, F.col("class_label"))
        .when(variant == 1, F.upper(F.replace("class_label", F.lit("e"), F.lit("_"))))
        .when(variant == 2, F.concat("class_label", F.lit("{x}")))
        .when(variant == 3, F.lit(""))
        .otherwise(F.concat(F.lit("."), "class_label", F.lit("()")))
    )
    kind = F.when(variant == 2, "ui_component").otherwise("service_method")
    low = cl.is_low_value_symbol(F.col("label"), F.col("kind"))
    labels = t.files().select(label.alias("label"), kind.alias("kind"))
    return labels.select(low.alias("low")).groupBy("low").agg(F.count(F.lit(1)).alias("n"))


_WIDGET = tuple(w for w in SYMBOL_PLAN.distinctive if len(w) >= 3)
_PRIO = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SYMBOL_KIND_PRIORITY.items()) + " ELSE 9 END"


@query(
    "symbol_hits",
    with_ctes(
        ["symbols"],
        f"""SELECT rn, label, path, line FROM (SELECT *, row_number() OVER (ORDER BY {_PRIO}, score DESC, path, line, label, pos, tie) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY rel DESC, pos, tie) AS nth,
    max(bare IN ('order1234')) OVER (PARTITION BY lower(path)) AS wide FROM (
    SELECT *, lower(name) AS bare, (CASE WHEN list_contains(['order1234'], lower(name)) THEN 1 ELSE 0 END) AS rel, (tie % 1000)::DOUBLE AS score FROM sk WHERE kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(label), lower(path), line ORDER BY pos, tie) = 1))
  WHERE nth <= 4 OR (wide AND nth <= 16) OR bare IN ('order1234','order77')) WHERE rn <= 20""",
        _SYMBOL_KINDS,
    ),
)
def symbol_hits(t: StarTables) -> DataFrame:
    """Twenty best symbols after the per-file cap, widened where a strict identifier matches."""
    symbols = kinded_symbols(t).where(F.col("kind").isNotNull()).withColumn("score", (F.col("tie") % 1000).cast("double"))
    hits = sy.symbol_hits(symbols, SYMBOL_PLAN, ORDER, identifiers=("Order1234", "Order77"), strict=("Order1234",))
    order = [F.asc("priority"), F.desc("score"), F.asc("path"), F.asc("line"), F.asc("label"), F.asc("pos"), F.asc("tie")]
    return ranked_top(hits, order, 20, rank="rn").select(F.col("rn").cast("bigint"), "label", "path", "line")


def _sql_owner_score() -> str:
    counted = [w for w in SYMBOL_PLAN.distinctive if w not in C.OWNER_EXCLUDED_TOKENS]
    either = " + ".join(f"CASE WHEN contains(lower(label),'{w}') OR contains(lower(path),'{w}') THEN 1 ELSE 0 END" for w in counted)
    in_path = _sql_words("lower(path)", counted)
    weight = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SYMBOL_OWNER_WEIGHT.items()) + " ELSE 100.0 END"
    names = " + ".join(
        f"CASE WHEN contains(lower(path),'{n.lower()}') THEN {900.0 * SYMBOL_STRENGTH[n]}"
        f" WHEN contains(lower(label),'{n.lower()}') THEN {650.0 * SYMBOL_STRENGTH[n]} ELSE 0.0 END"
        for n in SYMBOL_PLAN.identifiers
        if n.lower() not in C.OWNER_EXCLUDED_TOKENS
    )
    stem = "regexp_replace(lower(split_part(path,'/',-1)),'\\.[^.]*$','')"
    return f"""{weight} + greatest(0.0, 1100.0 - least(coalesce(r.rank,10000),50)*85.0) + {sql_owner_path('s.path')}
 + CASE WHEN r.rank IS NOT NULL THEN 220.0 ELSE 0.0 END - CASE WHEN r.rank IS NULL THEN 400.0 ELSE 0.0 END
 + CASE line_status WHEN 'exact' THEN 120.0 WHEN 'adjusted' THEN 60.0 ELSE 0.0 END
 + CASE WHEN kind IN {sql_in(C.CLASS_KINDS)} AND (lower(label) = {stem} OR (contains(lower(path),'/services/') AND lower(label) = 'i' || {stem})) THEN 820.0 ELSE 0.0 END
 + 90.0*({either}) + 160.0*({in_path}) + {names}
 + CASE WHEN kind IN {sql_in(C.EXECUTABLE_KINDS)} AND ({either}) > 0 THEN 180.0 ELSE 0.0 END"""


_OWNERS = {
    **_SYMBOL_KINDS,
    **RANKED_SQL,
    "owned": f"""SELECT pos, tie, label, kind, line, s.path, r.rank AS file_rank, ({_sql_owner_score()})::DOUBLE AS score FROM (
  SELECT pos, tie, label, kind, path AS path, line, CASE WHEN tie % 3 = 0 THEN 'exact' WHEN tie % 3 = 1 THEN 'adjusted' ELSE 'not_found' END AS line_status FROM sk WHERE kind IS NOT NULL) s
  LEFT JOIN (SELECT path_norm, rank FROM ranked) r ON lower(s.path) = r.path_norm""",
}


def owned_symbols(t: StarTables) -> DataFrame:
    status = F.when(F.col("tie") % 3 == 0, "exact").when(F.col("tie") % 3 == 1, "adjusted").otherwise("not_found")
    symbols = kinded_symbols(t).where(F.col("kind").isNotNull()).withColumn("line_status", status)
    ranked = g.with_file_ranks(symbols, "path", ranked_files(t), "file_rank")
    return ranked.withColumn("score", sy.owner_score(SYMBOL_PLAN, F.col("file_rank")))


@query("primary_owner_scores", with_ctes(["symbols", "files"], "SELECT pos, tie, round(score, 6) AS score FROM owned", _OWNERS))
def primary_owner_scores(t: StarTables) -> DataFrame:
    """Owner score of every symbol."""
    return owned_symbols(t).select("pos", "tie", F.round("score", 6).alias("score"))


@query(
    "primary_owner_rerank",
    with_ctes(
        ["symbols", "files"],
        f"""SELECT pos, tie, label, rank FROM (SELECT *, max(CASE WHEN rank = 1 THEN second END) OVER () AS first_second FROM (
  SELECT *, 0.40*(CASE WHEN contains(lower(path),'order1234') OR contains(lower(label),'order1234') THEN 1.0 ELSE 0.0 END)
   + 0.40*(CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in C.SYMBOL_OWNER_WEIGHT.items())} ELSE 100.0 END)/1100.0
   + 0.15*least(1.0, ({_sql_words('lower(label)', _WIDGET)})/3.0)
   + 0.05*least(1.0, ({' + '.join(f"CASE WHEN contains(lower(path),'{w}') AND NOT contains(lower(label),'{w}') THEN 1 ELSE 0 END" for w in _WIDGET)})/3.0) AS second
  FROM (SELECT *, row_number() OVER (ORDER BY score DESC, line, pos, tie) AS rank FROM owned) WHERE rank <= 10))
ORDER BY CASE WHEN rank > 1 AND second - first_second >= 0.08 THEN second END DESC NULLS LAST, rank LIMIT 1""",
        _OWNERS,
    ),
)
def primary_owner_rerank(t: StarTables) -> DataFrame:
    """Primary owner after the bounded second pass."""
    second = sy.rerank_score(SYMBOL_PLAN, SYMBOL_PLAN.tokens and SYMBOL_PLAN.distinctive, ("Order1234",))
    best = sy.rescored_winner(owned_symbols(t), "score", second, [F.asc("line"), F.asc("pos"), F.asc("tie")])
    return best.select("pos", "tie", "label", F.col("rank").cast("bigint"))


@query(
    "code_block_slots",
    with_ctes(
        ["symbols", "files"],
        """SELECT slot, pos, tie, reserved, CAST(ok AS BOOLEAN) AND sum(ok) OVER (ORDER BY slot) <= 6 AS gets_block FROM (
  SELECT *, row_number() OVER (ORDER BY reserved DESC, rank) AS slot FROM (
    SELECT *, mine AND row_number() OVER (PARTITION BY mine ORDER BY rank) <= 2 AS reserved FROM (
      SELECT *, CASE WHEN tie % 3 < 2 THEN 1 ELSE 0 END AS ok, lower(path) = (SELECT lower(path) FROM ranked WHERE rank = 0) AS mine,
        row_number() OVER (ORDER BY score DESC, line, pos, tie) AS rank FROM owned) WHERE rank <= 24))""",
        _OWNERS,
    ),
)
def code_block_slots(t: StarTables) -> DataFrame:
    """Twenty-four best symbols, two slots kept for the top file, six blocks for verified lines."""
    order = [F.desc("score"), F.asc("line"), F.asc("pos"), F.asc("tie")]
    hits = ranked_top(owned_symbols(t), order, 24)
    first = ranked_files(t).where(F.col("rank") == 0).select("path_norm").scalar()
    slots = sy.reserve_top_file(hits, first, "rank")
    budget = sy.within_block_budget(slots, F.col("tie") % 3 < 2, "slot")
    return budget.select(F.col("slot").cast("bigint"), "pos", "tie", "reserved", "gets_block")
