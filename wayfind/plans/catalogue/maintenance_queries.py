"""Chunks, distinct and set operators, repository drift, summaries and answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import paths as pt
from wayfind.operators import chunks as ch
from wayfind.operators import dedup as dd
from wayfind.operators import drift as dr
from wayfind.operators import summaries as sm
from wayfind.plans.catalogue.graph_queries import ENDPOINTS, GRAPH, ORDER, RANKED_SQL, SYMBOL_PLAN, cross_file_hints, ranked_files
from wayfind.plans.catalogue.registry import query
from wayfind.plans.catalogue.text_queries import indexed_documents, sql_facts, sql_lines, sql_strip
from wayfind.sources.starschema import StarTables, with_ctes

# --------------------------------------------------------------------------
# Chunks
# --------------------------------------------------------------------------

_NORMAL = r"""regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda y: regexp_replace(y, '\s+$', '')), lambda y: y <> ''), chr(10)), '^\s+|\s+$', '', 'g')"""


def _last(marker: str, kept: int) -> str:
    """0-based last index of a marker in w plus the kept part of it, if the index is positive."""
    at = f"(length(w) - instr(reverse(w), reverse({marker})) + 1 - length({marker}))"
    return f"WHEN instr(w, {marker}) > 0 AND {at} > 0 THEN {at} + {kept}"


_SPLIT = (
    "CASE "
    + " ".join(
        _last(m, k)
        for m, k in (("chr(10) || '## '", 2), ("chr(10) || '### '", 3), ("chr(10) || '# '", 1), ("chr(10) || '- '", 1), ("'. '", 1), ("chr(10)", 0))
    )
    + " WHEN instr(w, '.') > 0 AND length(w) - instr(reverse(w), '.') >= 200 THEN length(w) - instr(reverse(w), '.') + 1 ELSE length(w) END"
)


@query(
    "chunk_documents",
    f"""WITH RECURSIVE n AS MATERIALIZED (SELECT doc_id, {_NORMAL} AS x FROM documents),
rec(doc_id, start, stop, cur, done, total) AS (
  SELECT doc_id, -1::BIGINT, 0::BIGINT, 0::BIGINT, false, length(x)::BIGINT FROM n WHERE x <> ''
  UNION ALL
  SELECT doc_id, cur, e, greatest(e - 200, cur + 1), e >= total, total FROM (
    SELECT *, CASE WHEN sp THEN cur + split ELSE least(total, cur + 3200) END AS e FROM (
      SELECT *, cur + 3200 < total AND split >= 200 AS sp FROM (SELECT *, {_SPLIT} AS split FROM (
        SELECT r.*, substr(n.x, r.cur + 1, 3200) AS w FROM rec r JOIN n USING (doc_id) WHERE NOT r.done))))
),
pieces AS (SELECT doc_id, x, start, stop, length(regexp_replace(substr(x, start + 1, stop - start), '^\\s+|\\s+$', '', 'g')) AS own FROM rec JOIN n USING (doc_id) WHERE start >= 0),
joined AS (SELECT *, sum(CASE WHEN own >= 200 OR start = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS g FROM pieces)
SELECT doc_id, CAST(g - 1 AS INT) AS ord, length(chunk)::BIGINT AS chars, md5(chunk) AS digest FROM (
  SELECT doc_id, g, regexp_replace(substr(any_value(x), min(start) + 1, max(stop) - min(start)), '^\\s+|\\s+$', '', 'g') AS chunk FROM joined GROUP BY doc_id, g)""",
)
def chunk_documents(t: StarTables) -> DataFrame:
    """Overlapping chunks of every document."""
    chunks = ch.chunk_documents(t.read("documents").select("doc_id", "text"))
    return chunks.select("doc_id", F.col("order").alias("ord"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


# --------------------------------------------------------------------------
# Distinct and set operators
# --------------------------------------------------------------------------


@query(
    "ordered_distinct_ci",
    "SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part) QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) = 1",
)
def ordered_distinct_ci(t: StarTables) -> DataFrame:
    """First spelling of every name, ignoring case."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return dd.distinct_ci(t.read("part").select("p_partkey", name.alias("name")), "name", [F.col("p_partkey")])


@query(
    "suffix_dedup",
    with_ctes(
        ["files"],
        """SELECT path FROM (SELECT file_key, v, path, rank, arg_min(v, rank) OVER (PARTITION BY file_key) AS best FROM (
  SELECT file_key, v, (file_key * 7919 + v * 104729) % 1000003 AS rank, CASE v WHEN 0 THEN path WHEN 1 THEN 'lib/' || array_to_string(string_split(path,'/')[3:], '/') ELSE array_to_string(string_split(path,'/')[3:], '/') END AS path
  FROM files, (VALUES (0),(1),(2)) x(v))) WHERE CASE WHEN best = 2 THEN v = 2 ELSE v <> 2 END""",
    ),
)
def suffix_dedup(t: StarTables) -> DataFrame:
    """Greedy distinct of path variants: a full path, a mirror of it, and their common ending."""
    tail = F.array_join(F.slice(F.split("path", "/"), 3, 99), "/")
    variants = F.array(
        F.struct(F.lit(0).alias("v"), F.col("path").alias("variant")),
        F.struct(F.lit(1).alias("v"), F.concat(F.lit("lib/"), tail).alias("variant")),
        F.struct(F.lit(2).alias("v"), tail.alias("variant")),
    )
    rows = t.files().select("file_key", F.explode(variants).alias("x")).select("file_key", "x.v", F.col("x.variant").alias("path"))
    ranked = rows.withColumn("rank", (F.col("file_key") * 7919 + F.col("v") * 104729) % 1000003)
    return dd.suffix_dedup(ranked, "path", [F.col("rank"), F.col("path")]).select("path")


@query(
    "union_bag",
    "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT source, n_chars FROM documents UNION ALL SELECT * FROM (SELECT source, n_chars FROM documents ORDER BY doc_id LIMIT 80)) GROUP BY source",
)
def union_bag(t: StarTables) -> DataFrame:
    """Bag union in which the first eighty rows count twice."""
    docs = t.read("documents").select("doc_id", "source", "n_chars")
    both = docs.unionByName(docs.orderBy("doc_id").limit(80))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "upper_median_score",
    "SELECT o_orderpriority, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS median FROM orders GROUP BY o_orderpriority",
)
def upper_median_score(t: StarTables) -> DataFrame:
    """Upper median per group without gathering a group."""
    return sm.upper_median(t.read("orders"), "o_orderpriority", "o_totalprice")


# --------------------------------------------------------------------------
# Paths
# --------------------------------------------------------------------------


@query(
    "module_and_pack",
    r"""SELECT page_id, p[i + 1] AS module, CASE WHEN len(p) > i + 1 THEN p[i + 2] END AS pack FROM (
  SELECT page_id, p, CASE WHEN list_position(p, 'en') > 0 AND len(p) > list_position(p, 'en') THEN list_position(p, 'en') WHEN list_position(p, 'http:') > 0 AND len(p) > list_position(p, 'http:') THEN list_position(p, 'http:') END AS i FROM (
    SELECT page_id, string_split(replace(url, '\', '/'), '/') AS p FROM pages))""",
)
def module_and_pack(t: StarTables) -> DataFrame:
    """Module and pack: the two path parts after the first marker folder."""
    found = pt.module_and_pack(F.col("url"), ("en", "http:"))
    return t.read("pages").select("page_id", found.getField("module").alias("module"), found.getField("pack").alias("pack"))


@query(
    "canonical_source_file",
    """SELECT page_id, CASE WHEN instr(url, 'example.com/') > 0 THEN substr(url, instr(url, 'example.com/') + 12) WHEN starts_with(url, 'https://') THEN url ELSE 'src/' || replace(url, 'http://', 'http:/') END AS path FROM pages""",
)
def canonical_source_file(t: StarTables) -> DataFrame:
    """Repository path of a recorded path: mirror cut, known prefix kept, else rooted."""
    path = pt.canonical_source_file(
        F.col("url"), mirror_marker="example.com/", known_prefixes=("https://",), source_root=F.lit("src")
    )
    return t.read("pages").select("page_id", path.alias("path"))


@query(
    "source_location",
    "SELECT l_linestatus, CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber WHEN l_suppkey % 3 = 1 THEN l_partkey END) AS BIGINT) AS total, count(CASE WHEN l_suppkey % 3 < 2 THEN 1 END) AS n FROM lineitem GROUP BY l_linestatus",
)
def source_location(t: StarTables) -> DataFrame:
    """Line numbers parsed from locations of several shapes."""
    shape = F.col("l_suppkey") % 3
    location = (
        F.when(shape == 0, F.concat(F.lit("L"), F.col("l_linenumber").cast("string")))
        .when(shape == 1, F.concat(F.lit("line "), F.col("l_partkey").cast("string"), F.lit(":7")))
        .otherwise(F.lit("unknown"))
    )
    parsed = t.read("lineitem").select("l_linestatus", pt.source_line_number(location).alias("line"))
    return parsed.groupBy("l_linestatus").agg(F.sum("line").alias("total"), F.count("line").alias("n"))


@query(
    "safe_paths",
    with_ctes(["files"], "SELECT v, count(*) AS n, count(*) FILTER (v IN (1,3)) AS escaping FROM (SELECT file_key % 4 AS v FROM files) GROUP BY v"),
)
def safe_paths(t: StarTables) -> DataFrame:
    """Paths that climb out of the repository root."""
    v = F.col("file_key") % 4
    path = (
        F.when(v == 0, F.col("path")).when(v == 1, F.concat(F.lit("a/../../"), "path"))
        .when(v == 2, F.concat(F.lit("a/b/../"), "path")).otherwise(F.concat(F.lit("/etc/"), "path"))
    )
    rows = t.files().select(v.alias("v"), pt.escapes_root(path).alias("out"))
    return rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("out"), 1)).alias("escaping"))


@query(
    "source_type_and_title",
    with_ctes(["docs"], r"""SELECT doc_id, CASE WHEN contains(path,'/behavior/') THEN 'behavior pack' ELSE lower(regexp_extract(split_part(path,'/',-1), '\.[^.]+$')) END AS kind, translate(regexp_replace(split_part(path,'/',-1), '\.[^.]*$', ''), '-_', '  ') AS title FROM docs"""),
)
def source_type_and_title(t: StarTables) -> DataFrame:
    """Source type and title of a document from its path."""
    return t.documents().select("doc_id", pt.source_type_of(F.col("path")).alias("kind"), pt.title_of(F.col("path")).alias("title"))


# --------------------------------------------------------------------------
# Drift
# --------------------------------------------------------------------------

_PACK_SQL = {
    "pack_files": "SELECT DISTINCT 'pack' || (l_suppkey % 20) AS pack, path, l_partkey AS pos FROM lineitem JOIN files ON l_partkey = file_key WHERE l_quantity > 48",
}


def pack_files(t: StarTables) -> DataFrame:
    items = t.read("lineitem").where(F.col("l_quantity") > 48).select("l_suppkey", F.col("l_partkey").alias("file_key"))
    pack = F.concat(F.lit("pack"), (F.col("l_suppkey") % 20).cast("string"))
    return items.join(t.files(), "file_key").select(pack.alias("pack"), "path", F.col("file_key").alias("pos")).distinct()


@query(
    "orphan_files",
    with_ctes(
        ["files"],
        """SELECT f.path, pack AS suggested_pack, coalesce(n, 0) AS confidence FROM files f LEFT JOIN (SELECT folder, arg_min(pack, (-n, pack)) AS pack, max(n) AS n FROM (
  SELECT split_part(path,'/',2) AS folder, pack, count(*) AS n FROM pack_files GROUP BY ALL) GROUP BY folder) b ON split_part(f.path,'/',2) = b.folder WHERE f.path NOT IN (SELECT path FROM pack_files)""",
        _PACK_SQL,
    ),
)
def orphan_files(t: StarTables) -> DataFrame:
    """Files no pack covers, with the pack that fits their folder best."""
    return dr.orphans(t.files(), pack_files(t))


@query(
    "stale_packs",
    with_ctes(
        ["files"],
        """SELECT pack, coalesce(arg_min(reason, pos) FILTER (reason IS NOT NULL), 'up to date') AS reason FROM (SELECT pack, pos, CASE WHEN pack = 'pack3' THEN 'no manifest yet'
  WHEN pos % 401 = 0 THEN 'source file missing on disk: ' || path WHEN pos % 211 = 0 THEN 'file not present in manifest: ' || path WHEN pos % 97 = 0 THEN 'content changed since last build: ' || path END AS reason FROM pack_files) GROUP BY pack""",
        _PACK_SQL,
    ),
)
def stale_packs(t: StarTables) -> DataFrame:
    """First reason why each pack is stale."""
    sources = pack_files(t)
    manifest = sources.where((F.col("pack") != "pack3") & (F.col("pos") % 211 != 0)).select(
        "pack", "pos", F.concat(F.lit("mirror/of/"), "path").alias("key"), F.md5("path").alias("hash")
    )
    live = t.files().where(F.col("file_key") % 401 != 0).select(
        "path", F.when(F.col("file_key") % 97 == 0, F.md5(F.concat("path", F.lit("!")))).otherwise(F.md5("path")).alias("hash")
    )
    return dr.stale_packs(sources, manifest, live)


@query(
    "stale_graphs",
    """SELECT folder, newest_path, newest > graph AS is_stale FROM (SELECT o_custkey % 50 AS folder, max(o_orderdate) AS newest, arg_max('o' || o_orderkey, (o_orderdate, 'o' || o_orderkey)) AS newest_path,
  max(o_orderdate) FILTER (o_orderstatus = 'F') AS graph FROM orders GROUP BY 1)""",
)
def stale_graphs(t: StarTables) -> DataFrame:
    """Folders whose newest source is later than their graph."""
    files = t.read("orders").select(
        (F.col("o_custkey") % 50).alias("folder"), F.concat(F.lit("o"), "o_orderkey").alias("path"),
        F.col("o_orderdate").alias("modified"), "o_orderstatus",
    )
    graphs = files.where(F.col("o_orderstatus") == "F").groupBy("folder").agg(F.max("modified").alias("modified"))
    return dr.stale_graphs(files, graphs)


@query(
    "index_staleness",
    "SELECT max(epoch_us(o_orderdate)) / 1e6 > max(epoch_us(o_orderdate)) FILTER (o_orderstatus <> 'O') / 1e6 + 1 AS is_stale, count(*) AS files FROM orders",
)
def index_staleness(t: StarTables) -> DataFrame:
    """Whether sources changed after the recorded state."""
    seconds = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
    latest, recorded = F.max(seconds), F.max(F.when(F.col("o_orderstatus") != "O", seconds))
    return t.read("orders").agg(dr.index_is_stale(latest, recorded).alias("is_stale"), F.count(F.lit(1)).alias("files"))


_ROOTS = ["http://", "https://", "https://m.", "http://blog.", "ftp://"]


@query(
    "root_rollup",
    f"""SELECT root, count(url) AS files, coalesce(array_to_string(list_sort(list_distinct(list(url)))[1:3], ' '), '') AS paths FROM (SELECT unnest({_ROOTS}) AS root) LEFT JOIN pages ON starts_with(url, root) GROUP BY root""",
)
def root_rollup(t: StarTables) -> DataFrame:
    """Pages under every configured root, with the first three."""
    rolled = dr.root_rollup(t.read("pages").select(F.col("url").alias("path")), _ROOTS, 3)
    return rolled.select("root", "files", F.array_join("paths", " ").alias("paths"))


@query(
    "repository_files",
    with_ctes(["files"], "SELECT module, count(*) AS n FROM (SELECT CASE WHEN suffix(path,'.cs') THEN CASE WHEN split_part(path,'/',2) = 'brand1' THEN split_part(path,'/',3) ELSE split_part(path,'/',2) END ELSE 'ui' END AS module FROM files WHERE split_part(path,'/',3) <> 'hooks' AND NOT regexp_matches(split_part(path,'/',-1), '^Hot.*Dto\\.cs$')) GROUP BY module"),
)
def repository_files(t: StarTables) -> DataFrame:
    """Files per module under the configured roots, ignores applied."""
    roots = [
        {"name": "first", "path": "app/brand1", "extensions": [".cs"]},
        {"name": "backend", "path": "app", "extensions": [".cs"]},
        {"name": "frontend", "path": "app", "extensions": [".tsx"]},
    ]
    listed = dr.repository_files(t.files().select("path"), roots[1:] + roots[:1], ("hooks",), ("Hot*Dto.cs",), {"frontend": "ui"})
    return listed.groupBy("module").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# Summaries and answer checks
# --------------------------------------------------------------------------

_PRIO_SQL = "CASE source_type WHEN 'GRAPH_REPORT.md' THEN 100 WHEN 'index.md' THEN 90 WHEN 'scope-summary.md' THEN 80 WHEN 'source-files.txt' THEN 75 WHEN 'behavior pack' THEN 70 WHEN 'graph.json' THEN 60 WHEN 'manifest.json' THEN 40 ELSE 20 END"


@query(
    "module_summary",
    with_ctes(
        ["docs"],
        f"""SELECT rank, doc_id, source_type, array_to_string(list_filter(list_transform({sql_lines('text')}, lambda y: {sql_strip('y')}), lambda y: y <> '' AND NOT starts_with(y,'#') AND NOT starts_with(y,'|') AND NOT starts_with(y,'```'))[1:4], chr(10)) AS summary
FROM (SELECT *, row_number() OVER (ORDER BY {_PRIO_SQL} DESC, doc_id) AS rank FROM docs WHERE module = 'fr') WHERE rank <= 5 AND source_type IN ('GRAPH_REPORT.md','index.md','scope-summary.md','behavior pack')""",
    ),
)
def module_summary(t: StarTables) -> DataFrame:
    """Opening lines of a module's most important documents."""
    docs = sm.module_documents(t.documents(), "FR")
    texts = sm.summary_texts(docs)
    return texts.join(docs.select("doc_id", "source_type"), "doc_id").select(F.col("rank").cast("bigint"), "doc_id", "source_type", "summary")


@query(
    "module_summary_fallback",
    with_ctes(["docs"], f"SELECT rank, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_PRIO_SQL} DESC, doc_id) AS rank FROM docs WHERE contains(lower(path), 'behavior')) WHERE rank <= 12"),
)
def module_summary_fallback(t: StarTables) -> DataFrame:
    """An unknown module falls back to documents whose path mentions it."""
    return sm.module_documents(t.documents(), "behavior").select(F.col("rank").cast("bigint"), "doc_id")


@query(
    "pack_summary_files",
    with_ctes(
        ["docs", "doc_files"],
        f"""SELECT place, path FROM (SELECT path, row_number() OVER (ORDER BY rank, pos, path) AS place FROM (SELECT rank, pos, path FROM doc_files JOIN (
  SELECT doc_id, row_number() OVER (ORDER BY {_PRIO_SQL} DESC, doc_id) AS rank FROM docs WHERE pack = 'src3' OR contains(lower(path),'src3') QUALIFY rank <= 20) USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY rank, pos, path) = 1)) WHERE place <= 80""",
    ),
)
def pack_summary_files(t: StarTables) -> DataFrame:
    """Distinct files of a pack's documents, first eighty."""
    docs = sm.pack_documents(t.documents(), "src3")
    return sm.summary_files(docs, t.doc_files()).select(F.col("place").cast("bigint"), "path")


@query(
    "pack_summary_facts",
    with_ctes(
        ["docs"],
        f"""SELECT fact FROM (SELECT rank, pos, fact FROM (SELECT rank, unnest(f) AS fact, generate_subscripts(f, 1) AS pos FROM (SELECT rank, {sql_facts('text')} AS f FROM (
  SELECT *, row_number() OVER (ORDER BY {_PRIO_SQL} DESC, doc_id) AS rank FROM docs WHERE pack = 'knowledge' OR contains(lower(path),'knowledge')))) QUALIFY row_number() OVER (PARTITION BY lower(fact) ORDER BY rank, pos) = 1 ORDER BY rank, pos LIMIT 40)""",
    ),
)
def pack_summary_facts(t: StarTables) -> DataFrame:
    """Distinct facts of a pack's documents, first forty."""
    docs = sm.pack_documents(indexed_documents(t), "knowledge", limit=None)
    return sm.summary_facts(docs).select("fact")


@query(
    "dependency_gaps",
    with_ctes(
        GRAPH + ["files"],
        "SELECT DISTINCT lower(target_file) AS target FROM hints WHERE lower(source_file) IN (SELECT path_norm FROM ranked) AND target_file <> '' AND lower(target_file) NOT IN (SELECT path_norm FROM ranked) ORDER BY target LIMIT 10",
        {**ENDPOINTS, **RANKED_SQL},
    ),
)
def dependency_gaps(t: StarTables) -> DataFrame:
    """Dependency targets of the ranked files that are not ranked themselves."""
    ranked = ranked_files(t)
    chain = cross_file_hints(t).join(F.broadcast(ranked.select("path_norm")), F.lower("source_file") == F.col("path_norm"), "left_semi")
    return sm.dependency_gaps(chain, ranked)


@query(
    "answer_edges",
    with_ctes(GRAPH + ["files"], "SELECT pos, tie FROM hints WHERE lower(source_file) IN (SELECT path_norm FROM ranked) OR lower(target_file) IN (SELECT path_norm FROM ranked)", {**ENDPOINTS, **RANKED_SQL}),
)
def answer_edges(t: StarTables) -> DataFrame:
    """Edges with either end among the ranked files (semi join on both ends)."""
    hints = cross_file_hints(t).select("pos", "tie", "source_file", "target_file")
    return sm.restrict_to_paths(hints, ranked_files(t), ["source_file", "target_file"]).select("pos", "tie")


@query(
    "files_without_symbols",
    with_ctes(["files", "symbols"], "SELECT file_key FROM files WHERE path NOT IN (SELECT path FROM symbols WHERE NOT suffix(label, '()'))"),
)
def files_without_symbols(t: StarTables) -> DataFrame:
    """Files without a type symbol, which need one from live source (anti join)."""
    hit = t.symbols().where(~F.col("label").endswith("()")).select("path")
    return t.files().join(hit, "path", "left_anti").select("file_key")


@query(
    "ranked_semi_documents",
    with_ctes(["docs", "doc_files", "files"], "SELECT DISTINCT doc_id FROM doc_files WHERE lower(path) IN (SELECT path_norm FROM ranked)", RANKED_SQL),
)
def ranked_semi_documents(t: StarTables) -> DataFrame:
    """Documents that mention a ranked file (semi join on exploded paths)."""
    ranked = F.broadcast(ranked_files(t).select("path_norm"))
    mentions = t.doc_files().select("doc_id", F.lower("path").alias("path_norm"))
    return mentions.join(ranked, "path_norm", "left_semi").select("doc_id").distinct()


@query(
    "uncovered_packs",
    with_ctes(["docs", "doc_files", "files"], "SELECT DISTINCT pack FROM docs WHERE pack NOT IN (SELECT pack FROM docs JOIN doc_files f USING (doc_id) WHERE lower(f.path) IN (SELECT path_norm FROM ranked))", RANKED_SQL),
)
def uncovered_packs(t: StarTables) -> DataFrame:
    """Packs none of whose files is ranked."""
    docs = t.documents().select("doc_id", "pack")
    paths = t.doc_files().join(docs, "doc_id").select("pack", "path")
    return sm.uncovered_packs(docs.select("pack").distinct(), paths, ranked_files(t))


@query(
    "verified_topics",
    with_ctes(
        ["files", "symbols"],
        """SELECT topic_id, overruled FROM (SELECT o_orderkey AS topic_id, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE '.Order' || o_orderkey || '()' END AS m, path FROM orders JOIN files ON o_custkey = file_key) t,
LATERAL (SELECT m <> 'unknown' AND ((EXISTS (SELECT 1 FROM ps WHERE ps.path = t.path) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.path = t.path AND pl.label = lower(m))) OR (NOT EXISTS (SELECT 1 FROM ps WHERE ps.path = t.path) AND NOT suffix(t.path, '.cs'))) AS overruled)""",
        {"pl": "SELECT DISTINCT path, lower(label) AS label FROM symbols WHERE suffix(label, '()')", "ps": "SELECT DISTINCT path FROM pl"},
    ),
)
def verified_topics(t: StarTables) -> DataFrame:
    """Claims about a method in a file, checked against the symbols."""
    method = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit(".Order"), "o_orderkey", F.lit("()")))
    topics = t.read("orders").join(t.files(), F.col("o_custkey") == F.col("file_key")).select(
        F.col("o_orderkey").alias("topic_id"), F.col("path").alias("primary_file"), method.alias("entry_method"), F.lit(True).alias("file_match")
    )
    hits = t.symbols().where(F.col("label").endswith("()"))
    offered = t.files().where(F.col("path").endswith(".cs"))
    return sm.verified_topics(topics, hits, offered).select("topic_id", "overruled")


@query(
    "prompt_budget",
    "SELECT pos, used FROM (SELECT pos, CAST(sum(least(length(text), 2500)) OVER (ORDER BY pos) AS BIGINT) AS used FROM (SELECT text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents) WHERE pos <= 8) WHERE used <= 14000",
)
def prompt_budget(t: StarTables) -> DataFrame:
    """Leading blocks that fit a character budget; the first overflow ends the list."""
    from wayfind.operators.skew import ranked_top

    blocks = ranked_top(t.read("documents").select("doc_id", "n_chars", "text"), [F.desc("n_chars"), F.asc("doc_id")], 8, rank="pos")
    fit = sm.within_budget(blocks, F.least(F.length("text"), F.lit(2500)), 14000)
    return fit.select(F.col("pos").cast("bigint"), "used")


@query(
    "answer_fingerprint",
    with_ctes(["files"], "SELECT md5(string_agg(path, chr(10) ORDER BY path)) AS fingerprint FROM ranked", RANKED_SQL),
)
def answer_fingerprint(t: StarTables) -> DataFrame:
    """Digest of the ranked paths, independent of their order."""
    return sm.fingerprint(ranked_files(t))


@query(
    "parsed_analysis",
    """SELECT event_id, event_id % 3 <> 2 AS is_valid, CASE event_id % 3 WHEN 0 THEN 'summary|topics' WHEN 1 THEN 'topics' END AS missing FROM events""",
)
def parsed_analysis(t: StarTables) -> DataFrame:
    """Analysis payloads parsed leniently, missing fields listed."""
    v = F.col("event_id") % 3
    raw = (
        F.when(v == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(v == 1, F.replace("props", F.lit("{"), F.lit('{"summary": "x", ')))
        .otherwise(F.lit("not json"))
    )
    parsed = sm.parsed_analysis(raw, ("k", "summary", "topics"))
    return t.read("events").select(
        "event_id", parsed.getField("is_valid").alias("is_valid"), F.array_join(parsed.getField("missing"), "|").alias("missing")
    )
