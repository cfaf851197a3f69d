"""Manifests, discovery of roots, packs and graph folders, and the drift report, over listings derived from the tables.

Lists under a budget are checked here too, over the lines of orders and the turns of conversations.
``pages`` become a listing: host, language and page are folders, and how a URL ends decides whether its file is a project
marker, a graph or a source.  ``documents`` become hashed files below their sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.operators import budget as bg
from wayfind.operators import drift as dr
from wayfind.operators import summaries as sm
from wayfind.plans.catalogue.registry import query
from wayfind.sources import discovery as ds
from wayfind.sources import manifest as mf
from wayfind.sources.starschema import StarTables

GRAPH_FOLDER = "fr"
IGNORED = ("it",)
ROOTS = [{"name": "all", "path": ".", "extensions": [".ts", ".json"]}, {"name": "blog", "path": "blog.tionsh.example.net", "extensions": []}]

_LISTING = r"""listing AS MATERIALIZED (
  SELECT page_id, h || '/' || CASE WHEN mark = 'page.ts' THEN l || '/' || p || '/' || mark ELSE l || '/' || mark END AS path, page_id::DOUBLE AS modified, h, l
  FROM (SELECT page_id, string_split(rest, '/')[1] AS h, string_split(rest, '/')[2] AS l, string_split(rest, '/')[3] AS p,
    CASE WHEN contains(url, '.html') THEN 'package.json' WHEN contains(url, 'utm_') THEN 'graph.json' WHEN contains(url, '#top') THEN 'go.mod'
      WHEN contains(url, '?page') THEN 'app.csproj' ELSE 'page.ts' END AS mark
    FROM (SELECT page_id, url, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS rest FROM pages)) WHERE coalesce(l, '') <> '' AND coalesce(p, '') <> '')"""


def page_listing(t: StarTables) -> DataFrame:
    """(page_id, path, modified, host, lang) of every page with a language and a page part."""
    rest = F.split(F.regexp_extract("url", "^[^:]*://([^?#]*)", 1), "/")
    url = F.col("url")
    mark = (
        F.when(url.contains(".html"), "package.json").when(url.contains("utm_"), "graph.json").when(url.contains("#top"), "go.mod")
        .when(url.contains("?page"), "app.csproj").otherwise("page.ts")
    )
    rows = t.read("pages").select("page_id", F.get(rest, F.lit(0)).alias("host"), F.get(rest, F.lit(1)).alias("lang"), F.get(rest, F.lit(2)).alias("page"), mark.alias("mark"))
    rows = rows.where((F.coalesce("lang", F.lit("")) != "") & (F.coalesce("page", F.lit("")) != ""))
    path = F.when(F.col("mark") == "page.ts", F.concat_ws("/", "host", "lang", "page", "mark")).otherwise(F.concat_ws("/", "host", "lang", "mark"))
    return rows.select("page_id", path.alias("path"), F.col("page_id").cast("double").alias("modified"), "host", "lang")


@query(
    "detected_roots",
    f"""WITH {_LISTING}, marked AS (
  SELECT h, CASE WHEN path LIKE '%/package.json' THEN 0 WHEN path LIKE '%.csproj' THEN 1 WHEN path LIKE '%/go.mod' THEN 3 END AS place FROM listing)
SELECT h AS name, h AS path, CASE min(place) WHEN 0 THEN ['.ts', '.tsx', '.js', '.jsx'] WHEN 1 THEN ['.cs'] ELSE ['.go'] END AS extensions
FROM marked WHERE place IS NOT NULL AND h NOT LIKE '.%' GROUP BY h""",
)
def detected_roots(t: StarTables) -> DataFrame:
    """Source roots inferred from marker files."""
    return ds.detect_roots(page_listing(t))


@query(
    "graph_folders",
    f"""WITH {_LISTING}, found AS (SELECT DISTINCT h FROM listing WHERE l = '{GRAPH_FOLDER}' AND h NOT LIKE '.%')
SELECT h || '/{GRAPH_FOLDER}' AS folder, h AS parent, 'all' AS root, ['.ts', '.json'] AS extensions FROM found""",
)
def graph_folders(t: StarTables) -> DataFrame:
    """Top-most graph folders below nested roots."""
    return ds.graph_folders(page_listing(t), ROOTS, GRAPH_FOLDER, IGNORED)


_STALE = f"""folders AS (SELECT DISTINCT h || '/{GRAPH_FOLDER}' AS folder, h FROM listing WHERE l = '{GRAPH_FOLDER}'),
newest AS (SELECT f.folder, arg_max(s.path, (s.modified, s.path)) AS path, max(s.modified) AS modified FROM folders f JOIN listing s ON s.h = f.h
  WHERE (s.path LIKE '%.ts' OR s.path LIKE '%.json') AND s.l NOT IN ('it') GROUP BY f.folder),
built AS (SELECT h || '/' || l AS folder, max(modified) AS modified FROM listing WHERE path LIKE '%/graph.json' GROUP BY 1),
graphs AS (SELECT f.folder, CASE WHEN b.modified IS NULL THEN 'no graph yet' WHEN n.modified > b.modified THEN 'source changed after the graph (newest: ' || n.path || ')' END AS reason
  FROM folders f LEFT JOIN built b USING (folder) LEFT JOIN newest n USING (folder))"""


def _one_file_per_path(listing: DataFrame) -> DataFrame:
    """The newest of files of one path."""
    return listing.groupBy("path").agg(F.max("modified").alias("modified"))


@query(
    "stale_graph_folders",
    f"""WITH {_LISTING}, {_STALE}
SELECT folder, reason IS NOT NULL AS is_stale, coalesce(reason, 'up to date') AS reason FROM graphs""",
)
def stale_graph_folders(t: StarTables) -> DataFrame:
    """Graph folders with a source newer than their graph."""
    listing = _one_file_per_path(page_listing(t))
    return ds.stale_graph_folders(listing, ds.graph_folders(listing, ROOTS, GRAPH_FOLDER, IGNORED), IGNORED)


@query(
    "discovered_packs",
    """SELECT DISTINCT source AS module, lang AS pack FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND source NOT IN ('src1', 'src2')""",
)
def discovered_packs(t: StarTables) -> DataFrame:
    """Packs by their source lists, without excluded modules."""
    docs = t.read("documents").where("source is not null and lang is not null")
    lists = docs.select(F.concat(F.lit("out/"), "source", F.lit("/"), "lang", F.lit("/raw/source-files.txt")).alias("path"))
    others = docs.select(F.concat(F.lit("out/"), "source", F.lit("/raw/"), "lang", F.lit("/x/source-files.txt")).alias("path"))
    return ds.discover_packs(lists.unionByName(others), "out", ("src1", "src2"))


# the second state of the documents: toxic ones are rewritten, those of low quality are gone, very short ones move to another folder
_STATES = """before AS MATERIALIZED (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, md5(text) AS hash FROM documents),
after AS MATERIALIZED (
  SELECT CASE WHEN n_chars < 200 THEN 'short/' ELSE '' END || source || '/' || lang || '/' || d.doc_id || '.txt' AS path, md5(CASE WHEN l.toxic = 1 THEN text || '!' ELSE text END) AS hash
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1
  UNION ALL SELECT 'benchmark/' || item_id || '.txt', md5(text) FROM benchmark)"""


def document_states(t: StarTables) -> tuple[DataFrame, DataFrame]:
    """(path, hash) of the documents as files, before and after a change."""
    docs = t.read("documents").join(t.read("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    before = t.read("documents").select(path.alias("path"), mf.content_hash(F.col("text")).alias("hash"))
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where(F.coalesce("quality", F.lit(1)) == 1).select(
        F.when(F.col("n_chars") < 200, F.concat(F.lit("short/"), path)).otherwise(path).alias("path"), mf.content_hash(text).alias("hash")
    )
    added = t.read("benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), mf.content_hash(F.col("text")).alias("hash"))
    return before, after.unionByName(added)


@query(
    "manifest_diff",
    f"""WITH {_STATES}, judged AS (
  SELECT coalesce(b.path, a.path) AS path, b.hash AS old_hash, a.hash AS new_hash,
    CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'same' ELSE 'changed' END AS status
  FROM before b FULL JOIN after a ON a.path = b.path
), moved AS (SELECT path, status, coalesce(old_hash, new_hash) AS hash, regexp_extract(path, '[^/]*$') AS name FROM judged WHERE status IN ('added', 'removed')),
n1 AS (SELECT *, row_number() OVER (PARTITION BY hash, name, status ORDER BY path) AS n FROM moved),
p1 AS (SELECT g.path AS old_path, c.path, c.hash FROM n1 g JOIN n1 c ON g.status = 'removed' AND c.status = 'added' AND g.hash = c.hash AND g.name = c.name AND g.n = c.n),
r1 AS (SELECT * FROM moved m WHERE NOT EXISTS (FROM p1 WHERE p1.path = m.path AND m.status = 'added') AND NOT EXISTS (FROM p1 WHERE p1.old_path = m.path AND m.status = 'removed')),
n2 AS (SELECT *, row_number() OVER (PARTITION BY hash, status ORDER BY path) AS n FROM r1),
p2 AS (SELECT g.path AS old_path, c.path, c.hash FROM n2 g JOIN n2 c ON g.status = 'removed' AND c.status = 'added' AND g.hash = c.hash AND g.n = c.n),
r2 AS (SELECT * FROM r1 m WHERE NOT EXISTS (FROM p2 WHERE p2.path = m.path AND m.status = 'added') AND NOT EXISTS (FROM p2 WHERE p2.old_path = m.path AND m.status = 'removed'))
SELECT path, status, NULL::VARCHAR AS old_path, old_hash, new_hash FROM judged WHERE status IN ('same', 'changed')
UNION ALL SELECT path, 'renamed', old_path, hash, hash FROM p1 UNION ALL SELECT path, 'renamed', old_path, hash, hash FROM p2
UNION ALL SELECT path, status, NULL, CASE WHEN status = 'removed' THEN hash END, CASE WHEN status = 'added' THEN hash END FROM r2""",
)
def manifest_diff(t: StarTables) -> DataFrame:
    """Files added, removed, changed, kept and renamed between two states."""
    return mf.diff_manifests(*document_states(t))


_PACK_CHECK = """listed AS (SELECT source AS pack, source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id AS pos FROM documents WHERE source IS NOT NULL),
checked AS (SELECT l.pack, coalesce(arg_min(CASE WHEN a.path IS NULL THEN 'source file missing on disk: ' || l.path
    WHEN a.hash IS DISTINCT FROM b.hash THEN 'content changed since last build: ' || l.path END, l.pos) FILTER (a.path IS NULL OR a.hash IS DISTINCT FROM b.hash), 'up to date') AS reason
  FROM listed l JOIN before b ON b.path = l.path LEFT JOIN after a ON a.path = l.path GROUP BY l.pack)"""


def pack_reasons(t: StarTables) -> DataFrame:
    """Packs (one per source) whose manifest was built on the first state, checked against the second one."""
    before, after = document_states(t)
    docs = t.read("documents").where("source is not null")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    sources = docs.select(F.col("source").alias("pack"), F.col("doc_id").alias("pos"), path.alias("path"))
    built = mf.publishable(mf.build_manifests(sources, before.withColumn("modified", F.lit(None).cast("timestamp"))))
    return dr.stale_packs(sources, built.select("pack", "pos", "key", "hash"), after)


@query("hashed_pack_check", f"WITH {_STATES}, {_PACK_CHECK} SELECT pack, reason FROM checked")
def hashed_pack_check(t: StarTables) -> DataFrame:
    """Stale packs by content hashes that were taken from the files."""
    return pack_reasons(t)


@query(
    "drift_report",
    f"""WITH {_STATES}, {_PACK_CHECK}, {_LISTING}, {_STALE},
covered AS (SELECT DISTINCT h AS pack, path FROM listing WHERE l = 'en'),
real AS (SELECT DISTINCT path FROM listing WHERE h NOT LIKE '.%' AND l NOT IN ('it') AND (path LIKE '%.ts' OR path LIKE '%.json' OR h = 'blog.tionsh.example.net')),
sizes AS (SELECT pack, string_split(path, '/')[2] AS folder, count(*) AS n FROM (SELECT h AS pack, path FROM listing WHERE l = 'en') GROUP BY ALL),
best AS (SELECT folder, arg_min(pack, (-n, pack)) AS pack, max(n) AS n FROM sizes GROUP BY folder),
lonely AS (SELECT path, string_split(path, '/')[2] AS folder FROM real WHERE path NOT IN (SELECT path FROM covered))
SELECT 'uncovered file' AS section, path AS target, true AS needs_work, coalesce(b.pack || ' (' || b.n || ' related files)', 'no pack looks related') AS detail FROM lonely LEFT JOIN best b USING (folder)
UNION ALL SELECT 'pack', pack, reason <> 'up to date', reason FROM checked
UNION ALL SELECT 'graph folder', folder, reason IS NOT NULL, coalesce(reason, 'up to date') FROM graphs""",
)
def drift_report(t: StarTables) -> DataFrame:
    """Uncovered files, stale packs and stale graph folders in one report."""
    listing = page_listing(t)
    covered = listing.where(F.col("lang") == "en").select(F.col("host").alias("pack"), "path")
    return ds.drift_report(_one_file_per_path(listing), ROOTS, covered, pack_reasons(t), GRAPH_FOLDER, IGNORED)


# -- lists under a budget ---------------------------------------------------


@query(
    "block_backfill",
    """WITH rows AS (SELECT l_orderkey AS a, l_linenumber AS pos, 'S' || l_suppkey AS path, l_returnflag = 'R' AS has_block, l_linestatus = 'O' AS is_block, l_quantity > 20 AS leading, l_returnflag = 'N' AS safe FROM lineitem),
blocks AS (SELECT a, pos, path FROM rows WHERE is_block),
want AS (SELECT a, pos, path, row_number() OVER (PARTITION BY a ORDER BY pos, path) AS n FROM rows r WHERE NOT has_block
  AND EXISTS (FROM rows w WHERE w.a = r.a AND w.path = r.path AND w.leading) AND NOT EXISTS (FROM blocks b WHERE b.a = r.a AND b.path = r.path)),
marked AS (SELECT b.*, EXISTS (FROM rows p WHERE p.a = b.a AND p.path = b.path AND p.safe) AS safe FROM blocks b),
placed AS (SELECT m.*, row_number() OVER (PARTITION BY a, safe ORDER BY pos DESC, path DESC) AS tail, count(*) OVER (PARTITION BY a) AS have, (SELECT count(*) FROM want WHERE want.a = m.a) AS wants FROM marked m),
judged AS (SELECT a, pos, path, CASE WHEN NOT safe AND tail <= wants - greatest(0, 2 - have) THEN 'evicted' ELSE 'kept' END AS action FROM placed),
kept AS (SELECT a, count(*) FILTER (action = 'kept') AS n FROM judged GROUP BY a)
SELECT a AS answer_id, action, pos, path FROM judged
UNION ALL SELECT w.a, 'new', w.pos, w.path FROM want w LEFT JOIN kept k ON k.a = w.a WHERE w.n <= greatest(0, 2 - coalesce(k.n, 0))""",
)
def block_backfill(t: StarTables) -> DataFrame:
    """Blocks kept, evicted from the tail and filled in for leading files, two per order."""
    rows = t.read("lineitem").select(
        F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("path"),
        (F.col("l_returnflag") == "R").alias("has_block"), "l_linestatus", "l_quantity", "l_returnflag",
    )
    blocks, window, safe = rows.where("l_linestatus = 'O'"), rows.where("l_quantity > 20"), rows.where("l_returnflag = 'N'")
    return bg.backfill_blocks(rows, blocks.select("answer_id", "pos", "path"), window, 2, safe)


_PROMPT_LINES = """lines AS (
  SELECT conv_id AS a, 0 AS section, min(turn) AS pos, arg_min(text, turn) || chr(10) AS line FROM conversations GROUP BY conv_id
  UNION ALL SELECT conv_id, 3, turn, '  - ' || role || ' in ' || 'turn/' || turn || ' [' || role || ']' FROM conversations WHERE turn < 30
  UNION ALL SELECT conv_id, 6, turn, '  - ' || substr(text, 1, 80) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 15 AND text <> '')"""


@query(
    "assembled_prompts",
    f"""WITH {_PROMPT_LINES},
texts AS (SELECT a, section, CASE section WHEN 0 THEN '## Task' WHEN 3 THEN '## Symbol Hits' ELSE '## Facts' END || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY a, section),
base AS (SELECT a, string_agg(text, chr(10) || chr(10) ORDER BY section) AS base FROM texts GROUP BY a),
entries AS (SELECT conv_id AS a, turn AS pos, chr(10) || chr(10) || '[b' || turn || '] turn/' || turn || ' — ' || role || chr(10) || '```' || chr(10) || substr(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 2500) || chr(10) || '```' AS entry
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 8 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
fit AS (SELECT e.*, base, 14 + sum(length(entry)) OVER (PARTITION BY e.a ORDER BY pos) AS used FROM entries e JOIN base USING (a)),
code AS (SELECT a, string_agg(entry, '' ORDER BY pos) AS code, count(*) AS blocks FROM fit WHERE 4000 - length(base) >= 200 AND used <= 4000 - length(base) GROUP BY a)
SELECT a AS answer_id, length(prompt) AS chars, blocks, md5(prompt) AS digest FROM (
  SELECT a, base || CASE WHEN code IS NULL THEN '' ELSE chr(10) || chr(10) || '## Code Blocks' || code END AS prompt, coalesce(blocks, 0) AS blocks FROM base LEFT JOIN code USING (a))""",
)
def assembled_prompts(t: StarTables) -> DataFrame:
    """A prompt per conversation: its task, turns and facts, and the turns as blocks while they fit."""
    turns = t.read("conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("pos"), "role", "text")
    path = F.concat(F.lit("turn/"), F.col("pos").cast("string"))
    task = turns.groupBy("answer_id").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    symbols = turns.where("pos < 30").select("answer_id", "pos", F.col("role").alias("label"), path.alias("path"), F.col("role").alias("kind"))
    facts = turns.select("answer_id", "pos", F.substring("text", 1, 80).alias("text"))
    blocks = turns.select("answer_id", "pos", F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"), path.alias("path"), F.col("role").alias("symbol"), "text")
    lines = bg.prompt_lines({"task": task, "symbols": symbols, "facts": facts})
    out = bg.assemble_prompts(lines, bg.block_entries(blocks), 4000)
    return out.select("answer_id", F.col("chars").cast("long"), F.col("blocks").cast("long"), F.md5("prompt").alias("digest"))


@query(
    "selected_blocks",
    """WITH blocks AS (SELECT l_orderkey || '-' || l_linenumber AS block_id, l_returnflag, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos FROM lineitem),
chosen AS (SELECT block_id FROM blocks WHERE pos <= 40 AND l_returnflag = 'R')
SELECT block_id, pos FROM blocks WHERE pos <= 40 AND CASE WHEN (SELECT count(*) FROM chosen) > 0 THEN block_id IN (FROM chosen) ELSE pos <= 3 END""",
)
def selected_blocks(t: StarTables) -> DataFrame:
    """Blocks that an analysis chose, else the first three."""
    from wayfind.operators.skew import ranked_top

    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    top = ranked_top(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 40, rank="pos")
    blocks = top.withColumn("block_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    chosen = blocks.where("l_returnflag = 'R'").select("block_id")
    return sm.selected_blocks(blocks, chosen).select("block_id", F.col("pos").cast("long"))
