"""Index-shaped relations derived from the star-schema test tables.

The test tables hold no code base, so the relations of the retrieval model are
*derived* from them, row by row, by Spark: parts become source files, orders and
parts become graph nodes, line items become graph edges, live source lines and
symbols, documents become the document index, ``events``/``labels`` become the
event and outcome logs.  Every derived relation grows with its table.

``CTES`` holds the same derivations as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import text as tx


class StarTables:
    """Lazy readers for the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- files and graph -----------------------------------------------------

    def files(self) -> DataFrame:
        """file_key, module, folder, class_label, path."""
        part = self.read("part")
        even = F.col("p_size") % 2 == 0
        folder = (
            F.when(F.col("p_type") == "STANDARD", "Services")
            .when(F.col("p_type") == "ECONOMY", "Controllers")
            .when(F.col("p_type") == "PROMO", "Jobs")
            .when(F.col("p_type") == "LARGE", "Dtos")
            .when(F.col("p_type") == "SMALL", "Entities")
            .when(even, "components")
            .otherwise("hooks")
        )
        role = (
            F.when(F.col("folder") == "Services", "Service")
            .when(F.col("folder") == "Controllers", "Controller")
            .when(F.col("folder") == "Jobs", "Job")
            .when(F.col("folder") == "Dtos", "Dto")
            .otherwise("")
        )
        extension = (
            F.when(F.col("folder") == "components", ".tsx").when(F.col("folder") == "hooks", ".ts").otherwise(".cs")
        )
        pascal = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
        return (
            part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
            .withColumn("folder", folder)
            .select(
                F.col("p_partkey").alias("file_key"),
                F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("module"),
                "folder",
                F.concat(pascal, role).alias("class_label"),
                F.concat(
                    F.lit("app/"),
                    F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
                    F.lit("/"),
                    F.col("folder"),
                    F.lit("/"),
                    pascal,
                    F.col("p_partkey").cast("string"),
                    role,
                    extension,
                ).alias("path"),
            )
        )

    def nodes(self) -> DataFrame:
        """pos, node_id, label, source_file, source_location."""
        files = self.files()
        classes = files.select(
            F.col("file_key").alias("pos"),
            F.concat(F.lit("p"), "file_key").alias("node_id"),
            F.col("class_label").alias("label"),
            F.col("path").alias("source_file"),
            F.lit("L2").alias("source_location"),
        )
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        methods = orders.join(files, F.col("o_custkey") == F.col("file_key")).select(
            (F.col("o_orderkey") + 1_000_000_000_000).alias("pos"),
            F.concat(F.lit("o"), "o_orderkey").alias("node_id"),
            F.concat(F.lit(".Order"), "o_orderkey", F.lit("()")).alias("label"),
            F.col("path").alias("source_file"),
            F.concat(F.lit("L"), (F.col("o_orderkey") % 40 + 10).cast("string")).alias("source_location"),
        )
        return classes.unionByName(methods)

    def edges(self) -> DataFrame:
        """pos, tie, source_ref, target_ref, relation, source_location; (pos, tie) orders the edges."""
        items = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
        )
        classes = self.files().select(F.col("file_key").alias("l_partkey"), "class_label")
        relation = (
            F.when(F.col("l_linenumber") == 7, "mentions")
            .when(F.col("l_returnflag") == "A", "Calls")
            .when(F.col("l_returnflag") == "N", "uses")
            .otherwise("imports")
        )
        target = (
            F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("ext"), "l_suppkey"))
            .when(F.col("l_linestatus") == "F", F.concat(F.lit("p"), "l_partkey"))
            .otherwise(F.col("class_label"))
        )
        return items.join(classes, "l_partkey").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
            (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")).alias("tie"),
            F.concat(F.lit("o"), "l_orderkey").alias("source_ref"),
            target.alias("target_ref"),
            relation.alias("relation"),
            F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("source_location"),
        )

    def source_lines(self) -> DataFrame:
        """path, line_no, text: one live source line per line item (line numbers are sparse)."""
        items = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_suppkey")
        files = self.files().select(F.col("file_key").alias("l_partkey"), "path", "folder", "class_label")
        order = F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"))
        shape = F.col("l_suppkey") % 4
        backend = (
            F.when(shape == 0, F.concat(F.lit("    public async Task<int> "), order, F.lit("(int id)")))
            .when(shape == 1, F.concat(F.lit("  private int "), order, F.lit("(string name)")))
            .when(shape == 2, F.concat(F.lit("public sealed class "), order))
            .otherwise(F.concat(F.lit("    var total = "), order, F.lit("(7);")))
        )
        frontend = (
            F.when(shape == 0, F.concat(F.lit("export const "), order, F.lit(" = () => {")))
            .when(shape == 1, F.concat(F.lit("export type "), order, F.lit(" = string;")))
            .when(shape == 2, F.concat(F.lit("export default function "), order, F.lit("() {")))
            .otherwise(F.concat(F.lit("const use"), order, F.lit(": Hook = make();")))
        )
        return items.join(files, "l_partkey").select(
            "path",
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
            F.when(F.col("folder").isin("components", "hooks"), frontend).otherwise(backend).alias("text"),
        )

    def symbols(self) -> DataFrame:
        """pos, tie, label, path, line: graph symbols whose hinted line has drifted from the source."""
        items = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
        files = self.files().select(F.col("file_key").alias("l_partkey"), "path", "folder")
        order = F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"))
        label = F.when(F.col("l_suppkey") % 4 == 2, order).otherwise(F.concat(F.lit("."), order, F.lit("()")))
        pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        return items.join(files, "l_partkey").select(
            pos.alias("pos"),
            (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")).alias("tie"),
            label.alias("label"),
            "path",
            (pos + F.col("l_suppkey") % 5 - 2).alias("line"),
        )

    # -- documents -----------------------------------------------------------

    SOURCE_TYPES = (
        "graph chunk", "GRAPH_REPORT.md", "source-files.txt", "behavior pack",
        "index.md", "graph.json", ".md", "scope-summary.md",
    )
    DOC_NAMES = ("chunk", "report", "source-files", "behavior/flow", "index", "graph", "notes", "scope-summary")
    DOC_EXTENSIONS = (".json", ".md", ".txt", ".md", ".md", ".json", ".md", ".md")

    def documents(self) -> DataFrame:
        """doc_id, title, path, source_type, module, pack, source_level, area, text."""
        which = (F.col("doc_id") % 8 + 1).cast("int")

        def pick(values) -> F.Column:
            return F.element_at(F.array(*[F.lit(v) for v in values]), which)

        return self.read("documents").select(
            "doc_id",
            F.substring_index("text", " ", 3).alias("title"),
            F.concat(
                F.lit("knowledge/"), "lang", F.lit("/"), "source", F.lit("/"), pick(self.DOC_NAMES),
                F.lit("-"), F.col("doc_id").cast("string"), pick(self.DOC_EXTENSIONS),
            ).alias("path"),
            pick(self.SOURCE_TYPES).alias("source_type"),
            F.col("lang").alias("module"),
            F.col("source").alias("pack"),
            F.when(F.col("doc_id") % 3 == 0, "secondary").otherwise("central").alias("source_level"),
            F.col("lang").alias("area"),
            "text",
        )

    def doc_files(self) -> DataFrame:
        """doc_id, pos, path: files a document lists, in order."""
        items = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        keys = self.read("documents").select("doc_id")
        files = self.files().select(F.col("file_key").alias("l_partkey"), "path")
        return (
            items.join(keys, F.col("l_orderkey") == F.col("doc_id"))
            .join(files, "l_partkey")
            .select("doc_id", (F.col("l_linenumber") - 1).alias("pos"), "path")
        )

    # -- usage log -----------------------------------------------------------

    def event_log(self) -> DataFrame:
        """Event log with every measured field derived from the stream table."""
        k = F.get_json_object("props", "$.k").cast("int")
        tool = (
            F.when(F.col("event_type") == "view", "search_context")
            .when(F.col("event_type") == "click", "find_code_locations")
            .when(F.col("event_type") == "purchase", "search_context_hybrid")
            .when(F.col("event_type") == "signup", "find_related_files")
            .otherwise("health_check")
        )
        return (
            self.read("events")
            .withColumn("k", k)
            .select(
                "event_id",
                F.col("ts"),
                F.concat(F.lit("q"), F.col("user_id").cast("string"), F.lit(" "), "event_type").alias("query"),
                tool.alias("tool"),
                F.when(F.col("k") % 10 != 9, F.col("value") / (F.col("value") + F.lit(12.0))).alias("confidence"),
                F.when(F.col("k") % 3 == 0, F.lit(None).cast("string"))
                .when(F.col("k") % 3 == 1, "semantic_hash")
                .otherwise("keyword")
                .alias("retrieval_mode"),
                F.when(F.col("user_id") % 2 == 0, "sentence-transformers").otherwise("hash").alias("embedding_backend"),
                (F.col("k") % 13).alias("files_returned"),
                (F.col("k") * 3 % 41).alias("symbol_hits_returned"),
                (F.col("k") % 11).alias("location_hints_returned"),
                (F.col("k") * 7 % 9).alias("dependency_chain_returned"),
                (F.col("k") % 5).alias("related_files_returned"),
                (F.col("k") % 4).alias("code_blocks_returned"),
                (F.col("k") % 6 != 0).alias("primary_owner_present"),
                F.when(F.col("k") % 17 == 0, 2).otherwise(0).alias("gap_searches_fired"),
                F.when(F.col("k") % 34 == 0, 1).otherwise(0).alias("gap_files_added"),
                F.when(F.col("k") % 20 == 0, "FAILED")
                .when(F.col("k") % 20 == 1, "PARTIAL")
                .when(F.col("k") % 20 == 2, "PASSED")
                .alias("analysis_relevance_check"),
                F.when(F.col("k") % 20 < 3, "Medium").alias("analysis_confidence"),
                (F.col("k") % 19 == 3).alias("analysis_parse_incomplete"),
                (F.col("k") % 23 == 5).alias("analysis_parse_error"),
                (F.col("k") % 12).alias("vector_candidate_count"),
                (F.col("k") % 12 % 5).alias("suppressed_vector_count"),
                (F.col("k") * 37 + 100).cast("bigint").alias("context_chars"),
                F.array(
                    F.concat(F.lit("app/f"), F.col("k").cast("string"), F.lit(".cs")),
                    F.concat(F.lit("app/f"), (F.col("k") * 7 % 100).cast("string"), F.lit(".cs")),
                    F.concat(F.lit("lib/f"), (F.col("user_id") % 50).cast("string"), F.lit(".ts")),
                ).alias("top_files"),
                F.when(F.col("user_id") % 10 == 0, "test").otherwise("main").alias("log_source"),
            )
        )

    def outcomes(self) -> DataFrame:
        """Outcome log; every fourth labelled event gets a second, later outcome."""
        events = self.read("events").select(F.col("event_id"), "ts")
        labels = self.read("labels")
        outcome = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "success").otherwise("partial")
        first = labels.join(events, F.col("doc_id") == F.col("event_id")).select(
            F.concat(F.lit("out_a_"), F.col("event_id").cast("string")).alias("outcome_id"),
            "event_id",
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
            outcome.alias("outcome"),
            (F.col("event_id") % 5).cast("int").alias("used_suggested_files"),
            (F.col("event_id") % 3).cast("int").alias("extra_files_read"),
            (F.col("event_id") % 7 == 0).alias("needed_extra_search"),
            F.when(outcome == "success", "none").otherwise("bad_ranking").alias("failure_reason"),
            F.when(outcome == "success", F.array().cast("array<string>"))
            .otherwise(
                F.array(
                    F.concat(F.lit("app/f"), (F.col("event_id") % 100).cast("string"), F.lit(".cs")),
                    F.concat(F.lit("lib/f"), (F.col("event_id") % 60).cast("string"), F.lit(".ts")),
                )
            )
            .alias("missed_files"),
        )
        second = first.where(F.col("event_id") % 4 == 0).select(
            F.concat(F.lit("out_b_"), F.col("event_id").cast("string")).alias("outcome_id"),
            "event_id",
            (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts"),
            F.lit("partial").alias("outcome"),
            "used_suggested_files",
            "extra_files_read",
            F.lit(True).alias("needed_extra_search"),
            F.lit("stale_graph").alias("failure_reason"),
            "missed_files",
        )
        return first.unionByName(second)


# --------------------------------------------------------------------------
# The same derivations as SQL
# --------------------------------------------------------------------------

_PASCAL = (
    "upper(substr(split_part(p_name,' ',1),1,1)) || substr(split_part(p_name,' ',1),2)"
    " || upper(substr(split_part(p_name,' ',2),1,1)) || substr(split_part(p_name,' ',2),2)"
)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "files0": (
        (),
        f"""SELECT p_partkey AS file_key, lower(replace(p_brand,'#','')) AS module, {_PASCAL} AS pascal,
  CASE p_type WHEN 'STANDARD' THEN 'Services' WHEN 'ECONOMY' THEN 'Controllers' WHEN 'PROMO' THEN 'Jobs'
    WHEN 'LARGE' THEN 'Dtos' WHEN 'SMALL' THEN 'Entities'
    ELSE CASE WHEN p_size % 2 = 0 THEN 'components' ELSE 'hooks' END END AS folder FROM part""",
    ),
    "files": (
        ("files0",),
        """SELECT file_key, module, folder, pascal || role AS class_label,
  'app/' || module || '/' || folder || '/' || pascal || file_key || role ||
  CASE folder WHEN 'components' THEN '.tsx' WHEN 'hooks' THEN '.ts' ELSE '.cs' END AS path
FROM (SELECT *, CASE folder WHEN 'Services' THEN 'Service' WHEN 'Controllers' THEN 'Controller'
  WHEN 'Jobs' THEN 'Job' WHEN 'Dtos' THEN 'Dto' ELSE '' END AS role FROM files0)""",
    ),
    "nodes": (
        ("files",),
        """SELECT file_key AS pos, 'p' || file_key AS node_id, class_label AS label, path AS source_file, 'L2' AS source_location FROM files
UNION ALL
SELECT o_orderkey + 1000000000000, 'o' || o_orderkey, '.Order' || o_orderkey || '()', path, 'L' || (o_orderkey % 40 + 10)
FROM orders JOIN files ON o_custkey = file_key""",
    ),
    "edges": (
        ("files",),
        """SELECT l_orderkey*8 + l_linenumber AS pos, l_partkey*10000000 + l_suppkey AS tie, 'o' || l_orderkey AS source_ref,
  CASE WHEN l_suppkey % 10 = 0 THEN 'ext' || l_suppkey WHEN l_linestatus = 'F' THEN 'p' || l_partkey ELSE class_label END AS target_ref,
  CASE WHEN l_linenumber = 7 THEN 'mentions' WHEN l_returnflag = 'A' THEN 'Calls' WHEN l_returnflag = 'N' THEN 'uses' ELSE 'imports' END AS relation,
  'L' || l_linenumber AS source_location
FROM lineitem JOIN files ON l_partkey = file_key""",
    ),
    "source_lines": (
        ("files",),
        """SELECT path, l_orderkey*8 + l_linenumber AS line_no,
  CASE WHEN folder IN ('components','hooks') THEN CASE l_suppkey % 4
      WHEN 0 THEN 'export const Order' || l_orderkey || ' = () => {'
      WHEN 1 THEN 'export type Order' || l_orderkey || ' = string;'
      WHEN 2 THEN 'export default function Order' || l_orderkey || '() {'
      ELSE 'const useOrder' || l_orderkey || ': Hook = make();' END
    ELSE CASE l_suppkey % 4
      WHEN 0 THEN '    public async Task<int> Order' || l_orderkey || '(int id)'
      WHEN 1 THEN '  private int Order' || l_orderkey || '(string name)'
      WHEN 2 THEN 'public sealed class Order' || l_orderkey
      ELSE '    var total = Order' || l_orderkey || '(7);' END END AS text
FROM lineitem JOIN files ON l_partkey = file_key""",
    ),
    "symbols": (
        ("files",),
        """SELECT l_orderkey*8 + l_linenumber AS pos, l_partkey*10000000 + l_suppkey AS tie,
  CASE WHEN l_suppkey % 4 = 2 THEN 'Order' || l_orderkey ELSE '.Order' || l_orderkey || '()' END AS label,
  path, l_orderkey*8 + l_linenumber + l_suppkey % 5 - 2 AS line
FROM lineitem JOIN files ON l_partkey = file_key""",
    ),
    "docs": (
        (),
        f"""SELECT doc_id, array_to_string(string_split(text,' ')[1:3], ' ') AS title,
  'knowledge/' || lang || '/' || source || '/' || {_sql_list(StarTables.DOC_NAMES)}[doc_id % 8 + 1] || '-' || doc_id
    || {_sql_list(StarTables.DOC_EXTENSIONS)}[doc_id % 8 + 1] AS path,
  {_sql_list(StarTables.SOURCE_TYPES)}[doc_id % 8 + 1] AS source_type, lang AS module, source AS pack,
  CASE WHEN doc_id % 3 = 0 THEN 'secondary' ELSE 'central' END AS source_level, lang AS area, text
FROM documents""",
    ),
    "doc_files": (
        ("files",),
        """SELECT doc_id, l_linenumber - 1 AS pos, path FROM lineitem JOIN documents ON l_orderkey = doc_id
JOIN files ON l_partkey = file_key""",
    ),
    "event_log": (
        (),
        """SELECT event_id, ts, 'q' || user_id || ' ' || event_type AS query,
  CASE event_type WHEN 'view' THEN 'search_context' WHEN 'click' THEN 'find_code_locations' WHEN 'purchase' THEN 'search_context_hybrid'
    WHEN 'signup' THEN 'find_related_files' ELSE 'health_check' END AS tool,
  CASE WHEN k % 10 <> 9 THEN value / (value + 12.0) END::DOUBLE AS confidence,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'semantic_hash' ELSE 'keyword' END AS retrieval_mode,
  CASE WHEN user_id % 2 = 0 THEN 'sentence-transformers' ELSE 'hash' END AS embedding_backend,
  k % 13 AS files_returned, k*3 % 41 AS symbol_hits_returned, k % 11 AS location_hints_returned,
  k*7 % 9 AS dependency_chain_returned, k % 5 AS related_files_returned, k % 4 AS code_blocks_returned,
  k % 6 <> 0 AS primary_owner_present,
  CASE WHEN k % 17 = 0 THEN 2 ELSE 0 END AS gap_searches_fired, CASE WHEN k % 34 = 0 THEN 1 ELSE 0 END AS gap_files_added,
  CASE k % 20 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'PASSED' END AS analysis_relevance_check,
  CASE WHEN k % 20 < 3 THEN 'Medium' END AS analysis_confidence,
  k % 19 = 3 AS analysis_parse_incomplete, k % 23 = 5 AS analysis_parse_error,
  k % 12 AS vector_candidate_count, k % 12 % 5 AS suppressed_vector_count, CAST(k*37 + 100 AS BIGINT) AS context_chars,
  ['app/f' || k || '.cs', 'app/f' || (k*7 % 100) || '.cs', 'lib/f' || (user_id % 50) || '.ts'] AS top_files,
  CASE WHEN user_id % 10 = 0 THEN 'test' ELSE 'main' END AS log_source
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k FROM events)""",
    ),
    "outcomes1": (
        (),
        """SELECT 'out_a_' || event_id AS outcome_id, event_id, ts + INTERVAL 1 HOUR AS ts, outcome,
  CAST(event_id % 5 AS INTEGER) AS used_suggested_files, CAST(event_id % 3 AS INTEGER) AS extra_files_read,
  event_id % 7 = 0 AS needed_extra_search, CASE WHEN outcome = 'success' THEN 'none' ELSE 'bad_ranking' END AS failure_reason,
  CASE WHEN outcome = 'success' THEN []::VARCHAR[] ELSE ['app/f' || (event_id % 100) || '.cs', 'lib/f' || (event_id % 60) || '.ts'] END AS missed_files
FROM (SELECT e.event_id, e.ts, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'success' ELSE 'partial' END AS outcome
  FROM labels JOIN events e ON doc_id = e.event_id)""",
    ),
    "outcomes": (
        ("outcomes1",),
        """SELECT * FROM outcomes1 UNION ALL
SELECT 'out_b_' || event_id, event_id, ts + INTERVAL 2 HOUR, 'partial', used_suggested_files, extra_files_read, true, 'stale_graph', missed_files
FROM outcomes1 WHERE event_id % 4 = 0""",
    ),
}


def with_ctes(names: list[str] | tuple[str, ...], body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text of ``body`` behind the derived relations it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered]
    parts += [f"{name} AS MATERIALIZED ({sql})" for name, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def sql_tokens(text: str) -> str:
    """Search tokeniser as a list expression."""
    from wayfind.constants import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    raw = f"regexp_extract_all(lower(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')"
    kept = f"list_filter({raw}, lambda t: length(t) >= 2 AND t NOT IN ({stop}))"
    return (
        f"flatten(list_transform({kept}, lambda t: CASE WHEN length(t) > 3 AND suffix(t,'s') THEN [t, t[:-2]]"
        " WHEN t = 'followup' THEN [t, 'follow', 'up'] ELSE [t] END))"
    )


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
