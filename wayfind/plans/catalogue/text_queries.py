"""Tokenisers, scalar functions, extraction and keyword scoring over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import classify as cl
from wayfind.functions import identifiers as ids
from wayfind.functions import paths as pt
from wayfind.functions import text as tx
from wayfind.functions import vectors as vec
from wayfind.operators import scoring
from wayfind.operators.skew import ranked_top
from wayfind.plans.catalogue.registry import query
from wayfind.plans.catalogue.settings import GAP_TABLE, MODULE_VOCABULARY, PLAN, SYNONYMS
from wayfind.sources.starschema import StarTables, sql_in, sql_tokens, with_ctes

TOKENS = sql_tokens("text")

# --------------------------------------------------------------------------
# SQL building blocks
# --------------------------------------------------------------------------

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_LINES = r"regexp_split_to_array({x}, '\r\n|\n|\r')"


def sql_strip(x: str) -> str:
    return _STRIP.format(x=x)


def sql_lines(x: str) -> str:
    return _LINES.format(x=x)


def _provenance(marker: str) -> str:
    return f"contains(lower(y),'{marker}')"


def sql_facts(x: str) -> str:
    lines = f"list_transform({sql_lines(x)}, lambda y: {sql_strip('y')})"
    kept = (
        f"list_filter({lines}, lambda y: length(y) >= 25 AND NOT starts_with(y,'#') AND NOT starts_with(y,'|')"
        " AND NOT starts_with(y,'```'))"
    )
    clipped = f"list_transform({kept}, lambda y: CASE WHEN length(y) > 400 THEN substr(y,1,397) || '...' ELSE y END)"
    stated = (
        f"list_filter({clipped}, lambda y: NOT ({' OR '.join(_provenance(m) for m in C.PROVENANCE_MARKERS)}) AND"
        " (starts_with(y,'-') OR starts_with(y,'*') OR contains(y,':')"
        " OR contains(y,'->') OR contains(y,'=')))"
    )
    return sql_distinct_ci(f"list_transform(({stated}), lambda y: regexp_replace(y, '^[-* ]+|[-* ]+$', '', 'g'))")


def sql_distinct_ci(values: str) -> str:
    return (
        f"list_filter({values}, lambda v, i: list_position(list_transform({values}, lambda w: lower(w)), lower(v)) = i)"
    )


FIELD_ROWS = f"""
  SELECT doc_id, 'title' AS field, title AS content FROM docs UNION ALL SELECT doc_id, 'path', path FROM docs
  UNION ALL SELECT doc_id, 'module', module FROM docs UNION ALL SELECT doc_id, 'pack', pack FROM docs
  UNION ALL SELECT doc_id, 'source_type', source_type FROM docs UNION ALL SELECT doc_id, 'text', text FROM docs
  UNION ALL SELECT doc_id, 'files', path FROM doc_files
  UNION ALL SELECT doc_id, 'facts', array_to_string({sql_facts('text')}, ' ') FROM docs"""


def sql_term_rows(fields: str) -> str:
    return f"""SELECT doc_id, field, term, count(*) AS tf FROM (
      SELECT doc_id, field, unnest({sql_tokens('content')}) AS term FROM ({fields})) GROUP BY ALL"""


def sql_weight(field: str) -> str:
    return "CASE " + field + " " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in C.FIELD_WEIGHTS.items()) + " ELSE 0 END"


QUERY_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in PLAN.tokens)


def sql_multipliers() -> str:
    """The multipliers of the sample plan, written out by hand in order."""
    owner = "source_type IN ('graph.json','dependency-edges.enrichment.json')"
    steps = [
        ("source_type IN ('GRAPH_REPORT.md','source-files.txt','scope-summary.md','behavior pack','index.md')", 1.12),
        (owner, 0.95),
        ("source_type = 'graph chunk'", 1.08),
        ("module IN ('en')", 1.45),
        ("module NOT IN ('en') AND module <> ''", 0.82),
        ("source_level = 'secondary'", 1.45),
        (f"({owner} OR source_type IN ('graph chunk','GRAPH_REPORT.md','source-files.txt'))", 1.18),
        ("source_type IN ('index.md','scope-summary.md')", 0.72),
        (f"({owner} OR source_type IN ('source-files.txt','graph chunk'))", 1.5),
        ("source_level = 'secondary'", 1.35),
        ("source_type IN ('index.md','scope-summary.md','.md')", 0.68),
        ("source_type = 'behavior pack' AND NOT regexp_matches(lower(path), 'api-map|source-files|data-dictionary|runtime-verification')", 0.78),
        ("source_type = 'behavior pack'", 1.35),
        ("source_level = 'secondary'", 0.88),
        ("contains(lower(path), 'runtime-verification')", 1.5),
        (f"({owner} OR source_type IN ('graph chunk','source-files.txt','GRAPH_REPORT.md'))", 1.35),
        ("source_type IN ('index.md','scope-summary.md')", 0.58),
        ("contains(lower(area || ' ' || path || ' ' || title), 'services')", 1.12),
        ("source_type IN ('index.md','scope-summary.md')", 0.78),
        ("source_type = 'behavior pack'", 1.15),
    ]
    return " * ".join(f"(CASE WHEN {cond} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END)" for cond, factor in steps)


def sql_identifier_bonus() -> str:
    parts = []
    for word in (w.lower() for w in PLAN.identifiers):
        parts.append(
            f"CASE WHEN contains(lower(path),'{word}') OR contains(lower(title),'{word}') OR"
            f" EXISTS (SELECT 1 FROM doc_files f WHERE f.doc_id = docs.doc_id AND contains(lower(f.path),'{word}'))"
            f" THEN 160.0 WHEN contains(lower(text),'{word}') THEN 70.0 ELSE 0.0 END"
        )
    return " + ".join(parts) or "0.0"


SCORED_CTES = {
    "field_rows": FIELD_ROWS,
    "doc_terms": sql_term_rows("SELECT * FROM field_rows"),
    "qt": QUERY_ROWS,
    "ts": f"SELECT doc_id, sum(({sql_weight('field')})::DOUBLE * least(tf, 8)) AS s FROM doc_terms JOIN qt USING (term) GROUP BY doc_id",
    "additive": f"SELECT docs.*, coalesce(s, 0.0) + {sql_identifier_bonus()} AS base FROM docs LEFT JOIN ts USING (doc_id)",
    "scored": f"SELECT *, base::DOUBLE * {sql_multipliers()} AS score FROM additive WHERE base > 0",
}


def indexed_documents(t: StarTables) -> DataFrame:
    return t.documents().withColumn("facts", tx.fact_lines(F.col("text")))


def scored_documents(t: StarTables) -> DataFrame:
    documents, files = indexed_documents(t), t.doc_files()
    terms = scoring.build_doc_terms(documents, files)
    return scoring.score_documents(documents, terms, PLAN, doc_files=files)


# --------------------------------------------------------------------------
# Keyword search
# --------------------------------------------------------------------------


@query(
    "keyword_topk",
    with_ctes(
        ["docs", "doc_files"],
        "SELECT rank, doc_id, path, source_type, round(score, 4) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 25",
        SCORED_CTES,
    ),
)
def keyword_topk(t: StarTables) -> DataFrame:
    """Flagship: field-weighted keyword score with all multipliers, best 25 documents."""
    top = ranked_top(scored_documents(t), [F.desc("score"), F.asc("doc_id")], 25)
    return top.select(F.col("rank").cast("bigint"), "doc_id", "path", "source_type", F.round("score", 4).alias("score"))


@query(
    "document_scores",
    with_ctes(["docs", "doc_files"], "SELECT doc_id, round(score, 4) AS score FROM scored", SCORED_CTES),
)
def document_scores(t: StarTables) -> DataFrame:
    """Score of every matching document (no cut)."""
    return scored_documents(t).select("doc_id", F.round("score", 4).alias("score"))


@query(
    "field_term_index",
    with_ctes(
        ["docs", "doc_files"],
        "SELECT field, count(*) AS postings, count(DISTINCT term) AS terms, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(least(tf, 8)) AS BIGINT) AS capped FROM doc_terms GROUP BY field",
        {k: SCORED_CTES[k] for k in ("field_rows", "doc_terms")},
    ),
)
def field_term_index(t: StarTables) -> DataFrame:
    """Size of the inverted table by field."""
    terms = scoring.build_doc_terms(indexed_documents(t), t.doc_files())
    by_term = terms.groupBy("field", "term").agg(
        F.count(F.lit(1)).alias("postings"),
        F.sum("tf").alias("occurrences"),
        F.sum(F.least(F.col("tf"), F.lit(C.TF_CAP))).alias("capped"),
    )
    return by_term.groupBy("field").agg(
        F.sum("postings").alias("postings"),
        F.count(F.lit(1)).alias("terms"),
        F.sum("occurrences").alias("occurrences"),
        F.sum("capped").alias("capped"),
    )


@query(
    "phrase_bonus",
    with_ctes(
        ["docs"],
        f"""SELECT doc_id, CAST((CASE WHEN contains(lower(title),'that') THEN 20 ELSE 0 END) + (CASE WHEN contains(lower(path),'that') THEN 20 ELSE 0 END)
  + (CASE WHEN contains(lower(module),'that') THEN 20 ELSE 0 END) + (CASE WHEN contains(lower(pack),'that') THEN 20 ELSE 0 END)
  + (CASE WHEN contains(lower(array_to_string({sql_facts('text')},' ')),'that') THEN 20 ELSE 0 END) AS DOUBLE) AS bonus FROM docs""",
    ),
)
def phrase_bonus(t: StarTables) -> DataFrame:
    """Phrase containment bonus over the five phrase fields."""
    from dataclasses import replace

    plan = replace(PLAN, text=" That ", identifiers=())
    found = scoring.containment(indexed_documents(t), plan).select("doc_id", F.col("gain").alias("bonus"))
    return t.documents().select("doc_id").join(found, "doc_id", "left").fillna(0.0, ["bonus"])


@query(
    "score_multipliers",
    with_ctes(["docs"], f"SELECT doc_id, round(100.0::DOUBLE * {sql_multipliers()}, 6) AS score FROM docs"),
)
def score_multipliers(t: StarTables) -> DataFrame:
    """Intent, source and layer multipliers applied to a constant base."""
    return t.documents().select("doc_id", F.round(scoring.apply_multipliers(F.lit(100.0), PLAN), 6).alias("score"))


# --------------------------------------------------------------------------
# Tokenisers and token functions
# --------------------------------------------------------------------------


@query(
    "token_frequency",
    f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term",
)
def token_frequency(t: StarTables) -> DataFrame:
    """Corpus and document frequency of every search token."""
    tokens = t.read("documents").select("doc_id", tx.explode_costly(tx.search_tokens(F.col("text"))).alias("term")).where(F.col("term").isNotNull())
    per_doc = tokens.groupBy("term", "doc_id").count()
    return per_doc.groupBy("term").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(
    "embedding_token_counts",
    "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) AS token FROM documents) GROUP BY token",
)
def embedding_token_counts(t: StarTables) -> DataFrame:
    """Frequencies under the embedding tokeniser."""
    return (
        t.read("documents")
        .select(tx.explode_costly(tx.embedding_tokens(F.col("text"))).alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "path_name_tokens",
    "SELECT page_id, token FROM (SELECT DISTINCT page_id, unnest(regexp_split_to_array(lower(split_part(url,'/',-1)), '[^a-z0-9]+')) AS token FROM pages) WHERE token <> ''",
)
def path_name_tokens(t: StarTables) -> DataFrame:
    """Tokens of the last path component of every page."""
    return t.read("pages").select("page_id", F.explode(tx.path_name_tokens(F.col("url"))).alias("token"))


_WORD_RUN = (
    "regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[À-ÖØ-öø-ÿ][A-Za-z0-9_À-ÖØ-öø-ÿ]*', ' ', 'g'),"
    " '\\b[A-Za-z_][A-Za-z0-9_.]{2,}\\b')"
)
_STOP_SQL = sql_in(C.STOP_WORDS)
_IDENT_SQL = f"""flatten(list_transform(list_filter({_WORD_RUN}, lambda w: lower(w) NOT IN {_STOP_SQL}),
  lambda w: CASE WHEN contains(w,'.') THEN list_filter(string_split(w,'.'), lambda p: length(p) >= 3)
    WHEN w <> lower(w) OR regexp_matches(w,'[_0-9]') OR length(w) >= 15 THEN [w] ELSE []::VARCHAR[] END))"""
_LOGGED = "SELECT conv_id, turn, text FROM conversations"


@query(
    "query_identifiers",
    f"""SELECT conv_id, turn, array_to_string(ids,'|') AS identifiers,
  array_to_string(list_filter(ids, lambda w: regexp_matches(w,'[_0-9]') OR (w = lower(w) AND length(w) >= 15) OR regexp_matches(w,'[a-z][A-Z]')),'|') AS strict
FROM (SELECT conv_id, turn, {sql_distinct_ci('raw')} AS ids FROM (SELECT conv_id, turn, {_IDENT_SQL} AS raw FROM ({_LOGGED})))""",
)
def query_identifiers(t: StarTables) -> DataFrame:
    """Code-like identifiers of every logged query, and the strict subset."""
    found = t.read("conversations").select("conv_id", "turn", ids.query_identifiers(F.col("text")).alias("ids"))
    return found.select(
        "conv_id",
        "turn",
        F.array_join("ids", "|").alias("identifiers"),
        F.array_join(ids.strict_identifiers(F.col("ids")), "|").alias("strict"),
    )


@query(
    "named_files",
    f"SELECT page_id, name FROM (SELECT DISTINCT page_id, lower(unnest(list_filter({_WORD_RUN.replace('text', 'html')}, lambda w: contains(w,'.')))) AS name FROM pages)",
)
def named_files(t: StarTables) -> DataFrame:
    """Dotted names mentioned in raw text."""
    return t.read("pages").select("page_id", F.explode(ids.named_files(F.col("html"))).alias("name"))


@query(
    "expanded_query_tokens",
    f"""SELECT item_id, token, count(*) AS n FROM (
  SELECT item_id, unnest({TOKENS}) AS token FROM benchmark
  UNION ALL SELECT item_id, extra FROM (SELECT DISTINCT item_id, unnest({TOKENS}) AS trigger FROM benchmark)
    JOIN (VALUES ('permission','thatin'),('permission','access'),('elle','ment'),('service','orre')) s(trigger, extra) USING (trigger)
) GROUP BY ALL""",
)
def expanded_query_tokens(t: StarTables) -> DataFrame:
    """Query tokens with the profile's synonyms appended (constant map, no join)."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), cl.lit_array(v))])
    tokens = t.read("benchmark").select("item_id", tx.search_tokens(F.col("text")).alias("tokens"))
    extras = F.flatten(F.transform(F.array_distinct("tokens"), lambda w: F.coalesce(F.element_at(table, w), cl.lit_array(()))))
    return (
        tokens.select("item_id", F.explode(F.concat("tokens", extras)).alias("token"))
        .groupBy("item_id", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "normalized_text",
    r"""SELECT doc_id, length(n) AS chars, md5(n) AS digest FROM (SELECT doc_id,
  regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda y: regexp_replace(y, '\s+$', '')), lambda y: y <> ''), chr(10)), '^\s+|\s+$', '', 'g') AS n FROM documents)""",
)
def normalized_text(t: StarTables) -> DataFrame:
    """Whitespace normal form that chunking starts from."""
    n = t.read("documents").select("doc_id", tx.normalized_text(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").cast("bigint").alias("chars"), F.md5("n").alias("digest"))


@query(
    "extracted_facts",
    f"SELECT doc_id, pos - 1 AS pos, fact FROM (SELECT doc_id, unnest(f) AS fact, generate_subscripts(f, 1) AS pos FROM (SELECT doc_id, {sql_facts('text')} AS f FROM documents))",
)
def extracted_facts(t: StarTables) -> DataFrame:
    """Statement-like lines of every document."""
    facts = t.read("documents").select("doc_id", F.posexplode_outer(tx.fact_lines(F.col("text"))).alias("pos", "fact")).where(F.col("fact").isNotNull())
    return facts.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "fact")


_SNIPPET_TOKENS = "['" + "','".join(PLAN.tokens) + "']"


@query(
    "best_snippets",
    f"""SELECT doc_id, rn AS rank, line FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, length(line), pos) AS rn FROM (
    SELECT doc_id, pos, line, len(list_filter({_SNIPPET_TOKENS}, lambda k: contains(lower(line), k))) AS hits FROM (
      SELECT doc_id, unnest(c) AS line, generate_subscripts(c, 1) AS pos FROM (
        SELECT doc_id, list_concat({sql_facts('text')}, list_transform(list_filter(list_transform({sql_lines('text')}, lambda y: {sql_strip('y')}),
          lambda y: y <> '' AND NOT starts_with(y,'#') AND NOT starts_with(y,'|') AND NOT starts_with(y,'```')),
          lambda y: CASE WHEN length(y) > 280 THEN substr(y,1,277) || '...' ELSE y END)) AS c FROM documents)))
  WHERE hits > 0) WHERE rn <= 3""",
)
def best_snippets(t: StarTables) -> DataFrame:
    """Three best matching lines of every document."""
    docs = t.read("documents").select("doc_id", "text", tx.fact_lines(F.col("text")).alias("facts"))
    snippets = tx.best_snippets(F.col("facts"), F.col("text"), list(PLAN.tokens))
    return docs.select("doc_id", F.posexplode_outer(snippets).alias("pos", "line")).where(F.col("line").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "line"
    )


@query(
    "first_useful_lines",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform({sql_lines('text')}, lambda y: {sql_strip('y')}),
  lambda y: y <> '' AND NOT starts_with(y,'#') AND NOT starts_with(y,'|') AND NOT starts_with(y,'```'))[1:4], chr(10)) AS summary FROM documents""",
)
def first_useful_lines(t: StarTables) -> DataFrame:
    """First four prose lines of every document."""
    return t.read("documents").select("doc_id", tx.first_useful_lines(F.col("text")).alias("summary"))


@query(
    "significant_terms",
    f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({TOKENS}, lambda w: length(w) >= 4 AND w NOT IN {sql_in(C.LOW_SIGNAL_QUERY_TERMS + ('rewh',))}))), ' ') AS terms FROM benchmark""",
)
def significant_terms(t: StarTables) -> DataFrame:
    """Distinct query terms that carry signal."""
    terms = ids.significant_terms(tx.search_tokens(F.col("text")), ("rewh",))
    return t.read("benchmark").select("item_id", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query(
    "informative_tokens",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM conversations)
WHERE length(token) >= 3 AND token NOT IN {sql_in(C.STOP_WORDS + C.OWNER_EXCLUDED_TOKENS + C.GENERIC_FILE_TOKENS)} GROUP BY token""",
)
def informative_tokens(t: StarTables) -> DataFrame:
    """Tokens of the query log that count towards confidence."""
    tokens = t.read("conversations").select(tx.explode_costly(tx.search_tokens(F.col("text"))).alias("token"))
    return tokens.where(cl.is_informative(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_embedding_cells",
    """WITH tok AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') AS ts FROM benchmark),
terms AS (SELECT item_id, unnest(ts) AS term, 1.0::DOUBLE AS w FROM tok
  UNION ALL SELECT item_id, unnest(list_transform(ts[1:len(ts)-1], lambda a, i: a || ' ' || ts[i+1])), 0.55::DOUBLE FROM tok),
cells AS (SELECT item_id, CAST(('0x' || substr(sha1(term),1,8))::BIGINT % 384 AS INTEGER) AS bucket,
  sum(CASE WHEN ('0x' || substr(sha1(term),9,2))::INTEGER % 2 = 0 THEN w ELSE -w END) AS cell FROM terms GROUP BY ALL),
norms AS (SELECT item_id, sqrt(sum(cell*cell)) AS norm FROM cells GROUP BY item_id)
SELECT item_id, bucket, round(cell / norm, 6) AS value FROM cells JOIN norms USING (item_id) WHERE norm > 0 AND abs(cell) > 1e-12""",
)
def hash_embedding_cells(t: StarTables) -> DataFrame:
    """Signed hashing embedding of the question set, one row per non-zero cell."""
    return vec.hash_embedding_cells(t.read("benchmark"), "item_id", "text")


@query(
    "named_file_strength",
    with_ctes(
        ["files"],
        f"""SELECT file_key, CASE WHEN len(own) = 0 THEN 1.0 ELSE greatest(0.4, len(list_filter(own, lambda w: w IN ('red','widget','service','ring'))) / len(own)) END::DOUBLE AS strength
FROM (SELECT file_key, list_distinct(list_filter({sql_tokens("translate(regexp_replace(split_part(path,'/',-1), '[.][^.]*$', ''), '_-', '  ')")}, lambda w: w NOT IN {sql_in(C.GENERIC_FILE_TOKENS)})) AS own FROM files)""",
    ),
)
def named_file_strength(t: StarTables) -> DataFrame:
    """How far four query words cover the distinctive words of each file name."""
    strength = ids.named_file_strength(
        pt.base_name(F.col("path")), cl.lit_array(["red", "widget", "service", "ring"]), C.GENERIC_FILE_TOKENS
    )
    return t.files().select("file_key", strength.alias("strength"))


def _sql_canon(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > 4 AND suffix({w},'ies') THEN {w}[:-4] || 'y' WHEN length({w}) > 3 AND suffix({w},'ie') THEN {w}[:-3] || 'y'"
        f" WHEN length({w}) > 3 AND suffix({w},'s') AND NOT suffix({w},'ss') THEN {w}[:-2] ELSE {w} END"
    )


def _sql_canon_words(x: str) -> str:
    return f"list_transform(list_filter({sql_tokens(x)}, lambda t: t NOT IN {sql_in(C.GENERIC_FILE_TOKENS)}), lambda c: {_sql_canon('c')})"


@query(
    "identifier_corroboration",
    f"""WITH q AS (SELECT conv_id, turn, text, {sql_distinct_ci('raw')} AS ids FROM (SELECT conv_id, turn, text, {_IDENT_SQL} AS raw FROM ({_LOGGED}))),
inside AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_sql_canon_words('id')}) AS w FROM (SELECT conv_id, turn, unnest(ids) AS id FROM q)) GROUP BY ALL),
spoken AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform({TOKENS}, lambda c: {_sql_canon('c')})) AS w FROM conversations) GROUP BY ALL),
own AS (SELECT DISTINCT conv_id, turn, id, unnest({_sql_canon_words('id')}) AS w FROM (SELECT conv_id, turn, unnest(ids) AS id FROM q)),
frac AS (SELECT conv_id, turn, id, sum(CASE WHEN coalesce(s.n,0) > coalesce(i.n,0) THEN 1 ELSE 0 END) / count(*) AS f
  FROM own LEFT JOIN spoken s USING (conv_id, turn, w) LEFT JOIN inside i USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, id AS identifier, CASE WHEN f IS NULL THEN 1.0 ELSE round(greatest(0.4, f), 6) END::DOUBLE AS strength
FROM (SELECT conv_id, turn, unnest(ids) AS id FROM q) LEFT JOIN frac USING (conv_id, turn, id)""",
)
def identifier_corroboration(t: StarTables) -> DataFrame:
    """How far a query's own words back each identifier it names."""
    q = t.read("conversations").select(
        "conv_id", "turn", tx.search_tokens(F.col("text")).alias("tokens"), ids.query_identifiers(F.col("text")).alias("ids")
    )
    one = q.select("conv_id", "turn", "tokens", "ids", F.explode("ids").alias("identifier"))
    strength = ids.corroboration_strength(F.col("identifier"), F.col("tokens"), F.col("ids"), C.GENERIC_FILE_TOKENS)
    return one.select("conv_id", "turn", "identifier", F.round(strength, 6).alias("strength"))


_ACCENTED = "À-ÖØ-öø-ÿ"
#: The text with every word that has an accented letter blanked out, so that positions stay.
_MASKED = f"""array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_{_ACCENTED}]+|[^A-Za-z0-9_{_ACCENTED}]+'),
  lambda t: CASE WHEN regexp_matches(t, '[{_ACCENTED}]') THEN repeat(' ', length(t)) ELSE t END), '')"""
_MENTION = "'\\b[A-Za-z_][A-Za-z0-9_.]{2,}\\b'"
_CUE = r"""'(?i)\b(?:not|never|without|except|excluding|neither|nor)\b|n''t\b|\brather than\b|\binstead of\b|\bno longer\b'"""


@query(
    "negated_identifiers",
    f"""WITH m AS (SELECT conv_id, turn, text, regexp_extract_all(masked, {_MENTION}) AS words, string_split_regex(masked, {_MENTION}) AS gaps FROM (SELECT conv_id, turn, text, {_MASKED} AS masked FROM conversations)),
w AS (SELECT conv_id, turn, text, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap, generate_subscripts(words, 1) AS pos FROM m),
p AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS stop FROM w),
n AS (SELECT conv_id, turn, lower(word) AS word FROM p
  WHERE regexp_matches(substr(text, CAST(greatest(0, stop - length(word) - 40) AS INT) + 1, CAST(stop + 40 - greatest(0, stop - length(word) - 40) AS INT)), {_CUE})),
d AS (SELECT DISTINCT conv_id, turn, unnest(list_filter([word] || string_split(word, '.'), lambda x: x <> '')) AS name FROM n)
SELECT conv_id, turn, coalesce(names, '') AS negated FROM conversations LEFT JOIN (SELECT conv_id, turn, string_agg(name, '|' ORDER BY name) AS names FROM d GROUP BY ALL) USING (conv_id, turn)""",
)
def negated_identifiers(t: StarTables) -> DataFrame:
    """Identifiers of logged queries that have a negation cue nearby."""
    return t.read("conversations").select(
        "conv_id", "turn", F.array_join(F.array_sort(ids.negated_identifiers(F.col("text"))), "|").alias("negated")
    )


@query(
    "gap_queries",
    f"""SELECT conv_id, turn, CASE WHEN contains(lower(text),'thatin') OR contains(lower(text),'inoran') THEN 'inoran service thatin'
  WHEN contains(lower(text),'keit') THEN 'keit controller'
  ELSE array_to_string(list_filter(regexp_extract_all(lower(text),'[a-zA-Z]+'), lambda w: length(w) > 2 AND w NOT IN {sql_in(C.GAP_QUERY_STOP_WORDS)})[1:6], ' ') END AS gap_query FROM conversations""",
)
def gap_queries(t: StarTables) -> DataFrame:
    """Re-search query for every logged issue text."""
    return t.read("conversations").select("conv_id", "turn", ids.gap_query(F.col("text"), GAP_TABLE).alias("gap_query"))


@query(
    "confidence_curve",
    "SELECT event_id, round(CASE WHEN value <= 0 THEN 0.0 ELSE least(0.95, value / (value + 45.0)) END::DOUBLE, 9) AS confidence, round(least(1.0, value / 60.0)::DOUBLE, 9) AS saturation FROM events",
)
def confidence_curve(t: StarTables) -> DataFrame:
    """Saturating confidence of raw scores."""
    return t.read("events").select(
        "event_id",
        F.round(cl.raw_score_confidence(F.col("value")), 9).alias("confidence"),
        F.round(cl.saturating(F.col("value"), 60), 9).alias("saturation"),
    )


@query(
    "stable_ids",
    with_ctes(
        ["files"],
        """SELECT file_key, 'doc_' || substr(sha1(path || ':'),1,16) AS doc_ref, 'doc_' || substr(sha1(path || ':' || class_label),1,16) AS chunk_ref,
  'blk_' || substr(md5(path || '::' || class_label || '::' || file_key),1,12) AS block_ref FROM files""",
    ),
)
def stable_ids(t: StarTables) -> DataFrame:
    """Document, chunk and code-block ids."""
    return t.files().select(
        "file_key",
        pt.stable_id(F.col("path")).alias("doc_ref"),
        pt.stable_id(F.col("path"), F.col("class_label")).alias("chunk_ref"),
        pt.code_block_id(F.col("path"), F.col("class_label"), F.col("file_key")).alias("block_ref"),
    )


@query(
    "source_list_lines",
    r"""SELECT page_id, name FROM (SELECT page_id, regexp_replace(regexp_replace(replace(url,'.html','.md'), '^\s+|\s+$', '', 'g'), '^[-*` ]+|[-*` ]+$', '', 'g') AS name FROM pages)
WHERE regexp_matches(name, '(?i)\.(cs|tsx|ts|js|json|sql|md|yaml|yml)$')""",
)
def source_list_lines(t: StarTables) -> DataFrame:
    """File-naming lines of raw text."""
    lines = tx.source_file_lines(F.replace("url", F.lit(".html"), F.lit(".md")))
    return t.read("pages").select("page_id", F.explode(lines).alias("name"))


# --------------------------------------------------------------------------
# Many questions at once: the first turn of every conversation asks the document index
# --------------------------------------------------------------------------

#: What every query's multipliers hold; the invented words of the questions ask for nothing more.
_PLAIN_MULTIPLIERS = " * ".join(
    f"(CASE WHEN {cond} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END)"
    for cond, factor in (
        ("source_type IN ('GRAPH_REPORT.md','source-files.txt','scope-summary.md','behavior pack','index.md')", 1.12),
        ("source_type IN ('graph.json','dependency-edges.enrichment.json')", 0.95),
        ("source_type = 'graph chunk'", 1.08),
        ("source_type IN ('index.md','scope-summary.md')", 0.78),
        ("source_type = 'behavior pack'", 1.15),
    )
)
_ASKED_CTES = {
    "field_rows": FIELD_ROWS,
    "doc_terms": sql_term_rows("SELECT * FROM field_rows"),
    "asked": f"SELECT conv_id AS question_id, text, lower(trim(text)) AS phrase, {sql_distinct_ci('raw')} AS ids FROM (SELECT conv_id, text, {_IDENT_SQL} AS raw FROM conversations WHERE turn = 0)",
    "qt": f"SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({sql_tokens('text')}) AS term FROM asked) GROUP BY ALL",
    "gains": f"SELECT question_id, doc_id, sum(({sql_weight('field')})::DOUBLE * least(tf, 8) * times) AS gain FROM doc_terms JOIN qt USING (term) GROUP BY ALL",
    "low": f"SELECT doc_id, lower(path) AS path, lower(title) AS title, lower(module) AS module, lower(pack) AS pack, lower(text) AS text, lower(array_to_string({sql_facts('text')}, ' ')) AS facts FROM docs",
    "needles": "SELECT question_id, lower(unnest(ids)) AS needle FROM asked",
    "words": "SELECT DISTINCT needle FROM needles",
    "in_files": "SELECT DISTINCT w.needle, f.doc_id FROM words w JOIN doc_files f ON contains(lower(f.path), w.needle)",
    "in_docs": """SELECT w.needle, d.doc_id, contains(d.path, w.needle) OR contains(d.title, w.needle) AS named FROM words w JOIN low d
      ON contains(d.path, w.needle) OR contains(d.title, w.needle) OR contains(d.text, w.needle)""",
    "bonus": """SELECT needle, doc_id, CASE WHEN bool_or(named) THEN 160.0 ELSE 70.0 END AS gain FROM (SELECT needle, doc_id, named FROM in_docs UNION ALL SELECT needle, doc_id, true FROM in_files) GROUP BY ALL""",
    "phrases": """SELECT a.question_id, d.doc_id, 20.0 * (contains(d.title, a.phrase)::INT + contains(d.path, a.phrase)::INT + contains(d.module, a.phrase)::INT + contains(d.pack, a.phrase)::INT + contains(d.facts, a.phrase)::INT) AS gain
      FROM asked a JOIN low d ON length(a.phrase) >= 4 AND (contains(d.title, a.phrase) OR contains(d.path, a.phrase) OR contains(d.module, a.phrase) OR contains(d.pack, a.phrase) OR contains(d.facts, a.phrase))""",
    "additive": """SELECT question_id, doc_id, sum(gain) AS base FROM (SELECT * FROM gains UNION ALL SELECT question_id, doc_id, gain::DOUBLE FROM needles JOIN bonus USING (needle) UNION ALL SELECT question_id, doc_id, gain::DOUBLE FROM phrases) GROUP BY ALL""",
    "answers": f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT question_id, doc_id, base * {_PLAIN_MULTIPLIERS} AS score FROM additive JOIN docs USING (doc_id) WHERE base > 0)",
}


def conversation_questions(t: StarTables) -> DataFrame:
    return t.read("conversations").where("turn = 0").select(F.col("conv_id").alias("question_id"), "text")


def conversation_answers(t: StarTables) -> DataFrame:
    from wayfind.plans.batch import search_questions

    # dealt by document once: terms are counted and gathered where a document's text and files lie
    documents, files = indexed_documents(t), t.doc_files().repartition("doc_id")
    terms = scoring.build_doc_terms(documents.repartition("doc_id"), files)
    return search_questions(documents, terms, conversation_questions(t), 10, doc_files=files)


@query(
    "question_search",
    with_ctes(["docs", "doc_files"], "SELECT question_id, rank, doc_id, round(score, 4) AS score FROM answers WHERE rank <= 10", _ASKED_CTES),
)
def question_search(t: StarTables) -> DataFrame:
    """The ten best documents of every conversation's first turn, as one plan."""
    return conversation_answers(t).select("question_id", F.col("rank").cast("bigint"), "doc_id", F.round("score", 4).alias("score"))


@query(
    "question_replay",
    with_ctes(
        ["docs", "doc_files"],
        """SELECT question_id, count(*) AS expected, count(rank) AS found, count(rank) / count(*) AS recall, min(rank) AS first_rank
FROM (SELECT DISTINCT question_id, doc_id FROM in_files JOIN needles USING (needle)) LEFT JOIN (SELECT question_id, doc_id, rank FROM answers WHERE rank <= 10) USING (question_id, doc_id) GROUP BY question_id""",
        _ASKED_CTES,
    ),
)
def question_replay(t: StarTables) -> DataFrame:
    """How many of the documents that list a file named by a question are among its answers."""
    from wayfind.plans.batch import coverage_of_named, files_with_needles, question_needles
    from wayfind.plans.query import plan_questions
    from wayfind.session import cut_lineage

    planned = cut_lineage(plan_questions(conversation_questions(t)).select("question_id", "identifiers", "phrase"))
    needles = question_needles(planned).where(~F.col("is_phrase"))
    hits = cut_lineage(files_with_needles(t.doc_files().repartition("doc_id"), needles))
    found = coverage_of_named(conversation_answers(t), hits, needles)
    return found.select("question_id", "expected", "found", "recall", F.col("first_rank").cast("bigint"))


_PACK_FILES = [(("tion", "thth", "erth"), ("app/pack/First.cs", "app/pack/Second.cs")), (("thing", "thti", "thea"), ("app/pack/Second.cs", "app/pack/Third.tsx"))]


@query(
    "injected_pack_files",
    f"""WITH q AS (SELECT conv_id AS question_id, {sql_tokens('text')} AS ts FROM conversations WHERE turn = 0),
hit AS (SELECT question_id, len(list_intersect(ts, ['tion', 'thth', 'erth'])) > 0 AS a, len(list_intersect(ts, ['thing', 'thti', 'thea'])) > 0 AS b FROM q),
files AS (SELECT question_id, list_distinct_in_order AS paths FROM (SELECT question_id, CASE WHEN a AND b THEN ['app/pack/First.cs', 'app/pack/Second.cs', 'app/pack/Third.tsx'] WHEN a THEN ['app/pack/First.cs', 'app/pack/Second.cs']
  WHEN b THEN ['app/pack/Second.cs', 'app/pack/Third.tsx'] ELSE [] END AS list_distinct_in_order FROM hit))
SELECT question_id, i AS pos, paths[i + 1] AS path FROM files, unnest(range(len(paths))) r(i)""",
)
def injected_pack_files(t: StarTables) -> DataFrame:
    """Files that a profile adds to questions by their words, from its table function."""
    from wayfind.plans.hooks import injected_files
    from wayfind.plans.query import plan_questions
    from wayfind.sources.profile import TableProfile

    planned = plan_questions(conversation_questions(t))
    return injected_files(planned, TableProfile(pack_files=_PACK_FILES)).select("question_id", F.col("pos").cast("long"), "path")
