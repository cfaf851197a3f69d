"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.common import small_batches
from wayfind.llm.manifest import verify_rows
from wayfind.llm.mixing import mix_documents
from wayfind.llm.multi_index import link_vectors
from wayfind.llm.personal_data import find_personal_data
from wayfind.llm.piece_lattice import decode_documents, encode_documents, load_model
from wayfind.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_openings
from wayfind.llm.quality_rules import STATS, judge_documents
from wayfind.llm.sharding import shard_documents
from wayfind.llm.suffix_dedup import remove_repeats
from wayfind.llm.token_counts import count_tokens
from wayfind.llm.token_file import token_digests
from wayfind.llm.url_filter import filter_urls
from wayfind.llm.weighted_minhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules that the URL contract fixes.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``; ``sql`` is its DuckDB twin."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            small_batches(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_URL_SQL = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), fits AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""


@query("op2_url_filter", _URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page URL judged by the longest rule found in the digest array."""
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op4_entropy_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document gives to the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query("op8_balanced_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of equal row counts, copies kept together."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", *STATS, "base_failed", "kept")


@query("op1_rans_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in a rANS file, read back."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans and those the span classifier adds."""
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_multi_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within their labels."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


@query("op9_weighted_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document among near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_piece_lattice")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and the text they decode to, as checksums."""
    model = load_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    return decode_documents(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        F.crc32(F.encode("decoded", "UTF-8")).alias("text_crc32"),
    )


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages cut from every whole text."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_array_merge")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


#: A table for crc32 of the decimal digits of numbers, made by the usual rule, and the checksum of a number ``{0}`` beside it.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c // 256, crc_table.t[xor(c % 256, b) + 1])), 4294967295)"""


def _merkle_sql(levels: int = 8, upper: int = 4) -> str:
    """Every level as its own table: enough for 16^levels rows of a source and 16^upper sources."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        _CRC_TABLE,
        f"""leaves AS (
  SELECT doc_id, source, sha256({leaf.format(text="text")}) AS leaf,
    CASE WHEN {_CRC.format("doc_id")} % 5 = 0 THEN sha256({leaf.format(text=low)}) ELSE sha256({leaf.format(text="text")}) END AS other
  FROM documents, crc_table
), trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
ranked AS (SELECT l.*, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source),
a0 AS (SELECT tree, pos, leaf AS digest FROM ranked)""",
    ]
    for name, n in (("a", levels), ("b", upper)):
        for k in range(1, n + 1):
            parts.append(f"""{name}{k} AS (
  SELECT tree, pos // 16 AS pos, CASE WHEN any_value(many) THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many FROM {name}{k - 1}) GROUP BY tree, pos // 16)""")
        if name == "a":
            parts.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, digest FROM a{n})")
    # the siblings of a place on every level: left and right of it, and whether the level exists (more than one node)
    for name, n in (("a", levels), ("b", upper)):
        for k in range(n):
            parts.append(f"""{name}s{k} AS (
  SELECT x.tree, x.pos, any_value(m.c) > 1 AS deep, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
    coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM {name}{k} x JOIN {name}{k} y ON x.tree = y.tree AND x.pos // 16 = y.pos // 16
  JOIN (SELECT tree, count(*) AS c FROM {name}{k} GROUP BY tree) m ON m.tree = x.tree GROUP BY x.tree, x.pos)""")
    before = "SELECT doc_id, leaf, tree, pos, other AS seen, '' AS proof FROM ranked"
    step = "CASE WHEN s.deep THEN sha256(s.l || w.seen || s.r) ELSE w.seen END AS seen, CASE WHEN s.deep THEN w.proof || s.l || s.r ELSE w.proof END AS proof"
    parts.append(f"w0 AS ({before})")
    for k in range(levels):
        parts.append(f"w{k + 1} AS (SELECT w.doc_id, w.leaf, w.tree, w.pos, {step} FROM w{k} w JOIN as{k} s ON s.tree = w.tree AND s.pos = w.pos // {16**k})")
    for k in range(upper):
        parts.append(f"w{levels + k + 1} AS (SELECT w.doc_id, w.leaf, w.tree, w.pos, {step} FROM w{levels + k} w JOIN bs{k} s ON s.pos = w.tree // {16**k})")
    return f"""WITH {", ".join(parts)}
SELECT w.doc_id, w.leaf, a.digest AS subroot, b.digest AS root, sha256(w.proof) AS proof_sha256, w.seen AS folded_root, w.seen = b.digest AS verified
FROM w{levels + upper} w JOIN a{levels} a ON a.tree = w.tree CROSS JOIN b{upper} b"""


@query("op13_interval_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verification of every document after tampering with a fifth of them."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return verify_rows(table(spark, sf_dir, "documents"), fields, "source", "doc_id", chosen, {"text": lower})


_TRIE_SQL = f"""
WITH {_CRC_TABLE}, own AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS code, strlen(coalesce(text, '')) AS n_bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {_CRC.format("conv_id")} % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS base
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
), opening AS (
  SELECT c.conv_id, o.pos, o.code, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
), rebuilt AS (
  SELECT * FROM opening
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + coalesce(k.n, 0), o.code, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
    LEFT JOIN (SELECT conv_id, count(*) AS n FROM opening GROUP BY conv_id) k ON k.conv_id = c.conv_id
), paths AS (
  SELECT c.conv_id, coalesce(list(r.code ORDER BY r.pos) FILTER (r.code IS NOT NULL), []) AS codes, coalesce(list(r.n_bytes ORDER BY r.pos) FILTER (r.code IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, len(codes) = d AS ended, sha256(array_to_string(codes[:d], '')) AS node, sha256(array_to_string(codes[:d - 1], '')) AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_bytes
  FROM (SELECT *, unnest(range(len(codes) + 1)) AS d FROM paths)
), nodes AS (
  SELECT depth, node, CASE WHEN depth > 0 THEN any_value(above) END AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), counted AS (
  SELECT n.*, coalesce(k.c, 0) AS n_children FROM nodes n LEFT JOIN (SELECT depth - 1 AS depth, above, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY ALL) k ON k.depth = n.depth AND k.above = n.node
), pairs AS (
  SELECT DISTINCT x.depth, x.node, y.depth AS below_depth, y.node AS below FROM prefixes x JOIN prefixes y ON x.conv_id = y.conv_id AND x.depth <= y.depth
), sums AS (
  SELECT p.depth, p.node, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.n_bytes)::BIGINT AS saved_tokens
  FROM pairs p JOIN counted c ON c.depth = p.below_depth AND c.node = p.below GROUP BY p.depth, p.node
)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.node = c.node LEFT JOIN counted u ON u.depth = c.depth - 1 AND u.node = c.above
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared openings."""
    return prefix_trie(*with_shared_openings(*numbered_turns(table(spark, sf_dir, "conversations"))))
