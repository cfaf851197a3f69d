"""Vector expressions: similarity, and the signed hashing embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.text import embedding_tokens, explode_costly


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot_with(vector: Column, weights: list[float]) -> Column:
    """Inner product with a constant vector, unrolled so that it stays in generated code."""
    total = F.lit(0.0)
    for index, weight in enumerate(weights):
        total = total + F.get(vector, F.lit(index)).cast("double") * F.lit(float(weight))
    return total


def cosine(left: Column, right: Column) -> Column:
    """Cosine; 0 for empty vectors, different lengths and zero norms."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (norms > 0)
    return F.when(usable, dot(left, right) / norms).otherwise(F.lit(0.0))


def hash_bucket(term: Column, dimensions: int) -> Column:
    """First four SHA-1 bytes, big endian, modulo the dimensions."""
    return (F.conv(F.substring(F.sha1(term.cast("binary")), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")


def hash_sign(term: Column) -> Column:
    """Parity of the fifth SHA-1 byte."""
    byte = F.conv(F.substring(F.sha1(term.cast("binary")), 9, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hash_embedding_cells(docs: DataFrame, key: str, text: str, dimensions: int = C.EMBED_DIMENSIONS) -> DataFrame:
    """Sparse hashing embedding: one row (key, bucket, value) per non-zero cell.

    Unigrams weigh 1, bigrams less.  Terms are counted before they are hashed and
    cells are summed map-side, so the shuffle carries one row per cell of a text.
    Values are L2-normalised and rounded to six digits.
    """
    dims = max(32, int(dimensions))
    tokens = docs.select(F.col(key), embedding_tokens(F.col(text)).alias("tokens"))
    terms = tokens.select(
        key,
        explode_costly(
            F.concat(
                F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"))),
                F.when(
                    F.size("tokens") > 1,
                    F.zip_with(
                        F.slice("tokens", F.lit(1), F.size("tokens") - 1),
                        F.slice("tokens", F.lit(2), F.size("tokens") - 1),
                        lambda a, b: F.struct(
                            F.concat(a, F.lit(" "), b).alias("term"), F.lit(C.BIGRAM_WEIGHT).alias("weight")
                        ),
                    ),
                ).otherwise(F.array().cast("array<struct<term:string,weight:double>>")),
            )
        ).alias("t"),
    ).select(key, "t.term", "t.weight").where(F.col("term").isNotNull())
    cells = (
        terms.select(
            key,
            hash_bucket(F.col("term"), dims).alias("bucket"),
            (hash_sign(F.col("term")) * F.col("weight")).alias("signed"),
        )
        .groupBy(key, "bucket")
        .agg(F.sum("signed").alias("cell"))
    )
    norms = cells.groupBy(key).agg(F.sqrt(F.sum(F.col("cell") * F.col("cell"))).alias("norm"))
    return (
        cells.join(norms, key)
        .where((F.col("norm") > 0) & (F.abs("cell") > 1e-12))
        .select(key, "bucket", F.round(F.col("cell") / F.col("norm"), 6).alias("value"))
    )


def dense_vector(entries: Column, dimensions: int) -> Column:
    """Array of ``dimensions`` doubles from an array of (bucket, value) structs."""
    as_map = F.map_from_entries(entries)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at(as_map, i), F.lit(0.0))
    )


def hash_embeddings(docs: DataFrame, key: str, text: str, dimensions: int = C.EMBED_DIMENSIONS) -> DataFrame:
    """Dense hashing embeddings: the per-text list is bounded by the dimensions."""
    dims = max(32, int(dimensions))
    cells = hash_embedding_cells(docs, key, text, dims)
    packed = cells.groupBy(key).agg(F.collect_list(F.struct("bucket", "value")).alias("entries"))
    return docs.select(key).join(packed, key, "left").select(
        key,
        dense_vector(
            F.coalesce("entries", F.array().cast("array<struct<bucket:int,value:double>>")), dims
        ).alias("vector"),
    )
