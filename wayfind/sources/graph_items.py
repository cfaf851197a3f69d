"""Objects in the arrays of large JSON files, read by many tasks.

A graph is one JSON document, so a JSON reader gives a whole file to one task.  Here the text reader cuts files at every ``}``,
in as many splits as their size asks for.  Whether a ``}`` ends an object, and at which depth, depends on all that is before it:
every split counts its quotes and its braces twice, as if it began outside and inside a string; the counts of the splits
before it (one row per split) tell which of the two holds, and give its depth.  Fragments between two ends of objects at depth
one are one array element, whatever is nested in it or quoted in its strings.

A file counts if its quotes and braces close, its root is an object, and its elements are objects; others have no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.sources.listing import only_files, relative_path, scanned_path

#: Text before the first brace outside strings.
_HEAD = r'(?s)^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)\{'
#: A key and the bracket of its array, at the end of a head.
_ARRAY_KEY = r'(?s)"([^"]*)"\s*:\s*\[\s*$'
_OBJECT_KEY = r'(?s)"\s*:\s*$'


def _net_braces(segments: Column, first: int) -> Column:
    """Opening minus closing braces in every other segment between quotes, from the ``first`` one on."""
    outside = F.filter(segments, lambda s, i: (i + first) % 2 == 0)
    text = F.array_join(outside, "")
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def _fragments(spark: SparkSession, base: str, glob: str, uris: tuple[str, ...] | None) -> DataFrame:
    """path, length, block, row, value, and from the start of the block: quotes before, depth after if it began out of (d0) or in (d1) a string."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(base)
    rows = only_files(raw, uris).select(
        relative_path(scanned_path(), base).alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )
    segments = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    rows = rows.withColumns({"quotes": F.size(segments) - 1, "open0": _net_braces(segments, 0), "open1": _net_braces(segments, 1)})
    order = Window.partitionBy("path", "block").orderBy("row")
    rows = rows.withColumn("before", F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    rows = rows.withColumn("after", (F.col("before") + F.col("quotes")) % 2)
    # if the block began in a string, inside and outside change places
    out = F.when(F.col("before") == 0, F.col("open0")).otherwise(F.col("open1")) - F.when(F.col("after") == 0, 1).otherwise(0)
    inv = F.when(F.col("before") == 0, F.col("open1")).otherwise(F.col("open0")) - F.when(F.col("after") == 0, 0).otherwise(1)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("path", "length", "block", "row", "value", "quotes", "after", F.sum(out).over(running).alias("d0"), F.sum(inv).over(running).alias("d1"))


def _starts(fragments: DataFrame) -> DataFrame:
    """Per block: whether it begins in a string, its depth, and whether its file closes."""
    last = F.struct("row", "d0", "d1")
    blocks = fragments.groupBy("path", "length", "block").agg(
        F.sum("quotes").alias("quotes"), F.max(last).alias("last"), F.sum(F.octet_length("value") + 1).alias("bytes")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("last.d0")).otherwise(F.col("last.d1"))
    blocks = blocks.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    # the reader drops the brace at the end of a fragment, and there is none behind the last one if the file goes on after it
    missing = (F.sum("bytes").over(whole) - F.col("length")).cast("int")
    closes = (F.sum("quotes").over(whole) % 2 == 0) & (F.sum(change).over(whole) + missing == 0)
    return blocks.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "inside", "depth", closes.alias("closes"))


def graph_items(
    spark: SparkSession, base: str, glob: str, stage: Callable[[str, DataFrame], DataFrame], arrays: tuple[str, ...] = ("nodes", "links", "edges"),
    uris: tuple[str, ...] | None = None,
) -> DataFrame:
    """(path, length, array, pos, item): every object of the named arrays of the root, as JSON text.

    ``stage`` writes a table and reads it back: the files are scanned once.
    """
    fragments = stage("graph_fragments", _fragments(spark, base, glob, uris))
    on = (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))
    rows = fragments.join(_starts(fragments), on).where("closes")
    outside = (F.col("inside") + F.col("after")) % 2 == 0
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    rows = rows.select("path", "length", "block", "row", "value", (outside & (depth == 1)).cast("int").alias("ends"))
    # elements are numbered in two steps as well: inside a block, then by what the blocks before it hold
    order = Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = stage("graph_parts", rows.withColumn("item", F.coalesce(F.sum("ends").over(order), F.lit(0))))
    counts = rows.groupBy("path", "block").agg(F.sum("ends").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("path").alias("_path"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.join(counts, on).select("path", "length", (F.col("first") + F.col("item")).alias("item"), "block", "row", "value", "ends")
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    whole = numbered.groupBy("path", "length", "item").agg(parts.alias("parts"), F.max("ends").alias("ends")).where("ends = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    # the first element of a file has the root's brace in front of it
    text = F.when(F.col("item") == 0, F.regexp_replace(text, r"(?s)^[\s﻿]*\{", "")).otherwise(text)
    items = whole.select("path", "length", "item", text.alias("text"))
    head = F.regexp_extract("text", _HEAD, 1)
    items = items.select("path", "length", "item", head.alias("head"), F.substr("text", F.length(head) + 1).alias("body"))
    key = F.when(F.col("head").rlike(_ARRAY_KEY), F.regexp_extract("head", _ARRAY_KEY, 1)).when(F.col("head").rlike(_OBJECT_KEY), F.lit(""))
    items = stage("graph_items", items.select("path", "length", "item", key.alias("key"), "body"))
    # a file has a few keys at its root, however many elements their arrays have
    keys = items.where(F.col("key").isNotNull()).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("item", "key"))).alias("keys"))
    placed = items.drop("key").join(keys, "path")
    own = F.element_at(F.filter("keys", lambda k: k["item"] <= F.col("item")), -1)
    placed = placed.select("path", "length", "item", "body", own.alias("own"))
    return placed.where(F.col("own.key").isin(*arrays)).select(
        "path", "length", F.col("own.key").alias("array"), (F.col("item") - F.col("own.item")).cast("int").alias("pos"), F.col("body").alias("item")
    )
