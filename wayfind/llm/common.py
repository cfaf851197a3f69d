"""Helpers shared by the training-data operators: shared scratch tables, split ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.session import is_local

#: ASCII white space of the contracts; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows one task may rank; larger groups are cut into hash buckets first.
RANK_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local master may go without: there a temporary folder is set once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="wayfind-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows: with whole texts in them, ten thousand take too much of an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if the frame has such a column (names clash ignoring case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_of(df: DataFrame) -> Column:
    """The whole row as one struct, so that own columns beside it cannot clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def split_rank(df: DataFrame, keys: list[str], code: str, name: str, ties: list[Column] | None = None) -> DataFrame:
    """Adds ``name``: the rank from 0 of every row within its group, ordered by the hash column ``code``.

    A group is cut into buckets by ``code``; counts per bucket give each bucket its start, and only the rows of a
    bucket are sorted together, so that no task holds a whole hot group.
    """
    total = df.agg(F.count(F.lit(1))).first()[0]
    buckets = max(1, -(-total // RANK_ROWS))
    rows = df.withColumn("_bucket", F.pmod(F.shiftright(F.col(code), 20), F.lit(buckets)))
    by = [*keys, "_bucket"]
    if buckets == 1:
        order = Window.partitionBy(*by).orderBy(code, *(ties or []))
        return rows.withColumn(name, F.row_number().over(order).cast("long") - 1).drop("_bucket")
    starts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    joined = rows.alias("a").join(starts.alias("b"), on, "left").select("a.*", "b._start")
    order = Window.partitionBy(*by).orderBy(code, *(ties or []))
    ranked = joined.withColumn(name, F.col("_start") + F.row_number().over(order) - 1)
    return ranked.drop("_bucket", "_start")


def placed(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The rows as a table sorted by ``by`` over all tasks, with ``task`` and ``place``, the position from 0 among all rows.

    Range partitions split any group; only one row per task is broadcast for the starts.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    rows = written(rows, label).withColumns({"task": F.shiftright("place", 33).cast("int"), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("task").agg(F.count(F.lit(1)).alias("_n")).select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "task").withColumn("place", F.col("place") + F.col("_start")).drop("_start")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds over equi joins: each node only keeps the smallest neighbour it knows,
    which is an aggregate with map-side combine, so a hub is never gathered.  Every round is written.
    """
    graph = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    known = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        # large star: all larger neighbours of a node move to its smallest neighbour
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: all smaller neighbours and the node itself move to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        graph = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("connected components did not settle")
    named = graph.groupBy("u").agg(F.min("v").alias("component"))
    roots = named.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return named.select(F.col("u").alias("node"), "component").unionByName(roots)
