"""Distinct operators that keep the first spelling or the best-ranked path variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.paths import base_name, normalized_path
from wayfind.operators.skew import first_per_key
from wayfind.session import cut_lineage


def distinct_ci(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """One row per lower-cased value: the first in order, with its own spelling."""
    keyed = df.withColumn("_k", F.lower(column))
    return first_per_key(keyed, ["_k"], order, df.columns).drop("_k")


def proper_suffixes(path: Column) -> Column:
    """All shorter forms of a path that start after a slash."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def suffix_dedup(df: DataFrame, path: str, order: list[Column]) -> DataFrame:
    """Greedy distinct in rank order: a row goes if a kept path equals it, ends with it, or is its end.

    Distributed and exact.  Every path is joined with its own shorter forms (an
    equi join, so the pairs number at most rows x depth, and a hot file name
    makes no quadratic group).  Then rounds: an undecided path that precedes all
    its undecided relatives is kept, its relatives are dropped.  The rounds work
    only on paths that have relatives at all.  All joins are merge joins: broadcasts
    of every join of every round would add up on the driver.
    """
    keyed = df.withColumn("_path", normalized_path(F.col(path)))
    # the path itself closes the order, so that no two paths share a rank
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("_path").alias("p"))
    # written once: a sum that is computed again may differ in its last digit, and the ranks are joined on below
    keyed = cut_lineage(keyed.withColumn("_rank", rank))
    best = cut_lineage(keyed.groupBy("_path").agg(F.min("_rank").alias("_rank")))
    shorter = best.select(F.col("_path").alias("a"), F.col("_rank").alias("ra"), F.explode(proper_suffixes(F.col("_path"))).alias("b"))
    half = shorter.join(best.select(F.col("_path").alias("b"), F.col("_rank").alias("rb")).hint("merge"), "b")
    pairs = cut_lineage(
        half.select("a", "ra", "b", "rb").unionByName(
            half.select(F.col("b").alias("a"), F.col("rb").alias("ra"), F.col("a").alias("b"), F.col("ra").alias("rb"))
        )
    )
    kept = best.select("_path").join(pairs.select(F.col("a").alias("_path")).distinct().hint("merge"), "_path", "left_anti")
    open_pairs = pairs
    while not open_pairs.isEmpty():
        blocked = open_pairs.where(F.col("rb") < F.col("ra")).select("a").distinct()
        winners = cut_lineage(open_pairs.select("a").distinct().join(blocked.hint("merge"), "a", "left_anti"))
        losers = open_pairs.join(winners.hint("merge"), "a", "left_semi").select(F.col("b").alias("a")).distinct()
        decided = cut_lineage(winners.unionByName(losers).distinct())
        kept = kept.unionByName(winners.select(F.col("a").alias("_path")))
        # a path that lost all its open relatives without being decided is free: keep it
        remaining = open_pairs.join(decided.hint("merge"), "a", "left_anti")
        still = remaining.join(decided.select(F.col("a").alias("b")).hint("merge"), "b", "left_anti").select("a", "ra", "b", "rb")
        freed = remaining.select("a").distinct().join(still.select("a").distinct().hint("merge"), "a", "left_anti")
        kept = kept.unionByName(freed.select(F.col("a").alias("_path")))
        open_pairs = cut_lineage(still)
    winners_only = kept.join(best.hint("merge"), "_path")
    return keyed.join(winners_only.hint("merge"), ["_path", "_rank"], "left_semi").drop("_path", "_rank")


def suffix_dedup_short(df: DataFrame, path: str, order: list[Column]) -> DataFrame:
    """The same result for a candidate list that is short by construction (a search result).

    Related paths share their last component, so each such group is folded on
    its own; a group is a handful of spellings of one file.
    """
    columns = [F.col(c) for c in df.columns]
    entry = F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("rank"), F.struct(*columns).alias("row"))
    groups = df.groupBy(base_name(normalized_path(F.col(path))).alias("_name")).agg(F.array_sort(F.collect_list(entry)).alias("e"))

    def related(kept: Column, item: Column) -> Column:
        old, new = normalized_path(kept["row"][path]), normalized_path(item["row"][path])
        return (old == new) | old.endswith(F.concat(F.lit("/"), new)) | new.endswith(F.concat(F.lit("/"), old))

    folded = F.aggregate(
        "e",
        F.slice("e", 1, 0),
        lambda kept, item: F.when(F.exists(kept, lambda k: related(k, item)), kept).otherwise(
            F.concat(kept, F.array(item))
        ),
    )
    return groups.select(F.explode(folded).alias("x")).select("x.row.*")
