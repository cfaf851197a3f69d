"""Shards by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked.  All start in shards that are dealt evenly by hash; then rounds of joins move linked
documents to the shard that most of their neighbours are in.  A shard takes at most as many movers as it has unlinked
documents to give away in return, and those fill the places that became free, so that the numbers of documents stay at most
one apart (the law is ``rows``) after every round.

A vote sees room: a group that fits a shard votes among the shards with unlinked documents enough for the rest of it, its
own shards by the members they hold, else any other.  Such groups move whole or not at all, those with the fewest movers
first, and those refused vote again in the next round; they get further rounds as long as that helps.  What is left of the
places goes, document by document, to groups that no shard can take whole: groups larger than a shard, and groups that meet
no shard with unlinked documents enough.  Only their links stay cut.

Neighbours vote as counts per (group, shard): a group of any size is never gathered and its pairs are never listed.  Ranks
are taken in hash buckets.

Null text counts as empty, so null and empty texts are linked.  Rows that repeat an id and text are separate documents, in
an order among themselves that does not show in the result.  An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import split_rank, written

SHARDS = 8
ROUNDS = 4
LAW = "rows"


def document_links(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, a, b, code, grouped): a and b identify the text, code orders the documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    octets = F.encode(text, "UTF-8")
    rows = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(octets).alias("text_crc32"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"),
    ).withColumn("code", F.xxhash64(F.lit(11), "doc_id", "a"))
    rows = written(rows, "shard-texts")
    linked = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(linked, ["a", "b"], "left").withColumn("grouped", F.col("_n").isNotNull()).drop("_n")


def _votes(rows: DataFrame, shards: int, held: dict[int, tuple[int, int]]) -> DataFrame:
    """(a, b, want, movers, whole): the shard a group wants, its members elsewhere, and if that shard has room for them.

    ``held`` has documents and unlinked documents per shard.  Ties go by a hash, so that no shard is favoured.
    """
    counts = rows.where("grouped").groupBy("a", "b", "shard").agg(F.count(F.lit(1)).alias("n"))
    tie = F.pmod(F.xxhash64("a", "shard"), F.lit(1 << 20))
    groups = counts.groupBy("a", "b").agg(F.sum("n").alias("_size"), F.collect_list(F.struct("n", tie.alias("tie"), "shard")).alias("_at"))  # one per shard
    free = F.array(*[F.lit(held[s][1]).cast("long") for s in range(shards)])

    def with_room(at: Column) -> Column:
        return F.struct((F.element_at(free, at["shard"] + 1) >= F.col("_size") - at["n"]).alias("room"), at["n"].alias("n"), at["tie"].alias("tie"), at["shard"].alias("shard"))

    groups = groups.withColumn("_best", F.array_max(F.transform("_at", with_room)))
    groups = groups.withColumn("_most", F.array_max("_at"))
    others = F.filter(F.array(*[F.lit(s) for s in range(shards)]), lambda s: F.element_at(free, s + 1) >= F.col("_size"))
    groups = groups.withColumn("_others", others)
    other = F.when(F.size("_others") > 0, F.get("_others", F.pmod(F.xxhash64("b", "a"), F.greatest(F.size("_others"), F.lit(1))).cast("int")))
    want = F.when(F.col("_best.room"), F.col("_best.shard")).otherwise(F.coalesce(other, F.col("_most.shard")))
    there = F.when(F.col("_best.room"), F.col("_best.n")).when(other.isNotNull(), 0).otherwise(F.col("_most.n"))
    fits = F.col("_size") <= max(n for n, _ in held.values())
    whole = fits & (F.col("_best.room") | other.isNotNull())
    return groups.select(
        "a", "b", F.when(fits, want).otherwise(F.col("_most.shard")).alias("want"),
        (F.col("_size") - F.when(fits, there).otherwise(F.col("_most.n"))).alias("movers"), whole.alias("whole"),
    )


def _seats(votes: DataFrame, quota: dict[int, int]) -> DataFrame:
    """Adds ``placed``: whole groups with the fewest movers first, as far as the wanted shard has places."""
    moving = votes.where("whole and movers > 0")
    classes = moving.groupBy("want", "movers").agg(F.sum("movers").alias("_all"))
    smaller = Window.partitionBy("want").orderBy("movers").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("want", "movers", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_before"))
    ranked = split_rank(moving, ["want", "movers"], "a", "_rank", [F.col("b")]).join(classes, ["want", "movers"])
    fits = F.col("_before") + F.col("movers") * (F.col("_rank") + 1) <= _pick(quota, "want")
    rest = votes.where("not (whole and movers > 0)").withColumn("placed", F.lit(False))
    return ranked.withColumn("placed", fits).select(*rest.columns).unionByName(rest)


def _pick(cases: dict[int, int], column: str) -> Column:
    out = F.lit(0)
    for key, value in cases.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def propagate(rows: DataFrame, shards: int, enough: bool = False, last: int | None = None) -> tuple[DataFrame | None, int]:
    """One round over (…, shard): every shard keeps its number of documents, give or take the one that deals the remainder.

    Also gives the movers of groups that could be whole.  With ``enough`` there is no round unless these are fewer than ``last``.
    """
    held = {s: (0, 0) for s in range(shards)}  # documents, unlinked documents
    for s, n, free in rows.groupBy("shard").agg(F.count(F.lit(1)), F.count(F.when(~F.col("grouped"), 1))).collect():
        held[s] = n, free
    votes = written(_seats(_votes(rows, shards, held), {s: free for s, (_, free) in held.items()}), "shard-votes")
    quota = {s: 0 for s in held}
    waiting = placed = 0
    for s, goes, n in votes.where("whole and movers > 0").groupBy("want", "placed").agg(F.sum("movers")).collect():
        waiting += n
        if goes:
            quota[s], placed = n, placed + n
    if enough and (waiting == 0 or waiting >= last):
        return None, waiting
    voted = rows.join(votes, ["a", "b"], "left").withColumns({
        "_mover": F.coalesce(F.col("want") != F.col("shard"), F.lit(False)), "whole": F.coalesce("whole", F.lit(False)),
        "placed": F.coalesce("placed", F.lit(False)),
    })
    voted = written(voted, "shard-moves")
    # the rest of the places, by document and not by group: the hash buckets then also split a group that holds a third of all
    # rows; while whole groups were refused and others moved, these vote again first
    rest = {s: held[s][1] - quota[s] if waiting == placed or placed == 0 else 0 for s in held}
    whole = voted.where("_mover and whole").withColumn("_goes", F.col("placed"))
    single = split_rank(voted.where("_mover and not whole"), ["want"], "code", "_rank")
    single = single.withColumn("_goes", F.col("_rank") < _pick(rest, "want")).drop("_rank")
    for s, n in voted.where("_mover and not whole").groupBy("want").agg(F.count(F.lit(1))).collect():
        quota[s] += min(n, rest[s])
    movers = whole.unionByName(single)
    leaving = {s: 0 for s in held}
    movers = written(movers, "shard-movers")
    for s, n in movers.where("_goes").groupBy("shard").agg(F.count(F.lit(1))).collect():
        leaving[s] = n
    movers = movers.withColumn("shard", F.when(F.col("_goes"), F.col("want")).otherwise(F.col("shard"))).drop("_goes")
    excess = {s: quota[s] - leaving[s] for s in held}  # above 0: so many unlinked documents leave; below 0: so many come
    free = split_rank(voted.where(~F.col("grouped")), ["shard"], "code", "_rank")
    places = [(s, -excess[s]) for s in held if excess[s] < 0]
    starts, at = {}, 0
    for s in held:
        starts[s] = at
        at += max(0, excess[s])
    seat, ends, total = F.lit(None).cast("int"), [], 0
    for s, n in places:
        total += n
        ends.append((total, s))
    number = F.col("_rank") + _pick(starts, "shard")
    for end, s in reversed(ends):
        seat = F.when(number < end, F.lit(s)).otherwise(seat)
    leaves = F.col("_rank") < _pick({s: max(0, x) for s, x in excess.items()}, "shard")
    free = free.withColumn("shard", F.when(leaves, seat).otherwise(F.col("shard"))).drop("_rank")
    stay = voted.where(F.col("grouped") & ~F.col("_mover"))
    kept = rows.columns
    return stay.select(*kept).unionByName(movers.select(*kept)).unionByName(free.select(*kept)), waiting


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null for this law).

    ``rounds`` are always made; more follow while groups that could be whole are cut and become fewer.
    """
    rows = split_rank(document_links(docs), [], "code", "_at", [F.col("doc_id")])
    rows = written(rows.withColumn("shard", F.pmod("_at", F.lit(shards)).cast("int")).drop("_at"), "shards")
    done, last = 0, None
    while True:
        moved, waiting = propagate(rows, shards, done >= rounds, last)
        if moved is None:
            break
        rows, last, done = written(moved, "shards"), waiting, done + 1
    rows = split_rank(rows, ["shard"], "code", "slot", [F.col("doc_id")])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(sharded: DataFrame, keys: list[str]) -> DataFrame:
    """Linked documents outside the shard that holds most of their group, and all linked documents."""
    per = sharded.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return groups.agg(F.sum(F.col("n") - F.col("most")).alias("cut"), F.sum("n").alias("linked"))
