from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from wayfind.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string, number long, a int, depth string, code string, n_bytes double"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def code(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, code(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows) -> list[tuple]:
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs_here in members.items():
        value = (len(convs_here) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += value
    return sorted(
        (
            (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


def result(df) -> list[tuple]:
    out = prefix_trie(*with_shared_openings(*numbered_turns(df)))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def extra(rows) -> list[tuple]:
    return [(*r, 1, 2, "x", "y", 0.5) for r in rows]


def test_odd_rows(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, None, "there"), (0, None, "system", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "bot", "hi"),
        (2, 5, "", ""), (3, 1, "user", "é😀" * 50), (None, 0, "user", "lost"), (None, None, None, None), (7, 0, "us", "erhi"), (8, 0, "user", "hi"),
        (11, 3, "user", "x" * 100_000), (12, 0, "user", "only one"), (-3, 0, "user", "hi"), (-5, 0, "user", "base"), (-5, 1, "user", "base"),
        (9_223_372_036_854_775_807, 0, "user", "hi"), (9_223_372_036_854_775_805, 0, "user", "hi"),
    ]
    rows += [(c, t, "user", f"w{t}") for c in range(20, 40) for t in range(c % 12)]
    assert result(spark.createDataFrame(extra(rows), SCHEMA).repartition(5)) == brute(rows)


def test_empty_table_has_no_root(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert result(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_copies_hot_openings_and_long_conversations_over_many_shards(spark):
    """A third of 1,500 conversations are equal, another third shares its first turn; three have 700 turns, two of them 600 in common."""
    rows = []
    for c in range(1500):
        for t in range(9 + c % 3):
            hot = c % 3 == 0 or (c % 3 == 1 and t == 0)
            rows.append((c, t, "user", f"hot {t}" if hot else f"c{c // 2} {t}"))
    for c, tail in ((2001, "p"), (2006, "q"), (2011, "r")):
        rows += [(c, t, "bot", f"long {t}" if t < 600 and c != 2011 else f"{tail} {t}") for t in range(700)]
    assert result(spark.createDataFrame(extra(rows), SCHEMA).repartition(6)) == brute(rows)


def test_turns_of_one_conversation_are_numbered_over_many_tasks(spark):
    df = spark.range(5000).select(F.lit(4).cast("long").alias("conv_id"), (5000 - F.col("id")).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows come to one task
    try:
        turns, convs = numbered_turns(df.repartition(7))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["at"] for r in turns.orderBy("at").collect()] == list(range(5000)) and convs.collect() == [(4, 5000)]
    assert turns.select("task").distinct().count() > 1
