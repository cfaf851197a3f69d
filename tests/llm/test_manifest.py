from __future__ import annotations

import hashlib
import string
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from wayfind.llm.manifest import build_manifest, verify_rows

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and per leaf the (left, right) siblings from the bottom up."""
    level, place, steps = digests, list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p // 16 * 16
            steps[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 16])))
        level, place = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [p // 16 for p in place]
    return (level[0] if level else ""), steps


def brute(rows: list[tuple]) -> list[tuple]:
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    groups = [
        sorted(g, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for _, g in groupby(sorted(rows, key=key), key=key)
    ]
    tops = [tree([leaf(r) for r in g]) for g in groups]
    root, upper = tree([t for t, _ in tops])
    out = []
    for g, (top, steps), above in zip(groups, tops, upper, strict=True):
        for r, own in zip(g, steps, strict=True):
            path = own + above
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            seen = leaf((*r[:4], r[4].translate(lower))) if bad else leaf(r)
            for left, right in path:
                seen = h(left, seen, right)
            out.append((r[0], leaf(r), top, root, h(*(a + b for a, b in path)), seen, seen == root))
    return sorted(out, key=str)


def result(df) -> list[tuple]:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    out = verify_rows(df, FIELDS, "source", "doc_id", chosen, {"text": lower})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def plain(rows) -> list[tuple]:
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


def test_odd_and_empty_rows(odd, odd_rows, empty):
    assert result(odd) == brute(plain(odd_rows))
    assert result(empty) == []


def test_one_row_and_sizes_around_powers_of_the_fan(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert result(spark.createDataFrame([(3, "s", None, 1, "A b")], schema)) == brute([(3, "s", None, 1, "A b")])
    sizes = {"one": 1, "fan": 16, "more": 17, "square": 256, "beyond": 257, "é": 2, None: 33}
    rows = [(7 * i + n, s, "en", i, f"Text {i % 3}") for s, n in sizes.items() for i in range(n)]
    assert result(spark.createDataFrame(rows, schema).repartition(7)) == brute(rows)


def test_hot_source_among_many(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 300}", "en", i, f"T{i}") for i in range(6000)]
    assert result(spark.createDataFrame(rows, schema)) == brute(rows)


def test_intervals_nest(documents):
    nodes = build_manifest(documents, FIELDS, "source", "doc_id").nodes().cache()
    assert nodes.groupBy("tree", "level").agg(F.sum(F.expr("high - low + 1")).alias("n"), F.count("*").alias("c")).groupBy("tree").agg(F.max("n"), F.min("n")).where("`max(n)` <> `min(n)`").count() == 0
    assert nodes.where(F.col("high") - F.col("low") >= F.pow(F.lit(16), F.col("level"))).count() == 0


def test_same_result_whatever_the_partitions(documents):
    chosen = F.lit(False)
    runs = [verify_rows(d, FIELDS, "source", "doc_id", chosen, {}) for d in (documents, documents.repartition(9))]
    assert runs[0].exceptAll(runs[1]).count() == 0
    assert runs[0].where("not verified").count() == 0
