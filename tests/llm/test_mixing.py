from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from wayfind.llm.mixing import FITS, apply_mix, mix_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        open_ = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, near: float) -> None:
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        largest = max((r.size for r in rows if r.source == s), default=0)
        assert abs(taken[s] - target[s]) <= max(near * target[s], largest)


def test_documents_of_the_test_table(documents, texts):
    rows = mix_documents(documents).collect()
    assert {r.doc_id: r.size for r in rows} == {d: len(WORDS.findall(t)) for d, t in texts}
    check(rows, 0.02)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_documents(documents.repartition(7)).collect()))


def test_skewed_sources_near_their_targets(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")).alias("text"),
    )
    check(mix_documents(rows).collect(), 0.005)


def test_size_classes_get_copies_at_their_rates(spark):
    """Every word count occurs once, so nothing is left of a rate that is rounded down by word count."""
    rows = spark.range(900).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") + 1).cast("int")).alias("text"),
    )
    out = mix_documents(rows).collect()
    check(out, 0.005)
    for source in ("s0", "s1", "s2"):
        own = sorted((r for r in out if r.source == source), key=lambda r: r.size)
        assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in own)
        for low in range(0, 300, 30):
            some = own[low : low + 30]
            assert abs(sum(r.copies for r in some) - sum(r.rate for r in some)) <= 1 + FITS


def test_odd_rows(odd, odd_rows, empty):
    rows = mix_documents(odd).collect()
    assert len(rows) == len(odd_rows)
    check(rows, 0.02)
    mixed = apply_mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mix_documents(empty).count() == 0 and apply_mix(empty).count() == 0
    nothing = odd.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.taken) for r in mix_documents(nothing).collect()} == {(0, 0)}
