from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from wayfind.llm.sharding import cut_links, shard_documents


def check(rows, texts) -> None:
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
    slots: dict[int, list[int]] = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_share_shards_of_equal_counts(documents, texts):
    out = shard_documents(documents)
    check(out.collect(), texts)
    assert cut_links(out, ["text_crc32", "size"]).first()["cut"] == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, shard_documents(documents.repartition(5)).collect()))


def test_a_group_of_a_third_is_cut_no_more_than_needed(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = shard_documents(rows)
    check(out.collect(), [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(2000)])
    row = cut_links(out, ["text_crc32", "size"]).first()
    assert row["linked"] == 667 and row["cut"] == 667 - 250


def test_small_groups_end_whole_beside_a_hot_group(spark):
    """A third of the rows is one group, the places of its shard run out; two fifths are in pairs, some in groups of forty."""
    kind = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("p"), (F.col("id") / 6).cast("long").cast("string")))
    kind = kind.when(F.col("id") < 1200, F.concat(F.lit("g"), (F.col("id") / 120).cast("long").cast("string")))
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), kind.otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = shard_documents(rows).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    check(out, texts)
    text, shards = dict(texts), {}
    for r in out:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert [t for t, s in shards.items() if len(s) > 1 and t != "hot"] == []


def test_odd_rows(odd, odd_rows, empty):
    check(shard_documents(odd).collect(), [(r[0], r[1] or "") for r in odd_rows])
    assert shard_documents(empty).count() == 0
