"""Back-filled blocks, prompts under a budget, side inputs in file order, indexes without cuts."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from wayfind.operators import budget as bg
from wayfind.sources.config import Limits, Settings
from wayfind.sources.documents import graph_documents, graph_tables, read_graphs, source_lines, text_documents
from wayfind.sources.listing import list_files
from wayfind.sources.logs import keyed_rows, valid_outcomes


def backfilled(spark, hits, blocks, window, budget, priority=None):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = bg.backfill_blocks(
        frame([("a", *h) for h in hits], "answer_id string, pos int, path string, has_block boolean"), frame([("a", *b) for b in blocks], "answer_id string, pos int, path string"),
        frame([("a", w) for w in window], "answer_id string, path string"), budget, None if priority is None else frame([("a", p) for p in priority], "answer_id string, path string"),
    )
    return {(r.action, r.path) for r in out.collect()}


def test_backfill_uses_room_first_and_evicts_the_tail(spark):
    blocks = [(0, "x.cs"), (1, "Top.cs"), (2, "y.cs"), (3, "z.cs")]
    hits = [(0, "top.cs", False), (1, "new1.cs", False), (2, "new2.cs", None), (3, "has.cs", True), (4, "far.cs", False)]
    window = ["TOP.cs", "new1.cs", "new2.cs", "has.cs"]
    assert backfilled(spark, hits, blocks, window, 4) == {("kept", p) for _, p in blocks}
    assert backfilled(spark, hits, blocks, window, 5) == {*(("kept", p) for _, p in blocks), ("new", "new1.cs")}
    assert backfilled(spark, hits, blocks, window, 5, ["top.cs"]) == {("kept", "x.cs"), ("kept", "Top.cs"), ("kept", "y.cs"), ("evicted", "z.cs"), ("new", "new1.cs"), ("new", "new2.cs")}
    assert backfilled(spark, hits, blocks, window, 4, ["top.cs"]) == {("kept", "x.cs"), ("kept", "Top.cs"), ("evicted", "y.cs"), ("evicted", "z.cs"), ("new", "new1.cs"), ("new", "new2.cs")}
    assert backfilled(spark, hits, blocks, [], 2, []) == {("kept", p) for _, p in blocks}
    assert backfilled(spark, hits, [], window, 2) == {("new", "top.cs"), ("new", "new1.cs")}


def test_prompts_stop_at_the_first_block_that_does_not_fit(spark):
    task = spark.createDataFrame([("a", 0, "Find it"), ("b", 0, "Other")], "answer_id string, pos int, text string")
    files = spark.createDataFrame([("a", i, f"f{i}.cs", float(i)) for i in range(25)] + [("b", 0, "", 1.0)], "answer_id string, pos int, path string, score double")
    packs = spark.createDataFrame([("a", 0, "p", ["x", "y"]), ("a", 1, "q", [])], "answer_id string, pos int, name string, files array<string>")
    blocks = spark.createDataFrame(
        [("a", 0, "b0", "x.cs", "Do()", "  one  "), ("a", 1, "b1", "y.cs", "", "l" * 3000), ("a", 2, "b2", "z.cs", "", "two"), ("a", 3, "b3", "e.cs", "", "  "), ("b", 0, "b0", None, None, "code")],
        "answer_id string, pos int, block_id string, path string, symbol string, text string",
    )
    lines = bg.prompt_lines({"files": files, "packs": packs, "task": task})
    got = {r.answer_id: r for r in bg.assemble_prompts(lines, bg.block_entries(blocks), 2200).collect()}
    listed = "\n".join(f"  - f{i}.cs (score: {i}.0)" for i in range(20))
    base = f"## Task\nFind it\n\n\n## Candidate Files\n{listed}\n\n## Packs\n  - p -> [x, y]\n  - q"
    assert got["a"].prompt == base + "\n\n## Code Blocks\n\n[b0] x.cs — Do()\n```\none\n```"
    assert got["a"].chars == len(got["a"].prompt) and got["a"].blocks == 1
    assert got["b"].prompt == "## Task\nOther\n\n\n## Code Blocks\n\n[b0] \n```\ncode\n```"
    whole = {r.answer_id: r for r in bg.assemble_prompts(lines, bg.block_entries(blocks)).collect()}
    assert whole["a"].blocks == 3 and "l" * 2500 + "\n```" in whole["a"].prompt
    tight = {r.answer_id: r for r in bg.assemble_prompts(lines, bg.block_entries(blocks), len(base) + 199).collect()}
    assert tight["a"].prompt == base


def test_last_duplicate_wins_in_file_order_over_splits(spark, tmp_path):
    for name, low in (("a.jsonl", 0), ("b.jsonl", 1000)):
        with open(tmp_path / name, "w", encoding="utf-8") as out:
            for i in range(low, low + 1000):
                out.write(json.dumps({"k": f"k{i % 7}", "v": i, "pad": "x" * (i % 50)}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = keyed_rows(spark, str(tmp_path), "k string, v long", "k", multi_line=False)
        assert rows.rdd.getNumPartitions() >= 1
        assert {r.k: r.v for r in rows.collect()} == {f"k{i % 7}": i for i in range(2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.json").write_text(json.dumps([{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 3}, {"v": 4}]))
    assert {r.k: r.v for r in keyed_rows(spark, str(tmp_path / "one"), "k string, v long", "k").collect()} == {"a": 3, "b": 2}


def test_nothing_is_cut_unless_asked(spark, tmp_path):
    base = tmp_path / "base"
    os.makedirs(base / "graph-out/m/p")
    os.makedirs(base / "docs")
    facts = "\n".join(f"- statement number {i} says that value {i} = {i}" for i in range(40))
    (base / "docs/long.md").write_text("word " * 450_000 + "\n" + facts + "\n")  # above 2 MiB
    (base / "docs/long.ts").write_text("x = 1\n" * 400_000)
    nodes = [{"id": f"n{i}", "label": f"Thing{i}Service", "source_file": f"src/f{i}.cs", "source_location": f"L{i}"} for i in range(700)]
    links = [{"source": f"n{i}", "target": f"n{(i + 1) % 700}", "relation": "calls"} for i in range(700)]
    (base / "graph-out/m/p/graph.json").write_text(json.dumps({"nodes": nodes, "links": links}))

    def stage(name, df):
        path = str(tmp_path / "stage" / name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def counts(settings):
        loaded = text_documents(list_files(spark, str(base), settings, glob="*.md", with_text=True), settings)
        tables = graph_tables(read_graphs(spark, str(base), settings, stage), settings, stage)
        graph = graph_documents(tables, settings)
        docs = graph.documents.select(F.sum(F.size(F.split("text", "\n"))), F.sum(F.size("facts")), F.max("node_count")).first()
        texts = [len(r.facts) for r in loaded.documents.collect()]
        return texts, tuple(docs), graph.doc_files.count(), graph.doc_edges.count(), source_lines(spark, str(base), settings).count()

    assert counts(Settings()) == ([40], (1400, 700, 700), 700, 700, 400_001)
    short = counts(Settings(limits=Limits.short()))
    assert short == ([], (500, 25, 700), 150, 60, 0)
    notes = spark.createDataFrame([("success", "none", 0, 0, False, "n" * 3000, ["f"])], "outcome string, failure_reason string, used_suggested_files int, extra_files_read int, needed_extra_search boolean, notes string, missed_files array<string>")
    assert len(valid_outcomes(notes).first()["notes"]) == 3000 and len(valid_outcomes(notes, 1000).first()["notes"]) == 1000
