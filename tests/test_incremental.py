"""An index refreshed file by file equals a full rebuild and writes only what changed."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import fields

import pytest

from wayfind.sources import incremental as inc
from wayfind.sources.incremental import changed_files, compact, generations, read_index, refresh_index, watch
from wayfind.sources.index import SearchIndex, build_index


def table(df) -> list:
    kept = [c for c in df.columns if c != "created_at"]
    return sorted((json.dumps([r[c] for c in kept], default=str) for r in df.select(*kept).collect()))


@pytest.fixture
def copy(repository, tmp_path):
    return shutil.copytree(repository, tmp_path / "base with space")


def put(base, path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.join(base, path)), exist_ok=True)
    with open(os.path.join(base, path), "w", encoding="utf-8") as handle:
        handle.write(text)


def test_refresh_follows_the_files(spark, copy, tmp_path, settings):
    folder, base = str(tmp_path / "index"), str(copy)
    with pytest.raises(FileNotFoundError):
        read_index(spark, folder)
    assert refresh_index(spark, base, folder, settings).action == "full"
    running = watch(spark, base, folder, settings, seconds=1)  # nothing changed: it only looks
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    spark.range(3).write.parquet(f"{folder}/gen-1-broken/documents")  # a refresh that died before it published
    # one text and one source change, a text is new, a source goes
    put(base, "docs/guide.md", "# Guide\n\nRefunds are settled by the billing service now.\n")
    put(base, "docs/more.md", "# More\n\nA new page about carts and payments.\n")
    put(base, "ui/src/api/orders.ts", "export const cancelOrder = () => 1;\n")
    os.remove(f"{base}/backend/Controllers/OrderController.cs")
    assert refresh_index(spark, base, folder, settings, min_interval=3600).action == "soon"
    done = refresh_index(spark, base, folder, settings)
    assert (done.action, done.gen, done.changed, done.removed) == ("delta", 1, 3, 1)
    now, full = read_index(spark, folder), build_index(spark, base, str(tmp_path / "full"), settings)
    for name in ("documents", "doc_files", "source_lines", "chunks", "meta"):
        assert table(getattr(now, name)) == table(getattr(full, name)), name
    # only rows of the changed files were written
    delta = f"{folder}/{generations(spark, folder)[-1].folder}"
    assert {r.source for r in spark.read.parquet(f"{delta}/documents").select("source").collect()} == {"docs/guide.md", "docs/more.md"}
    assert {r.path for r in spark.read.parquet(f"{delta}/source_lines").select("path").collect()} == {"ui/src/api/orders.ts"}


def test_generations_are_read_and_compacted(spark, tmp_path):
    """Three generations by hand: a document changes twice, another goes and comes back, a source goes."""
    folder = str(tmp_path)

    def generation(gen: int, docs: list, gone: list, lines: list, gone_paths: list) -> None:
        at = f"{folder}/gen-{gen}-x"
        for name in (f.name for f in fields(SearchIndex)):
            rows, schema = [(d, d, gen) for d in docs], "doc_id string, term string, v int"
            if name == "source_lines":
                rows, schema = [(p, gen) for p in lines], "path string, v int"
            if name == "meta":
                rows, schema = [(gen,)], "v int"
            spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}")
        spark.createDataFrame([(d,) for d in gone], "doc_id string").write.parquet(f"{at}/gone_documents")
        spark.createDataFrame([(p,) for p in gone_paths], "path string").write.parquet(f"{at}/gone_sources")
        for name in ("listing", "sources"):
            spark.range(1).write.parquet(f"{at}/{name}")
        inc._publish(spark, folder, gen, f"gen-{gen}-x", gen == 0, 0, 0)

    generation(0, ["a", "b", "c"], [], ["x", "y"], [])
    generation(1, ["b"], ["b", "c"], ["x"], ["x", "y"])
    generation(2, ["b", "c"], ["b"], [], [])
    spark.range(3).write.parquet(f"{folder}/gen-3-broken/documents")  # never published
    want = {("a", 0), ("b", 2), ("c", 2)}
    index = read_index(spark, folder)
    assert {(r.doc_id, r.v) for r in index.documents.collect()} == {(r.doc_id, r.v) for r in index.doc_terms.collect()} == want
    assert [tuple(r) for r in index.source_lines.collect()] == [("x", 1)] and [r.v for r in index.meta.collect()] == [2]
    assert compact(spark, folder).gen == 3 and len(generations(spark, folder)) == 1
    again = read_index(spark, folder)
    assert {(r.doc_id, r.v) for r in again.chunks.collect()} == want and [tuple(r) for r in again.source_lines.collect()] == [("x", 1)]
    assert compact(spark, folder).action == "none"


def test_changes_between_listings(spark):
    schema = "path string, uri string, length long, modified long"
    old = spark.createDataFrame([("a", "u/a", 1, 1), ("b", "u/b", 1, 1), ("c", "u/c", 1, 1), ("d", "u/d", 1, 1)], schema)
    new = spark.createDataFrame([("a", "u/a", 1, 1), ("b", "u/b", 2, 1), ("c", "u/c", 1, 2), ("e", "u/e", 1, 1)], schema)
    assert {tuple(r) for r in changed_files(old, new).collect()} == {("b", "changed", "u/b"), ("c", "changed", "u/c"), ("d", "removed", None), ("e", "new", "u/e")}
