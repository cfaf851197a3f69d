"""Manifests, packs, discovery and the drift report on real files."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from wayfind.sources import discovery as ds
from wayfind.sources import manifest as mf

FILES = {
    "app/package.json": "{}", "app/src/a.ts": "one", "app/src/b.ts": "two", "app/.git/x.ts": "hidden", "app/graph-out/graph.json": "{}",
    "app/graph-out/old/graph-out/graph.json": "{}", "svc/core/Core.csproj": "<Project/>", "svc/core/C.cs": "class C {}", "svc/graph-out/note.cs": "x",
    "node_modules/package.json": "{}", "deep/a/b/pom.xml": "<x/>", "bin.dat": b"\xff\x00\xfe",
}


def put(root, path: str, content: str | bytes) -> None:
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def tree(tmp_path):
    for path, content in FILES.items():
        put(tmp_path, path, content)
    return tmp_path


def md5(content: str | bytes) -> str:
    return hashlib.md5(content if isinstance(content, bytes) else content.encode()).hexdigest()


def test_hashes_of_binary_files(spark, tree):
    found = {r.path: r.hash for r in mf.hash_files(spark, str(tree)).collect() if "/." not in r.path}
    assert found == {p: md5(c) for p, c in FILES.items() if "/." not in p}


def test_diff_round_trip(spark, tree):
    before = mf.hash_files(spark, str(tree))
    before.write.parquet(str(tree / "_m1"))
    old = spark.read.parquet(str(tree / "_m1"))
    put(tree, "app/src/a.ts", "changed")
    os.rename(tree / "app/src/b.ts", tree / "svc/b.ts")  # keeps its name
    os.rename(tree / "bin.dat", tree / "data.bin")  # keeps its content only
    os.remove(tree / "deep/a/b/pom.xml")
    put(tree, "new.txt", "new")
    diff = {r.path: r for r in mf.diff_manifests(old, mf.hash_files(spark, str(tree))).where("path not like '\\_m1%'").collect()}
    kinds = {p: r.status for p, r in diff.items() if r.status != "same"}
    assert kinds == {"app/src/a.ts": "changed", "svc/b.ts": "renamed", "data.bin": "renamed", "deep/a/b/pom.xml": "removed", "new.txt": "added"}
    assert diff["svc/b.ts"].old_path == "app/src/b.ts" and diff["data.bin"].old_path == "bin.dat"
    assert diff["app/src/a.ts"].old_hash == md5("one") and diff["app/src/a.ts"].new_hash == md5("changed")


def test_renames_pair_one_to_one_whatever_they_share(spark):
    old = spark.createDataFrame([(f"a/f{i}", "h") for i in range(300)] + [("a/null", None), ("same", "s")], "path string, hash string")
    new = spark.createDataFrame([(f"b/f{i}", "h") for i in range(100, 450)] + [("b/null", None), ("same", "s")], "path string, hash string")
    rows = mf.diff_manifests(old, new).collect()
    renamed = {(r.old_path, r.path) for r in rows if r.status == "renamed"}
    assert len(renamed) == 300 and len({a for a, _ in renamed}) == 300 and len({b for _, b in renamed}) == 300
    assert {(f"a/f{i}", f"b/f{i}") for i in range(100, 300)} <= renamed
    counts = {r.status: r.files for r in mf.diff_summary(mf.diff_manifests(old, new)).collect()}
    assert counts == {"renamed": 300, "added": 51, "removed": 1, "same": 1}
    none = old.limit(0)
    assert {r.status for r in mf.diff_manifests(none, old).collect()} == {"added"} and mf.diff_manifests(none, none).count() == 0


def test_packs_from_manifest_to_stale(spark, tree):
    packs = tree / "_packs"
    lists = {"m/good": "app/src/a.ts\r\n\n app/src/b.ts \n", "m/out": "../secret\n", "m/gone": "app/none.ts\n", "n/none": "app/src/a.ts\n", "n/broken": "app/src/a.ts\n", "n/other": "app/src/a.ts\n"}
    for pack, text in lists.items():
        put(packs, f"{pack}/raw/source-files.txt", text)
    files = mf.hash_files(spark, str(tree)).where("path not like '\\_packs%'")
    sources = mf.pack_sources(spark, str(packs))
    assert [(r.pos, r.path) for r in sources.where("pack = 'm/good'").orderBy("pos").collect()] == [(0, "app/src/a.ts"), (2, "app/src/b.ts")]
    built = mf.build_manifests(sources, files)
    assert {(r.pack, r.problem) for r in built.where("problem is not null").collect()} == {
        ("m/out", "source escapes repository root: ../secret"), ("m/gone", "source file missing on disk: app/none.ts"),
    }
    stored = {r.pack: r.json for r in mf.manifest_json(mf.publishable(built)).collect()}
    assert set(stored) == {"m/good", "n/none", "n/broken", "n/other"}
    assert json.loads(stored["m/good"])["app/src/b.ts"]["hash"] == md5("two")
    put(packs, "m/good/raw/manifest.json", stored["m/good"])
    put(packs, "n/broken/raw/manifest.json", "{ no json")
    put(packs, "n/other/raw/manifest.json", '{"a": 1}')
    reasons = {r.pack: r.reason for r in mf.check_packs(spark, str(tree), str(packs)).collect()}
    assert reasons == {
        "m/good": "up to date", "m/out": "no manifest yet", "m/gone": "no manifest yet", "n/none": "no manifest yet",
        "n/broken": "manifest is no valid JSON", "n/other": "manifest holds no hashes",
    }
    put(tree, "app/src/b.ts", "other")
    assert {r.reason for r in mf.check_packs(spark, str(tree), str(packs)).where("pack = 'm/good'").collect()} == {"content changed since last build: app/src/b.ts"}


def test_roots_and_packs_from_paths(spark):
    paths = [*FILES, "out/m/p/raw/source-files.txt", "out/m/q/source-files.txt", "out/x/p/raw/source-files.txt", "out/deep/m/p/raw/source-files.txt"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    roots = {r.name: tuple(r.extensions) for r in ds.detect_roots(listing, ("node_modules",)).collect()}
    assert roots == {"app": (".ts", ".tsx", ".js", ".jsx"), "svc": (".cs",)}
    whole = ds.detect_roots(listing.where("path like 'bin%'")).collect()
    assert [(r.name, r.path) for r in whole] == [("root", ".")]
    assert {tuple(r) for r in ds.discover_packs(listing, "out", ("x",)).collect()} == {("m", "p")}


def test_graph_folders_are_top_most_and_judged_by_the_newest_source(spark):
    rows = [(p, 10.0) for p in FILES] + [("app/src/late.ts", 20.0), ("app/src/late.css", 30.0), ("app/.cache/late.ts", 40.0)]
    listing = spark.createDataFrame(rows, "path string, modified double")
    roots = [{"name": "app", "path": "./app", "extensions": [".ts"]}, {"name": "all", "path": ".", "extensions": [".cs"]}]
    folders = ds.graph_folders(listing, roots, "graph-out", ("node_modules",))
    assert {(r.folder, r.root) for r in folders.collect()} == {("app/graph-out", "app"), ("svc/graph-out", "all")}
    reasons = {r.folder: r.reason for r in ds.stale_graph_folders(listing, folders, ("node_modules",)).collect()}
    assert reasons == {"app/graph-out": "source changed after the graph (newest: app/src/late.ts)", "svc/graph-out": "no graph yet"}


def test_drift_report_and_decisions(spark, tmp_path):
    rows = [("app/src/a.ts", 1.0), ("app/src/b.ts", 1.0), ("lib/c.ts", 1.0)]
    listing = spark.createDataFrame(rows, "path string, modified double")
    packs = spark.createDataFrame([("m/p", "app/src/a.ts")], "pack string, path string")
    reasons = spark.createDataFrame([("m/p", "up to date")], "pack string, reason string")
    report = ds.drift_report(listing, [{"name": "all", "path": ".", "extensions": [".ts"]}], packs, reasons, "graph-out")
    assert {(r.section, r.target, r.needs_work, r.detail) for r in report.collect()} == {
        ("uncovered file", "app/src/b.ts", True, "m/p (1 related files)"), ("uncovered file", "lib/c.ts", True, "no pack looks related"), ("pack", "m/p", False, "up to date"),
    }
    assert {(r.section, r.checked, r.needs_work) for r in ds.drift_summary(report).collect()} == {("uncovered file", 2, 2), ("pack", 1, 0)}
    from wayfind.operators.drift import orphans

    path = str(tmp_path / "orphans")
    ds.write_orphan_report(orphans(listing, packs), path)
    written = [json.loads(line) for line in (r.value for r in spark.read.text(path).collect())]
    assert sorted((w["file"], w["suggested_pack"], w["confidence"], w["decision"]) for w in written) == [("app/src/b.ts", "m/p", 1, ""), ("lib/c.ts", None, 0, "")]
    reviewed = spark.read.json(path).withColumn("decision", F.when(F.col("file") == "lib/c.ts", "NEW:m/lib").otherwise("skip"))
    reviewed.write.json(path + "-reviewed")
    assert [tuple(r) for r in ds.read_decisions(spark, path + "-reviewed").collect()] == [("m/lib", "lib/c.ts", True)]
