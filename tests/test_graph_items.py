"""Large JSON graphs are read by many tasks and give what a JSON parser gives."""

from __future__ import annotations

import json
import random

import pytest

from wayfind.sources.graph_items import graph_items


@pytest.fixture
def staged(spark, tmp_path):
    def stage(name, df):
        path = str(tmp_path / "stage" / name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return stage


def found(spark, base, stage) -> dict:
    out: dict = {}
    for r in graph_items(spark, str(base), "*.json", stage).collect():
        out.setdefault(r.path, {}).setdefault(r.array, {})[r.pos] = json.loads(r.item)
    return {p: {a: [items[i] for i in range(len(items))] for a, items in arrays.items()} for p, arrays in out.items()}


def put(base, name: str, text: str) -> None:
    (base / name).write_text(text, encoding="utf-8")


def test_equal_to_a_parser_whatever_the_splits(spark, tmp_path, staged):
    rng = random.Random(3)
    odd = ["}", "{", '"', "\\", "},{", '": [', "\\\\\"}", "é😀", "\n", "[", "]", "nodes", ' "links": [{'] + ["plain"] * 5

    def thing(depth=0):
        out = {"id": "".join(rng.choice(odd) for _ in range(rng.randrange(6))), "n": rng.random()}
        if depth < 3 and rng.random() < 0.3:
            out["in{side"] = thing(depth + 1)
            out["list"] = [thing(depth + 1) for _ in range(rng.randrange(3))]
        return out

    base = tmp_path / "graphs"
    base.mkdir()
    shapes = {}
    for name, size, style in (("a.json", 3000, {}), ("b.json", 40, {"indent": 2}), ("c.json", 1, {"ensure_ascii": False})):
        shape = {"directed": False, "graph": {"name": "}{"}, "nodes": [thing() for _ in range(size)], "count": 7, "links": [thing() for _ in range(size)], "none": [], "edges": []}
        shapes[name] = {"nodes": shape["nodes"], "links": shape["links"]}
        put(base, name, json.dumps(shape, **style) + ("\n" if size == 40 else ""))
    for splits in ("128m", "4k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert found(spark, base, staged) == shapes
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_shapes_and_broken_files_have_no_rows(spark, tmp_path, staged):
    base = tmp_path / "graphs"
    base.mkdir()
    put(base, "list.json", '[{"nodes": [{"id": 1}]}]')
    put(base, "broken.json", "{ not json")
    put(base, "cut.json", '{"nodes": [{"id": 1}, {"id": 2}], "links": [{"a": 1')
    put(base, "quote.json", '{"nodes": [{"id": "1}]}')
    put(base, "empty.json", "")
    put(base, "none.json", '{"nodes": [], "links": []}')
    put(base, "fine.json", '\n {"edges": [{"from": "a"}], "nodes": [{"id": "x"}]} \n')
    assert found(spark, base, staged) == {"fine.json": {"edges": [{"from": "a"}], "nodes": [{"id": "x"}]}}
