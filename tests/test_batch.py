"""Many questions at once: tiles against all pairs as rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfind.operators.skew import top_per_key
from wayfind.plans import batch
from wayfind.plans.query import plan_questions

QUESTIONS = ["Which OrderService refunds a payment?", "cart page", "The shop has a cart", "api client of OrderController", "xyzzy", None, "guide GUIDE", "place order place"]


def test_tiles_give_the_answers_of_all_pairs(spark, index, profile, monkeypatch):
    copies = spark.range(3).select(F.col("id").alias("_n"))
    documents = index.documents.crossJoin(copies).withColumn("doc_id", F.concat("doc_id", F.col("_n").cast("string"))).drop("_n")
    terms = index.doc_terms.crossJoin(copies).withColumn("doc_id", F.concat("doc_id", F.col("_n").cast("string"))).drop("_n")
    files = index.doc_files.crossJoin(copies).withColumn("doc_id", F.concat("doc_id", F.col("_n").cast("string"))).drop("_n")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, text string")
    planned = plan_questions(questions, profile)
    pairs = batch.score_questions(documents, terms, planned, profile, files)
    wanted = top_per_key(pairs, ["question_id"], [F.desc("score"), F.asc("doc_id")], 4, rank="rank").select("question_id", "rank", "doc_id", "score")
    wanted = sorted(map(tuple, wanted.collect()))
    for name, value in (("DOCUMENTS", 3), ("QUESTIONS", 2), ("COLUMNS", 1), ("MAX_NEEDLES", 2)):
        monkeypatch.setattr(batch, name, value)
    found = batch.search_questions(documents, terms, questions, 4, profile, files).select("question_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, found.collect())) == wanted and len({r[0] for r in wanted}) >= 5


def test_files_that_questions_name(spark, monkeypatch):
    monkeypatch.setattr(batch, "MAX_NEEDLES", 1)
    files = spark.createDataFrame([(1, "app/Cart.cs"), (1, "app/x.cs"), (2, "lib/CARTS.ts"), (3, "lib/y.ts"), (4, None)], "doc_id long, path string")
    needles = spark.createDataFrame([(7, "cart", False), (8, "lib/", False), (9, "none", False)], "question_id int, needle string, is_phrase boolean")
    found = batch.files_with_needles(files, needles)
    assert sorted(map(tuple, found.collect())) == [(1, "cart"), (2, "cart"), (2, "lib/"), (3, "lib/")]


def test_coverage_counts_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(batch, "HITS", 5)
    hits = [(d, n) for d in range(20) for n, step in (("ring", 2), ("app", 1), ("cs", 3)) if d % step == 0] * 2
    named = [(1, "ring"), (1, "cs"), (1, "ring"), (2, "app"), (2, "none"), (3, "none"), (4, "cs"), (4, "ring"), (None, "cs")]
    answers = [(1, 2, 1), (1, 5, 2), (1, 3, 3), (2, 7, 1), (2, 7, 1), (3, 1, 1), (4, 1, 1), (9, 2, 1)]
    hits = spark.createDataFrame(hits, "doc_id long, needle string")
    named = spark.createDataFrame(named, "question_id int, needle string")
    answers = spark.createDataFrame(answers, "question_id int, doc_id long, rank int")
    wanted = batch.coverage_of_answers(answers, hits.distinct().join(named, "needle").select("question_id", "doc_id"))
    found = batch.coverage_of_named(answers, hits, named)
    assert found.columns == wanted.columns and {r.question_id: tuple(r) for r in found.collect()} == {r.question_id: tuple(r) for r in wanted.collect()}


def test_replay_makes_no_row_for_a_question_and_a_document(spark, tmp_path):
    """120 questions name what all of 120 documents list: 14,400 pairs, of which no stage may write rows."""
    import json

    from wayfind.plans.catalogue import QUERIES

    folder, many = str(tmp_path), 120
    ids = spark.range(many).coalesce(1)
    ids.selectExpr("id as p_partkey", "'red bolt' as p_name", "'Brand#1' as p_brand", "'LARGE' as p_type", "1 as p_size").write.parquet(f"{folder}/part.parquet")
    ids.selectExpr("id as l_orderkey", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber").write.parquet(f"{folder}/lineitem.parquet")
    ids.selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'s' as source").write.parquet(f"{folder}/documents.parquet")
    ids.selectExpr("id as conv_id", "0 as turn", "'user' as role", "concat('about RedBolt and ', id) as text").write.parquet(f"{folder}/conversations.parquet")
    plan = QUERIES["question_replay"](spark, folder)
    rows = {r.question_id: (r.expected, r.found) for r in plan.collect()}
    assert rows == {i: (many, 10) for i in range(many)}
    made: list[int] = []

    def walk(node) -> None:
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            made.append(metrics.apply("numOutputRows").value())
        children = list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(node.children()))
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            children = [node.executedPlan()]
        elif "QueryStage" in name:
            children = [node.plan()]
        for child in children:
            walk(child)

    walk(plan._jdf.queryExecution().executedPlan())
    assert made and max(made) < many * many / 2, json.dumps(made)


def test_many_needles_take_one_pass(spark):
    files = spark.createDataFrame([(1, "app/name29999x.cs"), (2, "lib/long_name_of_a_needle_77.ts"), (3, "lib/long_name_of_a_needle_7.ts")], "doc_id long, path string")
    texts = [f"name{i}" for i in range(29_990, 30_010)] + [f"long_name_of_a_needle_{i}" for i in range(60, 80)] + [f"n{i}z" for i in range(30_000)]
    needles = spark.createDataFrame([(1, t) for t in texts], "question_id int, needle string")
    found = batch.files_with_needles(files, needles)
    assert sorted(map(tuple, found.collect())) == [(1, "name29999"), (2, "long_name_of_a_needle_77")]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("big", [False, True], ids=["small sums", "large sums"])
def test_tile_holds_the_leading_documents(big, monkeypatch):
    monkeypatch.setattr(batch, "COLUMNS", 8)
    rng = np.random.default_rng(5)
    docs, asking, keys, steps = 700, 60, 90, [1.12, 0.95, 1.45]
    have = rng.random((docs, keys)) < np.linspace(0.004, 0.9, keys)
    kind = np.where(np.arange(keys) < 60, batch.TERMS, np.where(np.arange(keys) < 75, batch.NAMED, batch.TOLD))
    gain = np.where(kind == batch.TERMS, rng.integers(1, 40, (docs, keys)), np.where(kind == batch.NAMED, 160, 70)) * have
    times = (rng.random((asking, keys)) < 0.2) * rng.integers(1, 3, (asking, keys)) * (500 if big else 1)
    bits = rng.integers(0, 8, (2, docs))
    rows = []
    for d in range(docs):
        of = {k: [int(x) for x in np.flatnonzero(have[d] & (kind == k))] for k in (batch.TERMS, batch.NAMED, batch.TOLD)}
        fields = [(x, float(part)) for x in of[batch.TERMS] for part in (gain[d, x] - 1, 1) if part]  # a term's fields are added up
        rows.append((d, batch.TERMS, [x for x, _ in fields], [part for _, part in fields], None))
        rows += [(d, k, of[k], None, None) for k in (batch.NAMED, batch.TOLD, batch.TOLD)]  # a name may be told twice
        rows.append((d, batch.CLASSES, [3, 9], None, bits[:, d].tolist()))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fields = [("doc_id", pa.int64()), ("kind", pa.int32()), ("keys", pa.list_(pa.int64())), ("gains", pa.list_(pa.float64())), ("bits", pa.list_(pa.int64()))]
    left = pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(fields)})
    asked = [(q, (3, 9)[q % 2], np.flatnonzero(times[q]).tolist(), times[q][times[q] > 0].tolist()) for q in range(asking)]
    fields = [("question_id", pa.int64()), ("class", pa.int64()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    right = pa.table({name: pa.array([r[i] for r in asked], t) for i, (name, t) in enumerate(fields)})
    found = batch._tile(10, steps)(left, right).to_pylist()
    for q in range(asking):
        score = (gain @ times[q]).astype(float)
        for i, step in enumerate(steps):
            score *= np.where(bits[q % 2] >> i & 1, step, 1.0)
        best = np.lexsort((np.arange(docs), -score))[:10]
        assert [(r["doc_id"], r["score"]) for r in found if r["question_id"] == q] == [(d, score[d]) for d in best if score[d] > 0]
