"""Operators against brute force on small, deliberately skewed inputs."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfind.functions import identifiers as ids
from wayfind.functions import paths as pt
from wayfind.functions import text as tx
from wayfind.functions import vectors as vec
from wayfind.operators import chunks, dedup, graph, skew, summaries, usage
from wayfind.operators import symbols as sy
from wayfind.plans import query as pq


def one(spark, expression, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names)
    return df.select(expression.alias("x")).first()["x"]


TOKEN_CASES = {
    "": [],
    "OrderService2 handles followups": ["order", "service2", "handles", "handle", "followups", "followup"],
    "the FILE XMLParser": ["xmlparser"],
    "addresses bus": ["addresses", "addresse", "bus"],
    "éTat Ünïcode x a1": ["tat", "a1"],
    "followup camelCaseID": ["followup", "follow", "up", "camel", "case", "id"],
}


@pytest.mark.parametrize("text", TOKEN_CASES)
def test_tokeniser(spark, text):
    assert one(spark, tx.search_tokens(F.col("t")), t=text) == TOKEN_CASES[text]


IDENTIFIERS = {
    "Fix OrderService in cart.page.tsx but not CartHelper": (["OrderService", "cart", "page", "tsx", "CartHelper"], {"CartHelper"}),
    "where is HMS_ledger v2? GetForm is not the owner": (["HMS_ledger", "GetForm"], {"GetForm", "HMS_ledger"}),
    "plain words only": ([], set()),
}


@pytest.mark.parametrize("text", IDENTIFIERS)
def test_identifiers(spark, text):
    every, denied = IDENTIFIERS[text]
    assert one(spark, ids.query_identifiers(F.col("t")), t=text) == every
    assert set(every) - set(one(spark, ids.affirmed_identifiers(F.col("t")), t=text)) <= denied


def test_negation_reaches_forty_characters(spark):
    near = "GetForm is not the owner"
    far = "GetForm " + "x" * 45 + " not relevant"
    assert one(spark, ids.affirmed_identifiers(F.col("t")), t=near) == []
    assert "GetForm" in one(spark, ids.affirmed_identifiers(F.col("t")), t=far)


def test_written_out_plans(spark):
    from wayfind.plans.catalogue import settings as st

    assert pq.plan_query(st.QUERY_TEXT, st.PROFILE) == st.PLAN
    assert pq.plan_query(st.SYMBOL_TEXT) == st.SYMBOL_PLAN
    strength = {n: ids.corroboration_strength(F.lit(n), F.array(*map(F.lit, st.SYMBOL_PLAN.tokens)), F.array(*map(F.lit, st.SYMBOL_PLAN.identifiers)), tuple(st.SYMBOL_PLAN.generic)) for n in st.SYMBOL_PLAN.identifiers}
    assert spark.range(1).select(*[c.alias(n) for n, c in strength.items()]).first().asDict() == st.SYMBOL_STRENGTH


def test_questions_are_planned_as_single_queries(spark):
    from wayfind.plans.catalogue import settings as st

    texts = [st.QUERY_TEXT, st.SYMBOL_TEXT, "", "where is HMS_ledger v2? GetForm is not the owner"]
    rows = pq.plan_questions(spark.createDataFrame(list(enumerate(texts)), "question_id int, text string"), st.PROFILE).collect()
    for r in rows:
        plan = pq.plan_query(texts[r.question_id], st.PROFILE)
        assert (tuple(r.tokens), tuple(r.identifiers), frozenset(r.modules), frozenset(r.intents), r.query_profile, r.phrase) == (
            plan.tokens, plan.identifiers, plan.modules, plan.intents, plan.query_profile, plan.phrase,
        )


def test_query_plan(spark):
    plan = pq.plan_query("Which service handles the refund workflow bridge?")
    assert plan.query_profile == "cross_module_bridge"
    assert {"ownership", "business_flow", "implementation_trace", "cross_module"} <= plan.intents
    assert pq.plan_query("ordinary words").intents == {"general"}
    with pytest.raises(ValueError):
        pq.clean_query("x" * 8001)
    assert [pq.clamp_int(v, 5, 1, 9) for v in ("7", None, 40, -3)] == [7, 5, 9, 1]
    assert [pq.coerce_bool(v, True) for v in ("off", "Yes", None, 0)] == [False, True, True, False]


def chunk_texts(text, overlap=200):
    return [text[b:e].strip() for b, e in chunks.chunk_spans(text, 3200, overlap, 200)]


def test_chunks_end_at_the_best_boundary():
    assert chunk_texts("") == []
    assert chunk_texts("x") == ["x"]
    assert [len(c) for c in chunk_texts("a" * 3300)] == [3200, 300]
    first, second = chunk_texts("b" * 3000 + ". " + "c" * 400)
    assert first == "b" * 3000 + "." and second.startswith("b" * 199 + ".")


def test_a_short_tail_lengthens_the_last_chunk():
    assert chunk_texts("d" * 3200 + "e" * 100, overlap=0) == ["d" * 3200 + "e" * 100]
    text = ("word " * 700 + "\n## part\n") * 3 + "tail"
    assert chunk_texts(text)[-1].endswith("tail")
    covered = {i for b, e in chunks.chunk_spans(text, 3200, 200, 200) for i in range(b, e)}
    assert covered == set(range(len(text)))


def test_hash_embedding_is_unit_length_and_hashed(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "")], "k int, t string")
    rows = {r["k"]: r["vector"] for r in vec.hash_embeddings(docs, "k", "t", 32).collect()}
    expected = [0.0] * 32
    for term, weight in (("alpha", 1.0), ("beta", 1.0), ("alpha", 1.0), ("alpha beta", 0.55), ("beta alpha", 0.55)):
        digest = hashlib.sha1(term.encode()).digest()
        expected[int.from_bytes(digest[:4], "big") % 32] += weight if digest[4] % 2 == 0 else -weight
    norm = sum(v * v for v in expected) ** 0.5
    assert rows[1] == pytest.approx([v / norm for v in expected], abs=1e-6)
    assert rows[2] == [0.0] * 32


def related(a: str, b: str) -> bool:
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def test_suffix_dedup_equals_greedy_fold(spark):
    rng = random.Random(7)
    parts = ["a", "b", "c"]
    # a third of all rows share one file name at every depth
    paths = ["/".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + "/" + rng.choice(["index.ts", "index.ts", "x.cs", "y.cs"]) for _ in range(120)]
    rows = [(p.lstrip("/"), rng.randint(0, 30), i) for i, p in enumerate(paths)]
    kept: list[tuple] = []
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        if not any(related(row[0].lower(), k[0].lower()) for k in kept):
            kept.append(row)
    df = spark.createDataFrame(rows, "path string, rank int, n int")
    order = [F.col("rank"), F.col("n")]
    expected = sorted(k[2] for k in kept)
    assert sorted(r["n"] for r in dedup.suffix_dedup_short(df, "path", order).collect()) == expected
    assert sorted(r["n"] for r in dedup.suffix_dedup(df, "path", order).collect()) == expected


def test_first_later_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    right = [(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}"), rng.randint(0, 40_000), i) for i in range(400)]
    left = [(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 7)}"), rng.randint(-100, 41_000), i) for i in range(200)]
    to_df = lambda rows, name: spark.createDataFrame(rows, f"file string, s long, {name} int").withColumn("ts", F.timestamp_seconds("s"))
    expected = {}
    for key, at, n in left:
        later = [(t, i) for k, t, i in right if k == key and t > at]
        expected[n] = min(later)[1] if later else None
    found = usage.first_later(to_df(left, "l"), to_df(right, "r"), "file", ["l"], ["r"], bucket_seconds=900)
    assert {r["l"]: r["next_r"] for r in found.collect()} == expected


def test_coverage_first_cap_keeps_one_edge_per_file_first(spark):
    rng = random.Random(1)
    rows = [("hub", rng.choice(["a", "a", "a", "b", ""]), i) for i in range(90)] + [("hub", "last", 90), ("leaf", "a", 1)]
    df = spark.createDataFrame(rows, "anchor string, other_file string, pos int")
    capped = graph.coverage_first_cap(df, ["pos"], 10)
    hub = sorted((r["slot"], r["pos"], r["other_file"]) for r in capped.where("anchor = 'hub'").collect())
    seen, first, rest = set(), [], []
    for _, other, pos in [r for r in rows if r[0] == "hub"]:
        (rest if (not other or other in seen) else first).append(pos)
        seen.add(other)
    assert [h[1] for h in hub] == (first + rest)[:10]
    assert "last" in {h[2] for h in hub}


def test_coverage_first_cap_deals_hints_once(spark):
    rng = random.Random(3)
    others = ["", "A", "a", "b", "B/x", None, *(f"f{i}" for i in range(12))]
    rows = [(rng.choice(["hub", "hub", "hub", "HUB", "leaf", None]), rng.choice(others), pos) for pos in rng.sample(range(9000), 3000)]
    df = spark.createDataFrame(rows, "anchor string, other_file string, pos int").repartition(3, "pos")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        capped = graph.coverage_first_cap(df, ["pos"], 10)
        found = sorted(((r["anchor"] or "-", r["slot"], r["pos"], r["other_file"]) for r in capped.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = []
    for anchor in {r[0] for r in rows}:
        seen, lines = set(), []
        for _, other, pos in sorted((r for r in rows if r[0] == anchor), key=lambda r: r[2]):
            key = None if other is None else other.lower()
            # without a name, the first row is neither deferred nor not, and nulls come first
            lines.append((2 if key in seen or key == "" else 0 if key is None else 1, pos, other))
            seen.add(key)
        expected += [(anchor or "-", slot, pos, other) for slot, (_, pos, other) in enumerate(sorted(lines, key=lambda x: x[:2])[:10], 1)]
    assert found == sorted(expected, key=str)
    plan = graph.coverage_first_cap(spark.createDataFrame(rows, "anchor string, other_file string, pos int"), ["pos"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    hub = pa.RecordBatch.from_pydict({"anchor": ["hub"] * 5000, "other_file": [f"f{i}" for i in range(5000)], "pos": list(range(5000)), "_other": [f"f{i}" for i in range(5000)], "_turn": [0] * 5000})
    (sent,) = graph._leading_of_batches(["pos"], 10)(iter([hub]))
    assert sent.num_rows == 10 and sent.schema.names == ["anchor", "other_file", "pos"]


def test_upper_median(spark):
    rows = [("a", v) for v in (5.0, 1.0, 3.0, 2.0)] + [("b", 7.0)] * 9 + [("c", float(v)) for v in range(101)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r["k"]: r["median"] for r in summaries.upper_median(df, "k", "v", 4).collect()} == {"a": 3.0, "b": 7.0, "c": 50.0}


@pytest.mark.parametrize("path,out", [("a/b.cs", False), ("a/../b.cs", False), ("../b.cs", True), ("a/../../b.cs", True), ("/etc/x", True), ("C:/x", True)])
def test_path_escape(spark, path, out):
    assert one(spark, pt.escapes_root(F.col("p")), p=path) is out


def test_group_limit_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    plan = skew.top_per_key(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_all_statements_and_file_lines_of_a_text_count(spark):
    facts = ["- a repeated statement of this text"] * 30 + [f"- statement number {i} of a long text" for i in range(40)]
    files = [f"src/part{i}.cs" for i in range(150)]
    rows = spark.createDataFrame([("\n".join(facts + files),)], "text string")
    row = rows.select(tx.fact_lines(F.col("text")).alias("facts"), tx.source_file_lines(F.col("text")).alias("files"), tx.fact_lines(F.col("text"), 3).alias("few")).first()
    assert row["facts"] == [line[2:] for line in facts[29:]]
    assert [f for f in row["files"] if f.startswith("src/part")] == files
    assert row["few"] == row["facts"][:3]


def test_gates_see_whole_chunks_and_all_files(spark):
    from types import SimpleNamespace

    from wayfind.plans import hybrid
    from wayfind.sources.config import Settings

    settings, text = Settings(dimensions=16), "refund payment " * 100 + "RefundPolicy"
    vector = hybrid.query_vector(SimpleNamespace(spark=spark), text, settings)
    index = SimpleNamespace(
        spark=spark, chunks=spark.createDataFrame([("c", 1, text, vector)], "chunk_id string, doc_id long, text string, vector array<double>"),
        documents=spark.createDataFrame([(1, *"pqrstu")], "doc_id long, path string, title string, source string, source_type string, module string, pack string"),
        doc_files=spark.createDataFrame([(1, i, f"f{i}") for i in range(50)], "doc_id long, pos int, path string"),
    )
    row = hybrid.vector_candidates(index, text, settings).first()
    assert row["snippet"].endswith("RefundPolicy") and len(row["files"]) == 50


def test_missed_files_without_times(spark):
    from wayfind.operators import usage

    events = spark.createDataFrame(
        [("e1", 10, ["A.cs"]), ("e2", 30, ["a.cs", "b.cs"]), ("e0", None, ["c.cs"]), ("e3", 5, ["d.cs"])], "event_id string, t long, top_files array<string>"
    ).withColumn("ts", F.timestamp_seconds("t"))
    outcomes = spark.createDataFrame(
        [("o1", 10, ["a.cs", "c.cs", "d.cs", "none.cs"]), ("o2", None, ["a.cs", "d.cs", "c.cs", "none.cs"])], "outcome_id string, t long, missed_files array<string>"
    ).withColumn("ts", F.timestamp_seconds("t"))
    found = {(r.outcome_id, r.file): r.resolved_by_event for r in usage.missed_files(events, outcomes).collect()}
    assert found == {
        ("o1", "a.cs"): "e2", ("o1", "c.cs"): "e0", ("o1", "d.cs"): None, ("o1", "none.cs"): None,
        ("o2", "a.cs"): "e1", ("o2", "d.cs"): "e3", ("o2", "c.cs"): "e0", ("o2", "none.cs"): None,
    }


def test_scoped_scores_see_the_leading_results(spark):
    """A profile may score files by the modules and packs of the first 25 results."""
    from wayfind.operators import files as fl
    from wayfind.plans.catalogue.settings import PLAN
    from wayfind.sources.profile import Profile

    class Scoped(Profile):
        def adjust_scoped_score(self, score, path, modules, packs):
            return score * F.when(F.array_contains(modules, "m0") & F.array_contains(packs, "p24") & ~F.array_contains(packs, "p25"), 2.0).otherwise(0.0)

    schema = "doc_id string, rank int, score double, module string, pack string, source string, source_type string, source_level string, source_file string, title string"
    results = spark.createDataFrame([(f"d{i}", i + 1, 100.0 - i, f"M{i}", f"p{i}", f"s{i}", "graph.json", "central", None, "t") for i in range(30)], schema)
    listed = spark.createDataFrame([(f"d{i}", 0, f"app/Services/F{i}.cs") for i in range(30)], "doc_id string, pos int, path string")
    plain = {r.path: r.contribution for r in fl.file_contributions(results, listed, PLAN).collect()}
    scoped = {r.path: r.contribution for r in fl.file_contributions(results, listed, PLAN, Scoped()).collect()}
    assert len(plain) == 30 and set(scoped) == set(plain) and all(scoped[p] > plain[p] > 0 for p in plain)


def test_table_function_of_a_profile(spark):
    from wayfind.plans.hooks import injected_files
    from wayfind.sources.profile import TableProfile

    profile = TableProfile(pack_files=[(("a", "b"), ("x.cs", "y.cs")), (("c",), ("y.cs", "z.cs"))])
    planned = spark.createDataFrame([(1, ["a", "c"]), (2, ["c"]), (3, ["q"]), (4, [])], "question_id int, tokens array<string>")
    assert sorted(map(tuple, injected_files(planned, profile).collect())) == [(1, 0, "x.cs"), (1, 1, "y.cs"), (1, 2, "z.cs"), (2, 0, "y.cs"), (2, 1, "z.cs")]


def test_actionable_parts_and_written_statistics(spark, tmp_path):
    from types import SimpleNamespace

    from wayfind.operators import summaries as sm

    symbols = spark.range(100).select(F.col("id").cast("double").alias("score"), F.lit("p").alias("path"), F.lit(None).cast("int").alias("line"), F.col("id").cast("string").alias("label"))
    answer = SimpleNamespace(plan="hidden", files=spark.createDataFrame([("a.cs", None)], "path string, why string"), symbols=symbols, vectors=symbols)
    parts = sm.actionable_parts(answer)
    assert set(parts) == {"files", "symbols", "symbol_count"} and parts["symbol_count"].first()[0] == 100
    assert sorted(r.score for r in parts["symbols"].collect()) == [float(i) for i in range(20, 100)]
    for _ in range(2):
        sm.write_statistics(parts, str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "files")).collect()] == ['{"path":"a.cs","why":null}']
    assert spark.read.json(str(tmp_path / "symbols")).count() == 80


def test_hints_shuffle_names_once_and_columns_in_use(spark):
    from wayfind.operators import graph as g

    rows = [(2, "A", "Calls", "b", "X.cs", "y.cs", "L1"), (1, "a", "Calls", "B", "x.cs", "z.cs", "L2"), (3, "a", "uses", "B", "x.cs", "z.cs", "L3"), (4, "a", "uses", "c", "x.cs", "X.CS", "L4")]
    names = "pos long, source_label string, relation string, target_label string, source_file string, target_file string, source_location string"
    hints = g.dependency_hints(spark.createDataFrame(rows, names), ["pos"])
    assert sorted(r["pos"] for r in hints.collect()) == [1, 3] and hints.columns == [n.split()[0] for n in names.split(", ")]
    plan = hints.select("pos", "target_file")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "source_location" not in below.split("Scan")[0] and " AS _k" not in below and plan.count("Exchange") == 1


def test_symbols_are_read_once_and_relevance_counts_tokens(spark):
    from wayfind.functions.text import search_tokens
    from wayfind.operators import symbols as sy
    from wayfind.plans.catalogue.settings import SYMBOL_PLAN

    words = ("order", "follow", "item")
    labels = ["OrderItems()", "followup", "Reorder", "ITEM_Order", "none", "orders"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    counted = F.size(F.array_intersect(search_tokens(F.col("label")), F.array(*[F.lit(w) for w in words])))
    assert all(a == b for a, b in rows.select(sy.relevance(F.col("label"), words), counted).collect())
    symbols = spark.range(40).select(
        F.concat(F.lit("Order"), F.col("id") % 9).alias("label"), F.lit("service_method").alias("kind"), F.concat(F.lit("p"), F.col("id") % 3).alias("path"),
        F.col("id").alias("line"), F.lit(1.0).alias("score"), F.col("id").alias("pos"),
    )
    hits = sy.symbol_hits(symbols, SYMBOL_PLAN, ["pos"], identifiers=("Order3",), strict=("Order3",))
    assert "Range" not in hits._jdf.queryExecution().executedPlan().toString() and hits.count() == 20


def test_suffix_dedup_sends_nothing_to_the_driver(spark):
    from wayfind.operators import dedup as dd

    rows = [(i, p) for i, p in enumerate(["a/b/c.cs", "b/c.cs", "c.cs", "x/c.cs", "d.cs"])]
    kept = dd.suffix_dedup(spark.createDataFrame(rows, "n int, path string"), "path", [F.col("n")])
    assert sorted(r["path"] for r in kept.collect()) == ["a/b/c.cs", "d.cs", "x/c.cs"]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_symbols_meet_lines_without_a_join_by_name(spark):
    symbols = spark.createDataFrame(
        [
            (1, "a.cs", "Run()", "method", 20), (2, "a.cs", "Run()", "method", None), (3, "a.cs", "op.Do()", "method", 1),
            (4, "a.cs", "Run", "service_class", 20), (5, "b.cs", "Run()", "method", 3), (6, "a.cs", "a.cs", "file", 1), (7, None, "Run()", "method", 1),
        ],
        "slot int, path string, label string, kind string, line int",
    )
    lines = spark.createDataFrame(
        [("a.cs", 2, "Run (1); Run(2)"), ("a.cs", 30, "x = Run<int>()"), ("a.cs", 31, "return op.Do(1);"), ("a.cs", 32, ""), (None, 1, "Run()")],
        "path string, line_no int, text string",
    )
    checked = sy.verify_symbols(symbols, lines, ["slot"])
    assert {r.slot: (r.line, r.line_status, r.line_delta) for r in checked.collect()} == {
        1: (30, "adjusted", 10), 2: (2, "located", None), 3: (31, "adjusted", 30), 4: (20, "not_found", None),
        5: (3, "file_missing", None), 6: (1, "not_verifiable", None), 7: (1, "file_missing", None),
    }
    # one exchange by file; the only join left is that of labels with a pattern of their own
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1


def test_hints_around_some_edges_equal_those_among_all(spark):
    """Labels in several spellings and under several ids: an edge of another document may take the hint."""
    rng = random.Random(5)
    names = ["Load", "load", "SAVE", "save", "n1", "N2", "lone"]
    nodes = [(i, f"n{i % 9}", rng.choice([*names, ""]), rng.choice(["a.cs", "A.cs", "b.cs", ""]), f"L{i}") for i in range(14)]
    refs = [f"n{i}" for i in range(9)] + [*names, "gone", "GONE", " n3 "]
    edges = [(i, rng.choice(refs), rng.choice(refs), rng.choice(["calls", "Calls", "uses", "mentions"]), "") for i in range(160)]
    nodes.append((99, "far", "Far", "far.cs", "L1"))
    edges.append((200, "far", "n1", "calls", ""))
    nodes = spark.createDataFrame(nodes, "pos int, node_id string, label string, source_file string, source_location string")
    edges = spark.createDataFrame(edges, "pos int, source_ref string, target_ref string, relation string, source_location string")
    full = {tuple(r) for r in graph.dependency_hints(graph.resolve_edges(nodes, edges, ["pos"]), ["pos"]).collect()}
    for rest in range(8):
        own = edges.where((F.col("pos") % 8 == rest) & (F.col("pos") < 200))
        found = {tuple(r) for r in graph.hints_around(nodes, edges, own, ["pos"]).collect()}
        assert {r for r in found if r[0] % 8 == rest and r[0] < 200} == {r for r in full if r[0] % 8 == rest and r[0] < 200}
        assert 200 not in {r[0] for r in found}
