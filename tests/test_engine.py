"""Index build and the search tools, end to end on the hand-written repository."""

from __future__ import annotations

import pytest

from wayfind.plans.engine import Engine
from wayfind.sources.index import index_health, index_summary
from wayfind.sources.listing import discovery_report, list_files

QUERY = "Which service method handles RefundPayment of an order?"


@pytest.fixture(scope="module")
def engine(index, settings, profile):
    return Engine(index, settings, profile)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_documents_by_loader(index):
    kinds = {r["source_type"]: r["documents"] for r in rows(index_summary(index))}
    assert kinds == {
        "graph.json": 1, "graph chunk": 4, "dependency-edges.enrichment.json": 1, "source-files.txt": 1, "behavior pack": 1, ".md": 1,
    }


def test_source_list_is_distinct_and_slashed(index):
    files = index.documents.where("source_type = 'source-files.txt'").join(index.doc_files.withColumnRenamed("path", "file"), "doc_id")
    assert sorted(r["file"] for r in rows(files)) == ["backend/Services/OrderService.cs", "ui/src/pages/CartPage.tsx"]


def test_corpus_mirror_is_cut(index):
    assert "ui/src/api/orders.ts" in {r["path"] for r in rows(index.doc_files)}


def test_edges_resolved_by_id_label_and_not_at_all(index):
    graph = index.documents.where("source_type = 'graph.json'").select("doc_id")
    edges = {(r["source_label"], r["relation"], r["target_label"], r["target_file"]) for r in rows(index.doc_edges.join(graph, "doc_id"))}
    assert edges == {
        (".CreateOrder()", "calls", ".PlaceOrderAsync()", "backend/Services/OrderService.cs"),
        ("CartPage", "imports", "placeOrder()", "ui/src/api/orders.ts"),
        ("placeOrder()", "calls", "OrderController", "backend/Controllers/OrderController.cs"),
        (".CreateOrder()", "uses", "Unknown", ""),
    }


def test_symbols_keep_captured_kinds(index):
    kinds = {(r["label"], r["kind"]) for r in rows(index.doc_symbols)}
    assert ("OrderService", "service_class") in kinds
    assert (".RefundPayment()", "service_method") in kinds
    assert ("CartPage", "ui_component") in kinds


def test_health_and_discovery(spark, index, repository, settings):
    listing = list_files(spark, repository, settings)
    health = rows(index_health(index, listing))[0]
    assert health["status"] == "ok" and health["document_count"] == 9
    status = {r["root"]: r["status"] for r in rows(discovery_report(listing, [*settings.roots, {"path": "missing", "kind": "docs", "required": True}]))}
    assert status == {"graph-out": "ok", "docs": "ok", "missing": "error"}


def test_keyword_search(engine):
    answer = engine.search_context(QUERY)
    files = [r["path"] for r in rows(answer.files.orderBy("rank"))]
    assert files[0] == "backend/Services/OrderService.cs"
    owner = rows(answer.primary_owner)[0]
    assert owner["path"] == "backend/Services/OrderService.cs" and owner["label"] == ".RefundPayment()"
    assert owner["line_status"] == "exact" and owner["line"] == 12
    blocks = rows(answer.code_blocks)
    assert 0 < len(blocks) <= 6 and any(">12:     private int RefundPayment" in b["text"] for b in blocks)
    confidence = rows(answer.confidence)[0]["confidence"]
    assert 0.3 < confidence <= 0.95
    assert rows(answer.dependencies) and rows(answer.related) and rows(answer.facts)
    assert {r["name"] for r in rows(answer.modules)} == {"shop"}


def test_adjusted_line_is_reported(engine):
    answer = engine.search_context("PlaceOrderAsync order service")
    hit = [r for r in rows(answer.symbols) if r["label"] == ".PlaceOrderAsync()"][0]
    assert (hit["graph_line"], hit["line"], hit["line_status"], hit["line_delta"]) == (9, 7, "adjusted", -2)


@pytest.mark.parametrize("mode", ["keyword", "semantic", "hybrid"])
def test_hybrid_modes(engine, mode):
    answer = engine.search_context_hybrid(QUERY, mode=mode)
    files = [r["path"] for r in rows(answer.files.orderBy("rank"))]
    assert "backend/Services/OrderService.cs" in files[:3]
    assert len(files) == len(set(files))
    assert rows(answer.primary_owner)[0]["path"] == "backend/Services/OrderService.cs"
    assert 0 < rows(answer.confidence)[0]["confidence"] <= 0.95


def test_negated_identifier_is_not_the_owner(engine):
    answer = engine.search_context_hybrid("refund payment order service, PlaceOrderAsync is not the owner")
    assert rows(answer.primary_owner)[0]["label"] != ".PlaceOrderAsync()"


def test_summaries(engine):
    module = engine.get_module_summary("shop")
    assert rows(module["summary"])[0]["summary"].startswith("- Placing an order")
    assert len(rows(module["facts"])) >= 2
    pack = engine.get_pack("orders")
    assert {r["path"] for r in rows(pack["source_files"])} >= {"backend/Services/OrderService.cs"}


def test_call_reports_errors(engine):
    assert engine.call("nope", {})["error"].startswith("Unknown tool")
    assert engine.call("search_context", {"query": "  "})["error"] == "query is required."


def test_log_round_trip(spark, index, settings, profile, tmp_path):
    engine = Engine(index, settings, profile, log_folder=str(tmp_path))
    engine.call("search_context", {"query": QUERY})
    event = rows(spark.read.json(f"{tmp_path}/events"))[0]
    assert event["tool"] == "search_context" and event["files_returned"] > 0 and event["primary_owner_present"]
    engine.record_outcome(event["event_id"], " Success ", used_suggested_files=2)
    outcome = rows(spark.read.json(f"{tmp_path}/outcomes"))[0]
    assert outcome["outcome"] == "success" and outcome["failure_reason"] == "none"
    with pytest.raises(Exception, match="outcome must be one of"):
        engine.record_outcome("e", "great").collect()
