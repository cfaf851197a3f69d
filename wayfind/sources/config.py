"""Settings of an index and of searches, read from grouped JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from typing import Any

from wayfind import constants as C

MODES = ("keyword", "semantic", "hybrid")


@dataclass(frozen=True)
class Limits:
    """How much of a file an index keeps; None keeps all.  ``Limits.short()`` keeps what fits a small index."""

    text_bytes: int | None = None
    graph_nodes: int | None = None
    graph_edges: int | None = None
    files: int | None = None
    facts: int | None = None
    symbols: int | None = None
    hints: int | None = None
    route_entries: int | None = None
    graph_chunks: int | None = None
    chunk_nodes: int | None = None
    chunk_edges: int | None = None
    hint_documents: int | None = None
    note_chars: int | None = None

    @classmethod
    def short(cls) -> Limits:
        return cls(
            C.MAX_TEXT_BYTES, C.MAX_GRAPH_NODES, C.MAX_GRAPH_EDGES, C.MAX_DOC_FILES, C.MAX_FACTS, C.MAX_SYMBOL_HINTS, C.MAX_DEPENDENCY_HINTS,
            C.MAX_ROUTE_ENTRIES, C.MAX_GRAPH_CHUNKS, C.MAX_CHUNK_NODES, C.MAX_CHUNK_EDGES, 120, 1000,
        )


@dataclass(frozen=True)
class Settings:
    """All knobs in one place; unknown keys of a config file are reported, not ignored."""

    roots: tuple[dict, ...] = ({"path": "graph-out", "kind": "graph", "required": True}, {"path": "docs", "kind": "docs", "required": False})
    include_file_names: tuple[str, ...] = ("graph.json", *C.WELL_KNOWN_FILE_NAMES)
    include_path_contains: tuple[str, ...] = ("/behavior/",)
    knowledge_extensions: tuple[str, ...] = (".md", ".json", ".txt")
    ignore_parts: tuple[str, ...] = ("node_modules", "bin", "obj", ".git")
    ignore_extensions: tuple[str, ...] = (".png", ".jpg", ".dll")
    source_root_prefixes: tuple[str, ...] = ("graph-out/", "docs/")
    ownership_roots: dict[str, tuple[str, str]] = field(default_factory=dict)
    module_markers: tuple[str, ...] = ("graph-out", "ops-knowledge")
    limits: Limits = Limits()
    chunk_central_graph: bool = False
    enable_symbol_hints: bool = True
    enable_dependency_chain: bool = True
    symbol_kinds: tuple[str, ...] = C.CAPTURED_SYMBOL_KINDS
    relations: tuple[str, ...] = C.CAPTURED_RELATIONS
    line_window: int = 12
    block_before: int = 4
    block_after: int = 8
    max_blocks: int = 6
    max_results: int = 12
    max_files: int = 25
    file_candidate_documents: int = 50
    max_files_per_document: int = 0
    confidence_scale: float = C.CONFIDENCE_SCALE
    default_mode: str = "hybrid"
    top_k_keyword: int = 20
    top_k_vector: int = 12
    protected_keywords: int = 8
    keyword_weight: float = 1.0
    vector_weight: float = 0.35
    require_scope_match: bool = True
    min_vector_score: float = 0.0
    dimensions: int = C.EMBED_DIMENSIONS
    symbol_injection_window: int = 8
    #: keep the fused order; True re-sorts the final list by raw score
    final_order_by_score: bool = False
    #: path endings let through by the keyword gate for offline / worker queries
    allow_endings: tuple[str, ...] = ()


def load_settings(path: str | None) -> tuple[Settings, list[str]]:
    """Settings and warnings.  One level of grouping is flattened; keys that mean nothing are reported."""
    if not path or not os.path.exists(path):
        return Settings(), []
    with open(path, encoding="utf-8") as handle:
        raw = json.load(handle)
    flat: dict[str, Any] = {}
    for key, value in raw.items():
        if isinstance(value, dict) and key in ("settings", "search", "index", "rag", "controls"):
            for inner, setting in value.items():
                if isinstance(setting, dict) and inner in ("search", "discovery", "rag"):
                    flat.update(setting)
                else:
                    flat[inner] = setting
        else:
            flat[key] = value
    known = {f.name: f for f in fields(Settings)}
    warnings = [f"unknown setting: {key}" for key in flat if key not in known]
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known}
    if isinstance(values.get("limits"), dict):
        named = {f.name for f in fields(Limits)}
        warnings += [f"unknown limit: {key}" for key in values["limits"] if key not in named]
        values["limits"] = Limits(**{k: v for k, v in values["limits"].items() if k in named})
    return Settings(**values), warnings


def resolve_mode(settings: Settings, override: str | None = None, vectors_enabled: bool = True) -> str:
    """Explicit override, else keyword where vectors are off, else the configured default."""
    wanted = (override or "").strip().lower()
    if wanted in MODES:
        return wanted
    if not vectors_enabled:
        return "keyword"
    return settings.default_mode if settings.default_mode in MODES else "hybrid"
