"""Project profiles: optional hooks that adapt ranking to one project.

A profile is a plain object.  Hooks about the query run on the driver; hooks
about rows take and return *Columns*, so that a profile never leaves generated
code.  Every hook has a neutral default.
"""

from __future__ import annotations

import importlib

from pyspark.sql import Column
from pyspark.sql import functions as F


class Profile:
    name = ""

    # -- query hooks (driver) ------------------------------------------------
    def expand_query_tokens(self, query: str, tokens: list[str]) -> list[str]:
        return []

    def module_intent_tokens(self) -> dict[str, tuple[str, ...]]:
        return {}

    def pinned_owner_files(self, tokens: list[str]) -> list[str]:
        return []

    def infer_module(self, path: str) -> str | None:
        return None

    def low_signal_terms(self) -> tuple[str, ...]:
        return ()

    def noise_files(self) -> dict[str, tuple[str, ...]]:
        return {}

    def gap_queries(self) -> list[tuple[tuple[str, ...], str]]:
        return []

    def proactive_gap_queries(self) -> list[tuple[tuple[str, ...], str]]:
        return []

    def extra_owner_file_patterns(self) -> tuple[str, ...]:
        return ()

    def pack_files_for_intents(self, tokens: list[str]) -> list[str]:
        return []

    # -- row hooks (Column in, Column out) -----------------------------------
    def expansions(self, tokens: Column) -> Column:
        """What ``expand_query_tokens`` adds, for a table of questions."""
        return F.array().cast("array<string>")

    def adjust_document_score(self, score: Column, plan, path: Column, pack: Column, title: Column) -> Column:
        """``plan`` is a query's plan, or the columns of planned questions (tokens, modules, intents)."""
        return score

    def adjust_owner_score(self, score: Column, plan, path: Column) -> Column:
        return score

    def adjust_primary_owner_score(self, score: Column, plan, path: Column) -> Column:
        return score

    def adjust_scoped_score(self, score: Column, path: Column, modules: Column, packs: Column) -> Column:
        return score

    def module_of(self, path: Column) -> Column:
        return F.lit(None).cast("string")


class TableProfile(Profile):
    """A profile given as small tables instead of code."""

    def __init__(
        self,
        name: str = "tables",
        synonyms: dict[str, tuple[str, ...]] | None = None,
        modules: dict[str, tuple[str, ...]] | None = None,
        pins: list[tuple[tuple[str, ...], tuple[str, ...]]] | None = None,
        module_paths: list[tuple[str, str]] | None = None,
        low_signal: tuple[str, ...] = (),
        noise: dict[str, tuple[str, ...]] | None = None,
        gaps: list[tuple[tuple[str, ...], str]] | None = None,
        owner_patterns: tuple[str, ...] = (),
        pack_files: list[tuple[tuple[str, ...], tuple[str, ...]]] | None = None,
    ) -> None:
        self.name = name
        self._synonyms = synonyms or {}
        self._modules = modules or {}
        self._pins = pins or []
        self._module_paths = module_paths or []
        self._low_signal = low_signal
        self._noise = noise or {}
        self._gaps = gaps or []
        self._patterns = owner_patterns
        self._pack_files = pack_files or []

    def expand_query_tokens(self, query, tokens):
        present = set(tokens)
        return [extra for trigger, extras in self._synonyms.items() if trigger in present for extra in extras]

    def expansions(self, tokens):
        if not self._synonyms:
            return super().expansions(tokens)
        none = F.array().cast("array<string>")
        found = [F.when(F.array_contains(tokens, t), F.array(*[F.lit(e) for e in extras])).otherwise(none) for t, extras in self._synonyms.items() if extras]
        return F.concat(*found) if found else none

    def module_intent_tokens(self):
        return self._modules

    def pinned_owner_files(self, tokens):
        present = set(tokens)
        return next((list(paths) for triggers, paths in self._pins if present & set(triggers)), [])

    def infer_module(self, path):
        lowered = path.replace("\\", "/").lower()
        return next((module for marker, module in self._module_paths if marker in lowered), None)

    def module_of(self, path):
        lowered = F.lower(F.translate(path, "\\", "/"))
        chain = None
        for marker, module in self._module_paths:
            hit = lowered.contains(marker)
            chain = F.when(hit, F.lit(module)) if chain is None else chain.when(hit, F.lit(module))
        return F.lit(None).cast("string") if chain is None else chain

    def low_signal_terms(self):
        return self._low_signal

    def noise_files(self):
        return self._noise

    def gap_queries(self):
        return self._gaps

    def extra_owner_file_patterns(self):
        return self._patterns

    def pack_files_for_intents(self, tokens):
        present = set(tokens)
        return list(dict.fromkeys(path for triggers, paths in self._pack_files if present & set(triggers) for path in paths))


def load_profile(module_name: str) -> Profile:
    """Profile object ``PROFILE`` of an importable module; any failure gives the neutral profile."""
    if not module_name:
        return Profile()
    try:
        loaded = getattr(importlib.import_module(module_name), "PROFILE")
    except Exception:  # a broken plug-in must not stop a search
        return Profile()
    return loaded if isinstance(loaded, Profile) else Profile()
