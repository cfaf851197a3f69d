"""The plan of a query: everything that depends on the query text alone.

The same expressions plan a table of questions and a single query.  The plan of a
single query is evaluated once and enters the DataFrame plans as literals (no join,
no broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions import classify as cl
from wayfind.functions import identifiers as ids
from wayfind.functions import text as tx
from wayfind.sources.profile import Profile


def clean_query(value: object, name: str = "query") -> str:
    """Trimmed query text, or an error if it is empty or too long."""
    text = str(value or "").strip()
    if not text:
        raise ValueError(f"{name} is required.")
    if len(text) > C.MAX_QUERY_CHARS:
        raise ValueError(f"{name} must be {C.MAX_QUERY_CHARS} characters or fewer.")
    return text


def clamp_int(value: object, default: int, low: int, high: int) -> int:
    try:
        number = int(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        number = default
    return min(high, max(low, number))


def coerce_bool(value: object, default: bool) -> bool:
    if value is None:
        return default
    if isinstance(value, str):
        word = value.strip().lower()
        if word in ("1", "true", "yes", "on"):
            return True
        if word in ("0", "false", "no", "off"):
            return False
    return bool(value)


GENERIC = frozenset(C.GENERIC_FILE_TOKENS)


@dataclass(frozen=True)
class QueryPlan:
    """Tokens, identifiers, intents and profile of one query."""

    text: str
    tokens: tuple[str, ...]
    identifiers: tuple[str, ...]
    affirmed: tuple[str, ...]
    named_files: frozenset[str]
    modules: frozenset[str]
    dominant: frozenset[str]
    intents: frozenset[str]
    query_profile: str
    generic: frozenset[str] = field(default_factory=frozenset)
    pins: tuple[str, ...] = ()
    #: identifiers that are no plain words, and the query's own words without those of negated identifiers
    strict: tuple[str, ...] = ()
    strict_affirmed: tuple[str, ...] = ()
    owner_words: tuple[str, ...] = ()

    @property
    def phrase(self) -> str:
        return self.text.strip().lower()

    @property
    def token_set(self) -> frozenset[str]:
        return frozenset(self.tokens)

    @property
    def distinctive(self) -> tuple[str, ...]:
        """Distinct tokens that are not generic, sorted so that plans are reproducible."""
        return tuple(sorted(self.token_set - self.generic))

    @property
    def informative(self) -> tuple[str, ...]:
        excluded = set(C.STOP_WORDS) | set(C.OWNER_EXCLUDED_TOKENS) | self.generic
        return tuple(sorted(t for t in self.token_set if len(t) >= 3 and t not in excluded))

    def token_counts(self) -> dict[str, int]:
        """A repeated query token counts once per occurrence."""
        counts: dict[str, int] = {}
        for token in self.tokens:
            counts[token] = counts.get(token, 0) + 1
        return counts


def _words_of(names: Column) -> Column:
    return F.flatten(F.transform(names, tx.search_tokens))


def reading(text: Column) -> dict[str, Column]:
    """What a query text says by itself: its tokens, identifiers and files."""
    own, identifiers, affirmed = tx.search_tokens(text), ids.query_identifiers(text), ids.affirmed_identifiers(text)
    strict, strict_affirmed = ids.strict_identifiers(identifiers), ids.strict_identifiers(affirmed)
    denied = F.array_except(_words_of(strict), _words_of(strict_affirmed))
    return {
        "own": own, "identifiers": identifiers, "affirmed": affirmed, "named_files": ids.named_files(text), "strict": strict,
        "strict_affirmed": strict_affirmed, "owner_words": F.array_sort(F.array_distinct(F.array_except(own, denied))),
    }


def judged(tokens: Column, vocabulary: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """What the tokens of a query ask for: modules, intents and the query's kind."""
    intents = cl.query_intents(tokens, vocabulary)
    return {
        "modules": cl.module_intents(tokens, vocabulary), "dominant": cl.dominant_modules(tokens, vocabulary), "intents": intents,
        "query_profile": cl.query_profile(tokens, intents),
    }


def _one_row(columns: dict[str, Column]) -> dict:
    return SparkSession.active().range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def plan_query(text: str, profile: Profile | None = None) -> QueryPlan:
    """The plan of one text, by the expressions that plan a table of questions (see ``plan_questions``)."""
    profile = profile or Profile()
    vocabulary = profile.module_intent_tokens()
    said = _one_row(reading(F.lit(text)))
    own = said.pop("own")
    tokens = tuple(own) + tuple(profile.expand_query_tokens(text, list(own)))
    found = _one_row(judged(cl.lit_array(tokens), vocabulary))
    dominant = frozenset(found["dominant"])
    pins = tuple(profile.pinned_owner_files(list(tokens)))
    if dominant:
        pins = tuple(p for p in pins if (m := profile.infer_module(p)) is None or m in dominant)
    named = frozenset(said.pop("named_files"))
    return QueryPlan(
        text=text, tokens=tokens, named_files=named, modules=frozenset(found["modules"]), dominant=dominant, intents=frozenset(found["intents"]),
        query_profile=found["query_profile"], generic=GENERIC | frozenset(vocabulary), pins=pins, **{k: tuple(v) for k, v in said.items()},
    )


def plan_questions(questions: DataFrame, profile: Profile | None = None, text: str = "text") -> DataFrame:
    """``questions`` with the columns of their plans: tokens, phrase, identifiers, affirmed, modules, intents, query_profile and more."""
    profile = profile or Profile()
    said = reading(F.trim(F.coalesce(F.col(text), F.lit(""))))
    rows = questions.select("*", *[c.alias(n) for n, c in said.items()])
    rows = rows.withColumn("tokens", F.concat("own", profile.expansions(F.col("own"))))
    found = judged(F.col("tokens"), profile.module_intent_tokens())
    return rows.select("*", F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("phrase"), *[c.alias(n) for n, c in found.items()])
