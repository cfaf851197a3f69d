"""Code-like identifiers in a query text, as Column expressions over a query log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.arrays import once, running_sums
from wayfind.functions.text import ordered_distinct_ci, search_tokens, stripped

_WORDS = "(?U)" + C.IDENTIFIER_PATTERN


def _mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))


def looks_like_code(word: Column) -> Column:
    """Upper case, underscore, digit, or a very long compound; plain words are not identifiers."""
    return (word != F.lower(word)) | word.rlike("[_0-9]") | (F.length(word) >= 15)


def query_identifiers(text: Column, drop_stop_words: bool = True) -> Column:
    """Ordered distinct identifiers; dotted names contribute their parts."""

    def parts(word: Column) -> Column:
        dotted = F.filter(F.split(word, r"\."), lambda part: F.length(part) >= 3)
        single = F.when(looks_like_code(word), F.array(word)).otherwise(F.array().cast("array<string>"))
        return F.when(word.contains("."), dotted).otherwise(single)

    words = _mentions(text)
    if drop_stop_words:
        words = F.filter(words, lambda word: ~F.lower(word).isin(*C.STOP_WORDS))
    return ordered_distinct_ci(F.flatten(F.transform(words, parts)))


def strict_identifiers(identifiers: Column) -> Column:
    """Only genuine multi-word identifiers: hump, underscore, digit or long compound."""
    return F.filter(
        identifiers,
        lambda word: word.rlike("[_0-9]")
        | ((word == F.lower(word)) & (F.length(word) >= 15))
        | word.rlike("[a-z][A-Z]"),
    )


def named_files(text: Column) -> Column:
    """Dotted names taken whole, lower-cased and distinct."""
    return F.array_distinct(
        F.transform(F.filter(_mentions(text), lambda word: word.contains(".")), F.lower)
    )


def negated_identifiers(text: Column) -> Column:
    """Lower-cased identifiers with a negation cue within the character window on either side."""
    window = C.NEGATION_WINDOW_CHARS
    gaps = F.transform(F.split(text, _WORDS), F.length)

    def placed(bound: Column) -> Column:
        words = bound["words"]
        lengths = F.transform(words, F.length)
        ends = running_sums(F.zip_with(F.slice(bound["gaps"], 1, F.size(words)), lengths, lambda gap, size: gap + size))
        return F.zip_with(words, ends, lambda word, end: F.struct((end - F.length(word)).alias("start"), word.alias("word")))

    starts = once(F.struct(_mentions(text).alias("words"), gaps.alias("gaps")), placed)

    def negated(item: Column) -> Column:
        begin = F.greatest(F.lit(0), item["start"] - window)
        end = item["start"] + F.length(item["word"]) + window
        return F.substr(text, begin + 1, end - begin).rlike(C.NEGATION_PATTERN)

    hit = F.filter(starts, negated)
    names = F.transform(
        hit,
        lambda item: F.concat(
            F.array(F.lower(item["word"])),
            F.filter(F.split(F.lower(item["word"]), r"\."), lambda part: part != ""),
        ),
    )
    return F.array_distinct(F.flatten(names))


def affirmed_identifiers(text: Column) -> Column:
    """Identifiers that are never negated nearby (for the owner bonus only)."""
    negated = negated_identifiers(text)
    return F.filter(query_identifiers(text), lambda word: ~F.array_contains(negated, F.lower(word)))


def canonical_word(word: Column) -> Column:
    """Singular form used when words are compared across spellings."""
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 3) & word.endswith("ie"), F.concat(F.substr(word, F.lit(1), F.length(word) - 2), F.lit("y")))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def corroboration_strength(identifier: Column, query_tokens: Column, identifiers: Column, generic: tuple[str, ...]) -> Column:
    """Share of an identifier's own words the query also uses outside its identifiers; at least 0.4."""

    def canonical_words(name: Column) -> Column:
        return F.transform(F.filter(search_tokens(name), lambda t: ~t.isin(*generic)), canonical_word)

    own = F.array_distinct(canonical_words(identifier))
    inside = F.flatten(F.transform(identifiers, canonical_words))
    spoken = F.transform(query_tokens, canonical_word)
    backed = F.filter(
        own, lambda w: F.size(F.filter(spoken, lambda t: t == w)) > F.size(F.filter(inside, lambda t: t == w))
    )
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.4), F.size(backed) / F.size(own)))


def named_file_strength(name: Column, query_tokens: Column, generic: tuple[str, ...]) -> Column:
    """How far the query's words cover the distinctive words of a named file; at least 0.4."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    own = F.array_distinct(F.filter(search_tokens(F.translate(stem, "_-", "  ")), lambda t: ~t.isin(*generic)))
    covered = F.size(F.array_intersect(own, query_tokens))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.4), covered / F.size(own)))


def significant_terms(terms: Column, low_signal: tuple[str, ...] = ()) -> Column:
    dropped = tuple(C.LOW_SIGNAL_QUERY_TERMS) + tuple(low_signal)
    lowered = F.transform(terms, lambda t: F.lower(stripped(t)))
    return F.array_distinct(F.filter(lowered, lambda t: (F.length(t) >= 4) & ~t.isin(*dropped)))


def gap_query(issue: Column, table: list[tuple[tuple[str, ...], str]]) -> Column:
    """Re-search query for an issue text: first trigger row, else its first six content words."""
    lowered = F.lower(issue)
    words = F.filter(
        F.regexp_extract_all(lowered, F.lit("[a-zA-Z]+"), F.lit(0)),
        lambda w: ~w.isin(*C.GAP_QUERY_STOP_WORDS) & (F.length(w) > 2),
    )
    fallback = F.array_join(F.slice(words, 1, 6), " ")
    chain = None
    for triggers, query in table:
        hit = F.lit(False)
        for trigger in triggers:
            hit = hit | lowered.contains(trigger)
        chain = F.when(hit, F.lit(query)) if chain is None else chain.when(hit, F.lit(query))
    return fallback if chain is None else chain.otherwise(fallback)
