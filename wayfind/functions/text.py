"""Text expressions: the three tokenisers, line extraction, facts, snippets.

All functions take and return Columns and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind import constants as C
from wayfind.functions.arrays import first_of_equal

# --------------------------------------------------------------------------
# Tokenisers.  There are three on purpose: search, embedding and path names.
# --------------------------------------------------------------------------


def raw_search_tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs after splitting camel-case humps; nothing dropped yet."""
    humps_split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(humps_split), F.lit("[a-z0-9]+"), F.lit(0))


def explode_costly(values: Column) -> Column:
    """Explode for arrays that are expensive to compute (tokenisers, patterns).

    A plain explode makes the optimizer add "array is not null and not empty" in
    front, which computes the array two more times per row.  The outer form does
    not; an empty array gives one null, which callers filter.
    """
    return F.explode_outer(values)


def is_search_token(token: Column) -> Column:
    return (F.length(token) >= 2) & ~token.isin(*C.STOP_WORDS)


def token_forms(token: Column) -> Column:
    """A token with the extra forms it is indexed under: plural stem, one compound split."""
    return (
        F.when((F.length(token) > 3) & token.endswith("s"), F.array(token, token.substr(F.lit(1), F.length(token) - 1)))
        .when(token == "followup", F.array(token, F.lit("follow"), F.lit("up")))
        .otherwise(F.array(token))
    )


def search_tokens(text: Column) -> Column:
    """Search tokeniser (array, duplicates and order kept)."""
    return F.flatten(F.transform(F.filter(raw_search_tokens(text), is_search_token), token_forms))


def embedding_tokens(text: Column) -> Column:
    """Embedding tokeniser: keeps path-like punctuation, no stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./:-]+"), F.lit(0))


def path_name_tokens(path: Column) -> Column:
    """Tokens of the last path component."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.array_distinct(F.filter(F.split(name, "[^a-z0-9]+"), lambda part: part != ""))


# --------------------------------------------------------------------------
# Lines
# --------------------------------------------------------------------------


def lines_of(text: Column) -> Column:
    """Physical lines (``\\n``, ``\\r\\n`` and ``\\r`` all end a line)."""
    return F.split(text, "\r\n|\n|\r")


def right_trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"\s+$", "")


def normalized_text(text: Column) -> Column:
    """Lines right-trimmed, blank lines dropped, result stripped."""
    kept = F.filter(F.transform(lines_of(text), right_trimmed), lambda line: line != "")
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def clipped(value: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being an ellipsis."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))).otherwise(value)


def is_markup_line(line: Column) -> Column:
    """Headings, table rows and code fences carry no prose."""
    return line.startswith("#") | line.startswith("|") | line.startswith("```")


def first_useful_lines(text: Column, limit: int = 4) -> Column:
    useful = F.filter(F.transform(lines_of(text), stripped), lambda line: (line != "") & ~is_markup_line(line))
    return F.array_join(F.slice(useful, 1, limit), "\n")


# --------------------------------------------------------------------------
# Ordered, case-insensitive distinct (first spelling wins)
# --------------------------------------------------------------------------


def ordered_distinct_ci(values: Column) -> Column:
    """First-wins distinct of an array, comparing lower-cased."""
    return first_of_equal(values, F.lower)


# --------------------------------------------------------------------------
# Extraction
# --------------------------------------------------------------------------


def source_file_lines(text: Column, limit: int | None = None) -> Column:
    """Lines that name a file, bullets stripped, distinct; all of them unless a ``limit`` is given."""
    bare = F.transform(lines_of(text), lambda line: F.regexp_replace(stripped(line), "^[-*` ]+|[-*` ]+$", ""))
    named = F.filter(bare, lambda line: line.rlike(C.SOURCE_LINE_EXTENSIONS))
    slashed = F.transform(named, lambda line: F.translate(line, "\\", "/"))
    distinct = ordered_distinct_ci(slashed)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def fact_lines(text: Column, limit: int | None = None) -> Column:
    """Statement-like lines, distinct: bullets, key/value pairs, arrows, assignments; all unless a ``limit`` is given."""
    markers = F.array(*[F.lit(marker) for marker in C.PROVENANCE_MARKERS])
    lines = F.transform(lines_of(text), stripped)
    long_enough = F.filter(lines, lambda line: ~is_markup_line(line) & (F.length(line) >= 25))
    short = F.transform(long_enough, lambda line: clipped(line, 400))
    no_provenance = F.filter(
        short, lambda line: ~F.exists(markers, lambda marker: F.contains(F.lower(line), marker))
    )
    stated = F.filter(
        no_provenance,
        lambda line: line.startswith("-")
        | line.startswith("*")
        | line.contains(":")
        | line.contains("->")
        | line.contains("="),
    )
    facts = F.transform(stated, lambda line: F.regexp_replace(line, "^[-* ]+|[-* ]+$", ""))
    distinct = ordered_distinct_ci(facts)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def best_snippets(facts: Column, text: Column, query_tokens: list[str], limit: int = 3) -> Column:
    """Facts and prose lines ranked by query tokens contained, then by shortness."""
    tokens = F.array(*[F.lit(token) for token in query_tokens])
    prose = F.transform(
        F.filter(F.transform(lines_of(text), stripped), lambda line: (line != "") & ~is_markup_line(line)),
        lambda line: clipped(line, 280),
    )
    candidates = F.concat(facts, prose)
    ranked = F.transform(
        candidates,
        lambda line, i: F.struct(
            (-F.size(F.filter(tokens, lambda token: F.contains(F.lower(line), token)))).alias("misses"),
            F.length(line).alias("chars"),
            i.alias("pos"),
            line.alias("line"),
        ),
    )
    hits = F.array_sort(F.filter(ranked, lambda item: item["misses"] < 0))
    return F.transform(F.slice(hits, 1, limit), lambda item: item["line"])
