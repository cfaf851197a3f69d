"""Path expressions: normal forms, owner folders, modules, locations, ids."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind import constants as C


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def slashed(value: Column) -> Column:
    return F.translate(value, "\\", "/")


def normalized_path(value: Column) -> Column:
    """Forward slashes, trimmed, lower case; null counts as empty."""
    return F.lower(F.trim(slashed(F.coalesce(value, F.lit("")))))


def normalized_scope(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def contains_any(value: Column, markers) -> Column:
    return any_of([value.contains(marker) for marker in markers])


def is_code_file(path: Column) -> Column:
    return path.rlike(C.CODE_FILE_PATTERN)


def owner_path_score(path: Column) -> Column:
    """Constant by folder, else by extension; first match wins."""
    lowered = F.lower(slashed(F.coalesce(path, F.lit(""))))
    chain = None
    for test, marker, score in C.OWNER_PATH_SCORES:
        hit = lowered.contains(marker) if test == "contains" else lowered.endswith(marker)
        chain = F.when(hit, F.lit(score)) if chain is None else chain.when(hit, F.lit(score))
    return chain.otherwise(F.lit(C.OWNER_PATH_SCORE_DEFAULT))


def is_rankable_owner(path: Column) -> Column:
    lowered = F.lower(slashed(F.coalesce(path, F.lit(""))))
    return is_code_file(lowered) & contains_any(lowered, C.OWNER_PATH_MARKERS)


def is_relationship_text(path: Column) -> Column:
    """Arrows or back-ticks mean the entry is prose about files, not a path."""
    return path.contains("→") | path.contains("->") | path.contains("`")


def position_divisor(pos: Column) -> Column:
    """Damping of a file's position in its document: 1, 2, then logarithmic."""
    return F.when(pos <= 1, (pos + 1).cast("double")).otherwise(F.lit(1.0) + F.log1p(pos.cast("double")))


def source_line_number(location: Column) -> Column:
    """``L123`` or the first run of digits."""
    digits = F.regexp_extract(F.coalesce(location, F.lit("")), r"\d+", 0)
    return F.when(digits != "", digits).cast("int")


def stable_id(path: Column, suffix: Column | None = None) -> Column:
    tail = suffix if suffix is not None else F.lit("")
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat(path, F.lit(":"), tail)), 1, 16))


def code_block_id(path: Column, symbol: Column, line: Column) -> Column:
    key = F.concat(path, F.lit("::"), symbol, F.lit("::"), line.cast("string"))
    return F.concat(F.lit("blk_"), F.substring(F.md5(key), 1, 12))


def first_non_empty(*values: Column) -> Column:
    """Coalesce where empty strings count as missing."""
    return F.coalesce(*[F.when(value != "", value) for value in values], F.lit(""))


def canonical_source_file(
    source_file: Column,
    *,
    mirror_marker: str = "raw/corpus/",
    known_prefixes: tuple[str, ...] = ("graph-out/", "docs/"),
    source_root: Column | None = None,
) -> Column:
    """Repository path of a graph node's file.

    A path inside a mirrored corpus is cut after the first marker; known
    prefixes are kept; anything else is put under ``source_root`` if given.
    """
    value = F.trim(slashed(source_file))
    at = F.instr(value, mirror_marker)
    known = any_of([value.startswith(prefix) for prefix in known_prefixes])
    plain = value
    if source_root is not None:
        rooted = F.regexp_replace(F.concat(source_root, F.lit("/"), value), "//", "/")
        plain = F.when(source_root.isNull() | (source_root == ""), value).otherwise(rooted)
    return (
        F.when(value == "", value)
        .when(at > 0, F.substr(value, at + F.lit(len(mirror_marker))))
        .when(known, value)
        .otherwise(plain)
    )


def module_and_pack(path: Column, markers: tuple[str, ...]) -> Column:
    """Struct (module, pack): the two components after the first marker folder found."""
    parts = F.split(slashed(path), "/")
    chain = None
    for marker in markers:
        at = F.array_position(parts, marker)
        found = F.struct(
            F.when(F.size(parts) > at, F.get(parts, at.cast("int"))).alias("module"),
            F.when(F.size(parts) > at + 1, F.get(parts, (at + 1).cast("int"))).alias("pack"),
        )
        hit = (at > 0) & (F.size(parts) > at)
        chain = F.when(hit, found) if chain is None else chain.when(hit, found)
    nothing = F.struct(F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("pack"))
    return chain.otherwise(nothing)


def source_type_of(path: Column) -> Column:
    """Well-known file name, behaviour folder, or extension."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, r"(?<=.)\.[^.]+$", 0))
    return (
        F.when(name.isin(*C.WELL_KNOWN_FILE_NAMES), name)
        .when(path.contains("/behavior/"), F.lit("behavior pack"))
        .otherwise(extension)
    )


def title_of(path: Column) -> Column:
    return F.translate(file_stem(path), "-_", "  ")


def escapes_root(path: Column) -> Column:
    """True if a relative path climbs out of its root at any point."""
    parts = F.filter(F.split(slashed(path), "/"), lambda part: (part != "") & (part != "."))
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda acc, part: F.struct(
            F.when(part == "..", acc["depth"] - 1).otherwise(acc["depth"] + 1).alias("depth"),
            (acc["out"] | ((part == "..") & (acc["depth"] < 1))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return slashed(path).startswith("/") | path.rlike("^[A-Za-z]:") | depth


def is_safe_relative(path: str) -> bool:
    """Driver-side guard for a single configured path."""
    cleaned = posixpath.normpath(path.replace("\\", "/"))
    return not (cleaned.startswith("/") or cleaned == ".." or cleaned.startswith("../"))
