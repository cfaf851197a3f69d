"""Lists under a budget, for many answers at once: back-filling code blocks and assembling prompts.

Tables are keyed by ``answer_id``; every list of an answer is ordered by ``pos``.  All sums run within one answer, so answers
spread over tasks however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions.paths import normalized_path

#: section, heading and how many of its lines are shown (None: all); in the order of the prompt
PROMPT_SECTIONS = (
    ("task", "## Task", None), ("owner", "## Top Match (one data point, not proof of a cause)", 1), ("files", "## Candidate Files", 20),
    ("symbols", "## Symbol Hits", 30), ("dependencies", "## Dependency Chain", 30), ("locations", "## Location Hints", 20), ("facts", "## Facts", 15),
    ("modules", "## Modules", 10), ("packs", "## Packs", 10), ("warnings", "## Warnings", 5),
)
BLOCK_HEADING = "## Code Blocks"
PROMPT_CHARS, BLOCK_CHARS, MAX_BLOCKS, LEAST_ROOM = 28_000, 2_500, 8, 200


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", normalized_path(F.col("path")))


def backfill_blocks(hits: DataFrame, blocks: DataFrame, window: DataFrame, budget: int, priority: DataFrame | None = None) -> DataFrame:
    """(answer_id, action, pos, path): blocks that are ``kept`` or ``evicted``, and hits that get a ``new`` block.

    ``hits``: answer_id, pos, path, has_block.  ``blocks``: answer_id, pos, path.  ``window``: answer_id, path, the leading files.
    A hit on a leading file without any block wants one; hits are served in order while the budget has room.  With
    ``priority`` (answer_id, path) blocks of other files make room, from the tail and no more of them than wanted.
    """
    hits, blocks, window = _keyed(hits), _keyed(blocks), _keyed(window).select("answer_id", "_p").distinct()
    open_hits = hits.where(~F.coalesce("has_block", F.lit(False))).join(window, ["answer_id", "_p"], "left_semi")
    wanted = open_hits.join(blocks.select("answer_id", "_p").distinct(), ["answer_id", "_p"], "left_anti").select(
        "answer_id", "pos", "path", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos", "path")).alias("n")
    )
    wants = wanted.groupBy("answer_id").agg(F.count(F.lit(1)).alias("wants"))
    have = blocks.groupBy("answer_id").agg(F.count(F.lit(1)).alias("have"))
    if priority is None:
        marked = blocks.withColumn("_safe", F.lit(True))
    else:
        safe = _keyed(priority).select("answer_id", "_p").distinct().withColumn("_safe", F.lit(True))
        marked = blocks.join(safe, ["answer_id", "_p"], "left").withColumn("_safe", F.coalesce("_safe", F.lit(False)))
    tail = Window.partitionBy("answer_id", "_safe").orderBy(F.desc("pos"), F.desc("path"))
    placed = marked.withColumn("_tail", F.row_number().over(tail)).join(wants, "answer_id", "left").join(have, "answer_id")
    missing = F.coalesce("wants", F.lit(0)) - F.greatest(F.lit(0), F.lit(budget) - F.col("have"))
    judged = placed.withColumn("action", F.when(~F.col("_safe") & (F.col("_tail") <= missing), "evicted").otherwise("kept"))
    left = judged.groupBy("answer_id").agg(F.sum((F.col("action") == "kept").cast("int")).alias("left"))
    room = F.greatest(F.lit(0), F.lit(budget) - F.coalesce("left", F.lit(0)))
    new = wanted.join(left, "answer_id", "left").where(F.col("n") <= room)
    return judged.select("answer_id", "action", "pos", "path").unionByName(new.select("answer_id", F.lit("new").alias("action"), "pos", "path"))


# -- prompts ----------------------------------------------------------------


def _bullet(*parts: Column | str) -> Column:
    return F.concat(F.lit("  - "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: section -> (the columns it reads, its line, and which rows have one)
LINE_OF: dict[str, Callable[[], tuple[Column, Column]]] = {
    "task": lambda: (F.concat(F.col("text"), F.lit("\n")), F.col("text").isNotNull()),
    "owner": lambda: (F.concat(F.lit("File: "), _or_empty("path"), F.lit("\nSymbol: "), _or_empty("label")), F.col("path").isNotNull()),
    "files": lambda: (_bullet(F.col("path"), " (score: ", F.format_string("%.1f", F.coalesce("score", F.lit(0.0))), ")"), F.col("path") != ""),
    "symbols": lambda: (_bullet(F.col("label"), " in ", _or_empty("path"), " [", _or_empty("kind"), "]"), F.col("label") != ""),
    "dependencies": lambda: (
        _bullet(_or_empty("source_file"), " --[", _or_empty("relation"), "]--> ", _or_empty("target_file"),
                F.when(_or_empty("source_label") != "", F.concat(F.lit(": "), "source_label")).otherwise(F.lit(""))), F.lit(True)),
    "locations": lambda: (_bullet(F.col("path"), " L", F.coalesce(F.col("line").cast("string"), F.lit("?")), ": ", _or_empty("symbol")), F.col("path") != ""),
    "facts": lambda: (_bullet(F.col("text")), F.col("text") != ""),
    "modules": lambda: (_bullet(F.col("name")), F.col("name") != ""),
    "packs": lambda: (
        _bullet(F.col("name"), F.when(F.size("files") > 0, F.concat(F.lit(" -> ["), F.array_join(F.slice("files", 1, 6), ", "), F.lit("]"))).otherwise(F.lit(""))),
        F.col("name") != ""),
    "warnings": lambda: (_bullet(F.col("text")), F.col("text") != ""),
}


def prompt_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """(answer_id, section, pos, line) of the parts of answers, one table per section with ``answer_id`` and ``pos``.

    Rows are cut to the section's number first and rows that say nothing left out then, as a list is shown.
    """
    out: DataFrame | None = None
    for place, (name, _, limit) in enumerate(PROMPT_SECTIONS):
        if name not in parts:
            continue
        rows = parts[name]
        if limit is not None:
            order = Window.partitionBy("answer_id").orderBy("pos")
            rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
        line, said = LINE_OF[name]()
        rows = rows.where(said).select("answer_id", F.lit(place).alias("section"), F.col("pos").cast("long").alias("pos"), line.alias("line"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no section is given")
    return out


def block_entries(blocks: DataFrame) -> DataFrame:
    """(answer_id, pos, entry) of the first blocks that hold code: ``blocks`` has answer_id, pos, block_id, path, symbol, text."""
    order = Window.partitionBy("answer_id").orderBy("pos")
    first = blocks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_BLOCKS)
    code = F.regexp_replace(_or_empty("text"), r"^\s+|\s+$", "")
    head = F.concat(F.lit("["), _or_empty("block_id"), F.lit("] "), _or_empty("path"), F.when(_or_empty("symbol") != "", F.concat(F.lit(" — "), "symbol")).otherwise(F.lit("")))
    entry = F.concat(F.lit("\n\n"), head, F.lit("\n```\n"), F.substring(code, 1, BLOCK_CHARS), F.lit("\n```"))
    return first.where(code != "").select("answer_id", "pos", entry.alias("entry"))


def assemble_prompts(lines: DataFrame, entries: DataFrame, budget: int = PROMPT_CHARS) -> DataFrame:
    """(answer_id, prompt, chars, blocks): the sections of every answer, then the code blocks that the rest of the budget holds.

    The first block that does not fit ends the list; its length stays in the running sum, so none after it fits either.
    Sections are never cut.
    """
    headings = F.array(*[F.lit(heading) for _, heading, _ in PROMPT_SECTIONS])
    listed = lines.groupBy("answer_id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    texts = listed.select("answer_id", "section", F.concat_ws("\n", F.get(headings, "section"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    base = texts.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("s"))
    base = base.select("answer_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("base"))
    sizes = base.select("answer_id", (F.lit(budget) - F.length("base")).alias("room"))
    running = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fit = entries.join(sizes, "answer_id").withColumn("used", len(BLOCK_HEADING) + F.sum(F.length("entry")).over(running))
    fit = fit.where((F.col("room") >= LEAST_ROOM) & (F.col("used") <= F.col("room")))
    code = fit.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("e"))
    code = code.select("answer_id", F.concat(F.lit(BLOCK_HEADING), F.array_join(F.transform("e", lambda x: x["entry"]), "")).alias("code"), F.size("e").alias("blocks"))
    joined = base.join(code, "answer_id", "left")
    prompt = F.concat("base", F.when(F.col("code").isNotNull(), F.concat(F.lit("\n\n"), "code")).otherwise(F.lit("")))
    out = joined.select("answer_id", prompt.alias("prompt"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    return out.select("answer_id", "prompt", F.length("prompt").alias("chars"), "blocks")
