"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Targets: the sources in code point order (null last) get the weights in turn and share all words in proportion; a target
stops at ``most`` times its source's words, and the excess goes to the others by weight until none is above.

Rates: of all document rates between 0 and ``most`` with ``sum(rate * words) = target`` in every source, those that are
closest to 1 in relative entropy.  Their dual is convex in one multiplier per source, and the rates are exponentially
tilted: ``rate = min(most, exp(multiplier * words / mean words))``.  Newton steps (kept inside a shrinking bracket) run as
aggregates over (source, words, documents), a table that counts all documents.

Copies: every document gets its rate rounded down or up.  The fractions are summed over a source in order of words and an
extra copy is due whenever the sum passes a half (systematic rounding), so that the documents of any range of word counts get
their rates to within one copy, and a source misses its target by no more than its longest document.  ``FITS`` single copies
are then moved to come nearer.  Documents of equal source and words have equal rates; the extra copies among them go to the
lowest hashes of the id, so reruns agree.

Null text counts as no words; documents without words keep one copy and take nothing.  Rows that repeat an id within a
source and word count get equal copies.  A source whose target equals ``most`` times its words takes all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import WORD, row_of, split_rank, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
STEPS = 60
TOLERANCE = 1e-9
#: Single copies per source that may be given or taken back after rounding.
FITS = 2
#: Rates are fixed to this many digits: sums in another order give other last digits.
DIGITS = 9


def word_count(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(hist: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, mean, target) from (source, size, n).

    The water level over the weights is found in closed form: sorted by cap / weight, the sources below the level are
    full.  One row per source goes through the window.
    """
    totals = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"),
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", given).withColumn("cap", F.lit(most) * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "_all": F.sum("source_size").over(everything).cast("double"), "_w": F.sum("weight").over(everything),
        "_full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "_gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("_all") - F.col("_full")) / (F.col("_w") - F.col("_gone"))
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("cap") >= F.col("_level") * F.col("weight"))
    # the first source in this order that is not full fixes the level of all that follow
    fixed = F.min(F.when(F.col("_open"), F.struct(F.col("_gone"), F.col("_level")))).over(everything)
    target = F.least("cap", F.coalesce(fixed["_level"], F.lit(0.0)) * F.col("weight"))
    mean = F.col("source_size") / F.when(F.col("n") > 0, F.col("n"))
    return rows.select("source", "source_size", "n", mean.alias("mean"), target.alias("target"))


def multipliers(hist: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, lam, full): the dual solution per source; ``full`` sources take ``most`` copies of everything."""
    full = F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)
    state = written(
        targets.select(
            "source", "mean", "target", full.alias("full"),
            F.log(F.greatest(F.try_divide("target", "source_size"), F.lit(1e-12))).alias("lam"),
            F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (full | (F.col("source_size") == 0)).alias("done"),
        ), "mix-state",
    )
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
        slope = F.when(rate < most, z * rate).otherwise(0.0)
        sums = _on_source(hist, state).groupBy("source").agg(
            F.sum(F.col("size") * F.col("n") * rate).alias("taken"), F.sum(F.col("size") * F.col("n") * slope).alias("slope")
        )
        gap = F.col("target") - F.col("taken")
        low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + gap / F.when(F.col("slope") > 0, F.col("slope"))
        # a step that leaves the bracket (or has no slope) halves it, or doubles away from a side not yet seen
        far = F.greatest(F.abs("lam") * 4, F.lit(4.0))
        middle = F.when(high >= 1e6, low + far).when(low <= -1e6, high - far).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < high) & (F.abs(newton - F.col("lam")) <= far), newton).otherwise(middle)
        done = F.col("done") | (F.abs(gap) <= F.col("target") * TOLERANCE)
        moved = _on_source(state, sums).select(
            "source", "mean", "target", "full", F.when(done, F.col("lam")).otherwise(step).alias("lam"),
            low.alias("low"), high.alias("high"), done.alias("done"),
        )
        state = written(moved, "mix-state")
    return state.select("source", "lam", "full")


def _on_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Inner join on the source, null meeting null; the keys of the right side go."""
    keys = ["source", *more]
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    own = [f"b.{c}" for c in right.columns if c not in keys]
    return left.alias("a").join(right.alias("b"), on).select("a.*", *own)


def group_copies(hist: DataFrame, targets: DataFrame, solved: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, rate, whole, extra): every document of the group has ``whole`` copies, ``extra`` of them one more."""
    rows = _on_source(_on_source(hist, targets.select("source", "mean", "target")), solved)
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilt))
    rows = rows.withColumn("rate", F.round(rate, DIGITS)).withColumn("whole", F.floor("rate").cast("long"))
    # the fractions as whole numbers, so that their sums are exact
    unit = 10**DIGITS
    part = F.round((F.col("rate") - F.col("whole")) * unit).cast("decimal(20,0)")
    source = Window.partitionBy("source")
    rising = source.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", part).withColumn("_sum", F.sum(F.col("_part") * F.col("n")).over(rising))
    upto = F.floor((F.col("_sum") + unit // 2) / unit)
    before = F.floor((F.col("_sum") - F.col("_part") * F.col("n") + unit // 2) / unit)
    rows = rows.withColumn("extra", (upto - before).cast("long"))
    # one copy more or less of the size that is nearest to what is missing or too much, if that helps
    taken = F.col("size") * (F.col("n") * F.col("whole") + F.col("extra"))
    for _ in range(FITS):
        rows = rows.withColumn("_left", F.col("target") - F.sum(taken).over(source))
        room = F.when(F.col("_left") > 0, F.col("extra") < F.col("n")).otherwise(F.col("extra") > 0)
        off = F.abs(F.abs("_left") - F.col("size"))
        helps = (F.col("size") > 0) & (F.col("_part") > 0) & room & (off < F.abs("_left"))
        nearest = F.min(F.when(helps, F.struct(off.alias("off"), F.col("size").alias("size")))).over(source)
        step = F.when(nearest["size"] == F.col("size"), F.signum("_left").cast("long")).otherwise(0)
        rows = rows.withColumn("_step", step).withColumn("extra", F.col("extra") + F.col("_step"))
    return rows.select("source", "size", "n", "rate", "whole", "extra")


def plan_mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """From (source, size, code): the targets per source, and (source, size, rate, whole, last_code) per group.

    A document has ``whole`` copies, and one more if its ``code`` is at most ``last_code``.
    """
    hist = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    targets = written(source_targets(hist, weights, most), "mix-targets")
    groups = written(group_copies(hist, targets, multipliers(hist, targets, most), most), "mix-groups")
    partial = groups.where("extra > 0").select("source", "size", "extra")
    ranked = split_rank(_on_source(sizes.select("source", "size", "code"), partial, "size"), ["source", "size"], "code", "_rank")
    cutoff = ranked.where("_rank < extra").groupBy("source", "size").agg(F.max("code").alias("last_code"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("source", "size")]
    plan = groups.alias("a").join(cutoff.alias("b"), on, "left").select("a.source", "a.size", "a.rate", "a.whole", "b.last_code")
    return targets, written(plan, "mix-plan")


def _copies() -> Column:
    return F.col("whole") + F.coalesce(F.col("code") <= F.col("last_code"), F.lit(False)).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, code)"""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("code"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = written(document_sizes(docs), "mix-documents")
    targets, plan = plan_mix(sizes, weights, most)
    rows = _on_source(_on_source(sizes, plan, "size"), targets.select("source", "source_size", "target"))
    copies = _copies()
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix: every row as often as it has copies."""
    _, plan = plan_mix(written(document_sizes(docs), "mix-documents"), weights, most)
    inner = docs.select(row_of(docs).alias("_row"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("code"))
    rows = _on_source(inner, plan, "size")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("_row.*")
