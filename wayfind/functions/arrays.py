"""Array expressions that stay linear (or n log n) in the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an int array: sums of whole blocks first, then within each block."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def bases(numbers: Column) -> Column:
        last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(numbers, b * BLOCK + 1, BLOCK)))
        return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def sums(bound: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(bound["bases"], block) + total(F.slice(bound["values"], block * BLOCK + 1, F.pmod(i, F.lit(BLOCK)) + 1))

        return F.transform(bound["values"], at)

    summed = once(values, lambda n: once(F.struct(n.alias("values"), bases(n).alias("bases")), sums))
    return F.when(F.size(values) > 0, summed).otherwise(F.array().cast("array<int>"))


def first_of_equal(values: Column, key: Callable[[Column], Column]) -> Column:
    """First value of every key, in order: sorted by (key, place), a value stays if its predecessor has another key."""

    def chosen(rows: Column) -> Column:
        no_row = F.slice(F.transform(rows, lambda r: r["k"]), 1, 0)
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform(rows, lambda r: r["k"]), 1, F.greatest(F.size(rows) - 1, F.lit(0))))
        paired = F.zip_with(rows, F.when(F.size(rows) > 0, before).otherwise(no_row), lambda r, k: F.struct(r["i"].alias("i"), r["v"].alias("v"), (~F.equal_null(r["k"], k)).alias("new")))
        kept = F.filter(paired, lambda p: p["new"])
        return F.transform(F.array_sort(F.transform(kept, lambda p: F.struct(p["i"], p["v"]))), lambda p: p["v"])

    ranked = F.transform(values, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    return once(F.array_sort(ranked), chosen)
