"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WHITE = r"[\x20\x09-\x0D]+"


def white_words(text: Column) -> Column:
    """The runs of anything but ASCII white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` reads it.

    Inside the function of an array operation, an expression is computed anew for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def sums_before(values: Column, block: int = 64) -> Column:
    """For every element of an array of longs, the sum of those before it.

    Arrays are taken in blocks, so that growing an array element by element
    stays cheap for long ones.
    """
    def before(xs: Column, start: Column) -> Column:
        kind = "struct<sum:bigint,out:array<bigint>>"
        return F.aggregate(
            xs, F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out")).cast(kind),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
            lambda a: a["out"])

    def in_blocks(xs: Column) -> Column:
        size = F.size(xs)
        blocks = F.when(size > 0, F.transform(
            F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")),
            lambda k: F.slice(xs, k * block + 1, block))).otherwise(F.array().cast("array<array<bigint>>"))
        return let(blocks, lambda bs: F.flatten(F.transform(
            F.arrays_zip(bs.alias("b"), before(F.transform(bs, lambda b: total(b)), F.lit(0).cast("long")).alias("s")),
            lambda z: before(z["b"], z["s"]))))

    return let(values, in_blocks)
