"""Check reports: all measures of a table in one aggregate, one row per check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Check:
    name: str
    status: Column
    details: Column
    count: Column | None = None
    percentage: Column | None = None


def verdict(passed: Column, otherwise: str = "FAIL") -> Column:
    """PASS, or the given status when the condition is false or unknown."""
    return F.when(passed, "PASS").otherwise(otherwise)


def check_rows(measures: DataFrame, checks: list[Check], numbers: tuple[str, ...] = ()) -> DataFrame:
    """One-row `measures` -> one row per check, with `count` / `percentage` where asked."""
    types = {"count": "bigint", "percentage": "double"}

    def as_struct(check: Check) -> Column:
        fields = [F.lit(check.name).alias("check"), check.status.alias("status"), check.details.alias("details")]
        for name in numbers:
            value = getattr(check, name)
            fields.append((F.lit(None) if value is None else value).cast(types[name]).alias(name))
        return F.struct(*fields)

    return measures.select(F.inline(F.array(*[as_struct(c) for c in checks])))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with distinct columns side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def key_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): rows per key, NULL equal to NULL; combined on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def key_measures(df: DataFrame, *keys: str, prefix: str = "") -> DataFrame:
    """One row: rows, rows with a NULL in a single key, rows beyond the first per key.

    Keys hardly repeat, so rows meet by key before they are counted: combining them in the map tasks
    would fill these with groups of one row.
    """
    missing = F.sum(F.when(F.col(keys[0]).isNull(), F.col("n")))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return key_sizes(df.select(*keys).repartition(*keys), *keys).agg(
        rows.alias(f"{prefix}rows"),
        F.coalesce(missing, F.lit(0)).alias(f"{prefix}nulls"),
        (rows - F.count(F.lit(1))).alias(f"{prefix}duplicates"),
    )


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("checks")).orderBy(F.desc("checks"), "status")


def text_list(values: Column) -> Column:
    """['a', 'b'] as text, for an array of strings."""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
