"""One count of every key of many tables, shared by all checks that ask about keys.

Each table is read once for all of its keys.  The occurrences of all tables meet in one shuffle, combined on
the map side, so a key that holds a third of a table is one row a task.  Uniqueness, orphans, children per
parent, distinct values and their frequencies then are aggregates of the counts.

Keys that are nearly unique, such as whole rows, would fill the map tasks with groups of one row: `repeats` counts
them apart, where rows meet first.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopmill.plans.checks import union_all


@dataclass(frozen=True)
class Key:
    """Values of one kind in one table: keys of the same kind are compared with each other."""

    kind: str
    table: str
    value: Column


def plain(table: str, column: str) -> Key:
    """A column whose name says its kind."""
    return Key(column, table, F.col(column).cast("string"))


def joined(*columns: str) -> Column:
    """Several columns as one text that differs whenever a value does; NULL equals NULL."""
    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.concat(*[part(c) for c in columns])


def hashes(df: DataFrame, *columns: str) -> tuple[Column, Column]:
    """Many columns as two 64-bit hashes, without turning numbers and times into texts; NULL equals NULL.

    Different rows have both alike by a chance of 2^-128 a pair.
    """
    types = dict(df.dtypes)
    # 0.0 and -0.0 are one value but hash differently; adding 0.0 makes them alike.  Hashes skip NULLs: say where they are.
    values = [F.col(c) + F.lit(0.0) if types[c] == "double" else F.col(c) for c in columns]
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(gaps, *values), F.xxhash64(F.lit("second"), *values, gaps)


def digest(df: DataFrame, *columns: str) -> Column:
    """The hashes of many columns as one text."""
    first, second = hashes(df, *columns)
    return F.concat(F.hex(first), F.lit(":"), F.hex(second))


def relationship_keys(relations: Iterable[tuple[str, str, str, str]], unique: Mapping[str, str]) -> list[Key]:
    """Keys of (child, column, parent, column) relations and of (table -> key column) rules, each once."""
    found = {(table, column): plain(table, column) for table, column in unique.items()}
    for child, key, parent, parent_key in relations:
        found[parent, parent_key] = Key(parent_key, parent, F.col(parent_key).cast("string"))
        found[child, key] = Key(parent_key, child, F.col(key).cast("string"))
    return list(found.values())


def key_counts(tables: Mapping[str, DataFrame], keys: list[Key]) -> DataFrame:
    """(kind, value, n_<table> ...): rows of every table that hold the value; NULL is a value.

    Groups are kept small, for map tasks hold many: a number for the kind, and counters for the tables of one kind alone.
    """
    kinds = list(dict.fromkeys(k.kind for k in keys))
    holders = {kind: list(dict.fromkeys(k.table for k in keys if k.kind == kind)) for kind in kinds}
    held: dict[str, list[Key]] = {}
    for key in keys:
        held.setdefault(key.table, []).append(key)
    found = [
        tables[table].select(F.inline(F.array(*[
            F.struct(F.lit(kinds.index(k.kind)).alias("kind"), k.value.alias("value"),
                     F.lit(holders[k.kind].index(table)).alias("holder")) for k in its_keys])))
        for table, its_keys in held.items()]
    places = range(max(map(len, holders.values())))
    counts = union_all(found).groupBy("kind", "value").agg(
        *[F.count_if(F.col("holder") == place).alias(f"n{place}") for place in places])

    def of_table(table: str) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == number, F.col(f"n{holders[kind].index(table)}"))
                            for number, kind in enumerate(kinds) if table in holders[kind]], F.lit(0))

    return counts.select(
        F.get(F.array(*[F.lit(kind) for kind in kinds]), F.col("kind")).alias("kind"), "value",
        *[of_table(table).alias(f"n_{table}") for table in held])


def repeats(
    df: DataFrame, key: Collection[str], identity: Collection[str], rules: Mapping[str, Column], prefix: str,
) -> DataFrame:
    """One row: `<prefix>_rows`, rows that agree with an earlier one in the key (`_key_repeats`) or in the identity
    too (`_row_repeats`), and the number of rows that fulfil each rule.

    The identity includes the key.  Rows meet once, as key, two hashes and the marks of the rules.
    """
    first, second = hashes(df, *identity)
    marks = sum((F.when(rule, 1 << bit).otherwise(0) for bit, rule in enumerate(rules.values())), F.lit(0))
    narrow = df.select(*key, first.alias("first"), second.alias("second"), marks.alias("marks")).repartition(*key)
    alike = Window.partitionBy(*key).orderBy("first", "second")
    before = F.lag(F.struct("first", "second")).over(alike)
    seen = narrow.select("marks", (F.row_number().over(alike) > 1).alias("key_repeats"),
                         (before == F.struct("first", "second")).alias("row_repeats"))
    return seen.agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        *[F.count_if(name).alias(f"{prefix}_{name}") for name in ("key_repeats", "row_repeats")],
        *[F.count_if(F.col("marks").bitwiseAND(1 << bit) != 0).alias(name) for bit, name in enumerate(rules)])


# --- aggregates of the counts -------------------------------------------------------------

def _sum(condition: Column, table: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(f"n_{table}"))), F.lit(0))


def _kind(kind: str) -> Column:
    return F.col("kind") == kind


def rows_with(kind: str, table: str, condition: Column | None = None) -> Column:
    """Rows of a table, or those whose value fulfils a condition."""
    return _sum(_kind(kind) if condition is None else _kind(kind) & condition, table)


def values_with(kind: str, table: str, condition: Column | None = None) -> Column:
    """Distinct values of a table, NULL among them unless the condition leaves it out."""
    here = _kind(kind) & (F.col(f"n_{table}") > 0)
    return F.count_if(here if condition is None else here & condition)


def uniqueness(kind: str, table: str, prefix: str) -> list[Column]:
    """Rows, rows without a key, rows beyond the first of each key."""
    rows = rows_with(kind, table)
    return [
        rows.alias(f"{prefix}_rows"),
        rows_with(kind, table, F.col("value").isNull()).alias(f"{prefix}_nulls"),
        (rows - values_with(kind, table)).alias(f"{prefix}_duplicates"),
    ]


def orphans(kind: str, child: str, parent: str, prefix: str) -> list[Column]:
    """Child rows with a key, and those of them without a parent."""
    given = F.col("value").isNotNull()
    return [
        rows_with(kind, child, given).alias(f"{prefix}_keys"),
        rows_with(kind, child, given & (F.col(f"n_{parent}") == 0)).alias(f"{prefix}_orphans"),
    ]


def sizes(counts: DataFrame, kind: str, table: str, name: str, type_: str = "string") -> DataFrame:
    """(name, n): the values of one kind in one table and their rows."""
    return counts.where(_kind(kind) & (F.col(f"n_{table}") > 0)).select(
        F.col("value").cast(type_).alias(name), F.col(f"n_{table}").alias("n"))
