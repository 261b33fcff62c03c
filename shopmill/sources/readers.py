"""Table scans."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shopmill.functions import exprs as X
from shopmill.sources.schemas import RAW_COLUMNS, raw_schema


def read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """Headered CSV with an explicit schema; a missing path is an error.

    Quoted fields may hold newlines and doubled quotes.  `multi_line=False` lets
    Spark split large files, for data known to have no newline inside a field.
    A row with fewer fields is filled with NULL; one with more stops the read and
    names its file.
    """
    record = "__record"
    read = (
        spark.read.schema(StructType([*schema.fields, StructField(record, StringType())]))
        .option("columnNameOfCorruptRecord", record)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    # Only malformed rows keep their text.  Read with one field more, a row is surplus
    # if that field is filled or nothing is missing.
    wide = StructType([
        *[StructField(f"c{i}", StringType()) for i in range(len(schema) + 1)], StructField("short", StringType())])
    again = F.from_csv(record, wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {
        "columnNameOfCorruptRecord": "short", "quote": '"', "escape": '"', "multiLine": "true"})
    surplus = F.col(record).isNotNull() & (again[f"c{len(schema)}"].isNotNull() | again["short"].isNull())
    # The first field is named too, as the text of malformed rows alone cannot be read.
    message = F.concat_ws(" ", F.lit("too many fields in"), F.input_file_name(), F.lit("row of"), F.col(schema.names[0]))
    return read.where(F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(True)).drop(record)


def read_raw_table(spark: SparkSession, table: str, path: str, multi_line: bool = True) -> DataFrame:
    """Raw table as text columns, with the missing-value spellings turned into NULL."""
    raw = read_csv(spark, path, raw_schema(table), multi_line)
    return raw.select(*[X.missing_to_null(c).alias(c) for c in RAW_COLUMNS[table]])


def read_raw_tables(spark: SparkSession, paths: Mapping[str, str], single_line: Collection[str] = ()) -> dict[str, DataFrame]:
    """All raw tables by name, lazily; `paths` maps table name to file or folder.

    Tables in `single_line` are known to hold no line break inside a field: Spark may split their files.
    """
    unknown = sorted(set(paths) - set(RAW_COLUMNS))
    if unknown:
        raise ValueError(f"unknown raw tables: {unknown}")
    return {
        table: read_raw_table(spark, table, path, multi_line=table not in single_line)
        for table, path in sorted(paths.items())
    }


def read_tables(spark: SparkSession, folder: str, names) -> dict[str, DataFrame]:
    """Stored parquet tables `folder/name`, lazily."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files in a folder, sorted; an empty folder is an error.

    Only the listing is read, never the contents.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    paths = sorted(row["path"] for row in listing.select("path").collect())
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return paths


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns of its header, all as text, missing-value spellings as NULL."""
    raw = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    return raw.select(*[X.missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
