"""Materialised intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Exchanges of a query are dropped when it ends, not when the driver happens to collect its garbage.
DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_exchanges(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; the session's own setting comes back."""
    before = spark.conf.get(DROP_EXCHANGES, None)
    spark.conf.set(DROP_EXCHANGES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_EXCHANGES) if before is None else spark.conf.set(DROP_EXCHANGES, before)


def scratch_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    A local run without that setting gets a folder of its own; a cluster without
    it is an error, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="shopmill-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once as parquet, read back: later passes scan columns, not the lineage."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with dropping_exchanges(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
