"""Links between close fingerprints, and the groups that links form.

A fingerprint is an array of 64-bit words.  Rows that share a block key are
compared inside tasks; only a spanning set of links leaves a block, never all
its pairs.  A block above ``CHUNK`` rows is cut into chunks, and each pair of
chunks is one group, so no group holds more than about two chunks and no pair
is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shopmill.sources.scratch import materialize

CHUNK = 4096


def spanning_links(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that connect what pairs within ``limit`` bits connect.

    A search from row to row; a row that was reached leaves the rest, so a
    dense block costs little more than its size.
    """
    rest, left = np.arange(1, len(prints)), prints[1:]
    stack, froms, tos = [0], [], []
    while len(rest):
        if not stack:
            stack, rest, left = [rest[0]], rest[1:], left[1:]
            continue
        here = stack.pop()
        close = np.bitwise_count(left ^ prints[here]).sum(axis=1) <= limit
        if close.any():
            reached = rest[close]
            froms.append(np.full(len(reached), here))
            tos.append(reached)
            stack.extend(reached)
            rest, left = rest[~close], left[~close]
    if not froms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(froms), np.concatenate(tos)


def _links_of_batches(limit: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = batch.column("nodes"), batch.column("prints")
            ends, all_nodes = nodes.offsets.to_numpy(), nodes.values.to_numpy(zero_copy_only=False)
            starts, all_prints = prints.offsets.to_numpy(), prints.values.to_numpy(zero_copy_only=False).view(np.uint64)
            a, b = [], []
            for row in range(batch.num_rows):
                own = all_nodes[ends[row]:ends[row + 1]]
                x, y = spanning_links(all_prints[starts[row]:starts[row + 1]].reshape(-1, words), limit)
                a.append(own[x])
                b.append(own[y])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])
    return run


def block_links(blocks: DataFrame, limit: int, words: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning links of the nodes that share a block within ``limit`` bits.

    ``blocks`` has (key, node long, print array of longs), a node once in a block.
    """
    counted = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    member = F.collect_list(F.struct("node", "print")).alias("members")
    small = counted.where(F.col("n") <= chunk).groupBy("key").agg(member).select("members")
    chunks = F.ceil(F.col("n") / chunk)
    large = (
        counted.where(F.col("n") > chunk)
        .withColumn("own", F.pmod(F.xxhash64("node"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(member).select("members")
    )
    groups = small.unionAll(large).select(
        F.transform("members", lambda m: m["node"]).alias("nodes"),
        F.flatten(F.transform("members", lambda m: m["print"])).alias("prints"))
    return groups.mapInArrow(_links_of_batches(limit, words), "a long, b long").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction over rows (a, b) with a > b."""
    sides = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = sides.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = sides.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
            least.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    Large and small stars alternate until nothing changes; each round is a
    written table, so a lost executor costs one round at most.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
