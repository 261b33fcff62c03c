"""Shards of near equal bytes by a minimax contiguous partition.

Equal texts are one atomic group.  Groups are put in the order of their smallest id, and their sizes
are summed along that order.  The smallest capacity for which a greedy pass needs no more than the
wanted number of shards is found by binary search, and the groups are cut there; where that capacity
leaves room (one group may be larger than an even share), cuts move towards even shares.

The running sums stay in Spark.  The driver holds some of them, with a mark on every gap that
hides others.  A greedy pass over these points gives a bound from either side, so the search
narrows the capacity, and only the gaps that a cut can fall into are opened, in bins.  The number
of points is bounded by shards and bins, whatever the number of groups.

A group of a third of all rows is counted and numbered in ``SALTS`` pieces by id.  Nulls: a null text has
no bytes and is equal to an empty one; null ids come first.  Repeated rows each get a slot of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shopmill.sources.scratch import materialize

SHARDS = 24
ROW_BYTES = 8  # added to the bytes of each text
SALTS = 64
BINS, FINE_BINS = 4096, 256


class Ends:
    """What the driver knows of the ends of groups along the line: some points, and which gaps hide others."""

    def __init__(self, line: DataFrame, total: int):
        self.line, self.total = line, total
        self.points, self.whole = [0, total], [False]  # whole[i]: nothing between points i and i + 1
        self.open([(0, total)], BINS)

    def open(self, gaps: list[tuple[int, int]], bins: int) -> None:
        """Learn points inside gaps: the first and last end of each bin, and which bins have no others."""
        lows, highs = np.array([g[0] for g in gaps]), np.array([g[1] for g in gaps])
        schema = "low long, high long, n long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = batch.column(0).to_numpy()
                gap = np.searchsorted(lows, ends, "left") - 1  # low < end < high
                inside = gap >= 0
                inside[inside] = ends[inside] < highs[gap[inside]]
                ends, gap = ends[inside], gap[inside]
                if not len(ends):
                    continue
                width = highs[gap] - lows[gap]
                spot = ((ends - lows[gap]).astype(object) * bins // width).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gap * bins + spot), pa.array(ends)], ["bin", "end"])

        found = self.line.select("end").mapInArrow(run, "bin long, end long").groupBy("bin").agg(
            F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        hidden = {(r["low"], r["high"]) for r in found if r["n"] > 2}
        opened = set(gaps)
        kept = [(a, b) for a, b, whole in zip(self.points, self.points[1:], self.whole) if not whole and (a, b) not in opened]
        self.points = sorted({*self.points, *(r["low"] for r in found), *(r["high"] for r in found)})
        hidden.update(kept)
        self.whole = [(a, b) not in hidden for a, b in zip(self.points, self.points[1:])]

    def floor(self, x: int) -> tuple[int, int]:
        """The last known end at or before x, and the last one there can be."""
        if x >= self.total:
            return self.total, self.total
        k = bisect_right(self.points, x) - 1
        return self.points[k], self.points[k] if self.whole[k] else x

    def reach(self, start: int, shards: int, capacity: int, side: int) -> list[int]:
        """Ends of greedy shards; side 0 never goes too far, side 1 never falls short."""
        ends = []
        for _ in range(shards):
            start = self.floor(start + capacity)[side]
            ends.append(start)
        return ends

    def smallest(self, shards: int, low: int, side: int) -> int:
        """The smallest capacity from ``low`` on whose greedy pass covers everything."""
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.reach(0, shards, middle, side)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def exact(self, x: int) -> int:
        """The last end at or before x; opens the gap around x as far as needed."""
        while True:
            low, high = self.floor(x)
            if low == high:
                return low
            k = bisect_right(self.points, x) - 1
            self.open([(self.points[k], self.points[k + 1])], BINS)


def capacity(ends: Ends, shards: int, largest: int) -> int:
    """The smallest capacity with which a greedy pass needs at most ``shards`` shards."""
    low = max(largest, -(-ends.total // shards), 1)
    while True:
        least, most = ends.smallest(shards, low, 1), ends.smallest(shards, low, 0)
        if least == most:
            return least
        early, late = ends.reach(0, shards, least, 0), ends.reach(0, shards, most, 1)
        gaps = set()
        for a, b in zip([0, *early], [0, *late]):
            first = max(bisect_right(ends.points, min(a + least, ends.total - 1)) - 1, 0)
            last = bisect_left(ends.points, min(b + most, ends.total) + 1)
            gaps.update((ends.points[k], ends.points[k + 1]) for k in range(first, min(last, len(ends.whole)))
                        if not ends.whole[k])
        ends.open(sorted(gaps), FINE_BINS)


def cut(ends: Ends, shards: int, limit: int) -> list[int]:
    """Ends of all shards but the last: none above ``limit``, and as even as that allows."""
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        even = start + -(-(ends.total - start) // (left + 1))
        here = ends.floor(even)[0]
        if here <= start:
            here = ends.points[min(bisect_right(ends.points, start), len(ends.points) - 1)]
        if here - start > limit or ends.reach(here, left, limit, 0)[-1] < ends.total:
            here = ends.exact(start + limit)
        cuts.append(here)
        start = here
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", own: list[str] | None = None) -> DataFrame:
    """A struct ``own`` of columns of ``docs`` and size, text_crc32, shard, slot of every row."""
    kept = [c for c in docs.columns if c != text] if own is None else own
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.col(f"`{id}`").alias("id"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("digest"), F.pmod(F.xxhash64(F.col(f"`{id}`")), F.lit(SALTS)).alias("salt"),
    ), "rows")
    pieces = rows.groupBy("digest", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("id").alias("first"))
    pieces = materialize(pieces.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "pieces")
    order = [F.col("first").asc_nulls_first(), F.col("digest")]
    groups = pieces.groupBy("digest").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first").alias("first"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(
        docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(groups.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "groups")

    # Running sums: within each range of the order, then over the ranges (one row for each).
    sums = placed.groupBy("part").agg(F.sum("n").alias("part_n"), F.sum("bytes").alias("part_bytes"), F.max("bytes").alias("most"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select("part", "part_bytes", "most", *[
        F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")]), "parts")
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = materialize(placed.join(sums.select("part", "n_before", "bytes_before"), "part").select(
        "digest", "n", (F.col("n_before") + F.sum("n").over(along)).alias("end_rows"),
        (F.col("bytes_before") + F.sum("bytes").over(along)).alias("end")), "line")

    whole = sums.agg(F.sum("part_bytes").alias("total"), F.max("most").alias("largest")).first()
    if whole["total"] is None:
        return rows.select("own", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ends = Ends(line, whole["total"])
    cuts = cut(ends, shards, capacity(ends, shards, whole["largest"]))

    number = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    numbered = line.withColumn("shard", number)
    starts = numbered.groupBy("shard").agg(F.min(F.col("end_rows") - F.col("n")).alias("shard_rows"))
    where = numbered.join(starts, "shard").select(
        "digest", "shard", (F.col("end_rows") - F.col("n") - F.col("shard_rows")).alias("group_slot"))
    slots = pieces.join(where, "digest").select(
        "digest", "salt", "shard", (F.col("group_slot") + F.col("before")).alias("piece_slot"))
    within = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("id")) - 1
    return rows.withColumn("within", within).join(slots, ["digest", "salt"]).select(
        "own", "size", "text_crc32", "shard", (F.col("piece_slot") + F.col("within")).alias("slot"))
