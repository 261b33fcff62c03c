"""Hard-negative mining by Strassen products of anchor and candidate tiles.

Vectors are whole numbers.  A task multiplies a tile of anchors with tiles of its candidates by
Strassen's recursion in 64-bit integers: sides are padded with zeros to even lengths, seven
products stand for eight, and small tiles are multiplied directly.  Additions of 64-bit integers wrap,
which is a ring, so an inner product that fits is exact whatever the intermediate sums.

Two passes, each map-only over the candidates, keep bounded heaps in every task:

1. the best ``n_positives`` rows of the anchor's own label, of all tasks merged into the anchor's positives;
2. for each positive a window of scores, and the best ``n_negatives`` rows of other labels inside it.

A heap is a set of rows (key, score, id) of which the best few of each key stay; heaps of batches and of tasks
merge by the same rule, and only heaps leave a task.  Anchors are dealt in blocks of about ``BLOCK`` rows by
their hash; a block is what is sent to all tasks (``BLOCK`` x dimension x 8 bytes), and candidates are
read once for each block and pass.  Blocks with more than twice that are dealt anew into more blocks.

Higher scores come first, ties by smaller id, a null id last.  Rows with a null label, a null vector or a null or
non-finite component take no part, nor does a row whose squared length reaches 2**62: any product of two
others fits 64 bits.  Shorter vectors are padded with zeros.  Equal anchor rows are one anchor.  Rows with
the anchor's id are the anchor itself, never its positives.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shopmill.llm.columns import total
from shopmill.sources.scratch import materialize

BLOCK = 2048  # anchors in a block
TILE = 1024  # candidates in a tile
LEAF = 16  # sides up to which a tile is multiplied directly
N_POSITIVES, N_NEGATIVES = 5, 10
#: A negative's score is between these percentages of its positive's.
LOW, HIGH = 30, 90


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit integers (modulo 2**64)."""
    (rows, inner), columns = a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
        return strassen(a, b, leaf)[:rows, :columns]
    r, k, c = rows // 2, inner // 2, columns // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((rows, columns), np.int64)
    out[:r, :c] = p1 + p4 - p5 + p7
    out[:r, c:] = p3 + p5
    out[r:, :c] = p2 + p4
    out[r:, c:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``size`` rows (score, id) of each key 0..n-1; an id may be missing."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.key = np.zeros(0, np.int64)
        self.score, self.id, self.missing = self.key, self.key, np.zeros(0, bool)
        self.worst = np.full(n, np.iinfo(np.int64).min)  # the last score of a full heap
        self.last = np.full(n, np.iinfo(np.int64).max)  # and its id

    def beaten(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows may still enter."""
        return (scores > self.worst[keys]) | ((scores == self.worst[keys]) & (ids <= self.last[keys]))

    def merge(self, key: np.ndarray, score: np.ndarray, id: np.ndarray, missing: np.ndarray) -> None:
        if not len(key):
            return
        key, score, id, missing = (np.concatenate(x) for x in (
            (self.key, key), (self.score, score), (self.id, id), (self.missing, missing)))
        order = np.lexsort((id, missing, -score, key))
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        stay = order[rank < self.size]
        full = order[rank == self.size - 1]
        self.key, self.score, self.id, self.missing = key[rank < self.size], score[stay], id[stay], missing[stay]
        last = key[rank == self.size - 1]
        self.worst[last] = score[full]
        self.last[last] = np.where(missing[full], np.iinfo(np.int64).max, id[full])


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """One row for each list, cut or padded with zeros to ``width``; what is cut meets only zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), width), np.int64)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


class Block:
    """A block of anchors, as sent to the tasks; ``windows`` has the lowest and highest scores of the second pass."""

    def __init__(self, anchors: list):
        width = max((len(a["units"]) for a in anchors), default=0)
        self.keys = np.array([a["anchor"] for a in anchors], np.int64)
        self.ids = np.array([a["id"] for a in anchors], np.int64)
        self.labels = np.array([a["label"] for a in anchors], np.int64)
        self.units = np.zeros((len(anchors), width), np.int64)
        for k, a in enumerate(anchors):
            self.units[k, :len(a["units"])] = a["units"]
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(scores by anchor and candidate, ids, missing ids, labels) of the candidates, a tile at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids, labels = part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                numbers = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
                candidates = _matrix(part.column(2), self.units.shape[1])
                yield strassen(self.units, np.ascontiguousarray(candidates.T)), numbers, missing, labels


def _pick(heaps: Heaps, keys: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
    """Put the fitting cells of a tile into the heaps; ``keys`` has the key of every row of the tile."""
    fits &= heaps.beaten(keys[:, None], scores, ids[None, :])
    rows, columns = np.nonzero(fits)
    heaps.merge(keys[rows], scores[rows, columns], ids[columns], missing[columns])


def _heap_batch(heaps: Heaps, **names: np.ndarray) -> pa.RecordBatch:
    columns = {name: values[heaps.key] for name, values in names.items()} | {"score": heaps.score}
    return pa.RecordBatch.from_arrays(
        [*[pa.array(x, pa.int64()) for x in columns.values()], pa.array(heaps.id, pa.int64(), mask=heaps.missing)],
        [*columns, "id"])


def _best(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The heaps of all tasks merged; tasks send ``size`` rows for a key at most."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _positives(candidates: DataFrame, block: Block, size: int) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        heaps, keys = Heaps(len(own.keys), size), np.arange(len(own.keys))
        for scores, ids, missing, labels in own.tiles(batches):
            fits = (own.labels[:, None] == labels[None, :]) & ((own.ids[:, None] != ids[None, :]) | missing[None, :])
            _pick(heaps, keys, scores, fits, ids, missing)
        yield _heap_batch(heaps, anchor=own.keys)

    return _best(candidates.mapInArrow(run, "anchor long, score long, id long"), ["anchor"], size)


def _negatives(candidates: DataFrame, block: Block, size: int) -> DataFrame:
    sent = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        heaps = [Heaps(len(own.keys), size) for _ in own.windows]
        for scores, ids, missing, labels in own.tiles(batches):
            other = own.labels[:, None] != labels[None, :]
            for heap, (low, high) in zip(heaps, own.windows):
                fits = other & (scores >= low[:, None]) & (scores <= high[:, None])
                _pick(heap, np.arange(len(own.keys)), scores, fits, ids, missing)
        for place, heap in enumerate(heaps):
            yield _heap_batch(heap, anchor=own.keys, place=np.full(len(own.keys), place + 1))

    return _best(candidates.mapInArrow(run, "anchor long, place long, score long, id long"), ["anchor", "place"], size)


def _windows(block: Block, found: list, count: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place among the positives, the lowest and highest score of a negative of every anchor."""
    at = {int(key): k for k, key in enumerate(block.keys)}
    out = [(np.ones(len(at), np.int64), np.zeros(len(at), np.int64)) for _ in range(count)]  # empty ones
    for row in found:
        score, k = int(row["score"]), at[row["anchor"]]
        lows, highs = out[row["rank"] - 1]
        lows[k], highs[k] = -(-low * score // 100), high * score // 100
    return out


def usable(rows: DataFrame, id: str, label: Column, vector: Column) -> DataFrame:
    """(id, label, units): the rows that take part, components as floor(256 * x)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    length = total(F.transform(vector, lambda x: F.pow(F.floor(x.cast("double") * 256).cast("double"), F.lit(2.0))), "double")
    return rows.where(label.isNotNull() & vector.isNotNull()).where(~bad).where(length < float(2**62)).select(
        F.col(f"`{id}`").cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("units"))


def mine(candidates: DataFrame, is_anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
         low: int = LOW, high: int = HIGH, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``candidates`` are (id, label, units) without nulls but for ids; ``is_anchor`` is a condition on them.
    """
    spark = candidates.sparkSession
    chosen = candidates.where(is_anchor).where("id IS NOT NULL").distinct()
    anchors = materialize(chosen.withColumn("anchor", F.xxhash64("id", "label", "units")), "anchors")
    blocks = -(-anchors.count() // block_rows)
    out = []
    while blocks:
        dealt = anchors.withColumn("block", F.pmod("anchor", F.lit(blocks)))
        if dealt.groupBy("block").count().where(F.col("count") > 2 * block_rows).isEmpty():
            break
        blocks *= 2
    for number in range(blocks):
        block = Block(dealt.where(F.col("block") == number).collect())
        if not len(block.keys):
            continue
        positives = materialize(_positives(candidates, block, n_positives), "positives")
        block.windows = _windows(block, positives.select("anchor", "rank", "score").collect(), n_positives, low, high)
        negatives = materialize(_negatives(candidates, block, n_negatives), "negatives")
        names = anchors.select("anchor", F.col("id").alias("anchor_id"))
        out.append(negatives.join(
            positives.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score")), ["anchor", "place"])
            .join(names, "anchor").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result
