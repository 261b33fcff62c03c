"""SimHash near-duplicate groups.

``fingerprints`` gives each text the majority bits of its shingle hashes.  Close
fingerprints are found by blocks and compared by Hamming distance.

``near_fingerprints`` links 64-bit fingerprints at 3 or fewer differing bits.  Six blocks of 10 or 11 bits are cut;
three differing bits leave three blocks whole, so the 20 choices of three blocks (32 bits) lose no pair.

Nulls and empty texts have no words: their fingerprint is zero, and they are
linked like any other.  Equal texts share one fingerprint and are one node.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shopmill.llm.links import block_links, components
from shopmill.sources.scratch import materialize

SEED = 42
CUTS = (0, 11, 22, 33, 44, 54, 64)  # six blocks of a 64-bit fingerprint
MAX_BITS = 3


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, lower-cased in A-Z, joined by a space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    columns = (words[k:] for k in range(width))
    count = len(words) - width + 1
    return np.fromiter((digest(join(run), SEED) for run in zip(*columns)), np.uint64, count)


def majority(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at:at + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, print): the 64-bit fingerprint of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(prints))], ["id", "print"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "id long, print long")


def near_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(print, component): for distinct fingerprints with a link, the smallest fingerprint reachable."""
    blocks = [((1 << high) - (1 << low)) for low, high in zip(CUTS, CUTS[1:])]
    masks = [sum(choice) for choice in combinations(blocks, len(blocks) - max_bits)]
    masks = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("bits"))
                     for k, m in enumerate(masks)])
    blocked = prints.select("print").distinct().select(
        F.explode(keys).alias("key"), F.col("print").alias("node"), F.array("print").alias("print"))
    return components(block_links(blocked, max_bits, 1)).withColumnRenamed("node", "print")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, print, component_id): linked texts get the smallest id of all texts reachable.

    Ids may repeat or be null; a group without any id has a null component_id.
    """
    marked = materialize(fingerprints(docs, id, text, width), "prints")
    owners = marked.groupBy("print").agg(F.min("id").alias("least"))
    linked = materialize(near_fingerprints(owners), "linked")
    least = (
        owners.join(linked, "print", "left")
        .withColumn("component", F.coalesce("component", "print"))
    )
    groups = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(least.join(groups, "component").select("print", "component_id"), "print", "left").select(
        F.col("id").alias(id), "print", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without the near copies: of each group of linked texts the document with the smallest id stays.

    Rows without an id cannot be told apart and stay; rows that share an id stay or go together.
    """
    dropped = simhash_groups(docs, id, text, width).where(F.col(id) != F.col("component_id")).select(
        F.col(id).alias("__dropped")).distinct()
    return docs.join(dropped, docs[id] == dropped["__dropped"], "left_anti")
