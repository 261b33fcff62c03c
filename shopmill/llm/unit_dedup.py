"""Substring dedup by paragraph or line hashing.

A unit is normalised (A-Z in lower case, runs of ASCII white space as one space, none at the ends) and represented by a
128-bit digest.  Digests are grouped over all texts, the occurrence with the smallest (id, unit number)
stays, every other one is removed.

* ``paragraph``: sentences end at ``.``, ``!`` or ``?`` before white space, at their full-width forms and at blank lines.
  From every sentence on, the shortest run of whole sentences with ``WORDS`` words or more is a unit, and so is the
  shortest such run that ends the text (the whole text where it has fewer).  Units overlap, every sentence is inside one,
  and none depends on where lines break: a passage is found in a copy that was wrapped anew.
* ``line``: every line that is not blank is a unit, however short.

Nulls and empty texts have no units.  Null ids rank first.  Rows that share an id are ranked by
their unit numbers; two of them at one place are both the kept occurrence.
Offsets are code points of the text as it came in, end exclusive, without white space after the unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopmill.sources.scratch import materialize

WORDS = 30
WHITE = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = re.compile(r"[.!?]+[\x20\x09-\x0D]+|[。！？]+[\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*\n")

Unit = tuple[int, int, int, int, bytes]  # number, start, end, words, normalised text


def _pieces(text: str, ends: Iterator[int]) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the pieces of a text that hold a word."""
    out, at = [], 0
    for end in ends:
        piece = text[at:end]
        words = piece.encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((end - len(piece.lstrip(WHITE)), at + len(piece.rstrip(WHITE)), words))
        at = end
    return out


def _sentence_ends(text: str) -> Iterator[int]:
    for found in SENTENCE_ENDS.finditer(text):
        yield found.end()
    yield len(text)


def paragraphs(text: str, least: int = WORDS) -> Iterator[Unit]:
    """Units numbered by their first sentence; the one that ends the text has the number of its own first sentence."""
    sentences = _pieces(text, _sentence_ends(text))
    bodies, sizes = [b" ".join(words) for _, _, words in sentences], [len(words) for _, _, words in sentences]
    end = held = 0
    last = None
    for k, size in enumerate(sizes):
        while end < len(sizes) and held < least:
            held += sizes[end]
            end += 1
        if held < least:
            break
        yield k, sentences[k][0], sentences[end - 1][1], held, b" ".join(bodies[k:end])
        last = k, end
        held -= size
    first, held = len(sizes), 0
    while first and held < least:
        first -= 1
        held += sizes[first]
    if held and last != (first, len(sizes)):
        yield first, sentences[first][0], sentences[-1][1], held, b" ".join(bodies[first:])


def lines(text: str) -> Iterator[Unit]:
    """Units numbered by their line."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        for start, end, words in _pieces(line, iter([len(line)])):
            yield number, at + start, at + end, len(words), b" ".join(words)
        at += len(line) + 1


LEVELS = {"paragraph": paragraphs, "line": lines}


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", level: str = "paragraph") -> DataFrame:
    """(id, unit, start, end, n_words, digest) of all units."""
    cut = LEVELS[level]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "unit", "start", "end", "n_words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += [(doc, *unit[:4], hashlib.md5(unit[4]).digest()) for unit in cut(body.as_py() or "")]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, "id long, unit long, start long, end long, n_words long, digest binary")


def repeated_units(docs: DataFrame, id: str = "doc_id", text: str = "text", level: str = "paragraph") -> DataFrame:
    """(id, unit, start, end, n_words, kept_id, kept_unit, digest) of every unit to remove.

    Counting per digest combines on the map side; the join back has one row for
    each repeated digest on one side, so a unit of a third of all texts splits.
    """
    all_units = materialize(units(docs, id, text, level), "units")
    first = all_units.groupBy("digest").agg(
        F.min(F.struct(F.col("id").alias("kept_id"), F.col("unit").alias("kept_unit"))).alias("first"),
        F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first.*")
    return all_units.join(first, "digest").where(
        ~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("unit") == F.col("kept_unit")))).select(
        F.col("id").alias(id), "unit", "start", "end", "n_words", F.col("kept_id").alias(f"kept_{id}"), "kept_unit",
        F.lower(F.hex("digest")).alias("digest"))


def _rest(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the union of spans leaves of 0..size."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append((at, min(start, size)))
        at = max(at, end)
    return [(a, b) for a, b in [*out, (at, size)] if a < b]


def remove_units(docs: DataFrame, removed: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, kept): every text without its removed units, and the stretches that stay, in offsets of the text as it was.

    Rows that share an id lose the same offsets.  Other columns are the caller's to join.
    """
    spans = removed.groupBy(F.col(f"`{id}`").alias("gone_id")).agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    own = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, kept = [], []
            for body, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                stay = _rest(len(body or ""), [(g["start"], g["end"]) for g in gone or []])
                bodies.append(None if body is None else "".join(body[a:b] for a, b in stay))
                kept.append([{"start": a, "end": b} for a, b in stay])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bodies, pa.string()), pa.array(kept, kind)], ["id", "text", "kept"])

    cut = own.join(spans, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("id", "text", "gone").mapInArrow(
        run, "id long, text string, kept array<struct<start:long,end:long>>")
    return cut.select(F.col("id").alias(id), F.col("text").alias(text), "kept")
