"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised to lower case, with every run of ASCII
characters other than letters and digits as one space.  Every item is cut into
overlapping passages of ``PASSAGE`` characters, one every ``STEP``, and one up to
``WHOLE`` characters is searched as a whole too, so a quote of part of an item is
found like the item itself.  A passage of m characters within k edits of a region
of a text shares at least m - q + 1 - k * q q-grams with it, on diagonals that are
at most k apart.  Shared q-grams are counted in overlapping bands of diagonals, each
2k + 2 wide; a band that meets the bound is verified by banded alignment.

The q-gram index is sent to the tasks in parts of at most ``PART_CHARS`` characters
of benchmark text, whatever the benchmark's size: a larger one takes more passes
over the texts, never a larger broadcast.  Texts are not shuffled at all.

Nulls, empty texts and items without letters or digits match nothing.  An item under
``SHORT`` normalised characters must stand in the text exactly and as whole words;
one without a q-gram is looked up among the runs of words that are as short.
Equal items are reported each.
Offsets are code points of the text as it came in, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Q = 8
EDIT_RATE = 0.08
SHORT = 24
PASSAGE, STEP = 48, 16
WHOLE = 144
PART_CHARS = 1 << 20
SEGMENT = 1 << 18
HITS = 1 << 21

_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_FILTER_BITS = 20
_GRAM = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Normalised bytes, whether each byte of the lower-cased text is among them, and that text.

    Characters whose lower case is longer stay as they are, so offsets are those of the text.
    """
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    raw = lowered.encode("utf-8", "surrogatepass")
    mapped = np.frombuffer(raw.translate(_TABLE), np.uint8)
    keep = mapped != 32
    keep[1:] |= keep[:-1].copy()
    return mapped[keep], keep, raw


def _trimmed(chars: np.ndarray) -> np.ndarray:
    """Without the space that punctuation leaves at an end."""
    full = np.flatnonzero(chars != 32)
    return chars[full[0]:full[-1] + 1] if len(full) else chars[:0]


def _grams(text: np.ndarray) -> np.ndarray:
    """The q bytes at every position as one number."""
    text = np.ascontiguousarray(text)
    return np.ndarray((len(text) - Q + 1,), "<u8", text, 0, (1,)).astype(np.uint64) if len(text) >= Q else np.zeros(0, np.uint64)


def _slot(grams: np.ndarray) -> np.ndarray:
    mixed = grams * _GRAM
    mixed >>= np.uint64(64 - _FILTER_BITS)
    return mixed.view(np.int64)


@dataclass
class Index:
    """Passages of a part of the benchmark and where each q-gram stands in them."""

    items: np.ndarray  # item of a passage
    passages: list[np.ndarray]
    edits: np.ndarray  # budget of a passage
    bound: np.ndarray  # q-grams that must be shared
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # postings of grams[g]: first[g] to first[g + 1]
    passage: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    reach: int  # no region is longer
    tiny: dict[bytes, list[int]]  # items without a q-gram


def _cuts(chars: np.ndarray) -> list[np.ndarray]:
    """The passages that an item is searched by."""
    last = len(chars) - PASSAGE
    if last <= 0:
        return [chars]
    cuts = [chars[at:at + PASSAGE] for at in [*range(0, last, STEP), last]]
    return [chars, *cuts] if len(chars) < WHOLE else cuts


def build_index(items: list[tuple[int, str]]) -> Index | None:
    numbers, passages, tiny = [], [], {}
    for number, text in items:
        chars = _trimmed(normalise(text or "")[0])
        if len(chars) >= Q:
            cuts = _cuts(chars)
            numbers += [number] * len(cuts)
            passages += map(np.ascontiguousarray, cuts)
        elif len(chars):
            tiny.setdefault(chars.tobytes(), []).append(number)
    if not passages and not tiny:
        return None
    lengths = np.array([len(p) for p in passages], np.int64)
    edits = np.where(lengths < SHORT, 0, (lengths * EDIT_RATE).astype(np.int64))
    bound = np.maximum(lengths - Q + 1 - edits * Q, 1)
    grams = np.concatenate([np.zeros(0, np.uint64), *(_grams(p) for p in passages)])
    passage = np.repeat(np.arange(len(passages)), lengths - Q + 1)
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in lengths - Q + 1)])
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[_slot(distinct)] = True
    return Index(np.array(numbers, np.int64), passages, edits, bound, distinct, np.append(first, len(grams)),
                 passage[order], place[order], known, int((lengths + 2 * edits).max(initial=0)) + 2, tiny)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits of ``pattern`` against any substring of ``text`` in the diagonals low to high, and its end.

    Cell (i, j) lies on diagonal j - i; only those cells are computed.
    """
    far = len(pattern) + len(text) + 1
    width = high - low + 1
    steps = np.arange(width)
    column = low + steps  # text position before row 0
    row = np.where((column >= 0) & (column <= len(text)), 0, far)
    for i, char in enumerate(pattern, 1):
        column = column + 1
        inside = (column >= 1) & (column <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[column[inside] - 1] == char
        best = row + np.where(inside, ~same, far)  # along the diagonal
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # a character of the pattern alone
        best = np.where((column >= 0) & (column <= len(text)), best, far)
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, far)  # characters of the text alone
    at = int(np.argmin(row))
    return int(row[at]), int(column[at])


def _regions(index: Index, text: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(passage, start, end, edits) of verified regions of a normalised text."""
    grams = _grams(text)
    at = np.flatnonzero(index.filter[_slot(grams)])
    if not len(at):
        return
    found = np.searchsorted(index.grams, grams[at])
    found[found == len(index.grams)] = 0
    real = index.grams[found] == grams[at]
    at, found = at[real], found[real]
    if not len(at):
        return
    count = index.first[found + 1] - index.first[found]
    if count.sum() > HITS and len(text) > 4 * index.reach:
        half = len(text) // 2
        yield from _regions(index, text[:half + index.reach])
        for p, start, end, edits in _regions(index, text[half:]):
            yield p, start + half, end + half, edits
        return
    run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    posting = np.repeat(index.first[found], count) + run
    passage = index.passage[posting]
    diagonal = np.repeat(at, count) - index.place[posting]
    enough = np.bincount(passage, minlength=len(index.bound)) >= index.bound
    likely = enough[passage]
    passage, diagonal = passage[likely], diagonal[likely]
    if not len(passage):
        return
    # Two bands for each hit: numbers b and b - 1, each 2k + 2 diagonals wide.
    shift = index.edits[passage] + 1
    band = np.floor_divide(diagonal, shift)
    offset = len(text) + 2
    key = np.concatenate([passage * (2 * offset) + band + offset, passage * (2 * offset) + band - 1 + offset])
    key, shared = np.unique(key, return_counts=True)
    passage, band = key // (2 * offset), key % (2 * offset) - offset
    full = shared >= index.bound[passage]
    for p, b in zip(passage[full].tolist(), band[full].tolist()):
        pattern, k = index.passages[p], int(index.edits[p])
        low, high = b * (k + 1) - k, (b + 2) * (k + 1) + k
        start = max(0, low)
        region = text[start:max(start, min(len(text), high + len(pattern)))]
        exact = region.tobytes().find(pattern.tobytes())
        if exact >= 0:
            yield p, start + exact, start + exact + len(pattern), 0
            continue
        edits, end = align(pattern, region, low - start, high - start)
        if edits <= k:
            back = region[:end][::-1]
            _, length = align(pattern[::-1], back, -k, k)
            yield p, start + end - length, start + end, edits


def _tiny_runs(index: Index, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of items without a q-gram, which are runs of a few short words."""
    words = text.tobytes().split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    for first, word in enumerate(words):
        start = int(ends[first]) - len(word)
        for end in ends[first:first + Q // 2].tolist():
            if end - start >= Q:
                break
            for item in index.tiny.get(text[start:end].tobytes(), ()):
                yield item, start, end


def _whole_words(chars: np.ndarray, start: int, end: int) -> bool:
    return (not start or chars[start - 1] == 32) and (end == len(chars) or chars[end] == 32)


def leaks(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits): stretches of a text that hold passages of an item, in code points."""
    chars, keep, raw = normalise(text)
    spans: dict[int, set[tuple[int, int, int]]] = {}
    for at in range(0, max(len(chars), 1), SEGMENT):
        for p, start, end, edits in _regions(index, chars[at:at + SEGMENT + index.reach]):
            if len(index.passages[p]) >= SHORT or _whole_words(chars, at + start, at + end):
                spans.setdefault(int(index.items[p]), set()).add((at + start, at + end, edits))
    if index.tiny and len(chars):
        for item, start, end in _tiny_runs(index, chars):
            spans.setdefault(item, set()).add((start, end, 0))
    rows = []
    places = np.flatnonzero(keep) if spans else keep
    for item, found in sorted(spans.items()):
        merged: list[list[int]] = []
        for start, end, edits in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1][1:] = [max(merged[-1][1], end), max(merged[-1][2], edits)]
            else:
                merged.append([start, end, edits])
        for start, end, edits in merged:
            low, high = int(places[start]), int(places[end - 1]) + 1
            while high < len(raw) and raw[high] & 0xC0 == 0x80:
                high += 1
            before = len(raw[:low].decode("utf-8", "ignore"))
            rows.append((item, before, before + len(raw[low:high].decode("utf-8", "ignore")), edits))
    return rows


def _parts(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, one on the driver at a time."""
    items = benchmark.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL")
    group, size = [], 0
    for row in items.orderBy("id", "text").toLocalIterator():
        if group and size + len(row["text"]) > PART_CHARS:
            yield group
            group, size = [], 0
        group.append((row["id"], row["text"]))
        size += len(row["text"])
    if group:
        yield group


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits): a row for every stretch of a text that holds a benchmark passage."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = "id long, item long, start long, end long, edits long"

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value  # at most PART_CHARS characters and an item
            for batch in batches:
                rows = [(doc, *leak) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1))
                        for leak in leaks(index, body.as_py() or "")]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["id", "item", "start", "end", "edits"])
        return run

    found = [slim.mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
             for index in map(build_index, _parts(benchmark, item_id, item_text)) if index]
    if not found:
        found = [spark.createDataFrame([], schema)]
    return reduce(DataFrame.unionAll, found).select(
        F.col("id").alias(id), F.col("item").alias(item_id), "start", "end", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage; rows without an id are judged by nothing and stay."""
    leaked = find_leaks(docs, benchmark, id, text).select(F.col(id).alias("__leaked")).distinct()
    return docs.join(leaked, docs[id] == leaked["__leaked"], "left_anti")
