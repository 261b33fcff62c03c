"""Token ids in binary shards that can be read document by document.

File format of a shard, all numbers little-endian:

* one zstandard frame for each document, with its content checksum: the token ids,
  as 16-bit numbers if the vocabulary allows it, else 32-bit ones;
* a skippable frame (magic 0x184D2A5D) with a zstandard frame of the index: ``ids``
  (int64), ``null`` (uint8, 1 where the id is null) and ``counts`` (int64), one after
  the other, preceded by the width of an id in bytes (uint32);
* a trailing seek table in the layout of the seekable zstandard format: a skippable
  frame (magic 0x184D2A5E) with compressed size, decompressed size and checksum
  (uint32 each; low half of the content's XXH64) of every document frame, their
  number, a descriptor byte and the magic 0x8F92EAB1.

A reader takes the two tables from the end of the file and then decompresses only
the frames it is asked for.  Shards are contiguous ranges of ids in ascending order
(nulls first, ties by text).  A task writes files under names of its own; a shard
counts only through the manifest row of the attempt that succeeded, so a lost
executor leaves files that nobody reads.

Nulls are tokenised as empty texts; every document ends with ``end_id``.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from shopmill.sources.scratch import materialize, scratch_folder

END_ID = 2
SHARD_BYTES = 32 << 20  # text of a shard, about
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CACHED_WORDS = 400_000


# -- tokenising ---------------------------------------------------------------------------

# The fixed split of the word vocabulary, written out for texts up to U+017F.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = "\\t-\\r \u0085 "
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_BEYOND = re.compile("[^\\x00-įı-ſ]|<\\|")


def _byte_letters() -> dict[int, str]:
    """The usual table of byte-level vocabularies: printable bytes stand for themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Pieces(dict):
    """Ids of a word as bytes, by the library's model; the cache is emptied when it is full."""

    def __init__(self, model, kind: str):
        self.model, self.kind, self.letters = model, kind, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        spelled = word if word.isascii() and word.isprintable() else "".join(map(self.letters.get, word.encode()))
        ids = self[word] = array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids


class Encoder:
    """Token ids of texts, as little-endian bytes of ``kind``.

    A tokenizer with the split above spends nearly all its time on positions that
    are not asked for.  Where a text holds only characters on which its
    normaliser (NFC, white space, lower case) does nothing but lower the case, the
    words are split here and each distinct word goes through the library's model;
    any other text, and any other tokenizer, goes through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = self._splits_like_ours(spec)
        self.pieces = _Pieces(self.library.model, "H" if self.kind == "<u2" else "I")

    @staticmethod
    def _splits_like_ours(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
            and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        )

    def ids(self, text: str) -> bytes:
        if self.by_word and not _BEYOND.search(text):
            return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text.lower())))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


# -- shards -------------------------------------------------------------------------------

def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def shard_tail(ids: list[int | None], counts: list[int], sizes: list[tuple[int, int, int]], width: int) -> bytes:
    """Index and seek table of a shard; sizes are (compressed, decompressed, checksum)."""
    index = struct.pack("<I", width) + zstandard.ZstdCompressor(level=3, write_checksum=True).compress(
        np.array([i or 0 for i in ids], "<i8").tobytes()
        + np.array([i is None for i in ids], np.uint8).tobytes()
        + np.array(counts, "<i8").tobytes())
    table = np.array(sizes, "<u4").tobytes() + struct.pack("<IBI", len(sizes), 0x80, SEEK_MAGIC)
    return _skippable(INDEX_MAGIC, struct.pack("<I", len(ids)) + index) + _skippable(TABLE_MAGIC, table)


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the shard")
        table_at = size - 9 - 12 * count - 8
        file.seek(table_at)
        if struct.unpack("<I", file.read(4))[0] != TABLE_MAGIC:
            raise ValueError("damaged seek table")
        file.seek(table_at + 8)
        self.sizes = np.frombuffer(file.read(12 * count), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0], dtype=np.int64)])
        file.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        body = file.read(length)
        if magic != INDEX_MAGIC or struct.unpack_from("<I", body)[0] != count:
            raise ValueError("damaged index")
        self.kind = "<u2" if struct.unpack_from("<I", body, 4)[0] == 2 else "<u4"
        index = zstandard.ZstdDecompressor().decompress(body[8:])
        self.ids = np.frombuffer(index, "<i8", count)
        self.nulls = np.frombuffer(index, np.uint8, count, 8 * count)
        self.counts = np.frombuffer(index, "<i8", count, 9 * count)

    def __len__(self) -> int:
        return len(self.sizes)

    def document(self, k: int) -> np.ndarray:
        """Token ids of the k-th document; only its frame is read, and its checksums are verified."""
        self.file.seek(int(self.starts[k]))
        content = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.sizes[k, 0])))
        if len(content) != self.sizes[k, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sizes[k, 2]:
            raise ValueError(f"checksum of document {k} does not match")
        return np.frombuffer(content, self.kind)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str, tokenizer: str, end_id: int):
    """One shard file for each partition of (id, text), and a manifest row for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder(tokenizer), zstandard.ZstdCompressor(level=3, write_checksum=True)
        end = np.array([end_id], encoder.kind).tobytes()
        ids, counts, sizes, path, out = [], [], [], None, None
        for batch in batches:
            if batch.num_rows and out is None:
                system, base = _place(folder)
                system.create_dir(base, recursive=True)
                path = f"{uuid.uuid4().hex}.tokens"
                out = system.open_output_stream(f"{base}/{path}")
            ids += batch.column(0).to_pylist()
            for text in batch.column(1):
                content = encoder.ids(text.as_py() or "") + end
                frame = pack.compress(content)
                out.write(frame)
                counts.append(len(content) // len(end))
                sizes.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        if out is not None:
            out.write(shard_tail(ids, counts, sizes, len(end)))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([sum(counts)], pa.int64())],
                ["path", "documents", "tokens"])
    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the token shards of ``docs`` to ``folder`` and return the manifest.

    Manifest: shard (number in id order), path (in ``folder``), documents, tokens, start (tokens of all shards before).
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(-(-size // shard_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = materialize(ordered.select("id", "text").mapInArrow(
        _write(folder, tokenizer, end_id), "path string, documents long, tokens long",
    ).select(F.spark_partition_id().alias("part"), "*"), "manifest")
    along = Window.orderBy("part")  # one row for each shard
    return manifest.select(
        (F.row_number().over(along) - 1).alias("shard"), "path", "documents", "tokens",
        F.coalesce(F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document, read back from the files; ids are 32-bit little-endian."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{base}/{path}"
                with system.open_input_file(name) as file:
                    reader = ShardReader(file, file.size())
                    starts = start + np.concatenate([[0], np.cumsum(reader.counts)])
                    for low in range(0, len(reader), 512):
                        high = min(low + 512, len(reader))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.ids[low:high], mask=reader.nulls[low:high].astype(bool)),
                            pa.array(starts[low:high], pa.int64()), pa.array(reader.counts[low:high], pa.int64()),
                            pa.array([reader.document(k).astype("<u4").tobytes() for k in range(low, high)], pa.binary()),
                        ], ["id", "start", "n_tokens", "ids"])

    shards = manifest.select("path", "start")
    spread = manifest.sparkSession.sparkContext.defaultParallelism
    return shards.repartition(max(spread, 1), "path").mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def token_file(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID,
               folder: str | None = None) -> DataFrame:
    """Write shards, read them back, and return (id, start, n_tokens, ids_crc32) of every document."""
    folder = folder or f"{scratch_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = materialize(write_shards(docs, folder, tokenizer, id, text, end_id), "manifest")
    return read_shards(manifest, folder).select(
        F.col("id").alias(id), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
