"""Byte-level BPE by recursive queries, and decoding by ordered aggregation.

Inside each task, an in-process SQL engine holds two tables made from a rank file: ``vocabulary``
(id, piece) and ``merges`` (left id, right id, id) with every pair whose joined bytes are a
piece.  A text is cut by a pattern; each distinct word becomes rows (word, position,
id), one for each byte.  A recursive query joins neighbours with the merges and contracts the
leftmost pair of the least rank of every word until no pair is left.  A word that is itself a
piece is that piece, whatever the merges would give.

In a word longer than two pieces of the greatest length, a step contracts many pairs at once: every pair
that is the least, leftmost one within that distance on both sides (other merges reach no further than one
piece), and all places of the word's least pair from the left up to the first whose merge makes a pair of a lower
rank.  These are the pairs that single steps would come to as well, so the result is the same.

``encode`` returns the ids of each text, ``decode`` the bytes of each list of ids, put together by an
aggregation that is ordered by position.  Both are map-only, so a lost executor costs its own tasks.
A task works on rounds of about ``ROUND`` characters and keeps the words that it has met, up to
``KNOWN``; beyond that it forgets them and meets them anew.  A single text is one round.

A null text is empty and has no ids.  A null list of ids decodes to no bytes; an id that the file does not have
stops the query.  Rows are answered one by one: ids may repeat or be null, other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

ROUND = 1_500_000  # characters of texts, or ids, that a task works on at once
KNOWN = 600_000  # words that a task keeps
MEMORY = "1GB"  # of the SQL engine in a task, which spills beyond it

#: One merge of every open word at a time: the leftmost pair of the least rank.  A row's key is its word's
#: number and its position in seven bits; a pair's place is its rank, its position and that of its right half.
CONTRACT = """
WITH RECURSIVE steps AS (
    SELECT word::BIGINT * 128 + pos AS key, id, true AS open FROM bytes_of_words
    UNION ALL (
    WITH paired AS (
        SELECT key, id, lead(key) OVER w AS next_key, lead(id) OVER w AS next_id
        FROM steps WHERE open WINDOW w AS (ORDER BY key)
    ), ranked AS (
        SELECT p.key, p.id, p.key >> 7 AS word, (m.id * 128 + p.key % 128) * 128 + p.next_key % 128 AS place
        FROM paired p LEFT JOIN merges m
            ON m.left_id = p.id AND m.right_id = p.next_id AND p.key >> 7 = p.next_key >> 7
    ), least AS (
        SELECT word, min(place) AS place FROM ranked GROUP BY word
    )
    SELECT r.key, CASE WHEN r.place = l.place THEN l.place >> 14 ELSE r.id END::INT AS id, l.place IS NOT NULL AS open
    FROM ranked r JOIN least l ON l.word = r.word
    WHERE l.place IS NULL OR r.key % 128 <> l.place % 128)
)
SELECT (key >> 7)::INT AS word, list(id ORDER BY key) AS ids FROM steps WHERE NOT open GROUP BY key >> 7
"""

#: The same for long words, with all pairs contracted at once that no other merge can reach before their turn.
CONTRACT_LONG = """
WITH RECURSIVE steps AS (
    SELECT word, pos, id, true AS open FROM bytes_of_long_words
    UNION ALL (
    WITH paired AS (
        SELECT word, pos, id, lead(id) OVER w AS next_id, lead(id, 2) OVER w AS after_id, lag(id) OVER w AS prev_id
        FROM steps WHERE open WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT p.*, m.id AS rank, m.id::BIGINT * 4294967296 + p.pos AS place
        FROM paired p LEFT JOIN merges m ON m.left_id = p.id AND m.right_id = p.next_id
    ), near AS (
        SELECT *, min(place) OVER (w RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS near_place,
            min(rank) OVER (PARTITION BY word) AS low, lag(rank) OVER w AS prev_rank
        FROM ranked WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), hits AS (
        SELECT *, sum(CASE WHEN prev_rank = low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM near WHERE rank = low
    ), turns AS (
        SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1 AS taken FROM hits
    ), effects AS (
        SELECT t.word, t.pos, least(a.id, b.id, c.id) < t.low AS lower
        FROM turns t
        LEFT JOIN merges a ON a.left_id = t.prev_id AND a.right_id = t.low
        LEFT JOIN merges b ON b.left_id = t.low AND b.right_id = t.after_id
        LEFT JOIN merges c ON c.left_id = t.low AND c.right_id = t.low
        WHERE taken
    ), safe AS (
        SELECT word, pos FROM effects QUALIFY NOT coalesce(bool_or(lower) OVER (
            PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    ), chosen AS (
        SELECT n.word, n.pos, n.id, n.rank, n.low IS NOT NULL AS open,
               coalesce(n.place = n.near_place, false) OR s.pos IS NOT NULL AS merged
        FROM near n LEFT JOIN safe s ON s.word = n.word AND s.pos = n.pos
    ), next AS (
        SELECT word, pos, CASE WHEN merged THEN rank ELSE id END AS id, open,
               lag(merged, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
        FROM chosen
    )
    SELECT word, pos, id, open FROM next WHERE NOT gone)
)
SELECT word, list(id ORDER BY pos) AS ids FROM steps WHERE NOT open GROUP BY word
"""

DECODE = """
SELECT row, string_agg(piece, '' ORDER BY pos) AS body
FROM (SELECT row, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM lists) JOIN vocabulary USING (id)
GROUP BY row
"""


def read_ranks(path: str) -> bytes:
    """The rank file: lines of a piece in base 64 and its rank."""
    with open(path, "rb") as file:
        return file.read()


class Coder:
    """The tables of one rank file and the words met so far, in a process's SQL engine."""

    def __init__(self, file: bytes, pattern: str):
        import duckdb
        import regex

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file.splitlines())}
        pairs = [(ranks[p[:k]], ranks[p[k:]], rank) for p, rank in ranks.items()
                 for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
        self.engine = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        self.words = regex.compile(pattern)
        self.reach = 2 * max(map(len, ranks), default=1)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self._table("merges", left_id=_ints([p[0] for p in pairs]), right_id=_ints([p[1] for p in pairs]),
                    id=_ints([p[2] for p in pairs]))
        # Bytes are kept as the characters of the same number, as texts are what the engine joins in order.
        self._table("vocabulary", id=_ints(list(ranks.values())), piece=pa.array([p.decode("latin-1") for p in ranks], pa.string()))
        whole = {p: rank for p, rank in ranks.items() if _is_text(p)}
        self._table("whole", text=pa.array([p.decode() for p in whole], pa.string()), id=_ints(list(whole.values())))
        self._forget()

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.engine.register("given", pa.table(columns))
        self.engine.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.engine.unregister("given")

    def _forget(self) -> None:
        self.engine.execute("CREATE OR REPLACE TABLE known AS SELECT text, [id] AS ids FROM whole")
        self.n_known = 0

    def _bytes_of(self, words: list[str], numbers: list[int]) -> pa.Table:
        """Rows (word, pos, id), one for each byte."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        if (flat < 0).any():
            raise ValueError("the rank file has no rank for some byte of the texts")
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return pa.table({"word": np.repeat(np.array(numbers, np.int32), sizes), "pos": at.astype(np.int32), "id": flat})

    def _learn(self, words: pa.Array, numbers: pa.Array) -> list[pa.Table]:
        """(word, ids) of new words, which are added to ``known``; ``numbers`` are their words' numbers in ``met``."""
        texts, which = words.to_pylist(), numbers.to_pylist()
        long = [len(t.encode()) > min(self.reach, 127) for t in texts]
        out = []
        for query, name, kind in ((CONTRACT, "bytes_of_words", False), (CONTRACT_LONG, "bytes_of_long_words", True)):
            rows = [k for k, is_long in enumerate(long) if is_long == kind]
            if rows:
                self.engine.register(name, self._bytes_of([texts[k] for k in rows], [which[k] for k in rows]))
                out.append(self.engine.sql(query.replace("{reach}", str(self.reach))).to_arrow_table())
                self.engine.unregister(name)
                self.engine.register("learnt", out[-1])
                self.engine.execute("INSERT INTO known SELECT text, ids FROM learnt JOIN met USING (word)")
                self.engine.unregister("learnt")
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end."""
        lists = [self.words.findall(t) for t in texts]
        ends = np.cumsum([0] + [len(words) for words in lists])
        coded = pa.array([w for words in lists for w in words], pa.string()).dictionary_encode()
        distinct = coded.dictionary
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if self.n_known + len(distinct) > KNOWN:
            self._forget()
        self.engine.register("met", pa.table({"word": pa.array(range(len(distinct)), pa.int32()), "text": distinct}))
        found = self.engine.sql("SELECT word, text, ids FROM met LEFT JOIN known USING (text)").to_arrow_table()
        fresh = pc.is_null(found.column("ids"))
        new, found = found.filter(fresh), found.filter(pc.invert(fresh)).select(["word", "ids"])
        if len(new):
            learnt = self._learn(new.column("text").combine_chunks(), new.column("word").combine_chunks())
            found = pa.concat_tables([found, *learnt])
            self.n_known += len(new)
        self.engine.unregister("met")
        found = found.combine_chunks()
        place = np.empty(len(distinct), np.int64)
        place[found.column("word").to_numpy()] = np.arange(len(distinct))
        ids = found.column("ids").chunk(0)
        starts, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        each = place[coded.indices.to_numpy()]
        sizes = starts[each + 1] - starts[each]
        before = np.append(0, np.cumsum(sizes))
        out = values[np.repeat(starts[each] - before[:-1], sizes) + np.arange(before[-1])]
        return out.astype(np.int32), before[ends]

    def bodies(self, lists: pa.Array) -> list[bytes]:
        """The bytes of every list of ids."""
        self.engine.register("lists", pa.table({"row": pa.array(range(len(lists)), pa.int64()), "ids": lists}))
        found = self.engine.sql(DECODE).to_arrow_table()
        self.engine.unregister("lists")
        out = [b""] * len(lists)
        for row, body in zip(found.column("row").to_pylist(), found.column("body")):
            out[row] = body.as_py().encode("latin-1")
        wanted = sum(len(x) for x in lists.drop_null())
        if wanted != self._count_known(lists):
            raise ValueError("an id is not in the rank file")
        return out

    def _count_known(self, lists: pa.Array) -> int:
        ids = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x.values, np.int64) for x in lists if x.is_valid]])
        return int(np.isin(ids, self._all_ids).sum())

    @property
    def _all_ids(self) -> np.ndarray:
        if not hasattr(self, "_ids"):
            self._ids = self.engine.sql("SELECT id FROM vocabulary").to_arrow_table().column("id").to_numpy()
        return self._ids


def _ints(values: list[int]) -> pa.Array:
    return pa.array(values, pa.int32())


def _is_text(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def coder(file: bytes, pattern: str) -> Coder:
    """One coder for all tasks of a Python worker."""
    return Coder(file, pattern)


def _rounds(sizes: list[int], most: int = ROUND) -> Iterator[slice]:
    """Consecutive rows with ``most`` in sum; a larger row is alone."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(start, k)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(docs: DataFrame, ranks: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids of every text by the rank file at ``ranks``, words cut by ``pattern``."""
    file = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for rows in _rounds([len(t) for t in texts]):
                ids, ends = own.ids(texts[rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))],
                    ["id", "ids"])

    return docs.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
    ).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id)


def decode(lists: DataFrame, ranks: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, ids, body): the bytes that every list of ids stands for, beside the list."""
    file = lists.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(file.value, "")
        for batch in batches:
            for rows in _rounds(batch.column(1).value_lengths().fill_null(0).to_pylist()):
                part = batch.column(1)[rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], part, pa.array(own.bodies(part), pa.binary())], ["id", "ids", "body"])

    return lists.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{ids}`").cast("array<int>").alias("ids"),
    ).mapInArrow(run, "id long, ids array<int>, body binary").withColumnRenamed("id", id)
