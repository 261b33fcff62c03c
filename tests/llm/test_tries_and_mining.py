"""Prefix trie, hard negatives and byte-level BPE against brute force."""
import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopmill.llm import byte_bpe, queries
from shopmill.llm.hard_negatives import Heaps, mine, strassen, usable
from shopmill.llm.prefix_trie import chains, ordered_turns, rebuilt, trie

public = pytest.importorskip("public_tokenizers")


# --- prefix trie -------------------------------------------------------------------

def all_prefixes(rows):
    """The contract, prefix by prefix."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = set()
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        has_child = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in members if whole[c] == prefix)
        out.add((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in below), sum(p not in has_child for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_rows(spark, rows, tail):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit(1))
    own = F.col("conv_id")
    built = rebuilt(ordered_turns(turns), own - own % 100, F.crc32(own.cast("string")) % 6)
    found = trie(chains(built), tail).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


@pytest.mark.parametrize("tail", [0, 12, 10_000])
def test_trie(spark, tail):
    draw = random.Random(3)
    rows = []
    for conv in [*range(0, 14), *range(100, 108), 205, 263]:
        for turn in range(draw.choice([1, 2, 5, 9])):
            rows.append((conv, draw.choice([turn, turn, 1]), draw.choice(["user", "bot"]), draw.choice(["a", "bc", "é"])))
    rows += rows[:5]  # repeated rows are repeated turns
    rows += [(3, None, None, None), (7, 2, None, ""), (None, 1, "user", "lost")]
    assert trie_rows(spark, rows, tail) == all_prefixes(rows)


def test_trie_deep_and_equal(spark):
    rows = [(c, t, "u", "x" * t) for c in (1, 2, 3) for t in range(30)] + [(c, 0, "u", "") for c in range(300, 340)]
    wanted = all_prefixes(rows)
    assert trie_rows(spark, rows, 0) == wanted == trie_rows(spark, rows, 1000)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, [], 10) == set()
    assert trie_rows(spark, [(None, 1, "user", "lost")], 10) == set()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives"])
def test_registered_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    engine = duckdb.connect()
    for table in ("conversations", "embeddings"):
        engine.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = engine.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


# --- hard negatives ------------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (33, 64, 129), (70, 0, 40), (0, 8, 8), (40, 65, 17)])
def test_strassen(shape):
    draw = np.random.default_rng(1)
    a = draw.integers(-2**30, 2**30, (shape[0], shape[1]))
    b = draw.integers(-2**30, 2**30, (shape[1], shape[2]))
    assert (strassen(a, b, leaf=2) == a @ b).all()


def test_heaps_merge():
    draw = np.random.default_rng(2)
    keys, scores, ids = draw.integers(0, 4, 500), draw.integers(0, 9, 500), draw.integers(0, 60, 500)
    missing = draw.random(500) < 0.1
    heaps = Heaps(4, 3)
    for part in np.array_split(np.arange(500), 7):
        enter = part[heaps.beaten(keys[part], scores[part], np.where(missing[part], np.iinfo(np.int64).max, ids[part]))]
        heaps.merge(keys[enter], scores[enter], np.where(missing[enter], np.iinfo(np.int64).max, ids[enter]), missing[enter])
    for key in range(4):
        rows = sorted((-s, m, i) for k, s, m, i in zip(keys, scores, missing, ids) if k == key)[:3]
        at = heaps.key == key
        got = list(zip(-heaps.score[at], heaps.missing[at], heaps.id[at]))
        assert [(s, m, None if m else i) for s, m, i in got] == [(s, m, None if m else i) for s, m, i in rows]


def test_mine(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(draw.choice([6, 6, 6, 3]))], draw.randrange(3)) for i in range(120)]
    rows += rows[30:40] + [rows[0]]  # repeated rows, one an anchor
    rows += [(None, [1.0] * 6, 1), (None, [0.5] * 6, 2), (40, [0.5, 0.5], 1)]
    rows += [(10, None, 1), (20, [1.0], None), (10, [None, 1.0], 0), (10, [float("nan")], 0), (10, [float("inf")], 0), (30, [1e30], 0),
             (50, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("units", F.lit("x"))
    own = usable(table, "vec_id", F.col("label"), F.col("embedding"))
    got = [tuple(r) for r in mine(own, F.col("id") % 10 == 0, 3, 4, block_rows=4).collect()]

    good = [(i, [int(x * 256 // 1) for x in v], l) for i, v, l in rows
            if v is not None and l is not None and all(x is not None and abs(x) < 1e20 for x in v)]
    anchors = {(i, tuple(v), l) for i, v, l in good if i is not None and i % 10 == 0}
    want = []
    for anchor, units, label in anchors:
        ranked = sorted((-sum(a * b for a, b in zip(units, v)), i is None, i or 0, l) for i, v, l in good)
        positives = [r for r in ranked if r[3] == label and (r[1] or r[2] != anchor)][:3]
        for p in positives:
            inside = [r for r in ranked if r[3] != label and -30 * p[0] <= -100 * r[0] <= -90 * p[0]][:4]
            want += [(anchor, None if p[1] else p[2], k + 1, None if r[1] else r[2], -p[0], -r[0]) for k, r in enumerate(inside)]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 50


def test_mine_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    own = usable(table, "vec_id", F.col("label"), F.col("embedding"))
    assert mine(own, F.col("id") % 10 == 0).collect() == []


# --- byte-level BPE --------------------------------------------------------------------

RANKS = public.path(queries.RANKS)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    draw = random.Random(7)
    texts = ["", " ", "a" * 3000, "ab" * 700, "日本語" * 200, "aab" * 90 + "xyzzy" * 40, "it's we'll  \n\n\t x\x1cy\x85z　 ١٢٣ ½"]
    texts += ["".join(draw.choice(a) for _ in range(n)) for a in ("ab", "etaoin", "éèü日本", "\x00\x1f '1a") for n in (5, 70, 2000)]
    points = [32, 10, 9, 0x1C, 0x85, 0xA0, 0x2003, 65, 97, 49, 0x4E00, 0x3042, 0x300, 0x1F600, 0x660, 39, 115, 0x180E, 0x200B, 0xFEFF]
    return texts + ["".join(chr(draw.choice(points)) for _ in range(50)) for _ in range(300)]


def test_encode_decode(spark, library, monkeypatch):
    texts = [*odd_texts(), None]
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("ids", F.lit(0)).withColumn("word", F.lit("x"))
    ids = byte_bpe.encode(docs, RANKS, public.PATTERN)
    rows = byte_bpe.decode(ids, RANKS).collect()
    wanted = [(k // 2 if k % 5 else None, library.encode_ordinary(t or ""), (t or "").encode()) for k, t in enumerate(texts)]
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], list(r["ids"]), bytes(r["body"]))) for r in rows)


def test_coder_forgets(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 3)
    own = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public.PATTERN)
    for texts in (["one two three four"], ["five six", "one, two"], odd_texts()[:9]):
        ids, ends = own.ids(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in texts]


def test_rounds():
    assert [(r.start, r.stop) for r in byte_bpe._rounds([3, 3, 9, 1, 1, 1], 5)] == [(0, 1), (1, 2), (2, 3), (3, 6)]
    assert list(byte_bpe._rounds([], 5)) == []


def test_unknown_id_and_null_list():
    own = byte_bpe.Coder(byte_bpe.read_ranks(RANKS), public.PATTERN)
    assert own.bodies(pa.array([None, [], [own.byte_ids[65].item()]], pa.list_(pa.int32()))) == [b"", b"", b"A"]
    with pytest.raises(ValueError):
        own.bodies(pa.array([[10**7]], pa.list_(pa.int32())))


def test_registered_bpe(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = queries.op13_byte_bpe(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
