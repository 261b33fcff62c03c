"""Repeated bytes, token files, shards and the pipeline against brute force and on odd input."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from shopmill.llm import sharding as H, suffixes as X, tokens as T
from shopmill.llm.queries import QUERIES, tokenizer_path

ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "one two three " * 10, "b"), (5, "Tie tie " * 9, "b"),
       (5, "Tie tie " * 9, "b"), (5, "Tie other " * 9, "b"), (6, "x" * 30_000 + " lang" * 3_000, "c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(*row, 1, "clash", "clash") for row in ODD],
        "doc_id long, text string, source string, digest int, n string, start string")


# -- repeated bytes -----------------------------------------------------------------------

def removed_by_hand(rows, length):
    """(n_bytes, n_removed, n_spans, kept) by id; ids are distinct."""
    bodies = {i: (t or "").encode() for i, t in rows}
    first, out = {}, {}
    for i in sorted(bodies):
        for k in range(len(bodies[i]) - length + 1):
            first.setdefault(bodies[i][k:k + length], i)
    for i, body in bodies.items():
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if first[body[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g))
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    pool = ["".join(rng.choices("abcdé \x00", k=rng.randrange(30, 160))) for _ in range(12)] + ["ab" * 150, "z" * 120, "ä" * 70]
    rows = [(k * 3, "".join(rng.choices(pool, k=rng.randrange(5))) + str(rng.random())) for k in range(60)]
    rows += [(500 + k, rows[k][1]) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = removed_by_hand(rows, X.LENGTH)

    def found():
        return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                for r in X.remove_repeats(docs).collect()}
    assert found() == expected
    assert sum(e[1] for e in expected.values()) > 1000
    monkeypatch.setattr(X, "HOT", 3)  # windows of frequent hashes go by their own hash
    monkeypatch.setattr(X, "GROUP_BYTES", 500)
    assert found() == expected


def test_no_group_holds_the_rows_of_a_hot_window(spark, monkeypatch):
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh", k=90))
    texts = ["".join(rng.choices("ijklmnop", k=40)) + passage + "".join(rng.choices("qrstuvwx", k=40)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    solve, most = X._repeats_of_groups, 8

    def watched(length):
        run = solve(length)

        def rows_of(batches):
            seen = {}
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    seen[key] = seen.get(key, 0) + 1
                    assert seen[key] <= most, "a hash above HOT reached one group"
                yield from run(iter([batch]))
        return rows_of

    monkeypatch.setattr(X, "HOT", most)
    monkeypatch.setattr(X, "_repeats_of_groups", watched)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in X.remove_repeats(docs).collect()}
    for k, text in enumerate(texts):
        places = [at for at in range(len(text) - 49) if any(text[at:at + 50] in other for other in texts[:k])]
        assert got[k] == ([(places[0], places[-1] + 50)] if places else [])
    assert all(got[k] for k in range(1, 40))


def test_merged_transforms_sort_suffixes():
    rng = random.Random(1)
    for shards in (1, 2, 3):
        strings = [bytes(rng.choices(b"ab\x00", k=rng.randrange(5, 20))) for _ in range(9)]
        cuts = np.linspace(0, 9, shards + 1).astype(int)
        block, string, offset = X.merged_intervals([strings[a:b] for a, b in zip(cuts, cuts[1:])], 4)
        at = [strings[s][o:o + 4] for s, o in zip(string, offset) if len(strings[s]) - o >= 4]
        assert at == sorted(at) and len(block) == sum(len(s) + 1 for s in strings)
        seen = {}
        for b, s, o in zip(block, string, offset):
            if len(strings[s]) - o >= 4:
                assert seen.setdefault(strings[s][o:o + 4], b) == b
        assert len(set(seen.values())) == len(seen)


def test_transform_of_one_shard():
    strings = [b"banana", b"ana", b"banana"]
    transform, string, offset = X.shard_transform(strings)
    suffixes = [(strings[s][o:], s) for s, o in zip(string, offset)]
    assert suffixes == sorted(suffixes)
    assert [int(t) - 1 for t in transform] == [strings[s][o - 1] if o else -1 for s, o in zip(string, offset)]


def test_repeats_of_odd_rows(spark, odd):
    got = X.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    assert {r["n_removed"] for r in got} == {0}
    copy = odd.unionAll(odd.where("doc_id IN (5, 6)").withColumn("doc_id", F.lit(None).cast("long")))
    late = [r for r in X.remove_repeats(copy).collect() if r["doc_id"] is None and r["n_bytes"] != 140]
    assert [(r["n_removed"], r["n_spans"]) for r in late] == [(r["n_bytes"], 1) for r in late] and len(late) == 4
    assert X.remove_repeats(odd.limit(0)).count() == 0


# -- token files --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(tokenizer_path())


TEXTS = ["Don't we'LL <b>£50²</b> ½ x_y - “quoted”  naïve ÀÉÎ\x85\x1c\x00\x7f tab\tZ", "İstanbul ΣΑΣ ſ ŉ", "日本語 text", "",
         "<|endoftext|> hi <|", "é é", "a b", "'sos 'T 'RE", "1234 ٣ x²", "\n\n", "plain words"]


def test_ids_are_those_of_the_library(encoder):
    rng = random.Random(2)
    chars = [chr(c) for c in range(0x0, 0x250)] + list("ΣİKſ日😀́ ") + [" "] * 60
    texts = TEXTS + ["".join(rng.choices(chars, k=60)) for _ in range(400)]
    assert encoder.by_word
    for text in texts:
        ids = encoder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == ids, text
    other = T.Encoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_word
    assert np.frombuffer(other.ids("a b"), other.kind).tolist() == other.library.encode("a b").ids


def test_token_file_round_trip(spark, encoder, tmp_path):
    rows = [(97 - 5 * k, t) for k, t in enumerate(TEXTS * 3)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = str(tmp_path / "tokens")
    manifest = T.write_shards(docs, folder, tokenizer_path(), shard_bytes=200).cache()
    got = {r["id"]: r for r in T.read_shards(manifest, folder).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = [*encoder.library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids
        start += len(ids)
    assert manifest.count() > 1
    files = {p.name: p.read_bytes() for p in (tmp_path / "tokens").iterdir()}
    for row in manifest.collect():
        data = files[row["path"]]
        reader = T.ShardReader(io.BytesIO(data), len(data))
        assert len(reader) == row["documents"]
        # Each frame is a whole one of its own for any zstandard reader.
        frame = data[reader.starts[1 % len(reader)]:reader.starts[1 % len(reader)] + reader.sizes[1 % len(reader), 0]]
        assert zstandard.ZstdDecompressor().decompress(frame) == reader.document(1 % len(reader)).tobytes()


def test_damage_is_noticed():
    pack = zstandard.ZstdCompressor(write_checksum=True)
    content = np.arange(500, dtype="<u2").tobytes()
    frame = pack.compress(content)
    import xxhash
    good = frame + T.shard_tail([7], [500], [(len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)], 2)
    assert T.ShardReader(io.BytesIO(good), len(good)).document(0).tolist() == list(range(500))
    bad = frame + T.shard_tail([7], [500], [(len(frame), len(content), 1)], 2)
    with pytest.raises(ValueError):
        T.ShardReader(io.BytesIO(bad), len(bad)).document(0)
    with pytest.raises(ValueError):
        T.ShardReader(io.BytesIO(good[:-1]), len(good) - 1)


def test_token_file_of_odd_rows(spark, odd):
    got = sorted(T.token_file(odd, tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 5, 5, 5, 6]
    assert [r["n_tokens"] for r in got][1:4] == [1, 1, 1]
    assert T.token_file(odd.limit(0), tokenizer_path()).count() == 0


# -- shards -------------------------------------------------------------------------------

def smallest_capacity(sizes, shards):
    def fits(limit):
        used, filled = 1, 0
        for size in sizes:
            if size > limit:
                return False
            if filled + size > limit:
                used, filled = used + 1, 0
            filled += size
        return used <= shards
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed,bins", [(0, 4096), (1, 8), (2, 3)])
def test_shards(spark, seed, bins, monkeypatch):
    monkeypatch.setattr(H, "BINS", bins)
    monkeypatch.setattr(H, "FINE_BINS", max(2, bins // 4))
    rng = random.Random(seed)
    texts = ["".join(rng.choices("äb", k=rng.randrange(60))) for _ in range(150)] + ["hot" * 20] * (80 if seed == 1 else 0)
    rows = [(k, rng.choice(texts[:100]) if k % 3 else rng.choice(texts)) for k in range(400)]
    rows += [(400 + k, t) for k, t in enumerate(texts[150:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in H.shard(docs, 24).select("own.doc_id", "size", "text_crc32", "shard", "slot").collect()}
    groups, where, filled, slots = {}, {}, {}, {}
    for i, text in rows:
        r, size = got[i], len(text.encode()) + 8
        assert (r["size"], r["text_crc32"]) == (size, zlib.crc32(text.encode()))
        groups[text] = groups.get(text, 0) + size
        assert where.setdefault(text, r["shard"]) == r["shard"]
        filled[r["shard"]] = filled.get(r["shard"], 0) + size
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(filled.values()) <= smallest_capacity(list(groups.values()), 24) and set(filled) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [where[t] for t in groups]
    assert order == sorted(order)


def test_room_beside_a_large_group_is_shared(spark):
    rows = [(k, "hot" * 100 if k % 3 == 0 else f"text {k:05d}") for k in range(600)]
    got = H.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).groupBy("shard").agg(F.sum("size")).collect()
    sizes = sorted(r[1] for r in got)
    assert len(sizes) >= 22 and sizes[-1] == 200 * 308 and sizes[-2] <= 2 * sizes[1]


def test_shards_of_odd_rows(spark, odd):
    got = H.shard(odd).collect()
    assert len(got) == len(ODD) and sorted(r["size"] for r in got)[:2] == [8, 8]
    assert len({r["shard"] for r in got if r["own"]["doc_id"] in (1, 2)}) == 1
    assert H.shard(odd.limit(0)).count() == 0


# -- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, sample, encoder):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sample)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, quality, near, clean, mixed = seen
    assert all(len(t.split()) >= 50 for t in quality.values()) and len(quality) > len(start) / 2
    assert len(set(near.values())) == len(near) and set(near) < set(quality)
    assert set(near) - set(clean) == {i for i, t in near.items() if any(b in t for b in bench)}
    assert set(mixed) <= set(clean) and len(mixed) > len(clean) / 2
    final = corpus_pipeline.STAGES[4][1](spark, docs, sample).collect()
    assert len(final) == docs.count()
    for r in final:
        ids = [*encoder.library.encode(mixed[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pipeline_stages_on_odd_rows(spark, sample):
    columns = spark.read.parquet(f"{sample}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x " * 30_000, "en", None, 1),
            (3, "some words. " * 5, None, "b", 2), (3, "some words. " * 5, None, "b", 2)]
    for docs in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sample).count() <= 2 * len(rows), name


def test_registered_queries_return_their_columns(spark, sample):
    columns = {
        "op1_simhash": "doc_id fingerprint component_id",
        "op4_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op5_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op6_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7_repeated_bytes": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op8_token_file": "doc_id start n_tokens ids_crc32",
        "op9_mix": "doc_id size source_size target taken",
        "op10_shards": "doc_id size text_crc32 law shard slot grown_shard",
    }
    total = spark.read.parquet(f"{sample}/documents.parquet").count()
    for name, expected in columns.items():
        result = QUERIES[name](spark, sample)
        assert result.columns[:len(expected.split())] == expected.split(), name
        assert result.count() == total, name


def test_repeats_of_the_sample(spark, sample):
    rows = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    expected = removed_by_hand(rows, 50)
    for r in QUERIES["op7_repeated_bytes"](spark, sample).collect():
        n, gone, spans, kept = expected[r["doc_id"]]
        assert tuple(r)[1:] == (n, gone, spans, hashlib.sha256(kept).hexdigest())
