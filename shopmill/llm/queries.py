"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopmill.llm.byte_bpe import decode, encode
from shopmill.llm.decontaminate import find_leaks
from shopmill.llm.hard_negatives import mine, usable
from shopmill.llm.licenses import scan
from shopmill.llm.mixing import mix
from shopmill.llm.pii import KINDS, find_spans, listed
from shopmill.llm.prefix_trie import chains, ordered_turns, rebuilt, trie
from shopmill.llm.quality import judge
from shopmill.llm.sharding import shard
from shopmill.llm.simhash import simhash_groups
from shopmill.llm.suffixes import remove_repeats
from shopmill.llm.tokens import token_file
from shopmill.llm.unit_dedup import repeated_units

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"), width=3).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_units(_table(spark, folder, "documents"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan(_table(spark, folder, "documents"), own=["doc_id"]).select("own.doc_id", *[
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_spans(_table(spark, folder, "documents"), own=["doc_id"]).select(
        "own.doc_id", *[F.size(f"base_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(_table(spark, folder, "documents"), ["doc_id"]).select(
        "own.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")


def op7_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return token_file(_table(spark, folder, "documents"), tokenizer_path())


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_table(spark, folder, "documents"), own=["doc_id"]).select(
        "own.doc_id", "size", "source_size", "target", "taken")


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shard(_table(spark, folder, "documents"), own=["doc_id"]).select(
        "own.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = F.col("conv_id")
    turns = rebuilt(ordered_turns(_table(spark, folder, "conversations")), base=own - own % 100,
                    heads=F.crc32(own.cast("string")) % 6)
    return trie(chains(turns)).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = usable(_table(spark, folder, "embeddings"), "vec_id", label, F.col("embedding"))
    return mine(rows, F.col("id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    ids = encode(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("body", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_licenses": op4_licenses,
    "op5_personal_data": op5_personal_data,
    "op6_quality": op6_quality,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_token_file": op8_token_file,
    "op9_mix": op9_mix,
    "op10_shards": op10_shards,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}

OP3_SQL = r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(text,
        '(?s).*?(?:[.!?]+[\x20\x09-\x0D]+|[\x{3002}\x{FF01}\x{FF1F}]+[\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*\n|\z)') AS pieces
    FROM documents WHERE text IS NOT NULL
), listed AS (
    SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS k FROM cut
), placed AS (
    SELECT *, coalesce(sum(length(piece)) OVER (
        PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM listed
), worded AS (
    SELECT doc_id, k, off + length(piece) - length(regexp_replace(piece, '^[\x20\x09-\x0D]+', '')) AS start,
           off + length(regexp_replace(piece, '[\x20\x09-\x0D]+$', '')) AS "end",
           regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM placed
), sentences AS (
    SELECT doc_id, row_number() OVER w - 1 AS unit, start, "end", len(words) AS n, array_to_string(words, ' ') AS body,
           sum(len(words)) OVER w AS upto, sum(len(words)) OVER (PARTITION BY doc_id) AS total
    FROM worded WHERE len(words) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), starts AS (
    SELECT doc_id, unit, start, upto - n AS before, LEAST(upto - n + 30, total) AS goal, total FROM sentences
    WHERE total - (upto - n) >= 30
    UNION  -- the run that ends the text
    SELECT doc_id, max_by(unit, unit), max_by(start, unit), max_by(upto - n, unit), any_value(total), any_value(total)
    FROM sentences WHERE total - (upto - n) >= LEAST(30, total) GROUP BY doc_id
), spans AS (
    SELECT a.doc_id, a.unit, a.start, max(b."end") AS "end", CAST(sum(b.n) AS BIGINT) AS n_words,
           md5(string_agg(b.body, ' ' ORDER BY b.unit)) AS digest
    FROM starts a JOIN sentences b ON b.doc_id = a.doc_id AND b.unit >= a.unit AND b.upto - b.n < a.goal
    GROUP BY a.doc_id, a.unit, a.start, a.goal
), units AS (
    SELECT DISTINCT * FROM spans
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit) OVER w AS kept_unit
    FROM units WINDOW w AS (PARTITION BY digest ORDER BY doc_id, unit)
)
SELECT doc_id, unit, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", n_words, kept_doc_id, kept_unit, digest
FROM ranked WHERE doc_id <> kept_doc_id OR unit <> kept_unit
"""

OP9_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           (CAST('0x' || substr(md5('42|' || doc_id || '|' || COALESCE(text, '')), 1, 13) AS BIGINT) + 0.5)
               / 4503599627370496.0 AS u
    FROM documents
), sources AS (
    SELECT source, SUM(size) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
    FROM sized GROUP BY source
), levels AS (
    SELECT *, source_size / weight AS fills,
           (1.5 * SUM(source_size) OVER () - 2.0 * COALESCE(SUM(source_size) OVER (
               ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / SUM(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM sources
), targets AS (
    SELECT source, source_size, LEAST(2.0 * source_size, COALESCE((
        SELECT arg_min(level, fills) FROM levels WHERE level * weight <= 2.0 * source_size) * weight,
        2.0 * source_size)) AS target
    FROM levels
), shares AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS wanted FROM targets
), ranked AS (
    SELECT doc_id, size, source_size, target, floor(wanted) AS sure, s.source,
           target - floor(wanted) * source_size AS rest, wanted > floor(wanted) AS drawn,
           u / (1 - u) / ((wanted - floor(wanted)) / (1 - (wanted - floor(wanted)))) AS rank
    FROM sized s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source
), along AS (
    SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY rank, CAST(doc_id AS VARCHAR), size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (sure + CASE WHEN drawn AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM along
"""

OP11_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), heads AS (  -- CRC-32 of the decimal id: for each byte, one exclusive or and eight shifts
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END),
        4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
    SELECT h.conv_id, 0 AS part, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.h
    UNION ALL
    SELECT h.conv_id, 1, t.place, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.h
), whole AS (
    SELECT h.conv_id, coalesce(list(md5(len(role) || '|' || role || text) ORDER BY part, place) FILTER (part IS NOT NULL), []) AS turns,
           coalesce(list(len(text) ORDER BY part, place) FILTER (part IS NOT NULL), []) AS sizes
    FROM heads h LEFT JOIN parts p USING (conv_id) GROUP BY h.conv_id
), prefixes AS (
    SELECT conv_id, depth, md5(array_to_string(turns[:depth], ',')) AS node, len(turns) = depth AS ends,
           CASE WHEN depth > 0 THEN md5(array_to_string(turns[:depth - 1], ',')) END AS parent,
           CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size
    FROM whole, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS depth)
), nodes AS (
    SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * any_value(size) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth
), children AS (
    SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY ALL
), below AS (  -- every node with every node of its subtree, by way of the smallest member below
    SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth
    FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
    SELECT top AS node, top_depth AS depth, sum(n.saved) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
    FROM below b JOIN nodes n ON n.node = b.node AND n.depth = b.depth
    LEFT JOIN children c ON c.node = b.node AND c.depth = b.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
LEFT JOIN nodes p ON p.node = n.parent AND p.depth = n.depth - 1
"""

OP12_SQL = """
WITH rows AS (
    SELECT vec_id AS id,
           CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS units
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(
        list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE
), scored AS (
    SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, a.id = b.id AS own,
           CAST(coalesce(list_sum(list_transform(list_zip(a.units, b.units), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM rows a, rows b WHERE a.id % 100 = 0
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same AND NOT own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op9_mix": OP9_SQL, "op11_prefix_trie": OP11_SQL,
                       "op12_hard_negatives": OP12_SQL}
