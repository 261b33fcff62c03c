"""Conversation prefix trie by truncation peeling.

A conversation is a chain of digests: the digest of its first d turns stands for the node at
depth d.  Peeling starts at the greatest depth.  A level's rows are the conversations that end there
and the nodes that are left of the level below, stripped of their last turn; rows of equal digest
are grouped into one node, which adds up what its children brought: members, leaves, saved
tokens.  So every node is found and finished in one pass from the leaves to the root, and no list of all
prefixes is ever grouped.

One level is one job with map-side combining (a first turn or a conversation that very many rows share
is added up before it is shuffled), and its rows are written, so a lost executor costs one level.
Conversations that are much deeper than the rest would cost a job for each of their
turns.  Where those longer than some depth have at most ``TAIL`` turns together, the subtrees
below that depth are peeled by the same rule inside tasks, one subtree in a task; the bound is on rows of any one task.

``ends_sha256`` needs the ids of a node's conversations in one text, in order.  Ids are joined in parallel in runs of
2**``RUN_BITS`` consecutive numbers; one task then reads a node's runs in order and feeds them to the
hash, holding one run at a time.

Null ids belong to no conversation.  Null roles and texts are empty.  Turns come in the order of their number
(null first), ties by role and text, so equal rows are equal turns.  A table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shopmill.sources.scratch import materialize

TAIL = 50_000  # turns of the conversations that tasks peel in whole subtrees
RUN_BITS = 16  # ids in a run: 2 to this power
DIGEST = 16  # bytes
ROOT = bytes(DIGEST)

STATE = "chain array<binary>, sizes array<long>, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"
NODE = "digest binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 0, role, text) of all turns of conversations with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text).select(
        "conv_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def rebuilt(turns: DataFrame, base: Column, heads: Column) -> DataFrame:
    """(conv_id, place, role, text) of every conversation with its first turns replaced.

    The first ``heads`` turns of conversation ``base`` (columns of conv_id) come first, then the conversation's own
    turns after its first ``heads``.  Conversations that are left without turns have one row with a null place.
    """
    plan = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), heads.alias("heads"))
    own = turns.select("conv_id", "place", "role", "text").join(plan.select("conv_id", "heads"), "conv_id")
    most = plan.agg(F.max("heads").alias("most"))
    first = turns.join(F.broadcast(most), F.col("place") < F.col("most")).select(
        F.col("conv_id").alias("base"), "place", "role", "text")
    lent = plan.join(first, "base").where("place < heads")
    parts = own.where("place >= heads").select("conv_id", F.lit(1).alias("part"), "place", "role", "text").unionAll(
        lent.select("conv_id", F.lit(0).alias("part"), "place", "role", "text")).unionAll(
        plan.select("conv_id", F.lit(2).alias("part"), F.lit(None).cast("int").alias("place"), F.lit("").alias("role"), F.lit("").alias("text")))
    return parts


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, place, role, text) in order -> one row (conv_id, chain, sizes) for each conversation."""
    conv, chain, sizes, out = None, [], [], []

    def batch() -> pa.RecordBatch:
        ids, chains, lengths = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(chains, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int64()))],
            ["conv_id", "chain", "sizes"])

    for part in batches:
        for own, place, role, text in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if own != conv:
                if conv is not None:
                    out.append((conv, chain, sizes))
                conv, chain, sizes = own, [], []
            if place is not None:
                speaker = role.encode("utf-8", "surrogatepass")
                turn = hashlib.blake2b(chain[-1] if chain else ROOT, digest_size=DIGEST)
                turn.update(len(speaker).to_bytes(8, "little") + speaker + text.encode("utf-8", "surrogatepass"))
                chain.append(turn.digest())
                sizes.append(len(text))
        if len(out) > 1000:
            yield batch()
            out = []
    if conv is not None:
        out.append((conv, chain, sizes))
    if out:
        yield batch()


def chains(parts: DataFrame) -> DataFrame:
    """(conv_id, chain, sizes): digests of all prefixes and code points of all texts; turns are streamed."""
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return dealt.mapInArrow(_chained, "conv_id long, chain array<binary>, sizes array<long>")


def _leaves(conversations: DataFrame) -> DataFrame:
    """Rows of the state for conversations that end, equal ones as one, however many they are."""
    none = F.lit(0).cast("long")
    return conversations.groupBy(F.coalesce(F.try_element_at("chain", F.lit(-1)), F.lit(ROOT)).alias("digest")).agg(
        F.first("chain").alias("chain"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    ).select("chain", "sizes", "n_convs", "conv_id", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))


def _grouped(rows: DataFrame, depth: int) -> DataFrame:
    """Rows that end at ``depth`` as nodes of that depth, still with their chains.

    The key is the last digest; the rest of the chain follows from it, so any row's will do.
    """
    key = F.element_at("chain", -1) if depth else F.lit(ROOT)
    size = F.element_at(F.first("sizes"), -1) if depth else F.lit(0)
    return rows.groupBy(key.alias("digest")).agg(
        F.first("chain").alias("chain"), F.first("sizes").alias("sizes"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        (F.sum("saved_tokens") + (F.sum("n_convs") - 1) * size).alias("saved_tokens"))


def _stripped(nodes: DataFrame) -> DataFrame:
    """What a level's nodes bring to the level above: their last turn goes, each is one child."""
    def cut(c: str) -> Column:
        return F.slice(c, 1, F.size(c) - 1).alias(c)

    return nodes.select(cut("chain"), cut("sizes"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"),
                        "n_leaves", "saved_tokens")


def _finished(nodes: DataFrame, depth: int) -> DataFrame:
    parent = F.lit(None).cast("binary") if depth == 0 else F.lit(ROOT) if depth == 1 else F.element_at("chain", -2)
    return nodes.select("digest", parent.alias("parent"), F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children",
                        "n_leaves", "saved_tokens")


def _peel_subtree(floor: int):
    """Peel rows (subtree, chain, sizes, n_convs, conv_id, ...) of whole subtrees down to depth ``floor``."""
    def run(rows: list) -> list:
        at: dict[int, dict[bytes, list]] = {}

        def put(chain, sizes, n, conv, children, leaves, saved):
            node = at.setdefault(len(chain), {}).setdefault(chain[-1], [chain, sizes, 0, conv, 0, 0, 0])
            node[2:] = node[2] + n, min(node[3], conv), node[4] + children, node[5] + leaves, node[6] + saved

        for row in rows:
            put(*row)
        out = []
        for depth in range(max(at), floor - 1, -1):
            for digest, (chain, sizes, n, conv, children, leaves, saved) in at.pop(depth, {}).items():
                leaves, saved = max(leaves, 1), saved + (n - 1) * sizes[-1]
                out.append((digest, chain[-2] if depth > 1 else ROOT, depth, conv, n, children, leaves, saved,
                            (chain[:-1], sizes[:-1], n, conv, 1, leaves, saved) if depth == floor else None))
                if depth > floor:
                    put(chain[:-1], sizes[:-1], n, conv, 1, leaves, saved)
        return out

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODE.split(", ")]
        state = pa.struct([("chain", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("n_convs", pa.int64()),
                           ("conv_id", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
        kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, state]

        def solved(rows: list) -> pa.RecordBatch:
            columns = list(zip(*run(rows)))
            columns[-1] = [None if x is None else dict(zip([f.name for f in state], x)) for x in columns[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "up"])

        key, rows = None, []
        for part in parts:
            for own, *row in zip(*(c.to_pylist() for c in part.columns)):
                if own != key and rows:
                    yield solved(rows)
                    rows = []
                key = own
                rows.append(row)
        if rows:
            yield solved(rows)

    return batches


def peel(conversations: DataFrame, tail: int = TAIL) -> DataFrame:
    """(digest, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens) of all nodes.

    ``conversations`` are (conv_id, chain, sizes), one row for each.
    """
    ended = materialize(_leaves(conversations), "ended")
    lengths = {row["depth"]: row["n"] for row in ended.groupBy(F.size("chain").alias("depth")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return conversations.sparkSession.createDataFrame([], NODE)
    top, turns = max(lengths), 0
    while top > 0 and turns + top * lengths.get(top, 0) <= tail:
        turns += top * lengths.get(top, 0)
        top -= 1
    out, above = [], None  # `above` holds what the level below brings
    if top < max(lengths):
        floor = top + 1
        deep = ended.where(F.size("chain") > top).withColumn("subtree", F.element_at("chain", floor))
        peeled = materialize(
            deep.repartition("subtree").sortWithinPartitions("subtree")
            .select("subtree", "chain", "sizes", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")
            .mapInArrow(_peel_subtree(floor), f"{NODE}, up struct<{STATE.replace(' ', ':').replace(',:', ',')}>"), "subtrees")
        out.append(peeled.drop("up"))
        above = peeled.where("up IS NOT NULL").select("up.*")
    for depth in range(top, -1, -1):
        rows = ended.where(F.size("chain") == depth)
        nodes = materialize(_grouped(rows if above is None else rows.unionAll(above), depth), f"level-{depth}")
        out.append(_finished(nodes, depth))
        above = _stripped(nodes)
    result = out[0]
    for level in out[1:]:
        result = result.unionAll(level)
    return result


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, run, ids text) in order -> (digest, hash of all texts joined by commas)."""
    key, state = None, None
    for part in batches:
        digests, hashes = [], []
        for own, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
            if own == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                digests.append(key)
                hashes.append(state.hexdigest())
            key, state = own, hashlib.sha256(text.encode())
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(hashes)], ["digest", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])


def end_hashes(conversations: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes where conversations end."""
    digest = F.when(F.size("chain") > 0, F.element_at("chain", -1)).otherwise(F.lit(ROOT))
    runs = (
        conversations.select(digest.alias("digest"), F.shiftright("conv_id", RUN_BITS).alias("run"), "conv_id")
        .groupBy("digest", "run").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    )
    return runs.repartition("digest").sortWithinPartitions("digest", "run").mapInArrow(
        _hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, tail: int = TAIL) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and ``digest`` of the prefix.  ``conversations`` are (conv_id, chain, sizes)."""
    conversations = materialize(conversations, "chains")
    nodes = materialize(peel(conversations, tail), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, "parent", "left").join(end_hashes(conversations), "digest", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    )
