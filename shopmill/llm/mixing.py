"""Mixing sources to target weights by Pareto order sampling.

``source_targets`` shares a budget of words among the sources by weight, with
a cap for each.  A source whose target is r times its size takes every document
floor(r) times, which is certain, and one copy more of some.  Those are drawn
by Pareto order: a document's rank is the odds of its random number divided by
the odds of its inclusion, and the smallest ranks are taken until the words left
over are filled, so the sample has a fixed size in words, to within half of the
document at the boundary.

Random numbers are the MD5 of seed, id and text, so reruns agree and rows of one
id but different texts differ.  The boundary is found by sums over 65,536 bins of
the rank in each source; only the boundary's bin is ordered row by row, so a
source that holds a third of all rows is not sorted in one task.

Nulls: a null text has size zero, a null source is a source of its own and the
last one, a null id is drawn by its text.  Empty sources have the target zero.
Rows of one id and text have equal ranks; they are numbered, so that the mix can take a part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopmill.llm.columns import white_words
from shopmill.sources.scratch import materialize

BINS = 65536
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP = 1.5, 2.0


def _random(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources are ordered by code point, null last, and weighted by ``weights`` in turn.
    A target stops at ``cap`` times the source's size; what it leaves goes to the
    others by weight.  Windows here run over one row for each source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    # Sources fill up in the order of cap / weight; `before` is what the full ones take.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        (budget * F.sum("source_size").over(everything)
         - cap * F.coalesce(F.sum("source_size").over(full), F.lit(0)))
        / F.sum("weight").over(rest)
    )
    filled = each.withColumn("level", level).withColumn(
        "open", level * F.col("weight") <= cap * F.col("source_size"))
    # The first source that is not filled sets the level for all after it.
    chosen = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)
    return filled.select(
        "source", "source_size",
        F.least(cap * F.col("source_size"), F.coalesce(
            chosen["level"] * F.col("weight"), cap * F.col("source_size"))).alias("target"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", own: list[str] | None = None,
        seed: int = 42, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """A struct ``own`` of columns of ``docs`` and size, source_size, target, copies, taken of every row."""
    kept = docs.columns if own is None else own
    body = F.col(f"`{text}`").cast("string")
    ranked = materialize(docs.select(
        F.struct(*[F.col(f"`{n}`") for n in kept]).alias("own"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.size(white_words(body)).cast("long").alias("size"),
        F.col(f"`{id}`").cast("string").alias("id"),
        _random(seed, F.col(f"`{id}`"), body).alias("random"),
        F.monotonically_increasing_id().alias("row"),
    ), "mix")
    targets = materialize(source_targets(ranked.select("source", "size"), weights, budget, cap), "targets").select(
        F.col("source").alias("of"), "source_size", "target")

    # All documents of a source are wanted equally often, so its inclusion odds are one number.
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sure = F.floor(wanted)
    share = wanted - sure
    rank = (F.col("random") / (1 - F.col("random"))) / (share / (1 - share))
    plan = ranked.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "own", "id", "row", "source", "size", "source_size", "target", sure.cast("long").alias("sure"),
        (F.col("target") - sure * F.col("source_size")).alias("left"),
        F.when(share > 0, rank).alias("rank"))
    # rank / (1 + rank) runs from 0 to 1 and keeps the order.
    plan = plan.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)))

    bins = plan.where("rank IS NOT NULL AND size > 0").groupBy("source", "bin").agg(
        F.sum("size").alias("words"), F.first("left").alias("left"))
    along = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = bins.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))).where(
        (F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
    edge = materialize(edge.select(
        F.col("source").alias("of"), F.col("bin").alias("edge"), F.col("before")), "edge")

    # Rows of the boundary's bin: taken while the sum is nearer to the target with the row than without it.
    at_edge = plan.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("edge"))).where("size > 0")
    inside = Window.partitionBy("source").orderBy("rank", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = at_edge.select("source", "rank", "id", "size", "row", "left", start.alias("start")).where(
        F.col("start") + F.col("size") / 2 <= F.col("left"))
    last = materialize(last.groupBy(F.col("source").alias("of")).agg(
        F.max(F.struct("rank", "id", "size", "row")).alias("last")), "last")

    bounds = edge.join(
        last.withColumnRenamed("of", "of_last"), F.col("of").eqNullSafe(F.col("of_last")), "left").select(
            "of", "edge", "last")
    here = F.struct("rank", "id", "size", "row")
    more = F.when(F.col("rank").isNull(), F.lit(0)).when(
        F.col("edge").isNull(), F.when(F.col("left") > 0, 1).otherwise(0)).when(
        F.col("bin") < F.col("edge"), 1).when(
        (F.col("bin") == F.col("edge")) & F.coalesce(here <= F.col("last"), F.lit(False)), 1).otherwise(0)
    copies = F.col("sure") + more
    return plan.join(bounds, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "own", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents it does not take go."""
    return mix(docs, id, text, source, **options).where("copies > 0").select(
        "own", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("own.*")
