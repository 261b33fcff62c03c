"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces all-must-pass filtering.

``measure`` counts, ``rule_votes`` turns counts into votes, ``weak.fit_kinds`` learns from
the histogram of vote patterns over all rows what each rule's vote is worth in either
direction for good text and for each kind of bad text, and a text is kept if its posterior probability of being good is at least one
half.  All of it is built-in expressions; a text never leaves its row.

Nulls and empty texts have no words, lines count for nothing and they are
rejected by the base rule.  Repeated windows are found by a 64-bit hash of
their three words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shopmill.llm import weak
from shopmill.llm.columns import total, white_words
from shopmill.sources.scratch import materialize

MIN_WORDS = 50
PRIOR = 0.8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rule_votes() -> dict[str, Column]:
    """Name of each rule and its vote: 1 good, -1 bad, 0 abstains.

    Every rule grades a measure of its own: within its lenient bound it votes for a text, beyond
    its strict bound against it, and between the two it abstains.  No rule reads another's vote,
    and none reads the length, which the base rule decides.
    """
    def per_word(name: str) -> Column:
        return _ratio(name, "n_words")

    length, lines, marks = per_word("word_chars"), _ratio("n_dup_lines", "n_lines"), _ratio("n_marks", "word_chars")
    spread = F.col("n_distinct") / F.sqrt(F.greatest("n_words", F.lit(1)))
    rules = {  # beyond the strict bound, beyond the lenient one
        "word_length": (~length.between(2.5, 11), ~length.between(3, 9)),
        "symbols": (per_word("n_symbols") > 0.1, per_word("n_symbols") > 0.05),
        "marks": (marks > 0.15, marks > 0.1),
        "repeated_lines": (lines > 0.45, lines > 0.3),
        "repeated_words": (per_word("n_repeat_words") > 0.45, per_word("n_repeat_words") > 0.35),
        "distinct_words": (spread < 1, spread < 1.5),
        "sentences": (per_word("n_enders") < 0.005, per_word("n_enders") < 0.01),
        "shouting": (per_word("n_shouts") > 0.1, per_word("n_shouts") > 0.05),
        "upper_case": (per_word("n_upper") > 2, per_word("n_upper") > 1),
        "tables": (per_word("n_bars") > 0.1, per_word("n_bars") > 0.05),
    }
    return {name: F.when(strict, -1).when(lenient, 0).otherwise(1) for name, (strict, lenient) in rules.items()}


def _left(text: Column, pattern: str) -> Column:
    """Characters of a class: the length that taking them out takes away."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and one struct column ``measures`` of counts, after all others."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(own, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(F.struct("*").alias("row"), own.alias("text"), white_words(own).alias("words"))
    step = step.select(
        "row", "text", "words", F.size("words").cast("long").alias("n_words"), lines.alias("lines"),
        F.transform(
            F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"))
    step = step.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(x["h"] == F.get("sorted", k)["h"], F.lit(False))
    step = step.withColumn("starts", F.sort_array(F.transform(
        F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.when(F.col("starts").isNull(), F.lit(0).cast("long")).otherwise(total(F.transform(
        "starts", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("starts", k + 1) - x), F.lit(3)).cast("long"))))
    return step.select("row", F.struct(
        F.col("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _left(F.col("text"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _left(F.col("text"), "[.?]+").alias("n_enders"),
        _left(F.col("text"), "!+").alias("n_shouts"),
        _left(F.col("text"), "[A-Z]+").alias("n_upper"),
        _left(F.col("text"), "[|]+").alias("n_bars"),
        _left(F.col("text"), r"[^\p{L}\p{M}\x20\x09-\x0D]+").alias("n_marks"),
    ).alias("measures")).select("row.*", "measures")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, own: list[str], text: str = "text") -> DataFrame:
    """A struct ``own`` of columns of ``docs``, then the measures, ``base_failed``, ``quality`` and ``kept``."""
    slim = docs.select(F.struct(*[F.col(f"`{n}`") for n in own]).alias("own"), F.col(f"`{text}`").alias("text"))
    measured = measure(slim).select("own", "measures.*")
    votes = rule_votes()
    voted = materialize(measured.select(
        "own", *MEASURES, F.array(*[v.cast("byte") for v in votes.values()]).alias("votes")), "measures")
    patterns = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    learnt = weak.fit_kinds(patterns, len(votes), PRIOR)
    quality = learnt.posterior_column([F.get("votes", F.lit(k)) for k in range(len(votes))])
    return (
        voted.withColumn("base_failed", base_failed()).withColumn("quality", quality)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the base rule or the posterior rejects; all columns stay."""
    return judge(docs, docs.columns, text).where("kept").select("own.*")
