"""Personal data by weak supervision.

Candidate spans come from four strict patterns (the base) and wider ones.  Labelers - checksum
or value ranges, gazetteers, words before the span, the characters around it, its shape - vote for
or against a candidate or abstain.  Expectation-maximisation estimates how reliable each labeler
is for each kind, from the histogram of vote patterns over the whole corpus.  Its posteriors are
the soft labels on which a naive Bayes classifier over features of the span is trained, again
from a histogram over all candidates; a wider candidate that the classifier accepts is added
to the base.  Base spans always stay.

Everything is built-in expressions.  Match positions are running sums of the lengths of matches
and of the text between them.  The patterns are written without nested repetition, and with
possessive runs, so very long runs of digits or letters cost time in proportion and no stack:
where a pattern forbids something within a run, those characters are masked first, one for one.

Nulls and empty texts have no spans.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from shopmill.llm import weak
from shopmill.llm.columns import let, sums_before, total
from shopmill.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 32  # characters before a span that labelers read
PRIOR = 0.5

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_NOT_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))"

#: Patterns on the masked text (see `_masked`).
STRICT = {
    "email": _NOT_LOCAL + r"[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++\.[A-Za-z0-9-]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A quick test without which a text has no match.
GATE = {
    "email": r"@|[(\[](?:at|AT)[)\]]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]|[0-9]{3}[)\x20.-]",
}
#: Gazetteers and context words (fixed values).
COMMON_ENDS = r"(?i)\.(com|org|net|edu|gov|info|biz|io|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|jp|in|br|mx)$"
CALLING_CODES = r"^\+?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
RESERVED_NETS = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
BEFORE = {
    "email": r"(?i)(mail|contact|kontakt|correo|courriel|write|schreib)",
    "ip": r"(?i)(\bip\b|address|adresse|host|server|client|from|login)",
    "card": r"(?i)(card|karte|carte|tarjeta|visa|master|credit|payment)",
    "phone": r"(?i)(tel|phone|fon|fax|call|mobil|ruf|appel|llam)",
}
AGAINST = r"(?i)(version|release|isbn|order|invoice|serial|sku|section|chapter|build|\bid\b)[^A-Za-z]*$"


def _masked(text: Column, kind: str) -> Column:
    """The text with what a run must not contain replaced, character for character."""
    if kind == "email":  # a dot that no label follows ends a domain
        return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")
    if kind == "card":  # a second separator ends a number
        return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"[\x20-](?=[\x20-])", "\x01")
    return text


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, before, after): leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(zipped: Column) -> Column:
        starts = sums_before(F.transform(zipped, lambda z: (F.length(z["gap"]) + F.length(z["m"])).cast("long")))
        return F.transform(F.arrays_zip(zipped.alias("z"), starts.alias("s")), lambda x: F.struct(
            (x["s"] + F.length(x["z"]["gap"])).alias("s"),
            (x["s"] + F.length(x["z"]["gap"]) + F.length(x["z"]["m"])).alias("e"),
            F.translate(x["z"]["m"], "\x01", ".").alias("m"),
            F.substring(x["z"]["gap"], -CONTEXT, CONTEXT).alias("before"),
            F.substring(x["z"]["next"], 1, 1).alias("after")))

    def with_gaps(gaps: Column) -> Column:
        return let(F.transform(found, lambda m, k: F.struct(
            m.alias("m"), F.get(gaps, k).alias("gap"), F.get(gaps, k + 1).alias("next"))), placed)

    return let(F.split(text, pattern, -1), with_gaps)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(digits, k, F.lit(1)).cast("int") * (
        F.when((size - k) % 2 == 1, 2).otherwise(1)))
    return total(F.transform(values, lambda v: v % 10 + F.floor(v / 10).cast("int")), "int") % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a match of a kind's strict pattern counts."""
    m = x["m"]
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def _votes(kind: str, x: Column, strict: bool) -> list[Column]:
    """Checksum or range, gazetteer, words before, characters around, shape."""
    m, digits, never = x["m"], _digits(x["m"]), F.lit(False)
    if kind == "email":
        sound, listed = _vote(m.rlike(r"\.[A-Za-z]{2,24}$"), m.rlike(r"\.[0-9-]+$")), _vote(m.rlike(COMMON_ENDS), never)
    elif kind == "ip":
        sound, listed = _vote(_valid(kind, x) | m.contains(":"), never), _vote(~m.rlike(RESERVED_NETS), m.rlike(RESERVED_NETS))
    elif kind == "card":
        passes = _luhn(digits)
        sound, listed = _vote(passes, ~passes), _vote(digits.rlike(CARD_ISSUERS), ~digits.rlike(CARD_ISSUERS))
    else:
        sound, listed = _vote(F.length(digits) >= 10, F.length(digits) < 8), _vote(m.rlike(CALLING_CODES), never)
    around = F.concat(F.substring(x["before"], -1, 1), x["after"])
    return [
        sound, listed, _vote(x["before"].rlike(BEFORE[kind]), x["before"].rlike(AGAINST)),
        _vote(~around.rlike("[A-Za-z0-9_]"), around.rlike("[A-Za-z0-9_]")),
        _vote(F.lit(strict), digits.rlike(r"^([0-9])\1{7,}$")),
    ]


def _cell(x: Column, votes: list[Column], strict: bool) -> Column:
    """Discrete features of a span, as one text."""
    return F.concat_ws(
        "|", F.lit("strict" if strict else "wide"), votes[0].cast("string"), votes[3].cast("string"),
        F.least(F.floor((x["e"] - x["s"]) / 8), F.lit(4)).cast("string"),
        F.when(x["before"] == "", "start").when(x["before"].rlike(r"[A-Za-z0-9]\x20$"), "word")
        .when(x["before"].rlike(r"[:=]\x20?$"), "field").otherwise("other"))


def candidates(docs: DataFrame, text: str, own: list[str]) -> DataFrame:
    """``own`` and, for each kind, arrays strict_<kind> and wide_<kind> of (s, e, votes, cell)."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def described(found: Column, kind: str, strict: bool) -> Column:
        def one(x: Column) -> Column:
            votes = _votes(kind, x, strict)
            return F.struct(x["s"], x["e"], F.array(*votes).alias("votes"), _cell(x, votes, strict).alias("cell"))
        return F.transform(found, one)

    row = "array<struct<s:bigint,e:bigint,votes:array<tinyint>,cell:string>>"
    columns = []
    for kind in KINDS:
        strict = F.filter(_matches(_masked(F.col("text"), kind), STRICT[kind]), partial(_valid, kind))
        gate = F.col("text").rlike(GATE[kind])
        for name, found, is_strict in (("strict", strict, True), ("wide", _matches(F.col("text"), WIDE[kind]), False)):
            columns.append(F.when(gate, described(found, kind, is_strict).cast(row)).otherwise(
                F.array().cast(row)).alias(f"{name}_{kind}"))
    step = step.select("own", *columns)
    free = lambda kind: F.filter(f"wide_{kind}", lambda w: ~F.exists(
        f"strict_{kind}", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    return step.select("own", *[f"strict_{k}" for k in KINDS], *[free(k).alias(f"wide_{k}") for k in KINDS])


def accepted_cells(histogram: list[tuple[str, tuple[int, ...], str, int]]) -> dict[str, list[str]]:
    """For each kind, the feature cells that the trained classifier takes for personal data.

    ``histogram`` has (kind, votes, cell, spans) over the whole corpus.
    """
    accepted = {}
    for kind in KINDS:
        own = sorted((votes, cell, n) for k, votes, cell, n in histogram if k == kind)
        patterns: dict[tuple[int, ...], int] = defaultdict(int)
        for votes, _, n in own:
            patterns[votes] += n
        learnt = weak.fit(list(patterns.items()), 5, PRIOR)
        mass = [1.0, 1.0]
        seen: list[dict[tuple[int, str], float]] = [defaultdict(float), defaultdict(float)]
        for votes, cell, n in own:
            p = learnt.posterior(votes)
            for side, share in enumerate((1 - p, p)):
                mass[side] += n * share
                for place, value in enumerate(cell.split("|")[1:]):
                    seen[side][place, value] += n * share
        accepted[kind] = []
        for cell in sorted({cell for _, cell, _ in own}):
            odds = math.log(mass[1] / mass[0]) + sum(
                math.log((seen[1][place, value] + 0.5) / (mass[1] + 2)) - math.log((seen[0][place, value] + 0.5) / (mass[0] + 2))
                for place, value in enumerate(cell.split("|")[1:]))
            if odds > 0:
                accepted[kind].append(cell)
    return accepted


def find_spans(docs: DataFrame, text: str = "text", own: list[str] | None = None) -> DataFrame:
    """``own`` (a struct of columns) and arrays base_<kind> and all_<kind> of (s, e) spans, in order of their starts."""
    kept = [c for c in docs.columns if c != text] if own is None else own
    found = materialize(candidates(docs, text, kept), "spans")
    def described(kind: str, side: str) -> Column:
        return F.transform(f"{side}_{kind}", lambda x: F.struct(
            F.lit(kind).alias("kind"), x["votes"].alias("votes"), x["cell"].alias("cell")))

    every = F.concat(*[described(kind, side) for kind in KINDS for side in ("strict", "wide")])
    counted = found.select(F.explode(every).alias("x")).groupBy("x.kind", "x.votes", "x.cell").agg(
        F.count(F.lit(1)).alias("n"))
    accepted = accepted_cells([(r["kind"], tuple(r["votes"]), r["cell"], r["n"]) for r in counted.collect()])

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def taken(kind: str) -> Column:
        cells = accepted[kind] or [""]
        return F.filter(f"wide_{kind}", lambda x: x["cell"].isin(*cells))

    columns = []
    for kind in KINDS:
        columns.append(plain(F.col(f"strict_{kind}")).alias(f"base_{kind}"))
        columns.append(F.sort_array(F.concat(plain(F.col(f"strict_{kind}")), plain(taken(kind)))).alias(f"all_{kind}"))
    return found.select("own", *columns)


def listed(side: str) -> Column:
    """kind:start:end of the spans of one side, comma-joined."""
    def written(kind: str) -> Column:
        return F.transform(f"{side}_{kind}", lambda x: F.concat_ws(
            ":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(F.concat(*map(written, KINDS)), ",")
