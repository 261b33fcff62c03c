"""Column expressions with the null, rounding and tie rules of the data model.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen.  Two rounding families are kept apart on purpose: the cleaning and
model stages round half to even, the marts round half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space at either end of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The spellings that mean "missing" in a raw text file.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------

def missing_to_null(c: Column | str) -> Column:
    """Raw text marker of a missing value -> NULL."""
    c = col(c)
    return F.when(~c.isin(*MISSING_MARKERS), c)


def _visible_ends(c: Column) -> Column:
    """True when the first and last character are visible ASCII: nothing to strip.

    Two cheap comparisons that spare almost every value the character search.
    """
    last = F.right(c, F.lit(1))
    return (c >= F.lit("!")) & (c < F.lit("\x7f")) & (last >= F.lit("!")) & (last < F.lit("\x7f"))


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends; NULL stays NULL."""
    c = col(c)
    return F.when(_visible_ends(c), c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def strip_to_null(c: Column | str) -> Column:
    """Strip, and treat a text that was only white space as missing."""
    c = col(c)
    return F.when(_visible_ends(c), c).otherwise(F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit("")))


# --- typing: what cannot be parsed becomes NULL, never an error ---------------

def to_time(c: Column | str) -> Column:
    return col(c).try_cast("timestamp_ntz")


def to_number(c: Column | str) -> Column:
    """Finite double or NULL (NaN and infinities are unusable in sums)."""
    x = col(c).try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_whole(c: Column | str) -> Column:
    """Whole number; a text such as '3.0' is accepted, fractions round half to even."""
    c = col(c)
    return F.coalesce(c.try_cast("bigint"), F.rint(to_number(c)).try_cast("bigint"))


# --- rounding -----------------------------------------------------------------

def round_half_even(c: Column | str, digits: int) -> Column:
    scale = F.lit(float(10 ** digits))
    return F.rint(col(c) * scale) / scale


def round_half_away(c: Column | str, digits: int) -> Column:
    c, scale = col(c), F.lit(float(10 ** digits))
    return F.signum(c) * F.floor(F.abs(c) * scale + F.lit(0.5)) / scale


# --- ratios and shares ---------------------------------------------------------

def ratio(numerator: Column | str, denominator: Column | str, digits: int) -> Column:
    """Rounded quotient, NULL unless the denominator is strictly positive."""
    n, d = col(numerator), col(denominator)
    return F.when(d > 0, round_half_even(n / d, digits))


def safe_percentage(part: Column | str, total: Column | str) -> Column:
    """Share in percent, two digits; 0.0 when there is nothing to compare with."""
    p, t = col(part), col(total)
    return F.when(t == 0, F.lit(0.0)).otherwise(
        round_half_even(p.cast("double") / F.nullif(t, F.lit(0)).cast("double") * F.lit(100.0), 2)
    )


# --- exact sums and means -------------------------------------------------------
# An amount with a fixed number of digits is its whole part and its units behind the point, each summed in a
# BIGINT: results do not depend on the order in which tasks deliver their partial sums, and partial
# aggregation stays on primitive numbers.  Amounts from MONEY_LIMIT on (and what is not finite) are left out of sums,
# means and their counts alike, and `numeric_quality` reports them as failures.  A total beyond 9.2e18 is NULL.

MONEY_LIMIT = 1e15


def usable_amount(c: Column | str) -> Column:
    return F.abs(col(c)) < F.lit(MONEY_LIMIT)


def unusable_amount(c: Column) -> Column:
    return (c < 0) | (c >= F.lit(MONEY_LIMIT))


def as_units(c: Column | str, digits: int = 2) -> Column:
    """A usable amount in whole units, for sums that are built in several steps."""
    c = col(c)
    return F.when(usable_amount(c), F.rint(c * F.lit(float(10 ** digits)))).cast("decimal(28,0)")


def whole_and_units(c: Column | str, digits: int = 2) -> tuple[Column, Column]:
    """A usable amount as its whole part and its units behind the point: BIGINTs, for sums that are built in several steps."""
    c = col(c)
    kept = F.when(usable_amount(c), c)
    whole = F.floor(kept)
    return whole, F.rint((kept - whole.cast("double")) * F.lit(float(10 ** digits))).cast("bigint")


def total_of(whole: Column, units: Column, digits: int = 2) -> Column:
    """Aggregate: the exact sum of amounts in two parts, rounded to a double once."""
    scale = 10 ** digits
    whole, units = F.try_sum(whole), F.try_sum(units)
    wide = whole.cast("decimal(38,0)") * F.lit(scale).cast("decimal(9,0)") + units.cast("decimal(38,0)")
    fits = F.abs(whole) < F.lit(2 ** 52 // scale)
    exact = F.when(fits, (whole * F.lit(scale) + units).cast("double")).otherwise(wide.cast("double"))
    return exact / F.lit(float(scale))


def _total(c: Column, digits: int, weight: Column | None = None) -> Column:
    whole, units = whole_and_units(c, digits)
    if weight is not None:
        whole, units = whole * weight, units * weight
    return total_of(whole, units, digits)


def exact_sum(c: Column | str, digits: int = 2) -> Column:
    """Sum over the non-NULL values, NULL when there are none."""
    return _total(col(c), digits)


def exact_mean(c: Column | str, digits: int = 2) -> Column:
    """Unrounded mean over the values that are summed, NULL when there are none."""
    c = col(c)
    return exact_sum(c, digits) / F.nullif(F.count_if(usable_amount(c)), F.lit(0)).cast("double")


def exact_weighted_mean(c: Column | str, weight: Column | str, digits: int = 2) -> Column:
    """Mean of the values that are summed, each counted `weight` times."""
    c, w = col(c), col(weight)
    return _total(c, digits, w) / F.nullif(F.sum(F.when(usable_amount(c), w)), F.lit(0)).cast("double")


# --- time -------------------------------------------------------------------------

def days_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed days with their fraction.

    Subtracting zone-free timestamps never looks at the session time zone, unlike
    `timestamp_diff`, which casts both sides to zoned timestamps first.
    """
    seconds = (col(end) - col(start)).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(86400.0)


def month_start(c: Column | str) -> Column:
    """First instant of the month as a zone-free timestamp."""
    return F.trunc(F.to_date(col(c)), "MM").cast("timestamp_ntz")


# --- report texts -------------------------------------------------------------------

def grouped_number(c: Column | str, digits: int = 0) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(col(c), digits)


def plain_money(c: Column | str) -> Column:
    """1234567.5 -> '1234567.5' (no exponent, at least one digit after the point)."""
    text = col(c).cast("decimal(38,2)").cast("string")
    return F.regexp_replace(text, "0$", "")


def text(*parts: Column | str) -> Column:
    """Join literal strings and columns into one text; a NULL part is skipped."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
