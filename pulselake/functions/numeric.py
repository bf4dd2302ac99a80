"""Rounding and parsing rules shared by every operator, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_round(x: Column, digits: int = 0) -> Column:
    """Half-away-from-zero on the binary value: scale, round, unscale.

    Spark's ``round(x, n)`` rounds the decimal string instead, so 1.005 would become 1.01.
    """
    if digits == 0:
        return F.round(x)
    scale = float(10**digits)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def _split(x):
    """Upper and lower half of a double's digits (works on floats and on Columns)."""
    c = x * 134217729.0
    high = c - (c - x)
    return high, x - high


def half_even(x: Column, digits: int = 0) -> Column:
    """Half-to-even on the exact binary value, as Python's ``round`` does.

    ``x * 10^digits`` may land on a tie only because the product was rounded, so a tie is decided by the exact
    remainder of the product (the classic two-product): above it round up, below it down, else to even. Exact as
    long as ``x * 10^digits`` stays below 2^52.
    """
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    product = x * F.lit(scale)
    (xh, xl), (sh, sl) = _split(x), _split(scale)
    rest = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    tie = F.abs(product - F.floor(product)) == 0.5
    nearest = (
        F.when(tie & (rest > 0), F.ceil(product).cast("double"))
        .when(tie & (rest < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return nearest / F.lit(scale)


def to_long(x: Column) -> Column:
    """DOUBLE to BIGINT, half-to-even (a bare Spark cast truncates)."""
    return F.rint(x).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 or NULL (ANSI division would raise)."""
    return F.try_divide(num, den)


def nonzero(x: Column) -> Column:
    """NULL instead of 0: the "falsy means absent" rule of the presentation layer."""
    return F.when(x != 0, x)


def safe_double(text: Column) -> Column:
    """Parse a double, NULL for anything that is not a plain number, nan or inf.

    The character check keeps out what only Java reads as a number, such as ``3.5f`` or hexadecimal.
    """
    bare = F.trim(text)
    digits_only = F.translate(bare, "0123456789+-.eE", "") == ""
    named = F.ltrim(F.lower(bare), F.lit("+-")).isin("nan", "inf", "infinity")
    return F.when(digits_only | named, bare.try_cast("double"))
