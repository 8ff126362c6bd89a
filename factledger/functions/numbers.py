"""Rounding and number-to-text rules that must agree with the published figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def round_half_even(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals, ties judged on the exact binary value.

    ``F.round`` judges ties on the printed decimal (2.675 -> 2.68 although the
    stored value lies below the tie). Number formatting rounds the stored value,
    half to even, and refers to ``x`` only once, so the expression stays small
    when the optimizer inlines it.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    text = F.call_function("format_number", x.cast("double"), F.lit(pattern))
    # "+ 0.0" keeps a rounded-away negative from showing up as -0.0
    return text.try_cast("double") + F.lit(0.0)


def round_half_up(x: Column) -> Column:
    """Whole-number rounding with ties towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def percent_of_max(value: Column, top: Column) -> Column:
    """Bar height 0..100; the maximum is never taken below 1."""
    return round_half_up(value / F.greatest(top, F.lit(1.0)) * 100).cast("int")


def float_text(x: Column) -> Column:
    """Plain text of a double with at least one decimal, never ``1.0E7``."""
    x = x.cast("double")
    short = x.cast("string")
    plain = F.regexp_replace(short.cast("decimal(38,16)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(x)
    return F.when((size >= 1e7) & (size < 1e16), plain).when(
        (size >= 1e-4) & (size < 1e-3), plain
    ).otherwise(short)
