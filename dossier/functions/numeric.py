"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_exact(x: Column, digits: int) -> Column:
    """Round on the binary value of a double, exact ties to even.

    ``F.round`` rounds the shortest decimal text half up, which differs on values
    such as 0.00115 (stored just below the tie).  Away from a tie both agree; at
    a tie the product ``x * 2 * 10**digits`` is compared with the odd integer
    exactly, by splitting ``x`` into two halves whose products are exact.
    """
    scale, split = f"1e{digits}D", "1.34217729e8D"  # split: 2**27 + 1
    low = f"floor(v * {scale})"
    hi = f"(v * {split} - (v * {split} - v))"
    excess = f"(({hi} * 2 * {scale} - ({low} * 2 + 1)) + (v - {hi}) * 2 * {scale})"
    body = (f"v -> if(abs(v * {scale} - {low} - 0.5D) < 1e-6D, "
            f"({low} + if({excess} > 0 or ({excess} = 0 and {low} % 2 <> 0), 1, 0)) / {scale}, "
            f"round(v, {digits}))")
    return F.get(F.call_function(
        "transform", F.array(x.cast("double")), F.expr(body)), F.lit(0))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def cap(x: Column, limit: float) -> Column:
    return F.least(x, F.lit(limit))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 when the denominator is 0 or null."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
