"""Colour-space expressions on scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights.
LUMA = (0.2989, 0.587, 0.114)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b


def wrap_unit(c: Column) -> Column:
    """Remainder by 1 in [0, 1)."""
    return c - F.floor(c)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue and saturation in [0, 1]; value in the unit of the input."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    flat = span == 0
    unit = F.when(flat, F.lit(1.0)).otherwise(span)
    sextant = (
        F.when(r == hi, (g - b) / unit)
        .when(g == hi, F.lit(2.0) + (b - r) / unit)
        .otherwise(F.lit(4.0) + (r - g) / unit)
    )
    hue = F.when(flat, F.lit(0.0)).otherwise(wrap_unit(sextant / 6.0))
    sat = F.when(flat, F.lit(0.0)).otherwise(span / F.when(hi == 0, F.lit(1.0)).otherwise(hi))
    return hue, sat, hi


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Each channel is v - v*s*max(0, min(k, 4-k, 1)) with k = (shift + 6h) mod 6."""

    def channel(shift):
        k = F.lit(float(shift)) + h * 6.0
        k = k - F.floor(k / 6.0) * 6.0
        return v - v * s * F.greatest(F.least(k, F.lit(4.0) - k, F.lit(1.0)), F.lit(0.0))

    return channel(5), channel(3), channel(1)
