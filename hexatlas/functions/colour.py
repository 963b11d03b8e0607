"""Pixel columns: byte scaling, ranges, colours and alpha."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hexatlas.functions.values import finite

HEX_COLOUR = r"^#*([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})\z"


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """Place a value in ``low..high`` as 0..255, truncated; missing values give 0."""
    top = F.when(high <= low, low + 1.0).otherwise(high)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (top - low)))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise((unit * 255.0).cast("int"))


def parse_range(text: Column) -> Column:
    """``'min,max'`` as a struct of two doubles; NULL when it is not two numbers."""
    parts = F.split(text, ",")
    low = F.trim(F.get(parts, F.lit(0))).try_cast("double")
    high = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    ok = (F.size(parts) == 2) & low.isNotNull() & high.isNotNull()
    return F.when(ok, F.struct(low.alias("low"), high.alias("high")))


def parse_colour(text: Column) -> Column:
    """``#rrggbb`` or ``#rrggbbaa`` (hash optional) as bytes r, g, b, a; else NULL."""
    digits = F.regexp_extract(text, HEX_COLOUR, 1)

    def byte(at: int) -> Column:
        return F.conv(F.substring(digits, at, 2), 16, 10).cast("int")

    alpha = F.when(F.length(digits) == 8, byte(7)).otherwise(F.lit(255))
    return F.when(
        text.rlike(HEX_COLOUR),
        F.struct(byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b"), alpha.alias("a")))


def shown(mask: Column, value: Column) -> Column:
    """A pixel is shown when its source is valid and its looked-up value is finite."""
    return (mask > 0) & finite(value)


def palette_alpha(mask: Column, value: Column, alpha: Column) -> Column:
    on = F.when(shown(mask, value), F.lit(255)).otherwise(F.lit(0))
    return alpha.cast("int").bitwiseAND(on)


def flat_alpha(mask: Column, value: Column, alpha: Column) -> Column:
    return F.when(shown(mask, value), alpha).otherwise(F.lit(0))
