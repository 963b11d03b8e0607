"""Value-level rules shared by every layer: finiteness, JSON-safe numbers, clamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(value: Column) -> Column:
    """Not NULL, not NaN, not infinite. Never NULL itself, so it can be negated."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def json_safe(value: Column) -> Column:
    """Text of a double in which the three non-JSON values are spelled out by name."""
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "Infinity")
        .when(value == float("-inf"), "-Infinity")
        .otherwise(value.cast("string"))
    )


def clamp_res(res: Column | int, top: int = 7) -> Column:
    """Stores stop at a finest resolution; finer requests read the finest one."""
    return F.least(F.lit(res) if isinstance(res, int) else res, F.lit(top))
