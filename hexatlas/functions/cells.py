"""Cell-id bit layout, web-mercator tile geometry, and zoom-to-resolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Zoom at which each resolution 1..10 starts, and the closing zoom.
ZOOM_BREAKS = [0.0, 2.2, 3.4, 4.6, 5.8, 7.0, 8.2, 9.4, 10.6, 11.8, 22.0]
MIN_RES, MAX_RES = 1, 10

# Mean edge of a resolution-0 hexagon (km), km per degree, area ratio.
EDGE_KM_RES0 = 1106.54
KM_PER_DEGREE = 111.32
APERTURE = 7

# Bit layout of a 64-bit hexagon index.
RES_SHIFT = 52
RES_MASK = 0xF
DIGIT_BITS = 3
MAX_DIGITS = 15


def res_for_zoom(z: float) -> int:
    """Plain-number form of :func:`zoom_to_res`, for choosing a plan on the driver."""
    return max(MIN_RES, min(MAX_RES, sum(1 for b in ZOOM_BREAKS if b <= z)))


def zoom_to_res(z: Column) -> Column:
    """Resolution of a zoom: number of breaks at or below it, held within 1..10."""
    reached = F.lit(0)
    for b in ZOOM_BREAKS:
        reached = reached + (z >= F.lit(b)).cast("int")
    return F.greatest(F.lit(MIN_RES), F.least(F.lit(MAX_RES), reached))


def edge_deg_value(res: int) -> float:
    return EDGE_KM_RES0 / math.sqrt(APERTURE) ** res / KM_PER_DEGREE


def edge_deg(res: Column) -> Column:
    """Mean hexagon edge in degrees of latitude."""
    return F.lit(EDGE_KM_RES0) / F.pow(F.sqrt(F.lit(float(APERTURE))), res) / F.lit(KM_PER_DEGREE)


def cell_hex(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def cell_resolution(cell: Column) -> Column:
    return F.shiftright(cell, RES_SHIFT).bitwiseAND(F.lit(RES_MASK)).cast("int")


def hex_parent(cell: Column, res: int) -> Column:
    """Ancestor of a hexagon index: lower the resolution, blank the finer digits."""
    blank = (1 << (DIGIT_BITS * (MAX_DIGITS - res))) - 1
    keep = ~(RES_MASK << RES_SHIFT)
    return (
        cell.bitwiseAND(F.lit(keep).cast("long"))
        .bitwiseOR(F.lit(res << RES_SHIFT).cast("long"))
        .bitwiseOR(F.lit(blank).cast("long"))
    )


def tiles_across(z: Column) -> Column:
    """Number of tiles along one side of the map at a zoom."""
    return F.pow(F.lit(2.0), z)


def tile_west(x: Column, n: Column) -> Column:
    return x / n * 360.0 - 180.0


def tile_north(y: Column, n: Column) -> Column:
    """Latitude of the upper edge of row ``y`` (row 0 is the northernmost)."""
    return F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))) * 180.0 / F.lit(math.pi)


def tile_row_at(lat: Column, n: Column) -> Column:
    """Fractional tile row of a latitude: the inverse of :func:`tile_north`."""
    return n / 2 * (1 - F.asinh(F.tan(F.radians(lat))) / F.lit(math.pi))


def tile_is_valid(z: Column, x: Column, y: Column) -> Column:
    n = tiles_across(z)
    return (z >= 0) & (x >= 0) & (x < n) & (y >= 0) & (y < n)


def tile_bbox(z: Column, x: Column, y: Column) -> Column:
    """Struct ``lon_min, lon_max, lat_min, lat_max``; NULL when x or y is off the map."""
    n = tiles_across(z)
    box = F.struct(
        tile_west(x, n).alias("lon_min"),
        tile_west(x + 1, n).alias("lon_max"),
        tile_north(y + 1, n).alias("lat_min"),
        tile_north(y, n).alias("lat_max"),
    )
    return F.when(tile_is_valid(z, x, y), box)


# Spark SQL text over the columns z, x, y, lng and lat. One parsed expression per rule:
# these are long formulas, and building them operator by operator from Python is slow.
ACROSS = "pow(2D, {z})"
WEST = "(({x}) / pow(2D, {z}) * 360D - 180D)"
NORTH = "(atan(sinh(pi() * (1D - 2D * ({y}) / pow(2D, {z})))) * 180D / pi())"


def west_sql(x: str = "x", z: str = "z") -> str:
    return WEST.format(x=x, z=z)


def north_sql(y: str = "y", z: str = "z") -> str:
    return NORTH.format(y=y, z=z)


def in_tile(buffer_deg: str, z: str = "z", x: str = "x", y: str = "y") -> Column:
    """Is centroid ``lng, lat`` in the buffered tile, also one turn east or west of it?

    Arguments are column names or literals. Limits are compared at ten decimals of a degree.
    """
    def at_ten(limit: str) -> str:
        return f"rint(({limit}) * 1e10D) / 1e10D"

    b = buffer_deg
    west, east = at_ten(f"{west_sql(x, z)} - {b}"), at_ten(f"{west_sql(f'{x} + 1', z)} + {b}")
    south, north = at_ten(f"{north_sql(f'{y} + 1', z)} - {b}"), at_ten(f"{north_sql(y, z)} + {b}")
    turns = " OR ".join(f"lng + {t}D BETWEEN {west} AND {east}" for t in (0, 360, -360))
    return F.expr(f"({turns}) AND lat BETWEEN {south} AND {north}")
