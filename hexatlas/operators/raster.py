"""Grid layers as pixels: value maps, lookup, re-wrapping, colouring and profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexatlas.functions import colour
from hexatlas.functions.values import finite
from hexatlas.operators.tiling import TILE

# Fixed value: tile side in pixels.
TILE_PIXELS = 256


def value_map(layer: DataFrame, order: str | None = None, unique_order: bool = False) -> DataFrame:
    """One finite value per positive ``cell_id``.

    With ``order`` the row that comes last wins, and of rows that share the last place the
    greatest value; without it the greatest value does. Say ``unique_order`` when no two
    rows of a cell share a place: the aggregation then needs no sort.
    """
    cell, value = F.col("cell_id"), F.col("value")
    rows = layer.select(cell.cast("bigint").alias("cell_id"), value.cast("double").alias("value"),
                        *([F.col(order).alias("_o")] if order else []))
    usable = finite(value) & (cell > 0)
    if order is None:
        best = F.max(F.when(usable, value))
    else:
        # rows without a place are never picked
        place = F.col("_o") if unique_order else F.struct("_o", "value")
        best = F.max_by("value", F.when(usable, place))
    return rows.where(usable).groupBy("cell_id").agg(best.alias("value"))


def require_rows(mapped: DataFrame) -> DataFrame:
    """Fail early when a layer has no usable row; reads at most one row."""
    if mapped.isEmpty():
        raise ValueError("layer has no positive cell ids with finite values")
    return mapped


def lookup(pixels: DataFrame, mapped: DataFrame, scatter: int = 4096) -> DataFrame:
    """Add ``value`` to each pixel; NaN for ids at or below zero and for unknown ids.

    Empty pixels share one id and can be most of a raster. They can match nothing, so they
    are given one of ``scatter`` negative keys and spread over all tasks.
    """
    empty = -(F.pmod(F.xxhash64(*pixels.columns), F.lit(scatter)) + 1)
    keyed = pixels.withColumn("_key", F.when(F.col("cell_id") > 0, F.col("cell_id")).otherwise(empty))
    values = mapped.select(F.col("cell_id").alias("_key"), "value")
    joined = keyed.join(values, "_key", "left").drop("_key")
    return joined.withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def grid_bounds(pixels: DataFrame, left: float, top: float, step_x: float,
                step_y: float) -> DataFrame:
    """Bounds of the pixels of a regular raster, one row ``xmin, ymin, xmax, ymax``."""
    return pixels.agg(
        (F.min("col") * step_x + left).alias("xmin"),
        (top - (F.max("row") + 1) * step_y).alias("ymin"),
        ((F.max("col") + 1) * step_x + left).alias("xmax"),
        (top - F.min("row") * step_y).alias("ymax"))


def layer_documents(bounds: DataFrame, name: str, url_base: str, params: dict[str, Column],
                    minzoom: int = 0, maxzoom: int = 12) -> DataFrame:
    """One JSON description per row of ``xmin, ymin, xmax, ymax``: bounds, centre, tiles."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    tiles = F.concat(F.lit(url_base.rstrip("/") + "/{z}/{x}/{y}.png?"), F.concat_ws("&", *pairs))
    body = F.struct(
        F.lit("2.2.0").alias("tilejson"), F.lit(name).alias("name"),
        F.array("xmin", "ymin", "xmax", "ymax").alias("bounds"),
        F.array((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2,
                F.lit(float(minzoom))).alias("center"),
        F.lit(minzoom).alias("minzoom"), F.lit(maxzoom).alias("maxzoom"),
        F.array(tiles).alias("tiles"))
    return bounds.withColumn("document", F.to_json(body))


def rewrap(pixels: DataFrame, left: float, step_x: float, width: int) -> DataFrame:
    """Move a raster from 0..360 to -180..180 degrees; ``row, col, cell_id`` in and out.

    The source is cut at 180 degrees. Its eastern part moves right by the offset of its
    left edge and is cut at the border; its western part starts at column 0 and wins
    wherever both fall, also with an empty pixel. The winner is known from the column
    alone, so nothing is shuffled. Absent and NaN pixels are 0, the empty id.
    """
    if not -180.0 <= left <= 180.0:
        raise ValueError("left edge must lie in -180..180")

    def nearest(v: float) -> int:
        return round(v)

    cut = min(width, nearest((180.0 - left) / step_x))
    out_width = nearest(360.0 / step_x)
    shift = nearest((left + 180.0) / step_x)
    west_width = min(width - cut, out_width)
    col = F.col("col")
    moved = F.when(col < cut, col + shift).otherwise(col - cut)
    kept = F.when(col < cut, (col + shift < out_width) & (col + shift >= west_width)) \
        .otherwise(col - cut < out_width)
    ident = F.col("cell_id").cast("double")
    return pixels.where(kept).select(
        "row", moved.alias("col"),
        F.when(ident.isNull() | F.isnan(ident), F.lit(0)).otherwise(F.col("cell_id"))
        .cast("bigint").alias("cell_id"))


def tile_pixels(raster: DataFrame, z: int, left: float, top: float, step_x: float,
                step_y: float, tile: tuple[int, int] | None = None) -> DataFrame:
    """Pixels ``z, x, y, px, py, cell_id, mask`` of all tiles of a zoom, or of ``tile``.

    Each takes the nearest source pixel: longitude picks the column and latitude the row
    independently. The two axis tables have ``256 * 2^z`` rows each, whatever the raster
    holds, and the raster is joined to them by equality; tile pixels outside the raster
    get no row.
    """
    spark = raster.sparkSession
    across = TILE_PIXELS * 2 ** z
    at = F.col("id")
    lng = (at + 0.5) / across * 360.0 - 180.0
    lat = F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * (at + 0.5) / across))) * 180.0 / F.lit(math.pi)
    side = F.lit(TILE_PIXELS)

    def axis(source: Column, name: str, number: str, pixel: str, only: int | None) -> DataFrame:
        first, last = (0, across) if only is None else (only * TILE_PIXELS, (only + 1) * TILE_PIXELS)
        return spark.range(first, last).select(
            source.cast("bigint").alias(name),
            F.floor(at / side).cast("int").alias(number), (at % side).cast("int").alias(pixel))

    x, y = tile or (None, None)
    cols = axis(F.floor((lng - left) / step_x), "col", "x", "px", x)
    rows = axis(F.floor((top - lat) / step_y), "row", "y", "py", y)
    return (raster.join(cols, "col").join(rows, "row")
            .select(F.lit(z).alias("z"), "x", "y", "px", "py", "cell_id",
                    F.when(F.col("cell_id") != 0, 255).otherwise(0).alias("mask")))


def whole_tiles(pixels: DataFrame) -> DataFrame:
    """Every tile that has a pixel with all its 65,536: those outside the raster have id 0 and mask 0.

    A tile's rows of pixels are made first and meet the stored rows, of at most 256 pixels
    each; what a row lacks is added in place. Only stored pixels are shuffled.
    """
    side = F.sequence(F.lit(0), F.lit(TILE_PIXELS - 1))
    stored = pixels.groupBy(*TILE, "py").agg(F.collect_list(F.struct("px", "cell_id", "mask")).alias("_row"))
    made = pixels.select(*TILE).distinct().withColumn("py", F.explode(side))
    row = F.coalesce("_row", F.array().cast("array<struct<px:int,cell_id:bigint,mask:int>>"))
    absent = F.transform(F.array_except(side, F.transform(row, lambda p: p["px"])), lambda p: F.struct(
        p.alias("px"), F.lit(0).cast("bigint").alias("cell_id"), F.lit(0).alias("mask")))
    full = made.join(stored, [*TILE, "py"], "left").withColumn("_p", F.explode(F.concat(row, absent)))
    return full.select(*TILE, "_p.px", "py", "_p.cell_id", "_p.mask")


def value_range(mapped: DataFrame) -> tuple[Column, Column]:
    """Least and greatest value of a map as scalars for :func:`coloured`."""
    return (mapped.agg(F.min("value").alias("m")).scalar(),
            mapped.agg(F.max("value").alias("m")).scalar())


def coloured(valued: DataFrame, low: Column, high: Column, palette: DataFrame) -> DataFrame:
    """Scale to a byte and look it up in ``palette(byte, r, g, b, a)`` of 256 rows."""
    scaled = (valued.withColumns({"_low": low, "_high": high})
              .withColumn("byte", colour.to_byte(F.col("value"), F.col("_low"), F.col("_high")))
              .drop("_low", "_high"))
    # a palette is 256 rows by definition
    return (scaled.join(F.broadcast(palette), "byte", "left")
            .withColumn("a", colour.palette_alpha(F.col("mask"), F.col("value"), F.col("a"))))


def masked(valued: DataFrame, colour_text: str) -> DataFrame:
    """One colour for every shown pixel, whatever its value."""
    rgba = colour.parse_colour(F.lit(colour_text))
    checked = F.coalesce(rgba, F.raise_error(F.lit(f"not a colour: {colour_text}"))
                         .cast("struct<r:int,g:int,b:int,a:int>"))
    return (valued.withColumn("_c", checked)
            .withColumns({"r": F.col("_c.r"), "g": F.col("_c.g"), "b": F.col("_c.b"),
                          "a": colour.flat_alpha(F.col("mask"), F.col("value"), F.col("_c.a"))})
            .drop("_c"))


def tile_profile(pixels: DataFrame, top: int = 10) -> DataFrame:
    """Per tile: pixel counts, id range, and the most frequent ids as ``id:count,...``.

    All counts are of pixels. Without ``px, py`` each row is one; with them rows that share a place
    are one pixel, counted once in the total and once under each id and kind that it has.
    Pixels are first counted per tile and id, so both parts work on the counted rows.
    """
    ident = F.col("cell_id")
    place = [c for c in ("px", "py") if c in pixels.columns]
    if place:
        pixels = pixels.groupBy(*TILE, *place, "cell_id").agg(F.max("mask").alias("mask"))
    counted = pixels.groupBy(*TILE, "cell_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("mask") > 0).cast("long")).alias("v"))
    parts = [F.sum("v").alias("valid_px"), F.sum("c").alias("total_px"),
             F.sum(F.when(ident == 0, F.col("c")).otherwise(0)).alias("zero_px"),
             F.sum(F.when(ident < 0, F.col("c")).otherwise(0)).alias("negative_px")]
    names = ["valid_px", "total_px", "zero_px", "negative_px"]
    summed = counted.groupBy(*TILE).agg(*parts, F.min(ident).alias("id_min"), F.max(ident).alias("id_max"))
    if place:
        one = pixels.groupBy(*TILE, *place).agg(
            F.max((F.col("mask") > 0).cast("long")).alias("valid_px"), F.lit(1).cast("long").alias("total_px"),
            F.max(F.when(ident == 0, 1).otherwise(0)).alias("zero_px"), F.max(F.when(ident < 0, 1).otherwise(0)).alias("negative_px"))
        summed = one.groupBy(*TILE).agg(*[F.sum(c).alias(c) for c in names]).join(summed.drop(*names), TILE)
    rank = F.row_number().over(
        Window.partitionBy(*TILE).orderBy(F.desc("c"), F.asc("cell_id")))
    best = (counted.withColumn("_r", rank).where(F.col("_r") <= top)
            .groupBy(*TILE).agg(F.sort_array(F.collect_list(
                F.struct("_r", F.concat_ws(":", "cell_id", "c").alias("t")))).alias("_l"))
            .select(*TILE, F.array_join(F.col("_l.t"), ",").alias("top_ids")))
    return summed.join(best, TILE)
