"""Hexagon tiles end to end: layer -> contract -> centroids -> tiles -> records."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.functions.cells import MAX_RES, MIN_RES, cell_hex, res_for_zoom
from hexatlas.functions.systems import CellSystem
from hexatlas.operators.diversity import INDEX_RESOLUTIONS
from hexatlas.operators.layers import Layer, hex_layer
from hexatlas.operators.tiling import (
    TILE, cap_tiles, count_copies, layer_tiles, one_tile, prune_one_tile)
from hexatlas.plans import index_store
from hexatlas.session import written


def checked_res(z: float, res: int | None) -> int:
    picked = res_for_zoom(z) if res is None else res
    if not MIN_RES <= picked <= MAX_RES:
        raise ValueError(f"resolution must be in {MIN_RES}..{MAX_RES}, got {picked}")
    return picked


def mean_layer(values: DataFrame, system: CellSystem, finest: int, scale: float = 1.0) -> Layer:
    """Mean and count per cell as a layer of every resolution up to ``finest``, from one scan.

    ``values`` has ``cell_id`` at ``finest`` and a whole-numbered ``value`` (the mean is divided by
    ``scale``). Sums and counts merge: they are written once per finest cell, and a coarser
    resolution sums the written table. NULL values are neither summed nor counted.
    """
    sums = written(values.where(F.col("value").isNotNull()).groupBy("cell_id").agg(
        F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("n")), "layer-sums")

    def at(res: int) -> DataFrame:
        if res > finest:
            raise ValueError(f"the layer stops at resolution {finest}")
        rows = sums if res == finest else sums.groupBy(
            system.parent(F.col("cell_id"), finest, res).alias("cell_id")).agg(F.sum("_sum").alias("_sum"), F.sum("n").alias("n"))
        return rows.select("cell_id", (F.col("_sum").cast("double") / F.col("n") / scale).alias("value"), "n")

    return at


def pyramid(layer: Layer, system: CellSystem, zooms: list[int], res: int | None = None,
            cap: int | None = None, top: int = MAX_RES,
            unique: bool = False) -> DataFrame:
    """Records of every tile of the zooms. Zooms that share a resolution share one scan.

    ``top`` is the finest resolution the layer has: deeper zooms draw those cells. Say
    ``unique`` when no cell repeats, as in a layer of the diversity store.
    """
    by_res: dict[int, dict[int, int]] = defaultdict(dict)
    for z in zooms:
        drawn = checked_res(z, res)
        by_res[min(drawn, top)][z] = drawn
    return layer_tiles([(hex_layer(layer(r)), r, zs) for r, zs in sorted(by_res.items())], system, cap, unique)


def single_tile(layer: Layer, system: CellSystem, z: int, x: int, y: int,
                res: int | None = None, cap: int | None = None, top: int = MAX_RES,
                unique: bool = False) -> DataFrame:
    """Records ``h3id, value, n`` of one tile, all of them unless a ``cap`` is given."""
    drawn = checked_res(z, res)
    r = min(drawn, top)
    rows = hex_layer(layer(r))
    rows = system.with_centroid(rows if cap is None else count_copies(rows, unique), r)
    inside = one_tile(rows, z, x, y, system.edge_deg(drawn)).drop("lng", "lat")
    at = {c: F.lit(v) for c, v in zip(TILE, (z, x, y))}
    kept = inside if cap is None else cap_tiles(inside.withColumns(at), cap)
    return kept.select(cell_hex(F.col("cell_id")).alias("h3id"), "value", "n")


def stored_tile(spark: SparkSession, base: str, metric: str, system: CellSystem, z: int, x: int,
                y: int, res: int | None = None, **filters) -> DataFrame:
    """One tile of a diversity metric from the store, reading only what the tile can show.

    The tile's covering set is pushed into the scan of whichever table answers, before any
    aggregation; ``filters`` are those of :func:`hexatlas.plans.index_store.layer`.
    """
    drawn = checked_res(z, res)
    layer = index_store.layer(
        spark, base, metric, system,
        scan=lambda df: prune_one_tile(df, system, z, x, y, drawn), **filters)
    return single_tile(layer, system, z, x, y, res, top=max(INDEX_RESOLUTIONS), unique=True)
