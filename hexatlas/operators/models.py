"""Model registry, per-model cells, footprints, item search and area reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexatlas.operators.ranking import dense_ids
from hexatlas.operators.space import Ring, box_meets_ring, box_overlap


def model_registry(model_cells: DataFrame) -> DataFrame:
    """``mdl_key, mdl_id``: ids are dense over the sorted keys and start at 1.

    Ids move between releases; only keys may be shown outside.
    """
    return dense_ids(model_cells, "mdl_key", "mdl_id")


def resolve_keys(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with the internal id of their key; unknown keys are left out here."""
    return requested.join(registry, "mdl_key")


def unknown_keys(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested keys that no model has: the report that goes with :func:`resolve_keys`."""
    return requested.select("mdl_key").distinct().join(registry, "mdl_key", "left_anti")


def keyed_by_id(model_cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Model cells in store form ``mdl_id, cell_id, val``."""
    return model_cells.join(registry, "mdl_key").select("mdl_id", "cell_id", "val")


def footprints(located: DataFrame, half_width: float, half_height: float,
               key: str = "mdl_key") -> DataFrame:
    """Bounding box of each model's cells, cell extents included.

    Rows carry ``lng, lat`` of their cell; minima and maxima combine before the shuffle.
    """
    return located.groupBy(key).agg(
        (F.min("lng") - half_width).alias("xmin"), (F.min("lat") - half_height).alias("ymin"),
        (F.max("lng") + half_width).alias("xmax"), (F.max("lat") + half_height).alias("ymax"),
        F.count(F.lit(1)).alias("n_cells"))


def catalogue_items(boxes: DataFrame, href: Column, collection: Column,
                    key: str = "mdl_key") -> DataFrame:
    """One item per model: ``collection, item_id, xmin, ymin, xmax, ymax, href``."""
    return boxes.select(collection.alias("collection"), F.col(key).alias("item_id"),
                        "xmin", "ymin", "xmax", "ymax", href.alias("href"))


def search(items: DataFrame, collections: list[str] | None = None,
           bbox: tuple[float, float, float, float] | None = None, intersects: Ring | None = None) -> DataFrame:
    """Items of the collections whose box meets ``bbox`` and the polygon ``intersects``.

    The filters reach the scan, the polygon's by its extent.
    """
    found = items
    if collections is not None:
        found = found.where(F.col("collection").isin(collections))
    if bbox is not None:
        found = found.where(box_overlap(bbox))
    if intersects is not None:
        found = found.where(box_meets_ring(intersects))
    return found


def page(found: DataFrame, limit: int = 10, after: str | None = None) -> DataFrame:
    """One page in ``item_id`` order with ``number_matched`` and ``number_returned``.

    Paging is by key (``after`` is the last id seen), so a late page costs what the first
    does. Only the ordered page passes through one task.
    """
    matched = found.agg(F.count(F.lit(1)).alias("c")).scalar()
    rest = found if after is None else found.where(F.col("item_id") > after)
    rows = rest.orderBy("item_id").limit(limit)
    # over the page itself, which has at most ``limit`` rows
    returned = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return rows.withColumns({"number_matched": matched, "number_returned": returned})


def scores_for_cells(scores: DataFrame, cells: DataFrame, metric: str = "metric",
                     value: str = "value") -> DataFrame:
    """Mean of each metric over an area's cells, with the number of cells that have it."""
    return (scores.join(cells.select("cell_id"), "cell_id", "left_semi")
            .groupBy(metric).agg(F.avg(value).alias("score"), F.count(value).alias("n_cells")))


def species_for_cells(cell_model: DataFrame, cells: DataFrame, block: Column | None = None) -> DataFrame:
    """Models present in an area: cells each covers and its mean value there.

    On the cell-oriented layout give ``block``, the folder of a cell of ``cells``: folders that
    the area does not touch are then never opened. The folders of a grid are few, which is
    what permits their broadcast; the cells are met by a join of their own.
    """
    rows = cell_model
    if block is not None:
        # the comparison marks the side as selective, without which partitions are not pruned
        touched = cells.select(block.alias("block")).where(F.col("block") >= 0).distinct()
        rows = rows.join(F.broadcast(touched), "block", "left_semi")
    return (rows.join(cells.select("cell_id"), "cell_id", "left_semi")
            .groupBy("mdl_key").agg(F.count(F.lit(1)).alias("n_cells"),
                                    F.avg("val").alias("mean_val")))
