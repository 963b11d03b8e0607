"""From layer rows to map tiles: assignment, capping, covering sets and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexatlas.functions import cells
from hexatlas.functions.systems import CellSystem
from hexatlas.session import written

# Tile buffer and covering buffer in cell edges, resolution of the stored
# prune column, polar limit of a covering box in degrees.
TILE_BUFFER_EDGES = 1.5
COVER_BUFFER_EDGES = 2.0
PRUNE_RES = 3
POLAR_LIMIT = 89.9

# Records of a tile document; a larger tile is several documents.
PART_ROWS = 50_000
# Rows of the fullest tile that ask for one salt more where tiles are capped.
SALT_ROWS = 1_000_000
# A broadcast of coarse cells is 16 bytes a cell: up to 16 MB.
MOST_BROADCAST_CELLS = 1 << 20

TILE = ["z", "x", "y"]
# Candidate tiles are taken this much too wide; the exact test follows.
SLACK = 1e-9


def _columns() -> Column:
    """Tile columns whose buffered span holds ``lng``, as it is or one turn away."""
    n = cells.ACROSS.format(z="z")

    def run(turn: int) -> str:
        at = f"lng + {turn + 180}D"
        low = f"greatest(0L, ceil(({at} - _buffer) / 360D * {n} - 1D - {SLACK!r}D))"
        high = f"least(cast({n} as bigint) - 1L, floor(({at} + _buffer) / 360D * {n} + {SLACK!r}D))"
        return f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<bigint>))"

    runs = ", ".join(run(t) for t in (0, 360, -360))
    return F.expr(f"array_distinct(flatten(array({runs})))")


def _rows() -> Column:
    """Tile rows whose buffered span holds ``lat``."""
    n = cells.ACROSS.format(z="z")

    def row(lat: str) -> str:
        held = f"greatest(-89.9999D, least(89.9999D, {lat}))"
        return f"{n} / 2D * (1D - asinh(tan(radians({held}))) / pi())"

    low = f"greatest(0L, ceil({row('lat + _buffer')} - 1D - {SLACK!r}D))"
    high = f"least(cast({n} as bigint) - 1L, floor({row('lat - _buffer')} + {SLACK!r}D))"
    return F.expr(f"if({low} <= {high}, sequence({low}, {high}), cast(array() as array<bigint>))")


def aimed(located: DataFrame, zooms: list[int], edge_deg: float | dict[int, float],
          edges: float = TILE_BUFFER_EDGES) -> DataFrame:
    """Say which zooms rows are drawn at, and the cell edge that sets each zoom's buffer."""
    edge = edge_deg if isinstance(edge_deg, dict) else {z: edge_deg for z in zooms}
    levels = ", ".join(f"named_struct('z', {int(z)}, 'b', {edge[z] * edges!r}D)" for z in zooms)
    return located.withColumn("_aims", F.expr(f"array({levels})"))


def to_tiles(aimed_rows: DataFrame) -> DataFrame:
    """Every tile in which each row is drawn, as ``z, x, y``, in one narrow pass.

    A row goes to a tile once even when two turns of longitude match; equal rows of a
    layer stay separate rows. No join and no shuffle: tiles come from arithmetic.
    """
    spread = (aimed_rows.withColumn("_aim", F.explode("_aims"))
              .withColumns({"z": F.col("_aim.z"), "_buffer": F.col("_aim.b")})
              .withColumn("x", F.explode(_columns()))
              .withColumn("y", F.explode(_rows())))
    return (spread.where(cells.in_tile("_buffer"))
            .withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
            .drop("lng", "lat", "_aims", "_aim", "_buffer"))


def one_tile(located: DataFrame, z: int, x: int, y: int, edge_deg: float,
             edges: float = TILE_BUFFER_EDGES) -> DataFrame:
    """Rows of a single tile: the filter alone, for one request."""
    side = 2 ** z
    if not (0 <= x < side and 0 <= y < side):
        raise ValueError(f"tile {x}/{y} does not exist at zoom {z}")
    return located.where(
        cells.in_tile(f"{edge_deg * edges!r}D", *(str(int(v)) for v in (z, x, y))))


def count_copies(layer: DataFrame, unique: bool = False) -> DataFrame:
    """Equal rows as one row with ``_copies``.

    No shuffle when the layer is already grouped by cell, nor when it is known to have
    ``unique`` cells, as those of a precomputed index are.
    """
    if unique:
        return layer.withColumn("_copies", F.lit(1).cast("bigint"))
    return layer.groupBy("cell_id", "value", "n").agg(F.count(F.lit(1)).alias("_copies"))


def cap_tiles(tiled: DataFrame, cap: int, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Keep the first ``cap`` rows of each tile by cell id, with the tile's ``n_total`` rows.

    Input rows carry ``_copies``; ``n_total`` shows where a tile was cut. Every row stands for a
    copy at least, so the first ``cap`` distinct rows of a tile hold its first ``cap`` copies:
    each task cuts its rows to those before they are shuffled, by (tile, salt) and then by tile.
    Salts come from the counts, one for ``salt_rows`` rows of the fullest tile. Only what is
    left is summed up, so copies are counted, never spread, and written out up to the cap.
    """
    if cap < 1:
        raise ValueError("a cap keeps one row at least")
    totals = written(tiled.groupBy(*TILE).agg(
        F.sum("_copies").alias("n_total"), F.count(F.lit(1)).alias("_rows")), "tile-totals")
    salts = -(-(totals.agg(F.max("_rows")).first()[0] or 0) // salt_rows)
    order = ["cell_id", "value", "n"]
    first = tiled.withColumn("_salt", F.pmod(F.xxhash64("cell_id", "value"), F.lit(max(1, salts))))
    for group in ([*TILE, "_salt"], TILE) if salts > 1 else (TILE,):
        at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        first = first.withColumn("_at", at).where(F.col("_at") <= cap).drop("_at")
    window = Window.partitionBy(*TILE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.lit(cap) - (F.col("_upto") - F.col("_copies"))
    kept = (first.withColumn("_upto", F.sum("_copies").over(window)).where(room > 0)
            .withColumn("_copies", F.least(F.col("_copies"), room)))
    return (kept.drop("_upto", "_salt").join(totals.drop("_rows"), TILE)
            .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .drop("_i", "_copies"))


def tile_records(capped: DataFrame) -> DataFrame:
    """Output records ``z, x, y, h3id, value, n``, and ``n_total`` where tiles were capped."""
    total = [c for c in ("n_total",) if c in capped.columns]
    return capped.select(*TILE, cells.cell_hex(F.col("cell_id")).alias("h3id"), "value", "n", *total)


def tile_documents(records: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """JSON documents of tiles, ``z, x, y, part, parts, n_records, body``; parts count from 1.

    Tiles are counted first. A tile of up to ``part_rows`` records is one document; a larger
    one is dealt out over numbered parts of about that size by a hash of the row's number, which
    spreads repeated records too. Records are written first, so a row keeps its number when a
    task is run again. A NULL ``n`` is left out of its record rather than written as null.
    """
    missing = {"h3id", "value", "n"} - set(records.columns)
    if missing:
        raise ValueError(f"tile records lack columns {sorted(missing)}")
    rows = written(records.select(*TILE, "h3id", "value", "n").withColumn("_row", F.monotonically_increasing_id()),
                   "tile-records")
    counted = rows.groupBy(*TILE).agg(F.count(F.lit(1)).alias("_n"))
    sized = counted.select(*TILE, F.ceil(F.col("_n") / part_rows).cast("int").alias("parts"))
    at = (F.pmod(F.xxhash64("_row"), F.col("parts")) + 1).cast("int")
    dealt = rows.join(sized, TILE).withColumn("part", at)
    listed = dealt.groupBy(*TILE, "part", "parts").agg(
        F.sort_array(F.collect_list(F.struct("h3id", "value", "n"))).alias("cells"))
    return listed.select(*TILE, "part", "parts", F.size("cells").alias("n_records"),
                         F.to_json(F.struct("cells")).alias("body"))


def tile_index(documents: DataFrame) -> DataFrame:
    """One row per tile: how many parts and records it has, to be read before its parts."""
    return documents.groupBy(*TILE).agg(
        F.max("parts").alias("parts"), F.sum("n_records").alias("n_records"))


def covering(tiles: DataFrame, system: CellSystem, prune_res: int = PRUNE_RES) -> DataFrame:
    """``z, x, y, hex_prune``: coarse cells whose centroid is in a tile's widened box.

    A box that passes the antimeridian is two boxes, one at either end. Boxes and coarse
    cells meet on a grid of bins two edges wide, by equality: a deep tile touches a handful
    of bins, and the few shallow tiles cannot touch more than all bins.
    """
    edge = system.edge_deg(prune_res)
    margin, step = f"{edge * COVER_BUFFER_EDGES!r}D", f"{edge * 2!r}D"
    whole = tiles.selectExpr(*[f"cast({c} as int) as {c}" for c in TILE]).distinct().selectExpr(
        *TILE,
        f"{cells.west_sql()} - {margin} as _w", f"{cells.west_sql('x + 1')} + {margin} as _e",
        f"greatest(-{POLAR_LIMIT}D, {cells.north_sql('y + 1')} - {margin}) as _s",
        f"least({POLAR_LIMIT}D, {cells.north_sql()} + {margin}) as _n")
    spans = """explode(filter(array(
        named_struct('w', greatest(_w, -180D), 'e', least(_e, 180D)),
        if(_w < -180D, named_struct('w', _w + 360D, 'e', 180D), null),
        if(_e > 180D, named_struct('w', -180D, 'e', _e - 360D), null)), b -> b is not null)) as _b"""
    boxes = whole.selectExpr(*TILE, spans, "_s", "_n").selectExpr(*TILE, "_b.w as _w", "_b.e as _e", "_s", "_n")
    binned = (boxes
              .withColumn("_bx", F.expr(f"explode(sequence(floor(_w / {step}), floor(_e / {step})))"))
              .withColumn("_by", F.expr(f"explode(sequence(floor(_s / {step}), floor(_n / {step})))")))
    dim = system.dimension(tiles.sparkSession, prune_res).selectExpr(
        "cell_id as hex_prune", "lng", "lat",
        f"floor(lng / {step}) as _bx", f"floor(lat / {step}) as _by")
    # a box of more than a turn meets a cell from both sides
    return (binned.join(dim, ["_bx", "_by"])
            .where("lng BETWEEN _w AND _e AND lat BETWEEN _s AND _n")
            .select(*TILE, "hex_prune").distinct())


def prune_keys(tiles: DataFrame, system: CellSystem, prune_res: int = PRUNE_RES) -> DataFrame:
    """``hex_prune, block``: coarse cells that the wanted tiles may read, and their store folders."""
    return covering(tiles, system, prune_res).select("hex_prune").distinct().withColumn(
        "block", system.block(F.col("hex_prune"), prune_res))


def prune_scan(source: DataFrame, tiles: DataFrame, system: CellSystem, layer_res: int,
               prune_res: int = PRUNE_RES) -> DataFrame:
    """Restrict a table that carries ``hex_prune`` to what the wanted tiles can show.

    On a store in blocks the folders that no tile touches are never opened: the join on ``block``
    prunes partitions at run time. Apply it to the scan, before any join or aggregate of the
    layer. It must not be applied to layers that normalise over all cells, nor to summaries.
    """
    if layer_res < prune_res or "hex_prune" not in source.columns:
        return source
    on = [c for c in ("block", "hex_prune") if c in source.columns]
    # the comparison marks the side as selective, without which partitions are not pruned
    keys = prune_keys(tiles, system, prune_res).where(F.col("block") >= 0).select(*on)
    # the coarse cells of the whole map bound the keys, however many tiles are asked for
    if system.size_at(prune_res) <= MOST_BROADCAST_CELLS:
        keys = F.broadcast(keys)
    return source.join(keys, on, "left_semi").select(source.columns)


def prune_one_tile(source: DataFrame, system: CellSystem, z: int, x: int, y: int,
                   layer_res: int, prune_res: int = PRUNE_RES) -> DataFrame:
    """:func:`prune_scan` for a single tile, as a filter that reaches folders and row groups.

    The covering set is read to the driver; it holds coarse cells alone, whose number
    does not grow with the data.
    """
    if layer_res < prune_res or "hex_prune" not in source.columns:
        return source
    tile = source.sparkSession.range(1).select(F.lit(z).alias("z"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    keys = prune_keys(tile, system, prune_res).collect()
    if not keys:
        return source.where(F.lit(False))
    found = source.where(F.col("hex_prune").isin([r["hex_prune"] for r in keys]))
    if "block" in source.columns:
        found = found.where(F.col("block").isin(sorted({r["block"] for r in keys})))
    return found


def layer_tiles(layers: list[tuple[DataFrame, int, dict[int, int]]], system: CellSystem,
                cap: int | None = None, unique: bool = False) -> DataFrame:
    """Checked layers to tile records: all rows, or the first ``cap`` of each tile.

    Each layer comes with the resolution of its cells and, per zoom, the resolution whose
    edge sets the buffer (finer than the cells' own where a store stops early). All are
    put together first, so a pyramid is one spread and one ranking.
    """
    parts = []
    for layer, res, zooms in layers:
        rows = layer if cap is None else count_copies(layer, unique)
        located = system.with_centroid(rows, res).where("lng IS NOT NULL AND lat IS NOT NULL")
        parts.append(aimed(located, list(zooms), {z: system.edge_deg(r) for z, r in zooms.items()}))
    tiled = to_tiles(reduce(DataFrame.unionByName, parts))
    return tile_records(tiled if cap is None else cap_tiles(tiled, cap))
