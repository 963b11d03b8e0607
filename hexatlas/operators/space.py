"""Boxes and polygons over cell centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hexatlas.session import written

Ring = list[tuple[float, float]]


def box_overlap(bbox: tuple[float, float, float, float]) -> Column:
    """Rows whose ``xmin, ymin, xmax, ymax`` meets a box; a box with west > east wraps."""
    west, south, east, north = bbox
    rows = (F.col("ymin") <= north) & (F.col("ymax") >= south)
    if west <= east:
        return rows & (F.col("xmin") <= east) & (F.col("xmax") >= west)
    return rows & ((F.col("xmax") >= west) | (F.col("xmin") <= east))


def inside_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: does a ray going east cross the ring an odd number of times?

    ``ring`` is an array of ``struct<lng, lat>``, first vertex not repeated at the end.
    """
    size = F.size(ring)
    edges = F.zip_with(
        ring, F.concat(F.slice(ring, F.lit(2), size - 1), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]
        # a level edge never spans, so its division is never evaluated
        return F.when(spans, lng < at).otherwise(F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crossed(e))


def cells_in_polygon(located: DataFrame, ring: Ring) -> DataFrame:
    """Cells whose centroid is inside one polygon; the box test comes first."""
    lngs, lats = [p[0] for p in ring], [p[1] for p in ring]
    vertices = F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat"))
                         for x, y in ring])
    near = located.where(F.col("lng").between(min(lngs), max(lngs))
                         & F.col("lat").between(min(lats), max(lats)))
    return near.where(inside_ring(F.col("lng"), F.col("lat"), vertices))


# Bin sides in degrees, coarsest first, and where the bin grid starts: no round figure, so that
# grid lines do not run through vertices or centroids.
BIN_SIDES = [32.0, 8.0, 2.0, 0.5, 0.125]
BIN_START = 0.00098765432101
LEAST_BINS = 256

_CROSSES = "((ay > {lat}) != (by > {lat}) AND {lng} < (bx - ax) * ({lat} - ay) / (by - ay) + ax)"
_EAST, _NORTH = f"({BIN_START}D + (_c + 1) * _s)", f"({BIN_START}D + (_r + 1) * _s)"


def _bin_no(v: str) -> str:
    return f"floor(({v} - {BIN_START}D) / _s)"


def _sided_edges(polygons: DataFrame) -> DataFrame:
    """``poly_id, _s, ax, ay, bx, by``: each edge, with its polygon's bin side.

    The side is the finest at which the polygon's box has no more than two bins per vertex (256
    at least), so bins are as many as vertices whatever the size of the polygon, and a polygon of
    few vertices does not meet every centroid far around it.
    """
    lngs, lats = F.transform("ring", lambda p: p["lng"]), F.transform("ring", lambda p: p["lat"])
    spans = polygons.groupBy("poly_id").agg(
        F.sum(F.size("ring")).alias("_k"), (F.max(F.array_max(lngs)) - F.min(F.array_min(lngs))).alias("_w"),
        (F.max(F.array_max(lats)) - F.min(F.array_min(lats))).alias("_h"))
    sides = ", ".join(f"{b!r}D" for b in BIN_SIDES)
    fit = f"filter(array({sides}), b -> (_w / b + 2) * (_h / b + 2) <= greatest({LEAST_BINS}, 2 * _k))"
    sided = spans.selectExpr("poly_id", f"coalesce(try_element_at({fit}, -1), {BIN_SIDES[0]!r}D) as _s")
    following = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = polygons.where(F.size("ring") > 0).select("poly_id", F.explode(F.arrays_zip(
        F.col("ring").alias("a"), following.alias("b"))).alias("e")).selectExpr(
        "poly_id", "e.a.lng as ax", "e.a.lat as ay", "e.b.lng as bx", "e.b.lat as by")
    return edges.join(sided, "poly_id")


def _edge_bins(edges: DataFrame) -> DataFrame:
    """Edges with each bin ``_r, _c`` that they pass, row by row of bins."""
    def at(lat: str) -> str:
        return f"(bx - ax) * (least(greatest({lat}, least(ay, by)), greatest(ay, by)) - ay) / (by - ay) + ax"

    low, high = f"({BIN_START}D + _r * _s)", _NORTH
    rows = edges.withColumn("_r", F.expr(f"explode(sequence({_bin_no('least(ay, by)')}, {_bin_no('greatest(ay, by)')}))"))
    # a level edge has no crossing to work out; a little is added for rounding
    ends = rows.selectExpr("*", f"if(ay = by, ax, {at(low)}) as _x", f"if(ay = by, bx, {at(high)}) as _y")
    wide = ends.withColumn("_c", F.expr(
        f"explode(sequence({_bin_no('least(_x, _y) - 1e-9D')}, {_bin_no('greatest(_x, _y) + 1e-9D')}))"))
    return wide.drop("_x", "_y")


def _odd_corners(edges: DataFrame) -> DataFrame:
    """``poly_id, _s, _r, _c`` of bins whose north-east corner is inside the polygon.

    An edge that passes the north line of a row of bins turns over all corners to its west.
    Corners of a row are told apart by where it is turned over an odd number of times.
    """
    met = edges.withColumn("_r", F.expr(f"explode(sequence({_bin_no('least(ay, by)')} - 1, {_bin_no('greatest(ay, by)')}))")).where(
        f"(ay > {_NORTH}) != (by > {_NORTH})").selectExpr(
        "poly_id", "_s", "_r", f"(bx - ax) * ({_NORTH} - ay) / (by - ay) + ax as _at").selectExpr(
        "poly_id", "_s", "_r", "_at", f"{_bin_no('_at')} as _c").selectExpr(
        "poly_id", "_s", "_r", f"case when {_EAST} < _at then _c when {_EAST} - _s < _at then _c - 1 else _c - 2 end as _c")
    turns = met.groupBy("poly_id", "_s", "_r", "_c").agg(F.count(F.lit(1)).alias("k")).where("k % 2 = 1")
    # no more turns than the polygon's box has columns
    lists = turns.groupBy("poly_id", "_s", "_r").agg(F.sort_array(F.collect_list("_c"), asc=False).alias("t"))
    spans = lists.selectExpr("poly_id", "_s", "_r", "explode(sequence(0, size(t) - 2, 2)) as i", "t").selectExpr(
        "poly_id", "_s", "_r", "explode(sequence(t[i + 1] + 1, t[i])) as _c")
    return spans


def cells_in_polygons(located: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs ``poly_id, cell_id`` for a table of polygons ``(poly_id, ring)``, each pair once.

    Rings of one ``poly_id`` are one polygon by the even-odd rule, so a ring inside another is a
    hole. Bins carry single edges, never a ring: a polygon of any number of vertices is spread
    over as many bins. From a centroid go north along its meridian's bin side to the bin's
    corner: only edges in the bin can be passed, and whether the corner is inside is known, so
    the parity at the centroid follows. A bin without edges is inside as a whole or not at all:
    its centroids are pairs as they are met, without an aggregation.
    """
    edges = written(_sided_edges(polygons), "polygon-edges")
    sides = [r["_s"] for r in edges.select("_s").distinct().collect()]
    if not sides:
        return polygons.select("poly_id").limit(0).crossJoin(located.select("cell_id").limit(0))
    place = ["poly_id", "_s", "_r", "_c"]
    # written, as both are read twice; merged, as a table of few polygons looks small enough to be sent whole
    crossed = written(_edge_bins(edges).select(*place, "ax", "ay", "bx", "by"), "polygon-bins")
    inside = written(_odd_corners(edges).select(*place), "polygon-corners")
    occupied = crossed.select(*place).distinct()
    corners = inside.join(occupied, place, "left_semi").selectExpr(
        *place, *[f"cast(null as double) as {c}" for c in ("ax", "ay", "bx", "by")])
    bins = crossed.unionByName(corners)
    listed = ", ".join(f"{b!r}D" for b in sides)
    points = located.select("cell_id", "lng", "lat").distinct().withColumn("_s", F.expr(f"explode(array({listed}))")).selectExpr(
        "*", f"{_bin_no('lat')} as _r", f"{_bin_no('lng')} as _c")

    def strip(x: str, y: str) -> str:
        return f"({x} > {_EAST} AND {y} > lat AND NOT {y} > {_NORTH})"

    # the edge is passed on the way to the corner, whose own parity is the row without an edge
    passed = (f"({_CROSSES.format(lat='lat', lng='lng')} != {_CROSSES.format(lat=_NORTH, lng=_EAST)}) "
              f"!= ({strip('ax', 'ay')} != {strip('bx', 'by')})")
    met = points.join(bins.hint("merge"), ["_s", "_r", "_c"]).selectExpr("poly_id", "cell_id", "lng", "lat", f"if(ax is null or {passed}, 1, 0) as _p")
    parted = met.groupBy("poly_id", "cell_id", "lng", "lat").agg(F.sum("_p").alias("_p")).where("_p % 2 = 1").select("poly_id", "cell_id")
    whole = points.join(inside.join(occupied, place, "left_anti").hint("merge"), ["_s", "_r", "_c"]).select("poly_id", "cell_id")
    return whole.unionByName(parted)


def ring_meets_box(ring: Ring, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Do a polygon and a box share a point?

    An edge touches the box (their extents overlap and the box's corners are not all on one
    side of the edge), which includes a vertex inside the box, or the box lies inside the ring.
    """
    touched = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        sides = [F.lit(bx - ax) * (y - F.lit(ay)) - F.lit(by - ay) * (x - F.lit(ax)) for x in (xmin, xmax) for y in (ymin, ymax)]
        touched = touched | ((xmin <= max(ax, bx)) & (xmax >= min(ax, bx)) & (ymin <= max(ay, by)) & (ymax >= min(ay, by))
                             & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))
    vertices = F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in ring])
    return touched | inside_ring(xmin, ymin, vertices)


def box_meets_ring(ring: Ring) -> Column:
    """Rows whose ``xmin, ymin, xmax, ymax`` meets a polygon, on either side of the antimeridian.

    A box with ``xmin > xmax`` passes it, and a ring may go on beyond 180 degrees; both are
    compared a turn to either side. The extents come first, so that they reach the scan.
    """
    west, east = min(p[0] for p in ring), max(p[0] for p in ring)
    south, north = min(p[1] for p in ring), max(p[1] for p in ring)
    far = F.when(F.col("xmin") > F.col("xmax"), F.col("xmax") + 360.0).otherwise(F.col("xmax"))
    met = F.lit(False)
    for turn in (0.0, 360.0, -360.0):
        left, right = F.col("xmin") + turn, far + turn
        met = met | ((left <= east) & (right >= west) & ring_meets_box(ring, left, F.col("ymin"), right, F.col("ymax")))
    return (F.col("ymin") <= north) & (F.col("ymax") >= south) & met
