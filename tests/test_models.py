"""Model ids, keys, footprints, search, areas and polygons."""

import pytest
from pyspark.sql import functions as F

from hexatlas.operators import models as M
from hexatlas.operators import space
from hexatlas.operators.space import cells_in_polygon, cells_in_polygons

STAR = [(0.0, 10.0), (3.0, 3.0), (10.0, 3.0), (4.0, -2.0), (7.0, -9.0), (0.0, -5.0), (-7.0, -9.0), (-4.0, -2.0), (-10.0, 3.0), (-3.0, 3.0)]


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def grid(spark):
    return spark.range(41 * 41).selectExpr("id cell_id", "(id % 41) * 0.55D - 11.02D lng", "(id div 41) * 0.55D - 11.03D lat")


def test_polygon(spark):
    pts = [tuple(r) for r in grid(spark).collect()]
    want = {c for c, x, y in pts if inside(x, y, STAR)}
    assert {r["cell_id"] for r in cells_in_polygon(grid(spark), STAR).collect()} == want and len(want) > 100


RINGS = "poly_id int, ring array<struct<lng:double,lat:double>>"


def pairs(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_many_polygons(spark):
    rings = {i: [(x / 2 + i, y / 2 - i) for x, y in STAR] for i in range(5)}
    rings |= {5: [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], 6: [(-3.0, -3.0), (-3.0, 4.0), (2.0, -3.0)],
              7: [(x * 12, y * 12) for x, y in STAR], 8: [(1.0, 1.0), (2.0, 2.0)], 9: [(1.0, 1.0)], 10: [],
              11: [(0.11, 0.11), (0.11, 0.12), (0.12, 0.11)], 12: [(32.00098765432101, -40.0), (32.00098765432101, 40.0), (-0.5, 0.3)]}
    polys = spark.createDataFrame(list(rings.items()), RINGS)
    pts = [tuple(r) for r in grid(spark).collect()]
    want = {(i, c) for i, r in rings.items() if r for c, x, y in pts if inside(x, y, r)}
    assert {i for i, _ in want} >= {0, 1, 2, 3, 4, 5, 6, 7, 12}
    assert pairs(cells_in_polygons(grid(spark).union(grid(spark)), polys)) == want
    assert cells_in_polygons(grid(spark), polys.limit(0)).count() == 0
    assert cells_in_polygons(grid(spark).limit(0), polys).count() == 0


def test_random_polygons_of_every_bin_size(spark):
    import random
    rng = random.Random(9)
    rings = {}
    for i, (reach, n) in enumerate(((40, 5), (11, 60), (3, 200), (0.8, 12), (170, 2500), (11, 7), (11, 1500))):
        cx, cy = rng.uniform(-4, 4), rng.uniform(-4, 4)
        rings[i] = [(cx + rng.uniform(-reach, reach), cy + rng.uniform(-reach / 2, reach / 2)) for _ in range(n)]
    polys = spark.createDataFrame(list(rings.items()), RINGS)
    pts = [tuple(r) for r in grid(spark).collect()][::3]
    want = {(i, c) for i, r in rings.items() for c, x, y in pts if inside(x, y, r)}
    assert pairs(cells_in_polygons(grid(spark).where("cell_id % 3 = 0"), polys)) == want and len(want) > 500


def test_a_ring_of_a_hundred_thousand_vertices_and_a_hole(spark):
    import math
    turn = [2 * math.pi * i / 100_000 for i in range(100_000)]
    outer = [(10 * math.cos(t) * (1 + 0.05 * math.sin(50 * t)), 10 * math.sin(t) * (1 + 0.05 * math.sin(50 * t))) for t in turn]
    hole = [(4 * math.cos(t), 4 * math.sin(t)) for t in turn[::100]]
    polys = spark.createDataFrame([(1, outer), (1, hole)], RINGS)
    got = pairs(cells_in_polygons(grid(spark), polys))
    for c, x, y in [tuple(r) for r in grid(spark).collect()]:
        r, t = math.hypot(x, y), math.atan2(y, x)
        edge = 10 * (1 + 0.05 * math.sin(50 * t))
        if abs(r - edge) > 0.01 and abs(r - 4) > 0.01:
            assert ((1, c) in got) == (4 < r < edge)
    from hexatlas.operators import space
    bins = space._edge_bins(space._sided_edges(polys))
    assert not [t for _, t in bins.dtypes if t.startswith("array")]
    per_bin = bins.groupBy("poly_id", "_s", "_r", "_c").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert per_bin[0] < 2000 and per_bin[1] < 2 * 101_000


def test_search_by_polygon(spark):
    from hexatlas.operators.space import box_meets_ring
    import random
    rng = random.Random(3)

    def near(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def cross(a, b, c, d):
        return near(c, a, b) * near(d, a, b) <= 0 and near(a, c, d) * near(b, c, d) <= 0 and \
            max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and \
            max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1]))

    def meets(box, ring):
        w, s, e, n = box
        e = e + 360 if w > e else e
        for turn in (-360, 0, 360):
            corners = [(w + turn, s), (e + turn, s), (e + turn, n), (w + turn, n)]
            if any(inside(*c, ring) for c in corners) or any(w + turn <= x <= e + turn and s <= y <= n for x, y in ring):
                return True
            if any(cross(a, b, c, d) for a, b in zip(ring, ring[1:] + ring[:1]) for c, d in zip(corners, corners[1:] + corners[:1])):
                return True
        return False

    boxes = [(rng.uniform(-180, 180), rng.uniform(-80, 70), rng.uniform(0, 60), rng.uniform(0, 30)) for _ in range(400)]
    boxes = [(w, s, w + dw if w + dw <= 180 else w + dw - 360, s + dh) for w, s, dw, dh in boxes]
    boxes += [(-0.5, -0.5, 0.5, 0.5), (20.0, 20.0, 20.0, 20.0), (-179.0, -5.0, -178.0, 5.0)]
    it = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "i int, xmin double, ymin double, xmax double, ymax double")
    for ring in (STAR, [(x * 9, y * 5) for x, y in STAR], [(150.0, -30.0), (205.0, -42.0), (188.0, 3.0), (216.0, 20.0), (170.0, 37.0)]):
        want = {i for i, b in enumerate(boxes) if meets(b, ring)}
        assert {r["i"] for r in it.where(box_meets_ring(ring)).select("i").collect()} == want and 0 < len(want) < len(boxes)
    assert any(w > e for w, _, e, _ in boxes)


def test_registry_and_keys(spark):
    cells = spark.createDataFrame([("b|2", 1, 1.0), ("a|1", 1, 2.0), ("b|2", 2, 3.0)], "mdl_key string, cell_id int, val double")
    reg = M.model_registry(cells)
    assert {tuple(r) for r in reg.collect()} == {("a|1", 1), ("b|2", 2)}
    asked = spark.createDataFrame([("b|2",), ("zz",), ("zz",)], "mdl_key string")
    assert [tuple(r) for r in M.resolve_keys(asked, reg).collect()] == [("b|2", 2)]
    assert [tuple(r) for r in M.unknown_keys(asked, reg).collect()] == [("zz",)]
    assert M.keyed_by_id(cells, reg).columns == ["mdl_id", "cell_id", "val"]


def items(spark):
    boxes = spark.createDataFrame([("m1", -10.0, -5.0, 10.0, 5.0), ("m2", 170.0, 0.0, 179.0, 5.0), ("m3", -179.0, 0.0, -170.0, 5.0),
                                   ("m4", 20.0, 20.0, 30.0, 30.0)], "mdl_key string, xmin double, ymin double, xmax double, ymax double")
    return M.catalogue_items(boxes, F.concat(F.lit("s3/"), "mdl_key"), F.when(F.col("mdl_key") == "m4", "b").otherwise("a"))


def found(df):
    return sorted(r["item_id"] for r in df.collect())


def test_search(spark):
    it = items(spark)
    assert found(M.search(it, bbox=(10.0, 5.0, 20.0, 20.0))) == ["m1", "m4"]      # touching counts
    assert found(M.search(it, bbox=(10.1, 5.1, 19.9, 19.9))) == []
    assert found(M.search(it, bbox=(175.0, -1.0, -175.0, 1.0))) == ["m2", "m3"]   # across the antimeridian
    assert found(M.search(it, ["b"])) == ["m4"]
    assert it.where("item_id = 'm2'").head()["href"] == "s3/m2"


def test_pages(spark):
    it = spark.range(100, 125).selectExpr("cast(id as string) item_id")
    seen, after = [], None
    while True:
        rows = M.page(it, 10, after).collect()
        if not rows:
            break
        assert {r["number_matched"] for r in rows} == {25} and {r["number_returned"] for r in rows} == {len(rows)}
        seen += [r["item_id"] for r in rows]
        after = seen[-1]
    assert seen == [str(i) for i in range(100, 125)]


def test_footprints_and_area_reports(spark):
    located = spark.createDataFrame([("m", 1.0, 2.0), ("m", -3.0, 4.0), ("k", 0.0, 0.0)], "mdl_key string, lng double, lat double")
    got = {r["mdl_key"]: tuple(r)[1:] for r in M.footprints(located, 0.25, 0.5).collect()}
    assert got == {"m": (-3.25, 1.5, 1.25, 4.5, 2), "k": (-0.25, -0.5, 0.25, 0.5, 1)}
    area = spark.createDataFrame([(1,), (2,), (2,)], "cell_id int")
    scores = spark.createDataFrame([(1, "bird", 2.0), (2, "bird", 4.0), (3, "bird", 90.0), (1, "fish", None)],
                                   "cell_id int, metric string, value double")
    assert {tuple(r) for r in M.scores_for_cells(scores, area).collect()} == {("bird", 3.0, 2), ("fish", None, 0)}
    cm = spark.createDataFrame([(1, "m", 1.0), (2, "m", 2.0), (3, "k", 5.0)], "cell_id int, mdl_key string, val double")
    assert [tuple(r) for r in M.species_for_cells(cm, area).collect()] == [("m", 2, 1.5)]


def test_a_polygon_of_few_vertices_meets_few_centroids_outside(spark):
    """Bins of a diamond hold a few times the centroids that are inside, not all of a third of the map."""
    polys = spark.createDataFrame([(1, [(12.0, 0.0), (0.0, 8.0), (-12.0, 0.0), (0.0, -8.0)])], "poly_id int, ring array<struct<lng: double, lat: double>>")
    edges = space._sided_edges(polys)
    side = edges.select("_s").distinct().head()[0]
    bins = space._edge_bins(edges).select("_r", "_c").union(space._odd_corners(edges).select("_r", "_c")).distinct().count()
    assert bins <= space.LEAST_BINS and bins * side * side < 3 * 2 * 12 * 8
    points = spark.range(120 * 80).selectExpr("id as cell_id", "(id % 120) * 0.25 - 14.913 as lng", "floor(id / 120) * 0.25 - 9.887 as lat")
    want = {r["cell_id"] for r in points.where("abs(lng) / 12 + abs(lat) / 8 < 1").collect()}
    got = [r["cell_id"] for r in cells_in_polygons(points, polys).collect()]
    assert set(got) == want and len(got) == len(want) > 2000
