"""Tile assignment, capping and pruning against brute force."""

import json
import math

import pytest
from pyspark.sql import functions as F

from hexatlas.functions.systems import Hexagons, Lattice
from hexatlas.operators import tiling as T
from hexatlas.operators.layers import hex_layer
from hexatlas.plans.hex_tiles import checked_res, pyramid, single_tile

LAT = Lattice()


def box(z, x, y):
    n = 2 ** z
    lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, (x + 1) / n * 360 - 180, lat(y + 1), lat(y)


def brute(points, z, b):
    """Every (point, tile) pair by testing all of them."""
    out = set()
    for x in range(2 ** z):
        for y in range(2 ** z):
            w, e, s, n = box(z, x, y)
            w, e, s, n = (round(v, 10) for v in (w - b, e + b, s - b, n + b))
            for i, (lng, lat) in enumerate(points):
                if s <= lat <= n and any(w <= lng + t <= e for t in (0, 360, -360)):
                    out.add((i, x, y))
    return out


@pytest.mark.parametrize("z,b", [(0, 1.0), (1, 200.0), (2, 5.625), (3, 0.5), (4, 11.25), (4, 30.0)])
def test_assignment_equals_brute_force(spark, z, b):
    points = [(((k * 137507) % 360000 - 180000) / 1000, ((k * 61803) % 180000 - 90000) / 1000)
              for k in range(150)]
    points += [(-180.0, 0.0), (180.0, 0.0), (179.999, 66.6), (0.0, 90.0), (0.0, -90.0), (0.0, 85.06),
               (-180.0, -85.05112877), (45.0, 0.0), (90.0, 66.51326044311186), (5.625, 5.625)]
    df = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(points)], "i int, lng double, lat double")
    rows = T.to_tiles(T.aimed(df, [z], b, edges=1.0)).collect()
    got = [(r["i"], r["x"], r["y"]) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == brute(points, z, b)


def test_duplicate_rows_stay_and_wraps_do_not_multiply(spark):
    layer = spark.createDataFrame([(LAT_CELL, 1.0, 1), (LAT_CELL, 1.0, 1)], "cell_id bigint, value double, n bigint")
    got = T.layer_tiles([(layer, 1, {0: 1})], LAT).collect()
    assert len(got) == 2


LAT_CELL = (1 << 52) | (0 << 26) | 4


def test_cap_keeps_the_first_rows_by_cell_and_counts_copies(spark):
    rows = [(c, float(c % 3), c) for c in range(500)] + [(7, 1.0, 7)] * 40
    layer = spark.createDataFrame(rows, "cell_id bigint, value double, n bigint").selectExpr("0 z", "0 x", "0 y", "*")
    for cap in (1, 10, 48, 300, 10000):
        counted = layer.groupBy("z", "x", "y", "cell_id", "value", "n").agg(F.count(F.lit(1)).alias("_copies"))
        got = [tuple(r) for r in T.cap_tiles(counted, cap, salt_rows=60).select("cell_id", "value", "n").collect()]
        assert sorted(got) == sorted(rows)[:cap]


def test_tasks_cut_tiles_before_the_shuffle(spark):
    rows = spark.range(100_000).selectExpr("int(id div 1000000) z", "int(id div 1000000) x", "int(id div 1000000) y", "id cell_id", "1D value", "1L n", "id % 3 + 1 _copies")
    capped = T.cap_tiles(rows, 50, salt_rows=10_000)
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3 and "Partial" in plan
    got = capped.orderBy("cell_id").collect()
    assert len(got) == 50 and {r["n_total"] for r in got} == {199_999} and [r["cell_id"] for r in got[:7]] == [0, 1, 1, 2, 2, 2, 3]


def test_a_third_of_all_rows_in_one_copy(spark):
    hot = spark.range(200_000).selectExpr(f"{LAT_CELL}L cell_id", "1D value", "1L n")
    rest = spark.range(400).selectExpr(f"(1L << 52) | ((id div 8 % 8) << 26) | (id % 8) cell_id", "2D value", "id n")
    capped = T.layer_tiles([(hot.unionByName(rest), 1, {0: 1})], LAT, cap=1000)
    assert capped.count() == 1000


def test_single_tile_equals_its_part_of_the_pyramid(spark):
    layer = lambda res: spark.range(3000).selectExpr(
        f"({res}L << 52) | ((id * 7919 % {LAT.side(res)}) << 26) | (id * 104729 % {LAT.side(res)}) cell_id",
        "id + 0.5D value").groupBy("cell_id").agg(F.max("value").alias("value"))
    whole = pyramid(layer, LAT, [2, 3])
    one = single_tile(layer, LAT, 3, 0, 4)
    part = whole.where("z = 3 AND x = 0 AND y = 4").select("h3id", "value", "n")
    assert one.count() > 0 and one.exceptAll(part).count() == 0 and part.exceptAll(one).count() == 0


def test_requests_off_the_map_or_scale_are_refused(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "lng double, lat double")
    with pytest.raises(ValueError):
        T.one_tile(df, 2, 4, 0, 1.0)
    with pytest.raises(ValueError):
        checked_res(3, 11)
    assert checked_res(3, None) == 2


def test_documents_leave_out_null_counts(spark):
    rec = spark.createDataFrame([(3, 2, 5, "cell-b", -7.25, None), (3, 2, 5, "cell-c", 0.0, 4), (3, 2, 5, "cell-a", 31.0, 0)],
                                "z int, x int, y int, h3id string, value double, n bigint")
    body = json.loads(T.tile_documents(rec).head()["body"])
    assert [sorted(c) for c in body["cells"]] == [["h3id", "n", "value"], ["h3id", "value"], ["h3id", "n", "value"]]
    assert [(c["h3id"], c["value"], c.get("n")) for c in body["cells"]] == [
        ("cell-a", 31.0, 0), ("cell-b", -7.25, None), ("cell-c", 0.0, 4)]
    with pytest.raises(ValueError):
        T.tile_documents(rec.drop("n"))


def tiles_of(spark, *tiles):
    return spark.createDataFrame(list(tiles), "z int, x int, y int")


def test_covering_equals_brute_force_across_the_antimeridian(spark):
    tiles = [(4, 3, 5), (5, 20, 11), (7, 64, 64), (10, 500, 300), (4, 0, 5), (4, 15, 8), (2, 1, 1)]
    got = {tuple(r) for r in T.covering(tiles_of(spark, *tiles), LAT).collect()}
    margin, want = LAT.edge_deg(3) * 2, set()
    dim = [tuple(r) for r in LAT.dimension(spark, 3).select("cell_id", "lng", "lat").collect()]
    for z, x, y in tiles:
        w, e, s, n = box(z, x, y)
        s, n = max(-89.9, s - margin), min(89.9, n + margin)
        want |= {(z, x, y, c) for c, lng, lat in dim
                 if any(w - margin <= lng + turn <= e + margin for turn in (-360, 0, 360)) and s <= lat <= n}
    assert got == want
    seam = {t[3] for t in got if t[:2] == (4, 0)}
    assert {lng > 170 for c, lng, _ in dim if c in seam} == {True, False}


@pytest.mark.parametrize("tiles", [[(5, 20, 11), (6, 30, 30)], [(5, 20, 11), (5, 0, 9)]])
def test_pruned_scan_gives_the_same_tiles(spark, tiles):
    asked = tiles_of(spark, *tiles)
    source = spark.range(20000).selectExpr("id * 137507 % 360000 - 180000 x", "id * 61803 % 160000 - 80000 y").select(
        LAT.cell_at(F.col("x"), F.col("y"), 6).alias("cell_id"), LAT.cell_at(F.col("x"), F.col("y"), 3).alias("hex_prune"),
        (F.col("x") % 10).cast("double").alias("value"))

    def drawn(rows):
        layer = rows.groupBy("cell_id").agg(F.sum("value").alias("value"))
        located = LAT.with_centroid(hex_layer(layer), 6)
        return T.to_tiles(T.aimed(located, sorted({t[0] for t in tiles}), LAT.edge_deg(6))).join(asked, T.TILE, "left_semi")

    pruned = T.prune_scan(source, asked, LAT, layer_res=6)
    a, b = drawn(source), drawn(pruned.select("cell_id", "value"))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert pruned.count() < source.count() / 5
    assert T.prune_keys(asked, LAT).count() < LAT.dimension(spark, 3).count() / 5


def test_prune_is_skipped_below_its_resolution_and_without_the_column(spark):
    df = spark.range(3).selectExpr("id cell_id", "id hex_prune")
    asked = tiles_of(spark, (2, 1, 1))
    assert T.prune_scan(df, asked, LAT, layer_res=2) is df
    assert T.prune_scan(df.drop("hex_prune"), asked, LAT, layer_res=5).columns == ["cell_id"]


def test_one_tile_prune_reaches_the_files(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 137507 % 360000 - 180000 x", "id * 61803 % 160000 - 80000 y").select(
        LAT.cell_at(F.col("x"), F.col("y"), 7).alias("cell_id"), LAT.cell_at(F.col("x"), F.col("y"), 3).alias("hex_prune"))
    rows.write.parquet(str(tmp_path / "s"))
    pruned = T.prune_one_tile(spark.read.parquet(str(tmp_path / "s")), LAT, 8, 90, 120, layer_res=7)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "In(hex_prune" in plan and 0 < pruned.count() < 2000


def files_read(df):
    """Files that the scans of an executed query opened, by their own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, pending = 0, [plan]
    while pending:
        node = pending.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            pending.append(node.executedPlan())
        elif kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            pending.append(node.plan())
        elif kind == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return total


class Fine(Lattice):
    block_res = 1


def test_ten_tiles_open_few_files_of_a_store(spark, tmp_path):
    from hexatlas.sources.stores import write_blocks

    path = str(tmp_path / "blocks")
    rows = spark.range(40_000).selectExpr("id * 137507 % 360000 - 180000 x", "id * 61803 % 160000 - 80000 y").select(
        LAT.cell_at(F.col("x"), F.col("y"), 6).alias("cell_id"), LAT.cell_at(F.col("x"), F.col("y"), 3).alias("hex_prune"),
        (F.col("x") % 10).cast("double").alias("value"))
    write_blocks(rows, path, Fine())
    stored = spark.read.parquet(path)
    whole = files_read(stored.select("value"))
    asked = tiles_of(spark, *[(8, 120 + i % 5, 100 + i // 5) for i in range(10)])
    pruned = T.prune_scan(stored, asked, Fine(), layer_res=6)
    # every file of the folders that the ten tiles touch, and of no other
    touched = {r["block"] for r in T.prune_keys(asked, Fine()).collect()}
    in_touched = files_read(stored.where(F.col("block").isin(list(touched))).select("value"))
    assert 0 < len(touched) <= 6 and 0 < files_read(pruned) == in_touched <= whole / 10
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()
    plain = T.prune_scan(rows, asked, Fine(), layer_res=6)
    assert pruned.count() > 0 and pruned.drop("block").exceptAll(plain).count() == 0 == plain.exceptAll(pruned.drop("block")).count()


def test_curve_is_the_interleaved_bits_and_files_are_compact(spark, tmp_path):
    cells = [LAT.pack(5, F.lit(x).cast("long"), F.lit(y).cast("long")) for x, y in ((0, 0), (0, 1), (1, 0), (3, 5), (127, 127))]
    got = [spark.range(1).select(LAT.curve(c).alias("c")).first()["c"] for c in cells]
    def curve(x, y):
        return sum(((x >> i & 1) << 2 * i + 1) | ((y >> i & 1) << 2 * i) for i in range(26))
    assert got == [curve(0, 0), curve(0, 1), curve(1, 0), curve(3, 5), curve(127, 127)]
    big = spark.range(1).select(LAT.curve(F.lit((24 << 52) | ((1 << 26) - 1 << 26) | ((1 << 26) - 1)).cast("long")).alias("c"))
    assert big.first()["c"] == curve((1 << 26) - 1, (1 << 26) - 1)


def test_rows_coarser_than_the_prune_column_have_no_block(spark, tmp_path):
    from hexatlas.sources.stores import write_cell_index

    rows = spark.createDataFrame([(1, 5, None), (3, (3 << 52) | (7 << 26) | 9, (3 << 52) | (7 << 26) | 9)],
                                 "res int, cell_id bigint, hex_prune bigint")
    write_cell_index(rows, str(tmp_path / "i"), LAT)
    back = {r["res"]: r["block"] for r in spark.read.parquet(str(tmp_path / "i")).collect()}
    assert back == {1: None, 3: 1}


def test_a_large_tile_is_documents_of_bounded_parts(spark, tmp_path):
    from hexatlas.sources.stores import write_tile_documents

    hot = spark.range(200_000).selectExpr("1 z", "0 x", "1 y", "concat('c', id div 3) h3id", "id % 7 + 0.5D value", "id n")
    same = spark.range(60_000).selectExpr("1 z", "1 x", "1 y", "'c' h3id", "1D value", "1L n")
    small = spark.createDataFrame([(2, 3, 3, "a", 1.0, None)], "z int, x int, y int, h3id string, value double, n bigint")
    records = hot.union(same).union(small)
    path = str(tmp_path / "docs")
    write_tile_documents(T.tile_documents(records, part_rows=5000), path)
    docs = spark.read.parquet(path)
    index = {(r["z"], r["x"], r["y"]): (r["parts"], r["n_records"]) for r in T.tile_index(docs).collect()}
    assert index == {(1, 0, 1): (40, 200_000), (1, 1, 1): (12, 60_000), (2, 3, 3): (1, 1)}
    assert docs.agg(F.max("n_records")).first()[0] < 5600
    assert docs.where("z = 1 AND x = 0").select("part").distinct().count() == 40
    back = docs.select("z", "x", "y", F.explode(F.from_json("body", "cells array<struct<h3id:string,value:double,n:bigint>>")["cells"]).alias("c"))
    back = back.select("z", "x", "y", "c.h3id", "c.value", "c.n")
    assert back.exceptAll(records).count() == 0 and records.exceptAll(back).count() == 0
    assert T.tile_documents(records.limit(0)).count() == 0


def test_hexagons_take_centroids_from_the_dimension(spark):
    dim = spark.createDataFrame([(0x85283473FFFFFFF, 5, -122.0, 37.3), (0x832834FFFFFFFFF, 3, -121.0, 38.0)],
                                "cell_id bigint, res int, lng double, lat double")
    layer = spark.createDataFrame([(0x85283473FFFFFFF, 1.5)], "cell_id bigint, value double")
    rows = single_tile(lambda res: layer, Hexagons(dim), 8, 41, 99, res=5).collect()
    assert [tuple(r) for r in rows] == [("85283473fffffff", 1.5, None)]
    whole = pyramid(lambda res: layer, Hexagons(dim), [6]).collect()
    assert {r["h3id"] for r in whole} == {"85283473fffffff"}


def test_stored_tile_reads_little_and_loses_nothing(spark, tmp_path):
    from hexatlas.plans import index_store
    from hexatlas.plans.hex_tiles import stored_tile

    occ = spark.range(30000).selectExpr("id * 137507 % 360000 - 180000 x", "id * 61803 % 160000 - 80000 y", "id").select(
        LAT.cell_at(F.col("x"), F.col("y"), 7).alias("cell_id"), (F.col("id") % 11).alias("aphiaid"), F.lit("p").alias("phylum"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("class"), F.lit("o").alias("order"), (F.col("id") % 5 + 2000).cast("int").alias("date_year"))
    base = str(tmp_path / "store")
    index_store.build(occ, LAT, base)
    for filters in ({}, {"taxon": ("class", "c1")}, {"years": (2001, 2003)}):
        got = stored_tile(spark, base, "n", LAT, 6, 40, 30, **filters)
        want = single_tile(index_store.layer(spark, base, "n", LAT, **filters), LAT, 6, 40, 30)
        assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hex_prune INSET" in plan or "hex_prune IN" in plan or "In(hex_prune" in plan
        folders = [line for line in plan.splitlines() if "PartitionFilters" in line]
        assert folders and ("taxon" in filters or all(
            "block" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in folders))
    with pytest.raises(ValueError):
        index_store.layer(spark, base, "weight")


def test_deep_zooms_draw_the_finest_cells_with_their_own_buffer(spark):
    cell = (7 << 52) | (256 << 26) | 256        # centroid a hair east and north of 0, 0
    layer = lambda res: spark.createDataFrame([(cell, float(res))], "cell_id bigint, value double")
    rows = pyramid(layer, LAT, [11, 12], top=7).collect()
    half = LAT.edge_deg(7) / 2
    want = {(z, x, y) for z, drawn in ((11, 9), (12, 10))
            for (_, x, y) in brute_near(half, half / 2, z, LAT.edge_deg(drawn) * 1.5)}
    assert {(r["z"], r["x"], r["y"]) for r in rows} == want and {r["value"] for r in rows} == {7.0}


def brute_near(lng, lat, z, b):
    n = 2 ** z
    mid = n // 2
    return {(0, x, y) for x in range(mid - 12, mid + 12) for y in range(mid - 12, mid + 12)
            if box(z, x, y)[0] - b <= lng <= box(z, x, y)[1] + b and box(z, x, y)[2] - b <= lat <= box(z, x, y)[3] + b}


def test_a_tile_keeps_more_than_fifty_thousand_cells(spark):
    layer = spark.range(60_000).select(LAT.cell_at((F.col("id") % 300) * 1000 - 150_000, (F.col("id") / 300).cast("long") * 600 - 60_000, 9)
                                       .alias("cell_id"), F.col("id").cast("double").alias("value"))
    cells = layer.select("cell_id").distinct().count()
    assert cells > 50_000
    assert pyramid(lambda res: layer, LAT, [0], res=9).count() == 60_000
    cut = T.layer_tiles([(hex_layer(layer), 9, {0: 9})], LAT, cap=100)
    assert cut.count() == 100 and {r[0] for r in cut.select("n_total").distinct().collect()} == {60_000}
