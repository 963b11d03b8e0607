"""Registries, stores, releases and the shared folder."""

import json

import pytest
from pyspark.sql import functions as F

from hexatlas import session
from hexatlas.functions.systems import Lattice
from hexatlas.sources import registry as G, releases as V, stores as W


def test_registry_entries():
    assert G.checked_registry([(" a ", "s3a://store/x"), ("b", " /y ")]) == {"a": "s3a://store/x", "b": "/y"}
    with pytest.raises(ValueError, match="unnamed: '/q'; without a path: 'c', 'd'; repeated: 'a'"):
        G.checked_registry([("a", "/1"), ("a", "/2"), ("", "/q"), ("c", ""), ("d", None)])
    with pytest.raises(ValueError, match="empty"):
        G.checked_registry([])


def test_tables_and_prune_columns(spark, tmp_path):
    for name, cols in (("t_b", "id cell_id, id HEX_PRUNE"), ("t_a", "id cell_id")):
        spark.range(3).selectExpr(*cols.split(", ")).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert G.discover(spark, str(tmp_path)) == ["t_a", "t_b"]
    assert G.attach(spark, str(tmp_path), ["t_b", "t_a"]) == ["t_a", "t_b"]
    assert [tuple(r) for r in G.table_list(spark, ["t_a", "t_b"]).collect()] == [("t_a", 1, None), ("t_b", 2, "HEX_PRUNE")]
    assert G.prune_tables(spark, ["t_a", "t_b"]) == {"t_b": "hex_prune"}
    info = G.describe(spark, {"z": "/1", "a": "/2"}, "z")
    assert info["datasets"] == ["a", "z"] and len(info["res_columns"]) == 10 and {"t_a", "t_b"} <= set(info["tables"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_store_reads_one_partition(spark, tmp_path):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id % 50 + 2) mdl_id", "id cell_id", "id * 1.5D val")
    path = str(tmp_path / "m")
    W.write_model_cells(rows, path)
    one = W.read_model(spark, path, 1)
    assert "PartitionFilters: [isnotnull(mdl_id" in plan(one) and "mdl_id#" in plan(one)
    assert one.count() == 1000 and one.columns == ["cell_id", "value"]
    assert spark.read.parquet(path).count() == 3000


def test_an_oversized_model_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        rows = spark.range(0, 200_000, 1, 8).selectExpr("7 mdl_id", "id cell_id", "rand(1) val")
        W.write_model_cells(rows, str(tmp_path / "hot"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = list((tmp_path / "hot" / "mdl_id=7").glob("*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "hot")).count() == 200_000


def test_cell_store_is_sorted_within_its_squares(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 7919 % 500 + 1 cell_id", "concat('m', id % 10) mdl_key", "1D val")
    W.write_cell_models(rows, str(tmp_path / "c"), columns=25, step=10)
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 5000
    squares = {(r["cell_id"], r["block"]) for r in back.select("cell_id", "block").distinct().collect()}
    assert squares == {(c + 1, c // 25 // 10 * 3 + c % 25 // 10) for c in range(500)}
    spans = back.groupBy(F.input_file_name(), "block").agg(F.min("cell_id").alias("a"), F.max("cell_id").alias("b")).orderBy("block", "a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]) if x["block"] == y["block"])


def test_an_area_opens_the_squares_it_touches(spark, tmp_path):
    from hexatlas.operators.models import species_for_cells
    from tests.test_tiling import files_read

    rows = spark.range(20_000).selectExpr("id * 7919 % 10000 + 1 cell_id", "concat('m', id % 7) mdl_key", "id % 5 + 0D val")
    W.write_cell_models(rows, str(tmp_path / "c"), columns=100, step=10)
    stored = spark.read.parquet(str(tmp_path / "c"))
    # an area without any filter of its own: cells of three squares
    area = spark.createDataFrame([(c,) for c in (1, 2, 205, 5051, 9999, 9999)], "cell_id long")
    found = species_for_cells(stored, area, W.grid_block(F.col("cell_id"), 100, 10))
    want = species_for_cells(rows, area)
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 0
    touched = spark.range(1).select(*[W.grid_block(F.lit(c), 100, 10).alias(f"c{c}") for c in (1, 2, 205, 5051, 9999)]).first()
    assert len(set(touched)) == 3
    inside = files_read(stored.where(F.col("block").isin(list(set(touched)))).select("val"))
    assert 0 < files_read(found) == inside < files_read(stored.select("val")) / 10
    assert "dynamicpruning" in plan(found)


def test_clustered_stores_prune(spark, tmp_path):
    occ = spark.range(1000).selectExpr("id % 3 * 2 + 3 res", "id cell_id", "id % 9 aphiaid", "'p' phylum", "concat('c', id % 4) class",
                                       "'o' `order`", "2000 date_year", "1L records", "id % 5 hex_prune")
    W.write_occurrence_store(occ, str(tmp_path / "occ"), Lattice())
    read = spark.read.parquet(str(tmp_path / "occ")).where("res = 5 AND class = 'c1'")
    text = plan(read)
    assert "PartitionFilters: [isnotnull(res" in text and "EqualTo(class,c1)" in text
    W.write_cell_index(occ, str(tmp_path / "idx"), Lattice())
    W.write_taxon_index(occ.withColumnsRenamed({"phylum": "rank", "class": "taxon"}), str(tmp_path / "tax"), Lattice())
    assert spark.read.parquet(str(tmp_path / "tax")).where("rank = 'p'").count() == 1000
    view = W.serve(spark, str(tmp_path / "idx"), "idx_view")
    assert spark.sql("SELECT count(*) c FROM idx_view").head()["c"] == view.count() == 1000


def test_releases(spark, tmp_path):
    base = str(tmp_path / "rel")
    for name, n in (("v20240101", 3), ("v20250101", 5)):
        W.write_release(spark.range(n), base, name)
    assert W.read_release(spark, base).count() == 5
    assert W.read_release(spark, base, "v20240101").count() == 3
    assert all("release=v20250101" in f for f in W.read_release(spark, base).inputFiles())
    # a folder without a commit record, as a writer leaves it that fails, is never current
    spark.range(9).write.parquet(f"{base}/release=v20990101")
    assert W.read_release(spark, base).count() == 5
    W.make_current(spark, base, "v20240101")
    assert W.current_release(spark, base) == "v20240101" and W.read_release(spark, base).count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        W.read_release(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="(?i)already exists"):
        W.write_release(spark.range(1), base, "v20240101")


ENTRIES = [
    {"ver": "v1", "title": "one", "status": "released", "released": "2024-01-01"},
    {"ver": "v2", "status": "prerelease", "released": ""},
    {"ver": "v3", "status": "prerelease", "released": "2025-05-05", "access": "public"},
    {"ver": "v0", "status": "released", "released": "2023-01-01", "access": ""},
]


@pytest.mark.parametrize("doc", [{"versions": ENTRIES}, ENTRIES])
def test_release_registry(spark, tmp_path, doc):
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=1))
    view = V.release_view(V.read_registry(spark, str(tmp_path / "v.json")))
    assert [(r["ver"], r["access"]) for r in view.collect()] == [
        ("v2", "restricted"), ("v3", "public"), ("v1", "public"), ("v0", "public")]
    assert [r["ver"] for r in V.with_access(view, "restricted").collect()] == ["v2"]


def test_items_csv_and_globs(spark, tmp_path):
    for c in "ab":
        spark.range(2).selectExpr(f"concat('{c}', id) item_id").write.parquet(str(tmp_path / f"part_{c}"))
    both = G.item_collections(spark, {"A": str(tmp_path / "part_a"), "B": str(tmp_path / "part_b")})
    assert sorted(tuple(r) for r in both.collect()) == [("a0", "A"), ("a1", "A"), ("b0", "B"), ("b1", "B")]
    assert G.occurrence_files(spark, str(tmp_path / "part_*"), ["item_id"]).count() == 4
    (tmp_path / "t.csv").write_text("taxonID,name\n1,a\n2,\"b,c\"\n")
    assert [tuple(r) for r in G.csv_lookup(spark, str(tmp_path / "t.csv"), "taxonID INT, name STRING").collect()] == [(1, "a"), (2, "b,c")]
    (tmp_path / "bad.csv").write_text("taxonID,name\nx,a\n")
    with pytest.raises(Exception):
        G.csv_lookup(spark, str(tmp_path / "bad.csv"), "taxonID INT, name STRING").collect()


def test_shared_folder_and_cut_lineage(spark):
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second and first.startswith(session.shared_dir(spark))
    df = session.written(spark.range(10).selectExpr("id", "id * 2 d"), "cut")
    assert df.count() == 10 and "Range" not in plan(df)
