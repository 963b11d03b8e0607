"""Every registered query against its SQL, and the shape of its plan."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import compare
from hexatlas.suite import QUERIES

NAMES = sorted(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    line = compare(spark, sf, name)
    assert line.startswith("ok "), line


def test_every_query_has_expected_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["h3id", "value", "n"] and df.count() > 0


HEAVY = ["T5_tile_pyramid", "T6_capped_tiles", "T8_pruned_tiles", "A4_occurrence_store", "A5_cell_index", "A6_taxon_index",
         "A7_live_index", "J1_value_map", "J2_pixel_lookup", "J6_result_diff", "J7_list_diff", "J8_tile_parity",
         "C6_raster_tiles", "T13_cells_in_polygons", "T14_model_footprints", "A10_area_species", "HB1_latest_beats", "HB3_silences"]


@pytest.mark.parametrize("name", HEAVY)
def test_plans_stay_distributed(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan
    # no window over the whole table: each has a partition key
    assert "Window [" not in plan or "Exchange SinglePartition" not in plan.split("Window [", 1)[1].split("\n", 3)[2]


def test_scans_read_only_what_they_use(spark, sf):
    plan = entry.queries()["A5_cell_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage and its tests imports and registers every other query."""
    root = Path(entry.__file__).parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e, tests.test_suite as t; print(len(e.queries()), len(e.oracle_sql()), len(t.NAMES))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True,
                          env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(NAMES))] * 3
