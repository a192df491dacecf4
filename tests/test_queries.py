"""Every registered query against its SQL statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from bindings import base
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in base.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in base.QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


PYTHON_QUERIES = ("ann_mask_", "ann_validate_masks", "exp_segmentation", "ail_", "src_encoding", "src_csv_quoted", "src_csv_encoding",
                  "exp_yolo_files", "exp_coco_files",
                  "src_image_meta", "vec_")


def check_plan(name, df):
    """No cross join, no global window, and Python only where no expression can do the work."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("SinglePartition" in below for below in lines[i + 1:i + 5])
    if not name.startswith(PYTHON_QUERIES):
        assert not any(mark in plan for mark in ("ArrowEvalPython", "BatchEvalPython", "InPandas"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    check_plan(name, df)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "count"]


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
