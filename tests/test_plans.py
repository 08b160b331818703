"""What the physical plans hold: columns all the way, no nested loops, pruned scans."""

import os
import re

import pytest

from starquilt.plans import QUERIES

FOLDER = os.environ.get("STARQUILT_TABLES", "/root/testdata/sf0.001")
#: A function without a column form, and the codec of files.
PYTHON = {"ufunc_python"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("io_", "concatenate_files", "stream_", "make_", "maps_equal", "get_covpix", "read_moc", "degrade_wmean"))])
def test_stays_in_columns(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert name in PYTHON or not re.search(r"Python|Pandas|Arrow", plan)
    assert not re.search(r"CartesianProduct|NestedLoopJoin|BatchEvalPython", plan)


def test_scans_read_what_they_need(spark):
    plan = plan_of(QUERIES["sum_union"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert len(re.findall(r"Exchange hashpartitioning\(pix", plan)) <= 4  # one for each input's own grouping, one for the union
