"""Plan and source checks: pushdown, pruning, no driver round trips."""

import pathlib
import re

from pyspark.sql import functions as F

from quire.sources import archive as A

ROOT = pathlib.Path(__file__).resolve().parent.parent / "quire"


def test_no_driver_collects_in_library():
    bad = re.compile(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(")
    # the training-data operators collect bounded summaries (documented there), so they have rules of their own
    hits = [str(p) for p in ROOT.rglob("*.py")
            if bad.search(p.read_text()) and "check.py" not in str(p) and "llm" not in p.parts]
    assert hits == []


def test_filter_and_projection_reach_the_scan(spark):
    part = A.read_table(spark, "/root/testdata/sf0.001", "part")
    df = part.filter(F.col("p_size") > 10).select("p_name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,10)]" in plan
    assert "ReadSchema: struct<p_name:string,p_size:int>" in plan


def test_entries_are_stored_without_contents(spark):
    t = A.load(spark, "/root/testdata/sf0.001")
    plan = t["entries"].select("archive", "path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<archive:string,path:string>" in plan and "html" not in plan
    # the catalogue reads pages for the entries and for main pages, both before its own plan
    assert "pages.parquet" not in t["catalog"]._jdf.queryExecution().executedPlan().toString()
    assert t["contents"]._jdf.queryExecution().executedPlan().toString().count("pages.parquet") == 1
