"""What keeps work in proportion to the rows, on plans and tasks of small tables."""

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import parse, resolve
from skeinworks.plans import queries as plans
from skeinworks.session import table
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_never_meet_in_the_driver(spark):
    files = spark.range(50).select(F.concat(F.lit("lib/m"), F.col("id").cast("string"), F.lit(".ts")).alias("path"))
    specs = files.select(F.col("path").alias("file"), F.lit(0).alias("pos"), F.lit("./m7").alias("spec"))
    found = resolve.imports(specs, files)
    assert "Broadcast" not in plan(found) and found.count() == 50
    assert "Broadcast" not in plan(plans.QUERIES["code_imports"](spark, SMALL))


def test_sources_of_one_file_are_read_by_many_tasks(spark):
    sources = spark.range(400).coalesce(1).select(F.concat(F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("const a = 1;").alias("content"))
    tasks = parse.parse(sources).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= spark.sparkContext.defaultParallelism and sum(t["count"] for t in tasks) == 400


def scans(df):
    return plan(df).count("MapInPandas")


def test_each_source_is_scanned_once(spark):
    assert scans(plans.QUERIES["code_calls"](spark, SMALL)) == 1
    assert scans(plans.QUERIES["code_skeletons"](spark, SMALL)) == 1
    assert scans(plans.QUERIES["code_names"](spark, SMALL)) == 0  # stored
    assert scans(plans.QUERIES["symbol_sources"](spark, SMALL)) == 0


def test_methods_are_found_in_one_pass(spark):
    found = plan(plans.QUERIES["method_names"](spark, SMALL))
    assert found.count("MapInPandas") == 1 and found.count("Generate explode") == 1


def test_call_edges_sweep_calls_once_and_meet_in_no_driver(spark):
    found = plan(plans.QUERIES["code_call_edges"](spark, SMALL))
    assert "Broadcast" not in found
    assert found.count("Window [last(") == 1


def test_edges_across_files_and_inside_of_one(spark):
    calls = spark.createDataFrame([("a", "f", "next"), ("a", "f", "g"), ("a", "f", "gone"), ("a", "f", "ns.go"), ("b", "h", "a.x")], "file string, caller string, callee_raw string")
    names = spark.createDataFrame([("a", "next", "run", "b"), ("a", "ns", "default", "c"), ("b", "a", "default", "a")], "file string, local_name string, orig_name string, target string")
    nodes = spark.createDataFrame([("a::f", "a", "f"), ("a::g", "a", "g"), ("b::run", "b", "run")], "node_id string, file string, name string")
    edges = lambda **kw: sorted((r.from_id, r.to_id, r.from_exists, r.to_exists) for r in resolve.call_edges(calls, names, nodes, **kw).collect())
    here = [("a::f", "a::g", True, True), ("a::f", "b::run", True, True)]
    assert edges() == sorted([*here, ("a::f", "c::go", True, False), ("b::h", "a::x", False, False)])
    assert edges(parsed=spark.createDataFrame([("a",), ("b",)], "path string")) == sorted([*here, ("b::h", "a::x", False, False)])


def test_callers_of_closed_files(spark):
    sources = spark.createDataFrame([("a.js", "function f() { g(1); }\n"), ("b.js", "h(1);\nconst s = `open")], "path string, content string")
    rows = parse.scanned(sources)
    assert [(r.file, r.caller, r.callee_raw) for r in parse.callers(rows, closed=True).collect()] == [("a.js", "f", "g")]
    assert sorted(r.file for r in parse.callers(rows).collect()) == ["a.js", "b.js"]


def test_streams_over_tables_of_several_files(spark, tmp_path):
    for name, order in (("conversations", "turn"), ("documents", "doc_id")):
        # The rows that come first by their order stand in the last file.
        table(spark, SMALL, name).repartitionByRange(3, F.desc(order)).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("mask_stream", "first_seen_stream"):
        got, want = (sorted(map(tuple, plans.QUERIES[name](spark, sf).collect())) for sf in (str(tmp_path), SMALL))
        assert got == want and got


@pytest.mark.parametrize("make", [plans.modules, plans.loose_modules, plans.tricky_modules, plans.method_modules, plans.QUERIES["agent_lessons"]])
def test_what_is_made_of_parts_is_spread(spark, make):
    assert make(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_cosines_of_texts_move_texts_alone(spark):
    for name in ("cosine_pairs", "curate_anti"):
        moved = [line for line in plan(plans.QUERIES[name](spark, SMALL)).splitlines() if "Exchange hashpartitioning" in line and "term" in line]
        assert not moved or all("item_id" not in line and "doc_id" not in line for line in moved)
    got = plans.QUERIES["cosine_pairs"](spark, SMALL)
    assert plan(got).count("REPARTITION_BY_NUM") == 1
