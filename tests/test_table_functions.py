"""Table functions in SQL against the operators over DataFrames."""

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import tables
from skeinworks.operators import parse
from tests.test_parse import BASIC, HARD, METHODS, ROUTES, TOOLS


@pytest.fixture(scope="module")
def files(spark):
    rows = [("basic.ts", BASIC), ("tools.js", TOOLS), ("methods.ts", METHODS), ("routes.js", ROUTES), ("hard.ts", HARD), ("open.ts", "function f() {\n"), ("empty.ts", ""), ("null.ts", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    df.createOrReplaceTempView("files")
    tables.register(spark)
    return df


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_functions_equal_operators(spark, files):
    scanned = parse.scanned(files)
    sql = lambda text: spark.sql(text)
    names = [c.split()[0] for c in parse.STATEMENT.split(", ")]
    assert rows(sql("SELECT f.path, s.* FROM files f, LATERAL code_statements(f.path, f.content) s"), "path", *names) == rows(parse.parse(files), "path", *names)
    assert rows(sql("SELECT f.path, s.* FROM files f, LATERAL code_symbols(f.path, f.content) s"), "path", "name", "kind", "line", "exported") == rows(parse.symbols(scanned), "file", "name", "kind", "line", "exported")
    assert rows(sql("SELECT f.path, s.* FROM files f, LATERAL code_calls(f.path, f.content) s"), "path", "caller", "nested_caller", "callee_raw", "line") == rows(parse.callers(scanned), "file", "caller", "nested_caller", "callee_raw", "line")
    assert rows(sql("SELECT f.path, s.* FROM files f, LATERAL code_imports(f.path, f.content) s"), "path", "pos", "spec") == rows(parse.import_specs(files), "file", "pos", "spec")
    shown = parse.skeletons(files, parse.parse(files)).where(F.col("path") != "null.ts")
    assert rows(sql("SELECT f.path, s.* FROM files f, LATERAL code_skeleton(f.path, f.content) s WHERE f.content IS NOT NULL"), "path", "skeleton", "original_lines", "skeleton_lines") == rows(shown, "path", "skeleton", "original_lines", "skeleton_lines")


def test_arguments(spark, files):
    some = spark.sql("SELECT s.section FROM files f, LATERAL code_statements(f.path, f.content, array('Exports', 'Types')) s")
    assert {r.section for r in some.collect()} == {"Exports", "Types"}
    for text in ("code_symbols(f.path, 1)", "code_statements(f.path, f.content, array(f.path))"):
        with pytest.raises(Exception, match="string"):
            spark.sql(f"SELECT s.* FROM files f, LATERAL {text} s").collect()
