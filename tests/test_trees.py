"""The data source of source trees: read with pushed filters, streamed, written."""

import os

import pytest
from pyspark.sql import functions as F

from skeinworks.sources import files, trees

FILES = {"src/x y.ts": "const a = 1;\n", "src/deep/b.tsx": "é漢\n", "lib/c.js": "", "lib/node_modules/d.js": "no", "lib/e.py": "no", "f.jsx": "f()"}


@pytest.fixture
def root(spark, tmp_path):
    trees.register(spark)
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_read(spark, root):
    got = {(r.path, r.content, r.size) for r in spark.read.format("source_tree").option("path", root).load().collect()}
    assert got == {(p, t, len(t.encode())) for p, t in FILES.items() if "node_modules" not in p and not p.endswith(".py")}
    assert {p for p, _, _ in got} == {r.path for r in files.source_tree(spark, root).where("content IS NOT NULL").collect()} | {"lib/c.js"}
    small = spark.read.format("source_tree").option("path", f"file://{root}").option("split_bytes", 1).option("suffixes", "ts,py").load()
    assert small.rdd.getNumPartitions() == 2 and {r.path for r in small.select("path").collect()} == {"src/x y.ts", "lib/e.py"}
    assert spark.read.format("source_tree").option("path", f"{root}/missing").load().count() == 0


@pytest.mark.parametrize(
    "condition, want",
    [("path LIKE 'src/%'", {"src/x y.ts", "src/deep/b.tsx"}), ("path = 'lib/c.js'", {"lib/c.js"}), ("path IN ('f.jsx', 'src/deep/b.tsx')", {"f.jsx", "src/deep/b.tsx"}), ("path LIKE '%.tsx' AND size > 0", {"src/deep/b.tsx"}), ("contains(path, 'x') AND content LIKE 'f%'", {"f.jsx"})],
)
def test_pushed_filters(spark, root, condition, want, monkeypatch):
    found = spark.read.format("source_tree").option("path", root).load().where(condition).select("path")
    assert {r.path for r in found.collect()} == want
    scan = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "BatchScan" in line]
    assert len(scan) == 1
    # What is pushed is not tested again above the scan, unless other columns ask for it.
    filters = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in line and "BatchScan" not in line]
    assert not any("path" in line for line in filters)


def test_folders_that_cannot_match_are_not_listed(root):
    tree = trees._Tree({"path": root})
    tree.filters = [trees.StringStartsWith(("path",), "src/de")]
    assert [p for p, _, _ in tree.listed()] == ["src/deep/b.tsx"]
    assert not trees._may_hold(tree.filters[0], "lib/") and trees._may_hold(tree.filters[0], "src/") and trees._may_hold(tree.filters[0], "src/deep/er/")


def test_stream(spark, root, tmp_path_factory):
    at = tmp_path_factory.mktemp("stream")
    for k, path in enumerate(FILES):
        os.utime(f"{root}/{path}", ns=(10**18 + k, 10**18 + k))

    def run():
        rows = spark.readStream.format("source_tree").option("path", root).option("settle_seconds", 0).load()
        rows.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.parquet(str(at / "out")).collect())

    first = sorted((p, t) for p, t in FILES.items() if "node_modules" not in p and not p.endswith(".py"))
    assert run() == first and run() == first
    with open(f"{root}/lib/c.js", "w") as file:
        file.write("later")
    assert run() == sorted([*first, ("lib/c.js", "later")])


def test_written_files_are_read_back(spark, tmp_path):
    trees.register(spark)
    rows = [(f"a/{k % 3}/f{k}.ts", f"const x{k} = `é`;\n") for k in range(40)] + [("gone.ts", None), (None, "x")]
    df = spark.createDataFrame(rows, "path string, content string").repartition(4)
    df.withColumns({"size": F.lit(None).cast("long"), "modified": F.lit(None).cast("timestamp")}).write.format("source_tree").option("path", str(tmp_path)).mode("append").save()
    back = spark.read.format("source_tree").option("path", str(tmp_path)).load()
    assert sorted((r.path, r.content) for r in back.collect()) == sorted(rows[:40])
    with pytest.raises(Exception, match="append"):
        back.limit(1).write.format("source_tree").option("path", str(tmp_path)).mode("overwrite").save()
