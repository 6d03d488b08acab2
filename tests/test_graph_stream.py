"""The growing graph: any order and split of file versions gives what one batch build gives."""

import random

import pytest

from skeinworks.operators import parse, resolve
from skeinworks.session import listed
from skeinworks.streaming.graph import GraphState, grow

FILES = {
    "a.ts": "import { b as bee, c } from './b';\nimport d from './d';\nexport function a() { bee(); helper(); c.run(d()); }\nfunction helper() { return a(); }\n",
    "b.ts": "import { a } from './a';\nexport function b() { return a(); }\nexport const c = { run(x) { return x; } };\n",
    "b.js": "export function b() { return lone(); }\nfunction lone() {}\n",
    "d/index.ts": "import { gone } from '../gone';\nexport default function d() { return gone(); }\n",
    "e.tsx": "import { a } from './a';\nexport const E = () => <p>{a()}</p>;\nconst open = `\n",
}
#: (seq, path, content): files come, change, go and come back.
HISTORY = [
    *((k, p, c) for k, (p, c) in enumerate(FILES.items())),
    (10, "b.ts", FILES["b.ts"].replace("a();", "b();")), (11, "gone.ts", "export function gone() {}\n"), (12, "d/index.ts", None), (13, "a.ts", FILES["a.ts"]),
    (14, "d.ts", "export default function d() { return 1; }\n"), (15, "b.ts", None), (16, "gone.ts", "export const gone = () => again();\nfunction again() {}\n"), (17, "d/index.ts", FILES["d/index.ts"]),
]


def built(spark, files):
    sources = spark.createDataFrame(list(files.items()), "path string, content string")
    scanned = parse.scanned(sources)
    imports = resolve.imports(parse.import_specs(sources), sources)
    names = parse.import_names(sources).join(imports.selectExpr("src AS file", "spec", "dst AS target").distinct(), ["file", "spec"])
    edges = resolve.call_edges(parse.call_sites(sources, scanned), names, parse.symbols(parse.with_lines(sources, scanned)))
    return set(map(tuple, edges.collect())), {r.src + " " + r.spec for r in imports.where("dst IS NULL").collect()}


@pytest.fixture(scope="module")
def want(spark):
    last = {}
    for seq, path, content in HISTORY:
        last[path] = content
    return built(spark, {p: c for p, c in last.items() if c is not None})


def rows_of(spark, versions):
    return spark.createDataFrame([(p, c, s) for s, p, c in versions], "path string, content string, seq long")


@pytest.mark.parametrize("seed", [None, 1])
def test_any_order_of_batches(spark, tmp_path, want, seed):
    history, sizes = list(HISTORY), [4, 5, 4]
    if seed is not None:
        random.Random(seed).shuffle(history)
        sizes = [3, 7, 3]
    state = GraphState(spark, str(tmp_path / "state"), buckets=3)
    assert state.edges().count() == 0 and state.pending().count() == 0
    for version, size in enumerate(sizes):
        state.apply(rows_of(spark, history[:size]), version)
        history = history[size:]
        if version == 1:
            before = set(map(tuple, state.edges().collect()))
            state.compact()
            assert set(map(tuple, state.edges().collect())) == before and state.versions() == (1, [])
            state.apply(rows_of(spark, HISTORY[:1]), 1)  # repeated after its commit: nothing happens
            assert state.versions() == (1, [])
    assert not history
    assert set(map(tuple, state.edges().collect())) == want[0]
    assert {r.src + " " + r.spec for r in state.pending().collect()} == want[1]
    assert {r.path for r in state.files().collect()} == {"a.ts", "b.js", "e.tsx", "gone.ts", "d.ts", "d/index.ts"}


def test_repeated_and_broken_batches(spark, tmp_path):
    """A batch that stopped half-way has no commit; run again, it replaces what it wrote."""
    state = GraphState(spark, str(tmp_path / "state"), buckets=2)
    state.apply(rows_of(spark, HISTORY[:3]), 0)
    files = {p: c for _, p, c in HISTORY[:3]}
    assert set(map(tuple, state.edges().collect())) == built(spark, files)[0]
    state._write("edges", spark.createDataFrame([("a.ts", "x", "y", 1)], "path string, from_id string, to_id string, version long"), f"{state.target}/edges/1")
    assert set(map(tuple, state.edges().collect())) == built(spark, files)[0]
    state.apply(rows_of(spark, HISTORY[3:5]), 1)
    files |= {p: c for _, p, c in HISTORY[3:5]}
    assert set(map(tuple, state.edges().collect())) == built(spark, files)[0]


def test_stream_of_files(spark, tmp_path, want):
    for k, at in enumerate((0, 6, 11)):
        rows_of(spark, HISTORY[at : (6, 11, 13)[k]]).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    files = spark.readStream.schema("path string, content string, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    grow(files, str(tmp_path / "state"), str(tmp_path / "checkpoint"), compact_after=2).awaitTermination()
    state = GraphState(spark, str(tmp_path / "state"))
    assert set(map(tuple, state.edges().collect())) == want[0]
    assert len(listed(spark, f"{state.target}/bases")) == 1
