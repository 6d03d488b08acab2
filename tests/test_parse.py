"""The scanner and what follows from it, on small sources."""

import random
import time

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import parse, resolve
from skeinworks.tools import CodeBase

BASIC = """
import { clock } from './clock';
import fs from 'node:fs';

interface Parcel {
  weight: number;
  to: string;
}

export interface Order {
  id: number;
  parcels: Parcel[];
}

export async function placeOrder(order: Order, at = clock()): Promise<number> {
  const price = await quote(order, { at });
  if (price < 0) { throw new Error("no } price"); }
  return price;
}

export class Depot<T> {
  private shelves: Map<string, T>;
  public async store(item: T): Promise<void> { this.shelves.set(`${item}`, item); }
  static empty(): boolean { return true; }
}

export const LIMIT = 12;
export type Speed = 'slow' | 'fast';
""".strip()

TOOLS = """
const registry = new Registry({ strict: true });

registry.addCommand(
  'weigh_parcel',
  {
    description: 'Weighs a parcel on the nearest scale.',
    inputSchema: {
      parcel: s.text(),
      scale: s.text().optional(),
    }
  },
  async ({ parcel, scale }) => {
    return scale ?? parcel;
  }
);
""".strip()

METHODS = """
export interface Route { stops: string[] }

Meteor.methods({
  async planRoute(route: Route) {
    verify(route, Object);
    return solve(route);
  },
  'dropStop'(name: string) {
    return forget(name);
  },
});
""".strip()

ROUTES = """
import http from 'web-kit';

const app = http.create();

app.get('/parcels', async (req, res) => {
  const all = await listParcels();
  res.send(all);
});

app.put('/parcels', async (req, res) => {
  const one = await addParcel(req.body);
  res.send(one);
});

function listParcels() {
  return table.all({});
}
""".strip()


@pytest.fixture(scope="module")
def rows(spark):
    sources = spark.createDataFrame([("basic.ts", BASIC), ("tools.js", TOOLS), ("methods.ts", METHODS), ("routes.js", ROUTES), ("empty.ts", ""), ("null.ts", None)], "path string, content string")
    parsed = parse.parse(sources)
    return sources, parsed, {r.path: r for r in parse.skeletons(sources, parsed).collect()}


@pytest.mark.parametrize(
    "path, shown",
    [
        ("basic.ts", ["import { clock } from './clock';", "// ── Types", "interface Parcel", "export interface Order", "export async function placeOrder", "{ ... }", "public async store", "static empty", "export const LIMIT", "export type Speed"]),
        ("tools.js", ["// ── Registrations", "registry.addCommand('weigh_parcel'", "Weighs a parcel on the nearest scale", "{ parcel, scale }"]),
        ("methods.ts", ["export interface Route", "// ── Registrations", "Meteor.methods({", "async planRoute", "dropStop"]),
        ("routes.js", ["// ── Registrations", "app.get('/parcels'", "app.put('/parcels'", "function listParcels"]),
    ],
)
def test_skeleton_holds(rows, path, shown):
    for text in shown:
        assert text in rows[2][path].skeleton


def test_skeleton_details(rows):
    skeletons = rows[2]
    basic = skeletons["basic.ts"].skeleton
    assert "quote" not in basic
    assert basic.index("// ── Types") < basic.index("// ── Exports") < basic.index("export interface Order")
    assert skeletons["methods.ts"].methods == ["planRoute", "dropStop"]
    assert "// ── Types" not in skeletons["methods.ts"].skeleton
    assert skeletons["routes.js"].reduction_pct >= 30
    assert skeletons["basic.ts"].reduction_pct >= 25
    assert skeletons["empty.ts"].skeleton == "" and skeletons["null.ts"].skeleton == ""


def test_bodies_make_most_of_a_file(spark):
    body = "\n".join(f"  const step{k} = await run(order, {{ at: {k} }});\n  if (!step{k}) {{ return {k}; }}" for k in range(20))
    text = BASIC.replace("  const price = await quote(order, { at });", body)
    sources = spark.createDataFrame([("long.ts", text)], "path string, content string")
    row = parse.skeletons(sources, parse.parse(sources)).first()
    assert row.reduction_pct >= 50 and row.original_lines == len(text.split("\n")) and "export async function placeOrder" in row.skeleton


def test_symbol_source(rows):
    sources, parsed, _ = rows
    got = {r.path: r for r in parse.symbol_source(sources, "placeOrder", parsed=parsed).collect()}
    assert "await quote" in got["basic.ts"].source and got["basic.ts"].line_start == 14
    assert "solve(route)" in parse.symbol_source(sources, "planRoute", parsed=parsed).where("path = 'methods.ts'").first().source
    assert got["routes.js"].source is None and "not found" in got["routes.js"].error


def test_patterns_agree_with_scanner(rows):
    sources, parsed, _ = rows
    assert {(r.name, r.file) for r in parse.rpc_methods(parsed).collect()} == {("planRoute", "methods.ts"), ("dropStop", "methods.ts")}
    assert {r.name for r in parse.rpc_methods_by_pattern(sources).collect()} == {"planRoute", "dropStop"}
    assert {r.name for r in parse.symbols_of_lines(sources.where("path = 'basic.ts'"), "path", "content").collect()} >= {"Parcel", "Order", "placeOrder", "Depot", "LIMIT", "Speed"}


HARD = r"""
const quoted = /["{'`]/;
const split = (a, b) => a / b / 2, other: Map<string, number> = new Map(), last = [1, 2];
const text = `a ${b ? `x{` : "y}"} ${ { k: 1 }.k } c`;
const path = a.replace(/\/[/{]+/g, "/"); // it's a comment with a quote
if (quoted.test(text)) { return /}/.exec(x); }

export function first(x) {
  const inner = x / 2; /* } */
  return x.match(/^[^/]*{/) ? `${inner}` : null;
}

export class Second<T extends { a: string }> {
  run(v: T): string { return v.a; }
}

queue.on('drain', settings);
jobs.plan('sweep', { description: ['Sweeps the', 'old rows.'], input: { shape: { table: s.text(), deep: { limit: s.int() } }, dry: s.bool() } }, async (args) => { await sweep(args); });
jobs.plan('count', async ({ table, since }) => table.count(since));
""".lstrip()


@pytest.fixture(scope="module")
def hard(spark):
    sources = spark.createDataFrame([("hard.ts", HARD)], "path string, content string")
    return sources, parse.parse(sources)


def test_scanner_reaches_the_end(hard):
    """Quotes and braces in regular expressions and nested templates hide no later line."""
    sources, parsed = hard
    names = {r.name for r in parse.symbols(parsed).collect()}
    assert names == {"quoted", "split", "other", "last", "text", "path", "first", "Second"}
    spans = {r.name: (r.line_start, r.line_end) for r in parsed.where("section = 'Exports'").collect()}
    assert spans == {"first": (7, 10), "Second": (12, 14)}
    assert parsed.where("section = 'unclosed'").count() == 0
    assert "run(v: T): string;" in parse.skeletons(sources, parsed).first().skeleton


def test_registrations(hard):
    sources, parsed = hard
    shown = [r.text for r in parsed.where("section = 'Registrations'").orderBy("pos").collect()]
    assert shown == [
        "jobs.plan('sweep', /* Sweeps the old rows. */ async ({ table, limit, dry }) => { ... }); // L17",
        "jobs.plan('count', async ({ table, since }) => { ... }); // L18",
    ]
    assert parse.symbol_source(sources, "drain", parsed=parsed).first().source == "queue.on('drain', settings);"


@pytest.mark.parametrize("code", ["a / b", "(a) / b / c", "x = 1 / 2 / 3", "a[0] / 2 / i"])
def test_divisions_stay(code):
    assert parse.code_only(code) == code


def test_code_only_keeps_lengths():
    rnd = random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice(["`", "${", "}", "{", "/", "'", '"', "\\", "\n", "a", " ", "//", "/*", "*/", "=", "("]) for _ in range(rnd.randint(0, 40)))
        code = parse.code_only(text)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_large_file_in_linear_time():
    part = "export function f%d(a) {\n  const s = `x ${a} {`; // note\n  return [a, { b: /[{]/ }];\n}\n\n"
    text = "".join(part % k for k in range(120_000))
    began = time.time()
    rows = parse.scan(text)
    assert len(text) > 10_000_000 and len(rows) == 120_000 and rows[-1][6:8] == (599_996, 599_999)
    assert time.time() - began < 20


LOOSE = """
import { a,
  b } from './ab';
export interface Shape { size: number }
export const top = { x: 1 };
interface Bare { y: string }
class Plain {
  const = 1;
}
async function later() {
  const inside = "}";
}
let v = 1;
jobs.plan('tidy', {
      description: 'Tidies up.',
      rows: s.int(),
}, async (args) => {
  await tidy(args);
});
jobs.plan('none', settings);
Meteor.methods({
  async sweep(x) {
    if (x) { return 1; }
  },
  rest: 1,
});
""".lstrip()


def test_lines_without_the_scanner(spark):
    sources = spark.createDataFrame([("loose.ts", LOOSE)], "path string, content string")
    rows = parse.parse_lines(sources)
    got = {s: [r.text for r in rows.where(F.col("section") == s).orderBy("pos").collect()] for s in parse.SECTIONS}
    assert got["imports"] == ["import { a,\n  b } from './ab';"] and got["Types"] == []
    assert got["Exports"] == ["export interface Shape { ... }", "export const top = { ... }"]
    assert got["Module-level"] == ["class Plain { ... }", "async function later() { ... }", "let v = 1;"]
    assert got["Registrations"] == ["jobs.plan('tidy', /* Tidies up. */ async ({ rows }) => { ... }); // L13", "Meteor.methods({\n  async sweep(...) { ... },\n  rest(...) { ... },\n}); // L20"]
    assert [r.name for r in rows.where("section = 'method'").orderBy("pos").collect()] == ["sweep", "rest"]
    assert {r.name for r in parse.symbols(rows).collect()} == {"Shape", "top", "Plain", "later", "v"}


def test_read_skeletons(spark, hard):
    sources = spark.createDataFrame([("loose.ts", LOOSE), ("open.ts", "export function f() {\n  if (x) {\n}\n"), ("notes.py", "import os\nexport x\n"), ("hard.ts", HARD)], "path string, content string")
    wanted = spark.createDataFrame([("loose.ts",), ("open.ts",), ("notes.py",), ("gone.ts",)], "path string")
    got = {r.path: r for r in parse.read_skeletons(wanted, sources, parse.parse(sources)).collect()}
    assert {p: r.engine for p, r in got.items()} == {"loose.ts": "scanner", "open.ts": "lines", "notes.py": "lines", "gone.ts": None}
    assert got["gone.ts"].error == "File not found: gone.ts" and all(got[p].error is None for p in ("loose.ts", "open.ts", "notes.py"))
    assert got["open.ts"].skeleton.endswith("export function f() { ... }") and "import os" in got["notes.py"].skeleton
    assert "Meteor.methods({\n  async sweep(x) { ... },\n  rest() { ... },\n}); // L20" in got["loose.ts"].skeleton and got["loose.ts"].methods == ["sweep", "rest"]


@pytest.mark.parametrize(
    "name, first, last",
    [("later", 9, 11), ("Bare", 5, 5), ("top", 4, 4), ("v", 12, 18), ("sweep", 21, 23), ("Plain", 6, 8), ("missing", None, None)],
)
def test_symbol_by_lines(spark, name, first, last):
    rows = parse.symbol_source_by_lines(spark.createDataFrame([("loose.ts", LOOSE)], "path string, content string"), name).collect()
    assert [(r.line_start, r.line_end) for r in rows] == ([(first, last)] if first else [])


def test_methods_by_pattern(spark):
    text = "Meteor.methods({\n  one(a, b) { if (a) { return { c: 1 }; } },\n  'two.go': async function (x) { run(x, { k: 2 }); },\n  async three() {},\n});\nMeteor.publish('list', f);\nMeteor.methods({ four: g });\n"
    sources = spark.createDataFrame([("m.js", text)], "path string, content string")
    assert sorted(r.name for r in parse.rpc_methods_by_pattern(sources).collect()) == ["four", "one", "publish:list", "three", "two.go"]


def test_older_rules(spark, hard):
    sources, parsed = hard
    shown = parse.skeletons(sources, parsed)
    names = {r.name for r in parse.symbols_of_lines(shown, "path", "skeleton", exported_variables=True).collect()}
    assert names == {"first", "Second"}
    calls = spark.createDataFrame([("n.ts", "function g() {\n  const x = f();\n  return h(x);\n}\n")], "path string, content string")
    got = lambda nested: {(r.caller, r.callee_raw) for r in parse.call_sites(calls, parse.scanned(calls), nested=nested).collect()}
    assert got(False) == {("g", "f"), ("g", "h")} and got(True) == {("x", "f"), ("g", "h")}


FILES = {
    "app/a.ts": "import { b as bee, c } from './b';\nimport d from './d';\nimport './side';\nexport function a() {\n  const x = bee();\n  helper();\n  this.go();\n  return c.run(d());\n}\nfunction helper() { return a(); }\n",
    "app/b.ts": "import {\n  a\n} from './a';\nexport function b() { return a(); }\nexport const c = { run(x) { return x; } };\n",
    "app/d/index.ts": "import { gone } from './gone';\nexport default function dd() { return gone(); }\n",
    "app/side.js": "start();\n",
}


@pytest.fixture(scope="module")
def base(spark):
    rows = [(p, c, k) for k, (p, c) in enumerate(FILES.items())]
    return CodeBase(spark.createDataFrame(rows, "path string, content string, seq long"))


def test_imports(base, spark):
    got = {(r.src, r.spec): r.dst for r in base.imports.collect()}
    assert got == {("app/a.ts", "./b"): "app/b.ts", ("app/a.ts", "./d"): "app/d/index.ts", ("app/a.ts", "./side"): "app/side.js", ("app/b.ts", "./a"): "app/a.ts"}
    specs = parse.import_specs(base.sources, single_line=True)
    assert ("app/b.ts", "./a") not in {(r.file, r.spec) for r in specs.collect()}
    shadowed = {(r.src, r.spec): r.dst for r in resolve.imports(parse.import_specs(base.sources), base.files, folders_count=True).collect()}
    assert shadowed["app/a.ts", "./d"] == "app/d"


def test_call_edges(base):
    got = {(r.from_id, r.to_id): (r.from_exists, r.to_exists) for r in base.edges.collect()}
    assert got["app/a.ts::a", "app/b.ts::b"] == (True, True)
    assert got["app/a.ts::a", "app/a.ts::helper"] == (True, True)
    assert got["app/a.ts::helper", "app/a.ts::a"] == (True, True)
    assert got["app/b.ts::b", "app/a.ts::a"] == (True, True)
    assert not any("this" in t for _, t in got)


def test_parsed_subset_gives_fewer_edges(base, spark):
    names = parse.import_names(base.sources).join(base.imports.selectExpr("src AS file", "spec", "dst AS target"), ["file", "spec"])
    calls = parse.call_sites(base.sources, base.parsed)
    some = spark.createDataFrame([("app/a.ts",)], "path string")
    part = {(r.from_id, r.to_id) for r in resolve.call_edges(calls, names, base.symbols, some).collect()}
    every = {(r.from_id, r.to_id) for r in base.edges.collect()}
    assert part < every and ("app/a.ts::a", "app/b.ts::b") not in part


def test_tools(base):
    assert [r.path for r in base.list_files("/app", "b.ts").collect()] == ["app/b.ts"]
    assert {r.id for r in base.blast_radius("app/b.ts", "b").collect()} == {"app/a.ts::a", "app/a.ts::helper", "app/b.ts::b"} - {"app/b.ts::b"}
    assert {(r.id, r.depth) for r in base.blast_radius("app/d/index.ts").collect()} == {("app/a.ts", 1), ("app/b.ts", 2)}
    assert base.search_symbol("help").first().file == "app/a.ts"
    assert base.repo_stats().first().total_files == 4
    scope = {r.file: r for r in base.get_scope(["helper"], max_tokens=60).collect()}
    assert scope["app/a.ts"].score == 100 and scope["app/b.ts"].score == 75 and sum(r.tokens for r in scope.values() if r.taken) <= 60
    detail = base.read_symbol_details("app/a.ts", "helper").first()
    assert detail.calls == 1 and detail.called_by == 1 and "return a()" in detail.source
    assert base.read_symbol_details("app/b.ts", "helper").first().candidates == ["app/a.ts"]
    assert [c[1] for c in base.calls][:2] == ["list_files", "blast_radius"]
    shown = base.read_file_skeleton("app/a.ts").first()
    assert shown.engine == "scanner" and shown.error is None and base.read_file_skeleton("app/zz.ts").first().error == "File not found: app/zz.ts"
    parsed = base.calls[-2]
    assert parsed[3] > len(shown.skeleton) // 4 and parsed[4] > 0 and parsed[5] == "tree-sitter" and parsed[7] is None
    assert base.repo_stats().first().tree_rate == "100.0%"
    with pytest.raises(ValueError):
        base.search_symbol("x", max_results=99)
    assert "limit" in base.calls[-1][7]


def test_source_tree(spark, tmp_path):
    for p in ("src/x y.ts", "node_modules/z.ts", "src/n.txt", "deep/er/w.jsx"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("const a = 1;\n")
    base = CodeBase.at(spark, str(tmp_path), '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@u/*": ["packages/u/*"], "http://x": ["y"]}}}')
    assert [(r.path, r.seq) for r in base.files.orderBy("seq").collect()] == [("deep/er/w.jsx", 0), ("src/x y.ts", 1)]
    assert {(r.alias, r.target, r.match) for r in base.resolve_alias("@u/kit").collect()} == {("@u", "packages/u", "head")}
