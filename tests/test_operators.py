"""Operators on small tables: ties, cycles, dangling ids, empty input, brute force."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skeinworks import session
from skeinworks.functions import text as tx
from skeinworks.operators import budget, lessons, masking, search, telemetry, traverse
from skeinworks.sources import files, transcripts
from skeinworks.streaming import live


def test_text_functions(spark):
    row = spark.createDataFrame([("a😀", -2.5, "x/../a/./b//c")], "s string, d double, p string").select(
        tx.utf16_length("s").alias("n"), tx.half_up(F.col("d")).alias("r"), tx.folded_path(F.col("p")).alias("p"), tx.padded(F.lit("long"), 2).alias("w"), tx.folder_of(F.lit("a/b/c")).alias("f"), tx.relative_to(F.lit("/r/a/b"), "/r").alias("rel")
    ).first()
    assert tuple(row) == (3, -2, "a/b/c", "long", "a/b", "a/b")


def test_stored_tables_are_deleted(spark):
    there = lambda df: Path(df.stored_at.removeprefix("file:")).exists()
    a = session.stored(spark.range(5).toDF("n"), "test")
    b = session.stored(a.where("n > 1"), "test")
    session.discard(a)
    assert not there(a) and there(b) and b.count() == 3
    inner = []

    def make():
        inner.append(session.stored(spark.range(3).toDF("n"), "test"))
        return inner[0].where("n > 0")

    out = session.settled(make, "test")
    assert not there(inner[0]) and there(b) and out.count() == 2
    session.clean_up(spark)
    assert not there(out) and not there(b)


def test_clusters_name_their_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        session.shared_folder(Session)


def walk(edges, seed, depth):
    seen, level = {seed: 0}, {seed}
    for d in range(1, depth + 1):
        level = {a for a, b in edges if b in level} - set(seen)
        seen |= dict.fromkeys(level, d)
    return {k: v for k, v in seen.items() if k != seed}


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_impact_equals_breadth_first(spark, depth):
    rnd = random.Random(depth)
    edges = [(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(50)] + [(3, 3), (3, 4), (4, 3)]
    got = traverse.impact(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(3,)], "id int"), depth)
    assert {r.id: r.depth for r in got.collect()} == walk(edges, 3, depth)


def test_impact_does_not_follow_unknown(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    got = traverse.impact(edges, spark.createDataFrame([("a",)], "id string"), 4, expandable=spark.createDataFrame([("c",)], "id string"))
    assert [r.id for r in got.collect()] == ["b"]
    with pytest.raises(ValueError):
        traverse.impact(edges, edges, 7)


def scope_by_hand(edges, seeds, max_depth, max_files):
    out, back = {}, {}
    for s, d, _ in sorted(edges, key=lambda e: (e[0], e[2])):
        out.setdefault(s, []).append(d)
    for s, d, p in sorted(edges, key=lambda e: (e[2], e[0])):
        if s not in back.setdefault(d, []):
            back[d].append(s)
    seen = {f: (0, 100) for f in seeds}
    level = list(seeds)
    for depth in range(1, max_depth + 1):
        nxt = []
        for f in level:
            for d in out.get(f, []):
                if d not in seen:
                    seen[d] = (depth, 100 - 25 * depth)
                    nxt.append(d)
            if depth == 1:
                for d in back.get(f, []):
                    if d not in seen:
                        seen[d] = (depth, 60)
                        nxt.append(d)
            if len(seen) >= max_files:
                break
        level = nxt
        if len(seen) >= max_files:
            break
    return sorted(((-s, d, f) for f, (d, s) in seen.items()))


@pytest.mark.parametrize("trial", range(4))
def test_scope_equals_loop(spark, trial):
    rnd = random.Random(trial)
    pairs = [(f"f{rnd.randint(0, 14):02}", f"f{rnd.randint(0, 14):02}") for _ in range(30)]
    edges = [(s, d, k) for k, (s, d) in enumerate(pairs)]
    seeds = ["f01", "f00", "f05"]
    table = spark.createDataFrame([(f, k, "seed") for k, f in enumerate(seeds)], "file string, ord long, reason string")
    got = traverse.scope(spark.createDataFrame(edges, "src string, dst string, pos long"), table, 3, 60)
    assert sorted((-r.score, r.depth, r.file) for r in got.collect()) == scope_by_hand(edges, seeds, 3, 60)
    few = traverse.scope(spark.createDataFrame(edges, "src string, dst string, pos long"), table, 1, 6).collect()
    assert len(few) == min(6, len(scope_by_hand(edges, seeds, 1, 6)))


def test_seeds(spark):
    known = spark.createDataFrame([("a.ts",), ("b.ts",)], "path string")
    symbols = spark.createDataFrame([("run", "function", "a.ts", 1), ("runner", "class", "b.ts", 2)], "name string, kind string, file string, seq long")
    methods = spark.createDataFrame([("go", "a.ts", 1), ("go", "b.ts", 2)], "name string, file string, seq long")
    got = {r.file: r.reason for r in traverse.seed_files(["a.ts", "run", "nothing"], known, symbols, methods).collect()}
    assert got == {"a.ts": "symbol:run(function)"}
    assert {r.file for r in traverse.seed_files(["unn"], known, symbols, methods).collect()} == {"b.ts"}
    assert {r.file: r.reason for r in traverse.seed_files(["go"], known, symbols, methods).collect()} == {"b.ts": "rpc:go"}


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("c", 3, 3)], "file string, rank int, cost long")
    got = {r.file: r.taken for r in budget.within_budget(rows, [F.col("rank")], "cost", 8, ["file"]).collect()}
    assert got == {"a": True, "b": False, "c": True}
    assert budget.within_budget(rows.limit(0), [F.col("rank")], "cost", 8, ["file"]).count() == 0


def test_search_takes_first_then_sorts(spark):
    symbols = spark.createDataFrame([(f"xrun{k}", "function", f"f{k}", 1, k) for k in range(3)] + [("run", "function", "late", 1, 9)], "name string, kind string, file string, line int, seq long")
    none = spark.createDataFrame([], "name string, file string, seq long")
    paths = spark.createDataFrame([("run.ts", 1)], "path string, seq long")
    assert "late" not in {r.file for r in search.search(symbols, none, paths, "run", limit=3).collect()}
    assert search.search_by_score(symbols, none, paths, "run", limit=3).first().file == "late"
    assert search.search(symbols, none, paths, "run", pattern=".ts", limit=3).first().reason == "Filename match"
    assert {r.match for r in search.lookup(symbols, "run").collect()} == {"exact"}
    assert {r.match for r in search.lookup(symbols, "xru").collect()} == {"near"}


LONG = "\n".join(f"line {k}" for k in range(9))


def payload(n):
    part = {"type": "tool_result", "content": [{"type": "text", "text": LONG}]}
    call = {"functionResponse": {"response": {"a": 1, "b": [1, 2]}}}
    messages = []
    for k in range(n):
        messages += [{"role": "user", "content": [part, {"type": "text", "text": LONG}]}, {"role": "model", "content": {"type": "tool_use"}}, {"role": "user", "content": call}, {"role": "model", "content": [{"type": "text", "text": "done"}]}]
    return json.dumps({"llm_request": {"messages": messages}})


def test_masking(spark):
    raw = spark.createDataFrame([("s", payload(3)), ("bad", "{nope"), ("empty", ""), ("none", "{}")], "session string, value string")
    loaded = transcripts.payloads(raw)
    assert {r.session: (r.broken, r.messages is None) for r in loaded.collect()} == {"s": (False, False), "bad": (True, True), "empty": (False, True), "none": (False, True)}
    rows = transcripts.message_rows(loaded, "session")
    turned = masking.model_turns(rows)
    assert [r.turn_id for r in turned.orderBy("pos").collect()] == [0] * 4 + [1] * 4 + [2] * 4
    once = masking.mask(rows, keep=1)
    got = {r.pos: r.parts for r in once.collect()}
    assert "[...5 lines" in got[0][0]["content"][0]["text"] and got[0][1]["text"] == LONG
    assert got[8][0]["content"][0]["text"] == LONG
    twice = {r.pos: r.parts for r in masking.mask(once, keep=1).collect()}
    assert twice == got


def test_session_transcript(spark):
    raw = spark.createDataFrame([('{"session_transcript": "a", "transcript": "b"}',), ('{"transcript": [{"x": "y\\nz"}]}',), ("?",)], "value string")
    assert [r.transcript for r in transcripts.session_transcript(raw).collect()] == ["a", '[{"x":"y\\nz"}]', None]


TALK = """It was found in apps/lib/send.ts today. Implemented in apps/lib/send.ts again. Meteor.call('joinRoom', 1).
@app/ui resolves to packages/ui. Note: always run the formatter before a commit here. Convention: function calls are never to be nested deeply.
grep: no results for 'sendMessageX'. The package 'kit' exports a small set of helpers. not found: x"""


def test_lessons(spark):
    found = lessons.extract(spark.createDataFrame([(1, TALK)], "id int, text string"), "id", "text")
    first = lessons.first_seen(found, F.col("lesson"), [F.col("family"), F.col("pos")], ["id"]).orderBy("family", "pos").collect()
    assert [(r.type, r.lesson) for r in first] == [
        ("file-location", "File location: apps/lib/send.ts"), ("meteor-method", "Meteor method 'joinRoom' discovered in session"), ("alias", "Import alias @app/ui resolves to packages/ui."),
        ("convention", "always run the formatter before a commit here."), ("avoid", "Search term 'sendMessageX' yielded no results — use search_symbol instead"), ("module", "Package kit provides: a small set of helpers"),
    ]


def test_terms_and_cosine(spark):
    a = spark.createDataFrame([(1, "fürabc xyz xyz constructor"), (2, "one two three"), (3, ""), (4, None)], "id int, text string")
    b = spark.createDataFrame([(7, "xyz xyz rabc constructor"), (8, "two three four")], "k int, text string")
    ta, tb = lessons.terms(a, "id", "text"), lessons.terms(b, "k", "text")
    assert {(r.term, r.tf) for r in ta.where("id = 1").collect()} == {("rabc", 1), ("xyz", 2), ("constructor", 1)}
    assert {(r.id, r.k, round(r.cosine, 4)) for r in lessons.cosine_pairs(ta, tb, "id", "k").collect()} == {(1, 7, 1.0), (2, 8, 0.6667)}
    assert {(r.id, r.k) for r in lessons.cosine_pairs(ta, tb, "id", "k", 0.66).collect()} == {(1, 7), (2, 8)}
    assert {r.id for r in lessons.curate(a, b, "id", "text", "k", "text").collect()} == {2, 3, 4}


def test_playbook_round_trip(spark):
    text = transcripts.playbook_text("# Book\n\n## Other\nx\n", [("file-location", "in a.ts"), (None, "rest")], "2024-01-01")
    again = transcripts.playbook_text(text + "\n## After\n", [("avoid", "b")], "2024-01-02")
    got = transcripts.playbook_lessons(spark.createDataFrame([(text,), (again,)], "text string")).collect()
    assert [(r.type, r.lesson) for r in got] == [("file-location", "in a.ts"), ("general", "rest"), ("avoid", "b")]
    assert again.endswith("\n## After\n") and "in a.ts" not in again
    assert transcripts.load_playbook(spark, "/tmp/no-such-playbook").first().text.startswith("# Playbook")


def test_sinks(spark, tmp_path):
    transcripts.write_playbook(spark, str(tmp_path / "book.md"), "# Büch\n\ntext\n")
    assert transcripts.load_playbook(spark, str(tmp_path / "book.md")).first().text == "# Büch\n\ntext\n"
    rows = spark.createDataFrame([("one",), ("two",)], "text string")
    transcripts.write_text(rows, str(tmp_path / "texts"))
    transcripts.write_report(rows, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "texts")).collect()) == ["one", "two"] and spark.read.json(str(tmp_path / "report")).count() == 2


def test_learned_follow_old_ones(spark):
    old = spark.createDataFrame([("a", "x", 4), ("b", "y", 9)], "type string, lesson string, seq int")
    new = spark.createDataFrame([("c", "z", 0), ("d", "w", 1)], "type string, lesson string, seq int")
    assert [(r.seq, r.lesson) for r in lessons.learned(old, new).orderBy("seq").collect()] == [(4, "x"), (9, "y"), (10, "z"), (11, "w")]
    assert [r.seq for r in lessons.learned(old.limit(0), new).orderBy("seq").collect()] == [0, 1]


CALLS = "seq long, tool string, input_tokens long, output_tokens long, ms long, engine string, error string"


def test_telemetry(spark):
    calls = spark.createDataFrame([(1, "a", 4, 10, 5, "tree-sitter", None), (2, "a", 1, 20, 6, "regex-fallback", "x"), (3, "b", 1, 40, 1, None, None)], CALLS)
    assert telemetry.efficiency(calls).first().tree_rate == "50.0%"
    assert [x.tool for x in telemetry.report(calls).first().per_tool] == ["b", "a"]
    assert telemetry.call_sequence(calls).orderBy("seq").collect()[1].line == "2. a (6ms, ~20t out, regex-fallback, ERR)"
    none = telemetry.efficiency(calls.limit(0)).first()
    assert (none.tokens_per_call, none.tree_rate) == (0, "n/a")


def test_ingest_reparses_only_changes(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    seen = []

    def parse(df):
        seen.append(sorted(r.path for r in df.collect()))
        return df.select("path", "hash")

    def put(name, rows):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(str(source))

    put("1", [("a", "x"), ("b", "y")])
    schema = spark.read.parquet(str(source)).schema
    for rows in (None, [("a", "x"), ("b", "z")]):
        if rows:
            put("2", rows)
        live.ingest(live.file_stream(spark, str(source), schema), parse, target, str(tmp_path / "cp")).awaitTermination()
    assert [x for x in seen if x] == [["a", "b"], ["b"]]
    assert {(r.path, r.version) for r in live.current(spark, target).collect()} == {("a", 0), ("b", 1)}
    put("3", [("a", None), ("c", "w")])
    live.ingest(live.file_stream(spark, str(source), schema), parse, target, str(tmp_path / "cp")).awaitTermination()
    assert {(r.path, r.version) for r in live.current(spark, target).collect()} == {("b", 1), ("c", 2)}
    put("4", [("a", "x")])
    live.ingest(live.file_stream(spark, str(source), schema), parse, target, str(tmp_path / "cp")).awaitTermination()
    assert {r.path for r in live.current(spark, target).collect()} == {"a", "b", "c"}


def test_content_cache(spark, tmp_path):
    cache = files.load_cache(spark, str(tmp_path / "none"))
    assert cache.count() == 0
    rows = spark.createDataFrame([("a.ts", "h", [("f", "function", 1)], ["m"], ["b.ts"])], cache.schema)
    files.save_cache(rows, str(tmp_path / "cache"))
    symbols, methods, imports = files.restored(files.load_cache(spark, str(tmp_path / "cache")))
    assert symbols.first().name == "f" and methods.first().file == "a.ts" and imports.first().dst == "b.ts"
