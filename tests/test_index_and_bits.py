"""The gram index and the bit-parallel traversal against nested loops and single traversals."""

import random

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import search, traverse


def test_lookup_all_equals_lookup(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 6)))
    known, asked = sorted({word() for _ in range(60)} | {"é漢🙂x"}), sorted({word() for _ in range(80)} | {"漢🙂", "zz", "é漢🙂xy"})
    names = spark.createDataFrame([(n, k) for k, n in enumerate(known)] + [(known[3], 99), (None, 7)], "name string, k int")
    wanted = spark.createDataFrame([(w,) for w in asked] * 2 + [(None,)], "want string")
    found = search.lookup_all(names, wanted, "name", "want")
    got = {}
    for r in found.collect():
        got.setdefault(r.want, set()).add((r.name, r.k, r.match))
    for w in asked:
        if w == "":
            continue  # holds in everything: only an exact one is found
        near = [n for n in known if n and (n in w or w in n)][:5]
        want = {(w, k, "exact") for n, k in ((n, k) for k, n in enumerate(known)) if n == w} | ({(w, 99, "exact")} if known[3] == w else set())
        if not want:
            want = {(n, k, "near") for n in near for k in ([known.index(n), 99] if n == known[3] else [known.index(n)])}
        assert got.get(w, set()) == want, w
    assert None not in got
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("bounded", [False, True])
def test_impact_of_each_equals_impact(spark, bounded):
    rnd = random.Random(6)
    nodes = [f"n{k}" for k in range(90)]
    edges = spark.createDataFrame([(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(130)] + [("n1", "n2"), ("n2", "n1")], "src string, dst string")
    seeds = spark.createDataFrame([(n,) for n in nodes[:70]] + [("n3",), ("gone",)], "id string")
    expandable = spark.createDataFrame([(n,) for n in nodes[::2]], "id string") if bounded else None
    got = {tuple(r) for r in traverse.impact_of_each(edges, seeds, 3, expandable=expandable).collect()}
    by = {}
    for a, b in {tuple(r) for r in edges.collect()}:
        by.setdefault(b, []).append(a)
    want = set()
    for s in {r.id for r in seeds.collect()}:
        depth, level = {s: 0}, [s]
        for d in range(1, 4):
            level = [x for x in dict.fromkeys(a for n in level if d == 1 or not bounded or n in nodes[::2] for a in by.get(n, [])) if x not in depth]
            depth |= dict.fromkeys(level, d)
        want |= {(s, n, d) for n, d in depth.items() if n != s}
    assert got == want
    one = {(r.id, r.depth) for r in traverse.impact(edges, spark.createDataFrame([("n5",)], "id string"), 3, expandable=expandable).collect()}
    assert one == {(n, d) for s, n, d in got if s == "n5"}
    assert traverse.impact_of_each(edges, seeds.where("id = 'gone'"), 3).count() == 0
