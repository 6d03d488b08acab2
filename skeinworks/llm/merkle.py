"""A Merkle manifest of a dataset, by a rollup of nested structs.

Every document is a leaf at its rank among those of its language. A rank has digits to the
base 32; a block is what two digits tell apart, 1,024 nodes at most. Within a block the lowest
digit is grouped away first, then the next: each group's nodes become an array of structs
inside their parent's struct, with the hashes beside them, so a block ends as one nested row of
bounded size. Its hash is a node of the tier above, which is rolled up likewise, until one node
is left to a language; languages are then rolled up by their own ranks.

Going down, a block meets the path above it as one more row of its group, and a transform over
the nested arrays with an explode gives every node its path: no join, and a leaf moves twice,
the first time as its hash alone.

Defined results
* null columns: `-` in the leaf. Null language: a language of its own, first in order. Null id:
  a leaf like others, before all other ids of its language; it is never tampered with. Null
  n_chars stays null where tampering would raise it.
* ties: rows of one id and language stand in the order of their leaves; equal rows are
  interchangeable. Each row has its own proof.
* empty and very long texts: hashed whole, as any. Empty table: no rows.
* extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinworks.session import discard, stored

#: Levels of the tree that one digit of a rank stands for, and digits of a block.
LEVELS, DIGITS = 5, 2
BASE, BLOCK = 1 << LEVELS, LEVELS * DIGITS
STEP = "struct<right:boolean,other:string>"
ABOVE = f"struct<subroot:string,root:string,path:array<{STEP}>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def spelt(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return sha(*(spelt(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """rows with `at` (rank in its group from 0, by order) and `n` (rows of the group), stored.
    Rows are sorted into ranges, by a number of their own last, so that equal rows may part; one
    count to a range and group is all that meets."""
    # Ranges are drawn from a stored table, which reads the same each time.
    spread = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), f"{label}-rows")
    keys = [group, *order, "__tie"]
    sorted_ = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = stored(sorted_.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), f"{label}-ranges")
    of_group = Window.partitionBy(group)
    counts = placed.groupBy("__range", group).agg(F.min("__place").alias("__low"), F.count("*").alias("__n"))
    before = F.sum("__n").over(of_group.orderBy("__range")) - F.col("__n")
    base = counts.select("__range", F.col(group).alias("__group"), (before - F.col("__low")).alias("__base"), F.sum("__n").over(of_group).alias("n"))
    same = (placed["__range"] == base["__range"]) & placed[group].eqNullSafe(base["__group"])
    out = stored(placed.join(base.drop("__low"), same).withColumn("at", F.col("__base") + F.col("__place")).select(*rows.columns, "at", "n"), label)
    discard(spread, placed)
    return out


def depth(n: Column) -> Column:
    """Levels of a tree over n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


#: The hashes of consecutive pairs of the level below, a last one alone.
PAIRS = "transform(sequence(0, greatest(size({below}) - 1, 0), 2), i -> sha2(concat({below}[i], coalesce(get({below}, i + 1), '')), 256))"


def _grouped(rows: DataFrame, keys: list[str], digit: int, kids: bool) -> DataFrame:
    """One digit grouped away. rows(keys, at, deep, hash, and node, above with kids): of the
    nodes that differ in the lowest digit of `at` alone, one remains, whose struct holds them
    with their steps through the levels that the digit stands for. Of those levels only as many
    exist as `deep` says; the others repeat the last that does."""
    own = F.struct("at", "hash", *(["node"] if kids else []))
    met = [F.first("above", True).alias("above")] if kids else []
    up = rows.groupBy(*keys, F.shiftright("at", LEVELS).alias("__up")).agg(F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), own))).alias("__kids"), F.max("deep").alias("deep"), *met)
    up = up.selectExpr("*", "__kids.hash AS __l0", f"deep - {LEVELS * digit} AS __here")
    for k in range(LEVELS):  # columns one by one, so that each is computed once
        up = up.selectExpr("*", f"IF(__here > {k}, {PAIRS.format(below=f'__l{k}')}, __l{k}) AS __l{k + 1}")
    out = [*keys, "__up AS at", "deep", f"get(__l{LEVELS}, 0) AS hash"]
    if kids:
        steps = ", ".join(f"IF(__here > {k}, named_struct('right', (x.at >> {k}) % 2 = 1, 'other', get(__l{k}, CAST((x.at % {BASE}) >> {k} AS INT) ^ 1)), NULL)" for k in range(LEVELS))
        out += [f"transform(__kids, x -> named_struct('at', x.at, 'hash', x.hash, 'node', x.node, 'steps', filter(array({steps}), s -> s IS NOT NULL))) AS node", "above"]
    return up.selectExpr(*out)


def _block(rows: DataFrame, keys: list[str], kids: bool) -> DataFrame:
    """A block's digits grouped away in turn, after one shuffle: groups by more columns stand
    where groups by fewer do."""
    rows = rows.withColumn("__block", F.shiftright("at", BLOCK)).repartition(*keys, "__block")
    for digit in range(DIGITS):
        rows = _grouped(rows, [*keys, "__block"], digit, kids)
    return rows.drop("__block")


def _up(nodes: DataFrame, keys: list[str], deepest: int, label: str) -> list[DataFrame]:
    """The tiers above nodes(keys, at, deep, hash), each stored, up to one node to every key."""
    tiers, left = [nodes], deepest
    while left > 0 or len(tiers) == 1:
        up = _block(tiers[-1].select(*keys, "at", "deep", "hash"), keys, False)
        tiers.append(stored(up.withColumn("deep", F.greatest(F.col("deep") - BLOCK, F.lit(0))), label))
        left -= BLOCK
    return tiers


def _down(nodes: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, at, hash, above of nodes(keys, at, deep, hash, node), from above(keys, at,
    above) of their blocks: paths grow by a block's levels."""
    parents = above.select(*keys, F.shiftleft("at", BLOCK).alias("at"), "above")
    met = _block(nodes.unionByName(parents, allowMissingColumns=True), keys, True)
    inner = lambda k: F.transform(k["node"], lambda x: F.struct(x["node"].alias("node"), x["at"].alias("at"), x["hash"].alias("hash"), F.concat(x["steps"], k["steps"]).alias("steps")))
    each = met.select(*keys, "above", F.explode(F.flatten(F.transform("node", inner))).alias("x"))
    path = F.struct(F.col("above.subroot"), F.col("above.root"), F.concat("x.steps", "above.path").alias("path"))
    return each.select(*keys, "x.node", "x.at", "x.hash", path.alias("above"))


def tree(leaves: DataFrame, label: str = "merkle") -> DataFrame:
    """node, leaf, subroot, root, path for leaves(lang, at, n, hash, node): the path holds a
    step for each level from the leaf to the root, the other node of its run (null where it
    stands alone) and whether it is the right one."""
    nodes = leaves.withColumn("deep", depth(F.col("n"))).drop("n")
    tiers = _up(nodes, ["lang"], nodes.agg(F.max("deep")).first()[0] or 0, label)
    top = ranked(tiers[-1].select("lang", F.col("hash").alias("subroot"), F.lit(0).alias("all")), "all", ["lang"], f"{label}-langs")
    langs = top.select("all", "at", depth(F.col("n")).alias("deep"), F.col("subroot").alias("hash"), F.struct("lang", "subroot").alias("node"))
    over = _up(langs, ["all"], langs.agg(F.max("deep")).first()[0] or 0, label)
    above = over[-1].select("all", "at", F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")).alias("above"))
    for tier in reversed(over[:-1]):
        above = _down(tier if "node" in tier.columns else tier.withColumn("node", F.lit(None).cast(langs.schema["node"].dataType)), above, ["all"])
    above = above.select("node.lang", F.lit(0).cast("long").alias("at"), F.struct(F.col("node.subroot"), "above.root", "above.path").alias("above"))
    for tier in reversed(tiers[:-1]):
        above = _down(tier if "node" in tier.columns else tier.withColumn("node", F.lit(None).cast(nodes.schema["node"].dataType)), above, ["lang"])
    return above.select("node", F.col("hash").alias("leaf"), "above.*")


def folded(start: Column, path: str) -> Column:
    """The root that a leaf and the others on its path give."""
    other = lambda s: F.coalesce(s["other"], F.lit(""))
    return F.aggregate(path, start, lambda done, s: sha(F.when(s["right"], F.concat(other(s), done)).otherwise(F.concat(done, other(s)))))


def proofs(docs: DataFrame, tampered: Column | None = None, change: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified for docs(doc_id, source, lang,
    n_chars, text). Rows for which `tampered` holds fold the leaf that they have with n_chars
    replaced by `change`; without it none is."""
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    altered = F.when(F.coalesce(tampered, F.lit(False)), leaf(change)) if tampered is not None else F.lit(None).cast("string")
    # Texts are read once; hashes travel from here on.
    light = docs.select("lang", "doc_id", leaf(F.col("n_chars")).alias("hash"), altered.alias("altered"))
    at = ranked(light, "lang", ["doc_id", "hash"], "merkle-leaves")
    found = tree(at.select("lang", "at", "n", "hash", F.struct("doc_id", "altered").alias("node")))
    root = folded(F.coalesce("node.altered", "leaf"), "path")
    out = found.select("node.doc_id", "leaf", "subroot", "root", "path", root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every document's
    proof, checked against the root; where 7 divides the crc32 of the id, n_chars is one more
    than it was hashed with."""
    checked = proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    others = F.filter(F.transform("path", lambda s: s["other"]), lambda x: x.isNotNull())
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(others, ""), 256).alias("proof_sha256"), "folded_root", "verified")
