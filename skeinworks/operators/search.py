"""Ranked symbol search and name look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skeinworks.functions.text import contains_any_case
from skeinworks.operators.listing import bounded

#: Scores of the three phases.
EXACT, PARTIAL, METHOD, FILE = 100, 80, 90, 60

SYMBOL = "array<struct<name string, kind string, line int>>"


def _phases(symbols: DataFrame, methods: DataFrame, files: DataFrame, query: str, pattern: str | None) -> list[DataFrame]:
    """symbols(name, kind, file, line, seq), methods(name, file, seq), files(path, seq)."""
    in_file = (lambda c: F.contains(F.col(c), F.lit(pattern))) if pattern else (lambda c: F.lit(True))
    hit = lambda name, kind, line: F.array(F.struct(name.alias("name"), kind.alias("kind"), line.cast("int").alias("line")))
    one = symbols.where(contains_any_case("name", query) & in_file("file")).select(
        "file", F.when(F.lower("name") == query.lower(), EXACT).otherwise(PARTIAL).alias("score"), hit(F.col("name"), F.col("kind"), F.col("line")).alias("symbols"), F.lit("Symbol match").alias("reason"), F.lit(1).alias("phase"), "seq")
    two = methods.where(contains_any_case("name", query) & in_file("file")).select(
        "file", F.lit(METHOD).alias("score"), hit(F.col("name"), F.lit("rpc_method"), F.lit(0)).alias("symbols"), F.lit("Method match").alias("reason"), F.lit(2).alias("phase"), "seq")
    three = files.where(contains_any_case("path", query) & in_file("path")).select(
        F.col("path").alias("file"), F.lit(FILE).alias("score"), F.array().cast(SYMBOL).alias("symbols"), F.lit("Filename match").alias("reason"), F.lit(3).alias("phase"), "seq")
    return [one, two, three]


def search(symbols: DataFrame, methods: DataFrame, files: DataFrame, query: str, pattern: str | None = None, limit: int = 15) -> DataFrame:
    """The first hits in the order symbols, methods, file names, and only then by score: the
    contract of the search tool, in which late exact hits can be lost. Each phase keeps its
    own first hits before they meet."""
    bounded(limit, 1, 50, "limit")
    one, two, three = (p.orderBy("seq").limit(limit) for p in _phases(symbols, methods, files, query, pattern))
    first = one.unionByName(two).unionByName(three).orderBy("phase", "seq").limit(limit)
    return first.orderBy(F.desc("score"), "phase", "seq")


def search_by_score(symbols: DataFrame, methods: DataFrame, files: DataFrame, query: str, pattern: str | None = None, limit: int = 15) -> DataFrame:
    """The hits with the highest scores over all phases."""
    bounded(limit, 1, 50, "limit")
    one, two, three = _phases(symbols, methods, files, query, pattern)
    return one.unionByName(two).unionByName(three).orderBy(F.desc("score"), "phase", "seq").limit(limit)


def search_whole_names(symbols: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """As `search` over symbols alone, but a name's hits stay together: all of the name that
    holds the limit's hit compete, then the best by score remain."""
    bounded(limit, 1, 50, "limit")
    hits = symbols.where(contains_any_case("name", query)).withColumn("score", F.when(F.lower("name") == query.lower(), EXACT).otherwise(PARTIAL))
    named = hits.groupBy("name").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    head = named.orderBy("first").limit(limit)  # limit names hold limit hits at least
    before = head.alias("a").join(head.alias("b"), F.col("b.first") < F.col("a.first"), "left").groupBy(F.col("a.name").alias("name"), F.col("a.first").alias("first")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return hits.join(F.broadcast(before.where(F.col("before") < limit)), "name").orderBy(F.desc("score"), "first", "seq").limit(limit)


def lookup(names: DataFrame, wanted: str, name: str = "name", limit: int = 5) -> DataFrame:
    """Rows of the exact name; else up to `limit` whose name holds it or is held by it."""
    exact = names.where(F.col(name) == wanted).withColumn("match", F.lit("exact"))
    near = names.where(F.contains(F.col(name), F.lit(wanted)) | F.contains(F.lit(wanted), F.col(name))).withColumn("match", F.lit("near"))
    none = exact.agg(F.count("*").alias("__n")).where("__n = 0")
    return exact.unionByName(near.orderBy(name).limit(limit).crossJoin(none).drop("__n"))  # one row or none


#: Characters of a gram of the containment index.
GRAM = 3


def grams(rows: DataFrame, text: str, least: int = GRAM) -> DataFrame:
    """text, gram: the distinct posting list of every text, grams of `least` to GRAM characters.
    A text shorter than GRAM is a gram of its own."""
    each = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda at: F.substring(F.col(text), at, F.lit(k)))
    every = F.array_distinct(F.flatten(F.array(*(each(k) for k in range(least, GRAM + 1)))))
    return rows.select(text, F.explode(every).alias("gram"))


def holders(inner: DataFrame, outer: DataFrame, part: str, whole: str) -> DataFrame:
    """part, whole: all pairs of distinct texts of which the whole holds the part. A text that
    holds another has all of its grams, so each part asks for its rarest one alone: one
    equi-join on grams with the wholes' posting lists, then the exact test. Empty parts hold in
    everything and are left out."""
    parts, wholes = inner.select(part).distinct().where(F.length(part) > 0), outer.select(whole).distinct()
    # A part shorter than a gram asks for itself, so wholes list their shorter grams too.
    listed = grams(wholes, whole, 1)
    often = listed.groupBy("gram").agg(F.count("*").alias("__often"))
    asked = grams(parts, part).join(often, "gram", "left").groupBy(part).agg(F.min_by("gram", F.struct(F.coalesce("__often", F.lit(0)), "gram")).alias("gram"))
    return asked.join(listed, "gram").where(F.contains(F.col(whole), F.col(part))).select(part, whole)


def lookup_all(names: DataFrame, wanted: DataFrame, name: str, want: str, limit: int = 5) -> DataFrame:
    """`lookup` for a whole column of wanted names: want, the columns of names, match: rows of
    the exact name; else of the first `limit` names, in their order, that hold it or are held
    by it. No pair is made but of texts that share a gram."""
    asked, known = wanted.select(F.col(want).alias("__want")).distinct(), names.select(F.col(name).alias("__name")).distinct()
    exact = asked.join(known, F.col("__want") == F.col("__name")).withColumn("match", F.lit("exact"))
    rest = asked.join(known, F.col("__want") == F.col("__name"), "left_anti")
    near = holders(rest, known, "__want", "__name").unionByName(holders(known, rest, "__name", "__want")).distinct()
    first = F.row_number().over(Window.partitionBy("__want").orderBy("__name"))
    near = near.withColumn("__r", first).where(F.col("__r") <= limit).drop("__r").withColumn("match", F.lit("near"))
    pairs = exact.unionByName(near)
    return pairs.join(names, F.col("__name") == F.col(name)).select(F.col("__want").alias(want), *names.columns, "match")


def resolve_alias(aliases: DataFrame, wanted: str) -> DataFrame:
    """alias, target, match: the exact alias; else the one before the first slash; else five
    that hold it or are held by it; else the first eight known."""
    ranked = aliases.select("alias", "target", F.when(F.col("alias") == wanted, 1).when(F.col("alias") == wanted.split("/")[0], 2).when(F.contains(F.col("alias"), F.lit(wanted)) | F.contains(F.lit(wanted), F.col("alias")), 3).otherwise(4).alias("__k"))
    best = ranked.agg(F.min("__k").alias("__b"))
    kinds = F.create_map(*(F.lit(x) for p in ((1, "exact"), (2, "head"), (3, "near"), (4, "known")) for x in p))
    found = ranked.crossJoin(best).where("__k = __b")  # best is one row
    keep = found.orderBy("alias").limit(8)
    return keep.withColumn("__r", F.expr("row_number() over (partition by __k order by alias)")).where("__k <> 3 OR __r <= 5").select("alias", "target", kinds[F.col("__k")].alias("match"))
