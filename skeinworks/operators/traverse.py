"""Bounded breadth-first traversal: impact of a change, and scopes around seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skeinworks.operators.listing import bounded
from skeinworks.session import stored
from skeinworks.sources.files import numbered


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, src: str = "src", dst: str = "dst", seed: str = "id", expandable: DataFrame | None = None) -> DataFrame:
    """id, depth of all that reaches a seed over edges src -> dst, by the fewest steps; seeds
    excluded. Cycles end as known ids leave each level by an anti-join. With expandable(id),
    other ids are reported and not followed. Each level is stored, so a plan holds one level:
    one scan of the edges, joined with the level (Spark broadcasts a small one, and leaves
    the edges unshuffled then). An empty level ends the traversal early."""
    bounded(max_depth, 1, 6, "max_depth")
    back = edges.select(F.col(dst).alias("__at"), F.col(src).alias("id"))
    seen = stored(seeds.select(F.col(seed).alias("id"), F.lit(0).alias("depth")).distinct(), "impact")
    level, found = seen, seen.where("depth > 0")
    for depth in range(1, max_depth + 1):
        step = level if expandable is None or depth == 1 else level.join(expandable.select("id").distinct(), "id", "left_semi")
        new = step.select(F.col("id").alias("__at")).join(back, "__at").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        level = stored(new.withColumn("depth", F.lit(depth)), "impact")
        if level.isEmpty():
            break
        seen, found = seen.unionByName(level), found.unionByName(level)
    return found


#: Seeds that one word of bits stands for.
WORD = 64


def impact_of_each(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, src: str = "src", dst: str = "dst", seed: str = "id", expandable: DataFrame | None = None) -> DataFrame:
    """seed, id, depth: what `impact` gives for each seed alone, by one traversal of all. Seeds
    are numbered, WORD of them are the bits of a word, and a row (id, word, bits) says which
    reach an id: a level is one join with the edges and a bitwise OR by id and word, whatever
    the number of seeds that meet there."""
    bounded(max_depth, 1, 6, "max_depth")
    back = edges.select(F.col(dst).alias("__at"), F.col(src).alias("id")).distinct()
    numbered_ = numbered(seeds.select(F.col(seed).alias("id")).distinct(), "id")
    words = numbered_.select("id", "seq", F.floor(F.col("seq") / WORD).alias("word"), F.expr(f"shiftleft(1L, CAST(seq % {WORD} AS INT))").alias("bits"))
    words = stored(words, "impact-seeds")
    seen = words.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    level, found = seen, []
    for depth in range(1, max_depth + 1):
        step = level if expandable is None or depth == 1 else level.join(expandable.select("id").distinct(), "id", "left_semi")
        met = step.withColumnRenamed("id", "__at").join(back, "__at").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
        known = seen.select("id", "word", F.col("bits").alias("__seen"))
        fresh = met.join(known, ["id", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("__seen", F.lit(0).cast("long"))))).drop("__seen")
        level = stored(fresh.where("bits <> 0"), "impact-level")
        if level.isEmpty():
            break
        found.append(level.withColumn("depth", F.lit(depth)))
        seen = stored(seen.unionByName(level).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")), "impact-seen")
    if not found:
        return seeds.sparkSession.createDataFrame([], f"seed {seeds.schema[seed].dataType.simpleString()}, id {edges.schema[src].dataType.simpleString()}, depth int")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    ones = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1)
    each = every.select("id", "depth", "word", F.explode(ones).alias("bit")).select("id", "depth", (F.col("word") * WORD + F.col("bit")).alias("seq"))
    return each.join(words.select(F.col("id").alias("seed"), "seq"), "seq").select("seed", "id", "depth")


def direct_dependencies(edges: DataFrame, file: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """What a file imports, repeated imports included."""
    return edges.where(F.col(src) == file).select(dst)


def seed_files(queries: list[str], files: DataFrame, symbols: DataFrame, methods: DataFrame, per_query: bool = False) -> DataFrame:
    """file, ord, reason of the seeds: known paths, files of exact symbols, files of methods;
    five files by part of a name only where nothing else was found (with per_query: for each
    query that found nothing). A later reason replaces an earlier one; the first place stays.
    files(path), symbols(name, kind, file, seq), methods(name, file, seq)."""
    is_path = [q.endswith((".ts", ".tsx", ".js", ".jsx")) for q in queries]
    # The queries of one call are a literal, so each table is read once for all of them.
    asked = lambda paths: F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(q).alias("q")) for k, q in enumerate(queries) if is_path[k] == paths)).cast("array<struct<k:bigint,q:string>>")
    met = lambda rows, paths, test: rows.select("*", F.explode(F.filter(asked(paths), test)).alias("x")).select(*rows.columns, "x.*")
    place = F.col("k") * (1 << 40)
    direct = met(files.select("path"), True, lambda x: x["q"] == F.col("path")).select("k", F.col("path").alias("file"), place.alias("ord"), F.concat(F.lit("direct:"), "q").alias("reason"))
    hits = met(symbols.select("name", "kind", "file", "seq"), False, lambda x: F.contains(F.lower("name"), F.lower(x["q"])))
    exact = hits.where("name = q").select("k", "file", (place + F.col("seq")).alias("ord"), F.concat(F.lit("symbol:"), "q", F.lit("("), "kind", F.lit(")")).alias("reason"))
    rpc = met(methods.select("name", "file", "seq"), False, lambda x: x["q"] == F.col("name")).groupBy("k", "q").agg(F.max_by("file", "seq").alias("file")).select("k", "file", (place + (1 << 39)).alias("ord"), F.concat(F.lit("rpc:"), "q").alias("reason"))
    own = direct.unionByName(exact).unionByName(rpc)
    near = hits.groupBy("k", "file").agg(F.min("seq").alias("seq"), F.max_by("name", "seq").alias("name"))
    near = near.withColumn("__r", F.row_number().over(Window.partitionBy("k").orderBy("seq"))).where("__r <= 5")
    fuzzy = near.join(own.select("k").distinct(), "k", "left_anti").select("k", "file", (place + F.col("seq")).alias("ord"), F.concat(F.lit("fuzzy:"), "name").alias("reason"))
    if not per_query:
        first = own.select("k").unionByName(fuzzy.select("k")).agg(F.min("k").alias("__first"))
        fuzzy = fuzzy.crossJoin(first).where("k = __first").drop("__first")  # first is one row
    return own.unionByName(fuzzy).groupBy("file").agg(F.min("ord").alias("ord"), F.max_by("reason", "ord").alias("reason"))


def scope(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_files: int = 40) -> DataFrame:
    """file, depth, score, reason around seeds(file, ord, reason). edges(src, dst, pos).
    Each level follows imports (score 100 - 25 * depth), and at depth 1 importers too (60);
    a file keeps the first reason that reaches it, in the order of the frontier, imports
    before importers, position. A level stops after the frontier file that fills max_files,
    then the best by score, depth and order remain."""
    bounded(max_depth, 1, 3, "max_depth")
    bounded(max_files, 1, 60, "max_files")
    seen = seeds.select("file", F.lit(0).alias("depth"), F.lit(100).alias("score"), "reason", F.array(F.col("ord"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("place"))
    level = seen
    for depth in range(1, max_depth + 1):
        near = level.select(F.col("file").alias("via"), "place")
        out = near.join(edges, F.col("via") == F.col("src")).select(F.col("dst").alias("file"), F.lit(100 - 25 * depth).alias("score"), F.concat(F.lit("dep-of:"), "via").alias("reason"), "place", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"))
        if depth == 1:
            back = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
            out = out.unionByName(near.join(back, F.col("via") == F.col("dst")).select(F.col("src").alias("file"), F.lit(60).alias("score"), F.concat(F.lit("imports:"), "via").alias("reason"), "place", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos")))
        first = out.join(seen.select("file"), "file", "left_anti").groupBy("file").agg(F.min(F.struct("place", "kind", "pos", "reason", "score")).alias("m"))
        # Files of a level, in the order in which they are met: a bounded head is enough, as
        # the frontier file that fills the scope is among the first max_files to be met.
        ranked = first.select("file", F.lit(depth).alias("depth"), "m.score", "m.reason", F.col("m.place").alias("via_place"), "m.kind", "m.pos")
        filled = seen.agg(F.count("*").alias("__n"))
        cut = ranked.orderBy("via_place", "kind", "pos", "file").limit(max_files).crossJoin(filled)  # one row
        order = Window.partitionBy("depth").orderBy("via_place", "kind", "pos", "file")
        last = cut.withColumn("__r", F.row_number().over(order)).where(F.col("__r") + F.col("__n") >= max_files).agg(F.min("via_place").alias("__last"))
        level = stored(
            ranked.crossJoin(last).where(F.col("__last").isNull() | (F.col("via_place") <= F.col("__last"))).crossJoin(filled).where(F.col("__n") < max_files)
            .select("file", "depth", "score", "reason", F.concat(F.array(F.element_at("via_place", 1)), F.array(F.col("kind").cast("long"), "pos")).alias("__p"), "via_place", "kind", "pos")
            .withColumn("place", F.concat("via_place", F.array(F.col("kind").cast("long"), "pos"))).drop("__p", "via_place", "kind", "pos"),
            "scope",
        )
        seen = seen.unionByName(level)
    return seen.orderBy(F.desc("score"), "depth", "place", "file").limit(max_files).drop("place")
