"""Imports, call edges and the frontier, as joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinworks.functions.text import folded_path, folder_of

#: Suffixes tried in order for an import without one.
CANDIDATES = ("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")


def first_candidate(wanted: DataFrame, base: str, known: DataFrame, path: str, suffixes=CANDIDATES, keys: list[str] | None = None) -> DataFrame:
    """keys and `resolved`: for each wanted row the known path of the first suffix. An
    equi-join on the spelled-out candidates, then the least rank. Both sides grow with the
    files, and Spark guesses paths that are made from short columns far too small, so the join
    sorts: broadcast, they would meet in the driver."""
    keys = keys or wanted.columns
    spelled = wanted.select(*keys, F.posexplode(F.array(*(F.concat(F.col(base), F.lit(s)) for s in suffixes))).alias("__rank", "__path"))
    return spelled.join(known.select(F.col(path).alias("__path")).distinct().hint("merge"), "__path").groupBy(*keys).agg(F.min_by("__path", "__rank").alias("resolved"))


def _relative(specs: DataFrame) -> DataFrame:
    return specs.where(F.startswith("spec", F.lit("."))).select(F.col("file").alias("src"), "pos", "spec", folded_path(F.concat_ws("/", folder_of("file"), F.col("spec"))).alias("__base"))


def spellings(specs: DataFrame) -> DataFrame:
    """src, pos, spec, __rank, __path: the paths that a relative import could mean, in order."""
    spelled = F.posexplode(F.array(*(F.concat(F.col("__base"), F.lit(s)) for s in CANDIDATES)))
    return _relative(specs).select("src", "pos", "spec", spelled.alias("__rank", "__path"))


def imports(specs: DataFrame, files: DataFrame, folders_count: bool = False) -> DataFrame:
    """src, pos, spec, dst of relative imports. specs(file, pos, spec), files(path). With
    folders_count, a folder of the exact name wins over its index file."""
    wanted = _relative(specs)
    known = files.select("path")
    if folders_count:
        known = known.union(files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("path")).distinct())
    return first_candidate(wanted, "__base", known, "path", keys=["src", "pos", "spec", "__base"]).select("src", "pos", "spec", F.col("resolved").alias("dst"))


def reverse(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct reversed edges."""
    return edges.select(F.col(dst).alias("file"), F.col(src).alias("importer")).distinct()


def call_edges(calls: DataFrame, import_names: DataFrame, symbols: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Distinct from_id, to_id, from_exists, to_exists. calls(file, caller, callee_raw),
    import_names(file, local_name, orig_name, target), symbols(node_id, file, name). A callee
    whose first segment is imported goes to the import's target; else to a symbol of the same
    file. With parsed(path), callers and imported targets outside of it are left out."""
    # A chain over several lines, with `?.` or `!.`, has the same names.
    calls = calls.withColumn("callee_raw", F.regexp_replace("callee_raw", r"\s+|[?!](?=\.)", ""))
    head = F.split_part("callee_raw", F.lit("."), F.lit(1))
    sites = calls.withColumn("head", head).where(~F.col("head").isin("", "this")).withColumn("from_id", F.concat_ws("::", "file", "caller"))
    if parsed is not None:
        sites = sites.join(parsed.select(F.col("path").alias("file")), "file", "left_semi")
    named = import_names.select("file", F.col("local_name").alias("head"), "orig_name", "target")
    joined = sites.join(named.hint("merge"), ["file", "head"], "left")  # as in first_candidate
    if parsed is not None:
        within = parsed.select(F.col("path").alias("target"), F.lit(True).alias("__in")).distinct()
        joined = joined.join(within, "target", "left").where("target IS NULL OR __in")
    last = F.when(F.instr("callee_raw", ".") > 0, F.substring_index("callee_raw", ".", -1)).otherwise(F.coalesce("orig_name", "head"))
    # Both kinds come out of one pass over the sites; those of the same file have to exist.
    across = F.col("target").isNotNull()
    to_id = F.when(across, F.concat_ws("::", "target", last)).otherwise(F.concat_ws("::", "file", "head"))
    edges = joined.groupBy("from_id", to_id.alias("to_id")).agg(F.max(across).alias("__across"))
    return with_ends(edges, symbols).where("__across OR to_exists").drop("__across")


def with_ends(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """edges(from_id, to_id) with from_exists and to_exists."""
    ids = nodes.select(F.col(node).alias("__n")).distinct()
    for end in ("from", "to"):
        mark = ids.select(F.col("__n").alias(f"{end}_id"), F.lit(True).alias(f"{end}_exists"))
        edges = edges.join(mark.hint("merge"), f"{end}_id", "left").withColumn(f"{end}_exists", F.coalesce(f"{end}_exists", F.lit(False)))
    return edges


def frontier(files: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Known and not parsed."""
    return files.join(parsed.select(key).distinct(), key, "left_anti")


def parsed_only(files: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    return files.join(parsed.select(key).distinct(), key, "left_semi")


def last_writer(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's value of the last row in order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def join_or_fallback(left: DataFrame, first: DataFrame, second: DataFrame, key: str, fallback: str, value: str) -> DataFrame:
    """left with value from first by key, else from second by fallback; `via` names which."""
    one = left.join(first.select(key, F.col(value).alias("__a")), key, "left")
    two = one.join(second.select(fallback, F.col(value).alias("__b")), fallback, "left")
    return two.withColumn("via", F.when(F.col("__a").isNotNull(), "key").when(F.col("__b").isNotNull(), "fallback")).withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
