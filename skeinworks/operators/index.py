"""An eager index of a whole source tree, with reuse by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinworks.operators import parse, resolve
from skeinworks.session import stored
from skeinworks.sources.files import split_by_cache


def parsed_file(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, symbols, methods, imports of every source: symbols by the older line rules over
    skeletons, methods by pattern, single-line imports resolved among files(path)."""
    shown = parse.skeletons(sources, parse.parse(sources))
    found = parse.symbols_of_lines(shown, "path", "skeleton", exported_variables=True)
    listed = lambda df, key, name, *cols: df.groupBy(F.col(key).alias("path")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    symbols = listed(found, "path", "s", F.col("pos"), F.col("name"), F.col("kind"))
    methods = parse.rpc_methods_by_pattern(sources).groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list("name")).alias("methods"))
    edges = resolve.imports(parse.import_specs(sources, single_line=True), files).where("dst IS NOT NULL")
    imports = listed(edges, "src", "i", F.col("pos"), F.col("dst"))
    out = sources.select("path").join(symbols, "path", "left").join(methods, "path", "left").join(imports, "path", "left")
    symbol = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["pos"].alias("line")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select(
        "path", none(symbol, "array<struct<name:string,kind:string,line:int>>").alias("symbols"),
        none(F.col("methods"), "array<string>").alias("methods"), none(F.transform("i", lambda x: x["dst"]), "array<string>").alias("imports"),
    )


def content_index(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache's rows (path, hash, symbols, methods, imports) for all sources, and `reused`:
    files whose hash the cache holds keep its row, only the others are parsed."""
    marked = stored(split_by_cache(sources.select("path", "content"), cache), "index-sources")
    fresh = marked.where("NOT reused")
    new = parsed_file(fresh.select("path", "content"), sources.select("path")).join(fresh.select("path", "hash"), "path")
    kept = cache.join(marked.where("reused").select("path"), "path", "left_semi")
    columns = ["path", "hash", "symbols", "methods", "imports"]
    return new.select(columns).withColumn("reused", F.lit(False)).unionByName(kept.select(columns).withColumn("reused", F.lit(True)))
