"""Source trees, import aliases and the content cache."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinworks.functions.text import folded_path, relative_to
from skeinworks.session import stored

#: Folders that hold no sources, and suffixes that do.
SKIPPED = ("node_modules", "dist", "build", ".git", ".meteor")
SUFFIXES = ("ts", "tsx", "js", "jsx")


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content of every source file under root, listed in parallel by Spark."""
    raw = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
        .select(F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"\+", "%2B"), "^file:/*", "/")).alias("path"), F.col("value").alias("content"))
    )
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return raw.withColumn("path", relative_to("path", root)).where(~F.col("path").rlike(skipped))


def numbered(files: DataFrame, order: str = "path") -> DataFrame:
    """files with `seq`, dense and distributed: a count of each range and its rank inside.
    Ranges come from a sort; only one count a range meets in one place."""
    # Stored with their numbers: numbers taken again on another plan would not be the same.
    ranged = stored(files.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    first = ranged.groupBy("__p").agg(F.min("__i").alias("__low"), F.count("*").alias("__n"))
    base = first.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(base), "__p").withColumn("seq", F.col("__base") + F.col("__i") - F.col("__low")).drop("__p", "__i", "__low", "__n", "__base")


def read_file(sources: DataFrame, path: str) -> DataFrame:
    """The row of one path; none if it is missing."""
    return sources.where(F.col("path") == path)


def _without_comments(text: str) -> str:
    """JSON text without // and /* */ comments; strings stay as they are."""
    out, k, quoted = [], 0, False
    while k < len(text):
        c = text[k]
        if quoted:
            out.append(text[k : k + 2] if c == "\\" else c)
            k += 2 if c == "\\" else 1
            quoted = c != '"'
        elif text.startswith("//", k):
            k = (text.find("\n", k) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", k):
            k = (text.find("*/", k + 2) + 2) if text.find("*/", k + 2) >= 0 else len(text)
        else:
            quoted = c == '"'
            out.append(c)
            k += 1
    return "".join(out)


def alias_map(spark: SparkSession, config_text: str) -> DataFrame:
    """alias, target from a compiler configuration's `paths`: the first target of each alias,
    without a trailing /*, under baseUrl. Broken text: no rows."""
    try:
        options = json.loads(_without_comments(config_text)).get("compilerOptions") or {}
    except ValueError:
        options = {}
    base, found = options.get("baseUrl") or ".", []
    for alias, targets in (options.get("paths") or {}).items():
        if targets:
            found.append((alias.removesuffix("/*"), f"{base}/{targets[0].removesuffix('/*')}"))
    rows = spark.createDataFrame(found, "alias string, target string")
    return rows.withColumn("target", folded_path(F.col("target")))


def digested(sources: DataFrame, content: Column | str = "content") -> DataFrame:
    """sources with `hash`, the MD5 of the content."""
    return sources.withColumn("hash", F.md5(content))


def split_by_cache(sources: DataFrame, cache: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """sources with `hash` and `reused`: whether the cache holds this key with this hash."""
    known = cache.select(F.col(key), F.col("hash").alias("__old")).dropDuplicates([key])
    return digested(sources, content).join(known, key, "left").withColumn("reused", F.coalesce(F.col("hash") == F.col("__old"), F.lit(False))).drop("__old")


def save_cache(parsed: DataFrame, path: str) -> None:
    parsed.write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path; an empty one where there is none."""
    from pyspark.errors import AnalysisException

    schema = "path string, hash string, symbols array<struct<name string, kind string, line int>>, methods array<string>, imports array<string>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def restored(cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of symbols, methods and imports from cached files."""
    symbols = cache.select(F.col("path").alias("file"), F.posexplode("symbols").alias("pos", "s")).select("file", "pos", "s.*")
    methods = cache.select(F.explode("methods").alias("name"), F.col("path").alias("file"))
    imports = cache.select(F.col("path").alias("src"), F.posexplode("imports").alias("pos", "dst"))
    return symbols, methods, imports
