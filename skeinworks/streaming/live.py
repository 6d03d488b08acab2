"""Streams of tool calls and of source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skeinworks.operators.telemetry import per_tool
from skeinworks.session import listed, shared_folder, table
from skeinworks.sources.files import split_by_cache

#: Seconds between two snapshots of a live report.
SNAPSHOT_SECONDS = 30


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = 100, pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; with no files_per_trigger, all that are there
    are one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, one file or a folder of them, as a stream whose first batch
    is all of it: order between its files means nothing."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    return file_stream(spark, path, schema, None) if listed(spark, path) != [f"{name}.parquet"] else file_stream(spark, sf_dir, schema, None, f"{name}.parquet")


def snapshots(calls: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """A cumulative per-tool report, handed to `write` every SNAPSHOT_SECONDS, or once for all
    that is there. State holds one row a tool."""
    query = per_tool(calls).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=f"{SNAPSHOT_SECONDS} seconds")).start()


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Changed files of each batch, found by their hash, go through `parse` into a new version
    at target; the greatest version of a path is its current one. files(path, content); a row
    with null content says that the file was deleted, and its path has no current rows then."""

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        known = current(spark, target)
        batch = batch.dropDuplicates(["path"])
        gone = batch.where("content IS NULL").select("path", F.lit(True).alias("deleted"))
        # Only the hashes of this batch's paths are read of what is known.
        known = known.join(batch.select("path"), "path", "left_semi")
        fresh = split_by_cache(batch.where("content IS NOT NULL"), known, "path").where("NOT reused").drop("reused")
        done = parse(fresh).withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True).withColumn("version", F.lit(version).cast("long"))
        # A repeated batch replaces what it wrote before.
        done.write.mode("overwrite").parquet(f"{target}/version_part={version}")

    query = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (query.trigger(availableNow=True) if once else query).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The current rows of an ingested table: each path's rows of its greatest version."""
    if not any(n.startswith("version_part=") for n in listed(spark, target)):
        return spark.createDataFrame([], "path string, hash string, version long")
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("version").alias("version"))
    return rows.join(last, ["path", "version"], "left_semi").where("NOT deleted").drop("deleted")


def run_snapshot(spark: SparkSession, calls: DataFrame, label: str) -> DataFrame:
    """One pass over a stream of calls; the table of its last snapshot."""
    import uuid

    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    query = snapshots(calls, lambda df, n: df.write.mode("overwrite").parquet(f"{base}/snapshot"), f"{base}/checkpoint", once=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{base}/snapshot")
