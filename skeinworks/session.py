"""Session defaults, shared scratch storage and worker import paths."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skeinworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def tasks_of(spark: SparkSession) -> int:
    """Several tasks a core, or as many as shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to several tasks a core by keys, whatever files they came from. For work that
    costs far more than reading: a small file is one task, however much is made of its rows."""
    return rows.repartition(tasks_of(rows.sparkSession), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where a local session names
    none (tests on one machine), a fresh local folder is set; a cluster has to name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skeinworks-"))
    return sc.getCheckpointDir()


#: Bytes of a row group of intermediate tables: two writers to an executor hold one each.
ROW_GROUP = 32 << 20
_STORED: list[str] = []
#: For each thread, the lists of what is being stored on the way to a result (see settled).
_OPEN = threading.local()


def stored(df: DataFrame, label: str, compression: str = "snappy", row_group: int = ROW_GROUP) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. This cuts the lineage:
    a lost executor costs no recomputation of what came before. The table stays until
    `discard` or `clean_up`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _STORED.append(path)
    for way in getattr(_OPEN, "ways", ()):
        way.append(path)
    df.write.option("compression", compression).option("parquet.block.size", row_group).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The stored result of `make`, without the tables that this thread stored on the way to it."""
    way: list[str] = []
    _OPEN.ways = [*getattr(_OPEN, "ways", ()), way]
    try:
        spark = (df := make()).sparkSession
        out = stored(df, label)
    finally:
        _OPEN.ways = _OPEN.ways[:-1]
    for path in way:
        if path != out.stored_at and path in _STORED:
            delete(spark, path)
            _STORED.remove(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)
        _STORED.remove(df.stored_at)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that `stored` has written and nothing has discarded. Results that
    still read them are to be written before."""
    while _STORED:
        delete(spark, _STORED.pop())


def _store(spark: SparkSession, path: str) -> tuple:
    """The store of a path that Spark reaches, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    store, at = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
