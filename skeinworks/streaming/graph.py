"""A code graph that grows with a stream of file versions.

A version of a file is a row (path, content, seq); null content deletes, and of two versions of
a path the one with the greater seq holds, whenever it arrives. What is known of a path is one
row of facts (symbols, imports, calls). A batch parses what changed, finds the files whose
imports could mean a path that came or went (`wanted` lists every spelling of every import, so
this is an equi-join with the batch), and makes the edges of these files anew from their facts.
An import whose file is not there yet is pending: its spellings wait in `wanted`.

State is three tables of Parquet under one folder, each in versions (one a batch) and buckets
by a hash of its key; a batch reads only the buckets that it touches. A version counts once its
commit is written, a repeated batch replaces what it wrote before, and `compact` folds all
versions into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skeinworks.operators import parse, resolve
from skeinworks.session import delete, discard, exists, listed, settled, stored, tasks_of

#: Folders of a state table by a hash of its key, and versions after which it is compacted.
BUCKETS, COMPACT_AFTER = 64, 20
FACTS = (
    "path string, seq long, hash string, deleted boolean, symbols array<struct<name:string,kind:string,line:int,exported:boolean,pos:int>>, specs array<struct<pos:int,spec:string>>,"
    " names array<struct<local_name:string,orig_name:string,spec:string>>, calls array<struct<caller:string,callee_raw:string,line:int>>"
)
#: Columns of each state table; the first is its key.
TABLES = {"facts": FACTS, "wanted": "candidate string, path string", "edges": "path string, from_id string, to_id string"}


def facts_of(sources: DataFrame) -> DataFrame:
    """path, symbols, specs, names, calls: one row for each of sources(path, content)."""
    scanned = stored(parse.scanned(sources), "graph-scanned")
    lists = lambda df, key, name, *cols: df.groupBy(F.col(key).alias("path")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    symbols = lists(parse.symbols(parse.with_lines(sources, scanned)), "file", "symbols", "name", "kind", "line", "exported", "pos")
    calls = lists(parse.call_sites(sources, scanned), "file", "calls", "caller", "callee_raw", "line")
    specs = lists(parse.import_specs(sources), "file", "specs", "pos", "spec")
    names = lists(parse.import_names(sources), "file", "names", "local_name", "orig_name", "spec")
    out = sources.select("path")
    for part in (symbols, specs, names, calls):
        out = out.join(part, "path", "left")
    return out.select("path", "symbols", "specs", "names", "calls")


class GraphState:
    """The state tables under `target`, and the graph they hold."""

    def __init__(self, spark: SparkSession, target: str, buckets: int = BUCKETS) -> None:
        self.spark, self.target, self.buckets = spark, target.rstrip("/"), buckets

    # --- versions ---------------------------------------------------------------------

    def versions(self) -> tuple[int, list[int]]:
        """The version up to which all is compacted (-1 for none) and those committed since."""
        done = [int(n) for n in listed(self.spark, f"{self.target}/commits")]
        bases = [int(n) for n in listed(self.spark, f"{self.target}/bases") if exists(self.spark, f"{self.target}/bases/{n}/edges/_SUCCESS")]
        base = max(bases, default=-1)
        return base, sorted(v for v in done if v > base)

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a table with their version; with keys (a column of the table's name of
        its key), only rows of these, out of the buckets that hold them."""
        base, since = self.versions()
        schema = f"{TABLES[table]}, version long, bucket int"
        paths = [f"{self.target}/bases/{base}/{table}"] if base >= 0 else []
        paths += [f"{self.target}/{table}/{v}" for v in since]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("bucket")
        reader = self.spark.read.schema(schema)
        rows = reader.parquet(paths[0])
        for p in paths[1:]:
            rows = rows.unionByName(reader.parquet(p))
        if keys is None:
            return rows.drop("bucket")
        key = TABLES[table].split()[0]
        touched = [r.b for r in keys.select(self.bucket(key).alias("b")).distinct().collect()]  # BUCKETS at most
        return rows.where(F.col("bucket").isin(touched)).join(keys.select(key), key, "left_semi").drop("bucket")

    def _write(self, table: str, rows: DataFrame, path: str) -> None:
        columns = StructType.fromDDL(TABLES[table]).names
        out = rows.select(*columns, "version").withColumn("bucket", self.bucket(columns[0]))
        # Where there are few buckets, several tasks write one.
        parts = -(-tasks_of(self.spark) // self.buckets)
        dealt = out.repartition(self.buckets * parts, "bucket", F.pmod(F.hash(columns[0]), F.lit(parts))) if parts > 1 else out.repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)

    # --- the graph ----------------------------------------------------------------------

    def facts(self, keys: DataFrame | None = None) -> DataFrame:
        """What holds of every path: its facts of the greatest seq, tombstones included."""
        rows = self.read("facts", keys)
        best = rows.groupBy("path").agg(F.max(F.struct("seq", "version")).alias("m"))
        return rows.join(best.select("path", "m.*"), ["path", "seq", "version"], "left_semi")

    def files(self) -> DataFrame:
        return self.facts().where("NOT deleted").select("path")

    def symbols(self) -> DataFrame:
        return _symbols(self.facts().where("NOT deleted"))

    def edges(self) -> DataFrame:
        """from_id, to_id, from_exists, to_exists: as `resolve.call_edges` gives for all files."""
        rows = self.read("edges")
        last = rows.groupBy("path").agg(F.max("version").alias("version"))
        held = rows.join(last, ["path", "version"], "left_semi").where("to_id IS NOT NULL").select("from_id", "to_id").distinct()
        return resolve.with_ends(held, self.symbols())

    def pending(self) -> DataFrame:
        """src, pos, spec of imports whose file is not there."""
        alive = self.facts().where("NOT deleted")
        return resolve.imports(_specs(alive), alive).where("dst IS NULL").select("src", "pos", "spec")

    # --- batches --------------------------------------------------------------------------

    def apply(self, batch: DataFrame, version: int) -> None:
        """One batch of file versions (path, content, seq)."""
        base, since = self.versions()
        if version <= base or version in since:
            return  # it was applied before the stream could say so
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content", "seq"), "seq").alias("m")).select("path", "m.content", "m.seq", F.md5("m.content").alias("hash"))
        known = self.facts(newest).select("path", F.col("seq").alias("old_seq"), F.col("hash").alias("old_hash"), F.coalesce(~F.col("deleted"), F.lit(False)).alias("was"))
        met = newest.join(known, "path", "left").where("old_seq IS NULL OR seq > old_seq").withColumn("was", F.coalesce("was", F.lit(False)))
        met = stored(met, "graph-batch")
        facts = settled(lambda: self._new_facts(met, version), "graph-facts")
        self._write("facts", facts, f"{self.target}/facts/{version}")
        self._write("wanted", _spelled(facts.where("NOT deleted")).withColumn("version", F.lit(version).cast("long")), f"{self.target}/wanted/{version}")
        # Files whose imports could mean a path that came or went; their facts are in the state.
        moved = met.where("(content IS NOT NULL) <> was").select(F.col("path").alias("candidate"))
        waiting = self.read("wanted", moved).select("path").distinct().join(met.select("path"), "path", "left_anti")
        alive = facts.where("NOT deleted").unionByName(self.facts(waiting).where("NOT deleted"))
        touched = stored(alive.drop("version"), "graph-touched")
        self._write("edges", self._edges_of(touched, facts).withColumn("version", F.lit(version).cast("long")), f"{self.target}/edges/{version}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.target}/commits/{version}")
        discard(met, facts, touched)

    def _new_facts(self, met: DataFrame, version: int) -> DataFrame:
        """Facts of a batch's paths: parsed anew, as they were where the content is the same, or
        a tombstone."""
        columns = StructType.fromDDL(FACTS).names
        fresh = met.where("content IS NOT NULL AND NOT (was AND hash <=> old_hash)")
        new = facts_of(fresh.select("path", "content")).join(met.select("path", "seq", "hash"), "path").withColumn("deleted", F.lit(False))
        same = met.where("was AND hash <=> old_hash").select("path", "seq")
        kept = self.facts(same).drop("seq", "version").join(same, "path")
        gone = met.where("content IS NULL").select("path", "seq", "hash", F.lit(True).alias("deleted"))
        rows = new.unionByName(gone, allowMissingColumns=True).select(columns).unionByName(kept.select(columns))
        return rows.withColumn("version", F.lit(version).cast("long"))

    def _edges_of(self, touched: DataFrame, facts: DataFrame) -> DataFrame:
        """Edges of the touched files, and a row without an edge for each of them and of those
        that are gone, which says that older edges no longer hold."""
        spelled = _spelled(touched).select(F.col("candidate").alias("path")).distinct()
        there = self.facts(spelled).select("path", "seq", "deleted").unionByName(facts.select("path", "seq", "deleted"))
        alive = there.groupBy("path").agg(F.max_by("deleted", "seq").alias("deleted")).where("NOT deleted")
        imports = resolve.imports(_specs(touched), alive).select(F.col("src").alias("file"), "spec", F.col("dst").alias("target")).distinct()
        names = touched.select(F.col("path").alias("file"), F.explode("names").alias("n")).select("file", "n.*").join(imports, ["file", "spec"])
        calls = touched.select(F.col("path").alias("file"), F.explode("calls").alias("c")).select("file", "c.*")
        found = resolve.call_edges(calls, names, _symbols(touched)).select(F.split_part("from_id", F.lit("::"), F.lit(1)).alias("path"), "from_id", "to_id")
        marks = touched.select("path").unionByName(facts.where("deleted").select("path"))
        return found.unionByName(marks, allowMissingColumns=True)

    def compact(self) -> None:
        """All committed versions as one; what no longer holds is left out."""
        _, since = self.versions()
        if not since:
            return
        upto, rows = since[-1], self.read("edges")
        last = rows.groupBy("path").agg(F.max("version").alias("version"))
        facts = self.facts()
        kept = {
            "facts": facts,
            "wanted": _spelled(facts.where("NOT deleted")).withColumn("version", F.lit(upto).cast("long")),
            "edges": rows.join(last, ["path", "version"], "left_semi"),
        }
        old = listed(self.spark, f"{self.target}/bases")
        for table, df in kept.items():  # edges last: their folder's mark makes the base count
            self._write(table, df, f"{self.target}/bases/{upto}/{table}")
        for name in old:
            delete(self.spark, f"{self.target}/bases/{name}")
        for v in since:
            for table in (*TABLES, "commits"):
                delete(self.spark, f"{self.target}/{table}/{v}")


def _specs(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("path").alias("file"), F.explode("specs").alias("s")).select("file", "s.*")


def _symbols(facts: DataFrame) -> DataFrame:
    rows = facts.select(F.col("path").alias("file"), F.explode("symbols").alias("s")).select("file", "s.*")
    return rows.withColumn("node_id", F.concat_ws("::", "file", "name"))


def _spelled(facts: DataFrame) -> DataFrame:
    """candidate, path: every path that a relative import of the file could mean."""
    return resolve.spellings(_specs(facts)).select(F.col("__path").alias("candidate"), F.col("src").alias("path")).distinct()


def grow(files: DataFrame, target: str, checkpoint: str, once: bool = True, compact_after: int = COMPACT_AFTER, buckets: int = BUCKETS) -> StreamingQuery:
    """Apply every batch of a stream of file versions to the graph under `target`."""

    def step(batch: DataFrame, version: int) -> None:
        state = GraphState(batch.sparkSession, target, buckets)
        state.apply(batch, version)
        if len(state.versions()[1]) >= compact_after:
            state.compact()

    query = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (query.trigger(availableNow=True) if once else query).start()
