"""Extendible hashing: shards under a byte limit, from DataFrame functions only.

Every row hashes to 60 bits. A shard is a hash prefix. The directory is built from a
histogram over prefixes: a prefix whose rows exceed the byte limit splits on its next bit,
one that fits stays whole, so a shard's depth is the least depth at which its prefix fits, and
all slots under it point to it. The histogram's size depends on bytes / limit, not on rows, and is never collected.

Defined results
* null key or text: hashed as the empty string, 0 bytes.
* equal keys: the text takes part in the hash, so different rows of one key can part.
* fully equal rows share all 60 bits. Where they exceed the limit together, they are dealt
  out in copies under the limit, as sub-shards `<prefix>+<n>`.
* a row larger than the limit has a shard of its own; `fits` is false there only.
* empty table: no rows. Extra columns are ignored by `assign` and kept by `write`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skeinworks.session import stored

HASH_BITS = 60
#: Bits beyond log2(bytes / limit) in the first histogram, and by which a histogram deepens.
SLACK_BITS = 8


def _hash60(key: str, text: str):
    both = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def _prefix(col: str, bits):
    return F.expr(f"shiftright({col}, {HASH_BITS} - {bits})")


def assign(docs: DataFrame, byte_limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, shard (its prefix as 0s and 1s), depth (bits of the
    directory used), n_bytes, shard_bytes, shard_rows, fits."""
    return _assign(docs, byte_limit, key, text, F.col(key)).withColumnRenamed("__row", key)


def _assign(docs: DataFrame, byte_limit: int, key: str, text: str, carried: Column) -> DataFrame:
    """As assign, with `carried` of each row in place of the key."""
    rows = stored(
        docs.select(carried.alias("__row"), _hash60(key, text).alias("__h"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes")),
        "shard-rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, math.ceil(math.log2(max(1.0, total / byte_limit))) + SLACK_BITS)
    low, parts, waiting = 0, [], rows
    while True:
        leaves = stored(
            waiting.groupBy(_prefix("__h", bits).alias("leaf")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"), F.min("__h").alias("h0"), F.max("__h").alias("h1")),
            "shard-leaves",
        )
        over = leaves.select("leaf", "bytes", "rows", "h0", "h1", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth")).withColumn("node", F.expr(f"shiftright(leaf, {bits} - depth)"))
        nodes = over.groupBy("depth", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        # One hash value cannot split further, whatever its size.
        done = nodes.where((F.col("shard_bytes") <= byte_limit) | (F.col("h0") == F.col("h1"))).select("depth", "node", "shard_bytes", "shard_rows", (F.col("h0") == F.col("h1")).alias("single"))
        # Shards are the fitting nodes without a fitting parent; every slot of the directory
        # under a shard points to it.
        parents = done.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("__up"))
        shards = done.withColumn("__up", F.shiftright("node", 1)).join(parents, ["depth", "__up"], "left_anti").drop("__up")
        slots = F.expr(f"sequence(shiftleft(node, {bits} - depth), shiftleft(node + 1, {bits} - depth) - 1)")
        directory = stored(shards.select(F.explode(slots).alias("leaf"), "depth", "node", "shard_bytes", "shard_rows", "single"), "shard-directory")
        parts.append(waiting.withColumn("leaf", _prefix("__h", bits)).join(directory, "leaf").drop("leaf"))
        if bits == HASH_BITS or not leaves.join(directory, "leaf", "left_anti").limit(1).count():
            break
        waiting = stored(waiting.withColumn("leaf", _prefix("__h", bits)).join(directory, "leaf", "left_anti").drop("leaf"), "shard-waiting")
        low, bits = bits + 1, min(HASH_BITS, bits + SLACK_BITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(node), depth, '0')"))
    out = out.withColumn("shard", shard)
    copies = F.col("single") & (F.col("shard_bytes") > byte_limit) & (F.col("shard_rows") > 1)
    whole = out.where(~copies).select("__row", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= byte_limit).alias("fits"))
    return whole.unionByName(_copies(out.where(copies), byte_limit))


def _copies(same: DataFrame, byte_limit: int) -> DataFrame:
    """Rows of one hash value that exceed the limit together: as many copies to a sub-shard
    as fit. Copies are equal, so any of them may go anywhere; each input partition numbers
    its own, which needs neither a sort nor all copies in one task."""
    # Stored with their numbers: numbers taken again on another plan would not be the same.
    salted = stored(same.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "shard-copies")
    low = salted.groupBy("__h", "__p").agg(F.min("__i").alias("__low"), F.count("*").alias("__n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    chunk = F.floor((F.col("__i") - F.col("__low")) / each)
    named = salted.join(low, ["__h", "__p"]).withColumn("shard", F.concat(F.col("shard"), F.lit("+"), F.col("__p").cast("string"), F.lit("."), chunk.cast("string")))
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return named.drop("shard_bytes", "shard_rows").join(sums, "shard").select("__row", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows", (F.col("shard_bytes") <= byte_limit).alias("fits"))


def write(docs: DataFrame, path: str, byte_limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Write docs as Parquet, one folder `shard=<prefix>` to a shard; a column `shard` of docs
    is replaced. Rows carry their columns through the assignment, so rows of one key or of
    none go where they were assigned. A large shard's rows come from one task, as its bytes
    are under the limit."""
    docs = docs.drop("shard")
    named = _assign(docs, byte_limit, key, text, F.struct(*docs.columns))
    named.select("__row.*", "shard").repartition(F.col("shard")).write.partitionBy("shard").parquet(path)
