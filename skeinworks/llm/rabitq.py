"""Nearest neighbours by randomly rotated one-bit codes.

Every vector, less a common centre, is rotated at random (into a longer space, for more
bits) and kept as the signs of its coordinates, its length and the inner product of the
vector with its signs. A query is rotated the same way and its coordinates are rounded to a
few bits; inner products with codes come from the packed bits alone, by AND and population
counts per bit plane. The correction scalars make the estimate unbiased and bound its
error, and only vectors whose bound reaches the best found so far are reranked exactly.

Queries meet all rows in blocks: a grid of row blocks and query blocks of bounded size, so
equal vectors, however many, spread over blocks. Vectors travel with their codes, in the
width that they have in the input, once for each block of QUERY_BLOCK queries; fetching the
reranked ones by their id instead would move them once for each query that asks for them. A
block returns its best k of a query, and a window merges the blocks.

Defined results
* vectors null, zero, of another length than most, or holding null or non-finite components,
  and rows without id, take no part. Ties go to the smaller id; rows of the query's own id
  are no candidates. Fewer candidates than k: all of them.
* repeated rows: each is a candidate. Query rows with equal id and vector are one query;
  different vectors of one id are queries of their own, each with its k rows under that id.
* empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from skeinworks.llm.vectors import dimension, fixed, matrix, packed, sample, usable
from skeinworks.session import reach_workers, stored

#: Neighbours of a query.
K = 20
#: Bits of a code for each dimension, rounded up to whole words; bits of a query's coordinates.
SPREAD, QUERY_BITS = 8, 4
#: Standard deviations of the error that bounds allow for.
SURE = 3.0
#: Vectors of the sample that gives the centre.
SAMPLE = 4096
#: Rows and queries of a block, and rows of the smaller blocks that keep all cores at work.
ROW_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 65536, 16384, 4096


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """`dim` orthonormal rows in the space of the codes."""
    bits = -(-dim * SPREAD // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (words of 64 bits), lengths, and inner products with the signs."""
    rest = x - centre
    length = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    words = np.packbits(unit > 0, axis=1, bitorder="little").view("<u8")
    return words, length, np.where(length > 0, np.abs(unit).sum(1) / np.sqrt(turn.shape[1]), 1.0)


def estimate(words: np.ndarray, length: np.ndarray, fit: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows), and bounds of their error."""
    bits = turn.shape[1]
    turned = queries @ turn
    low = turned.min(1)
    step = (turned.max(1) - low) / ((1 << QUERY_BITS) - 1)
    step[step == 0] = 1
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    masks = [np.packbits(level >> plane & 1, axis=1, bitorder="little").view("<u8") for plane in range(QUERY_BITS)]
    sums = np.zeros((len(queries), len(words)), np.int32)
    for at in range(0, len(words), 2048):  # temporaries of a size that caches hold
        columns = np.ascontiguousarray(words[at : at + 2048].T)
        for plane, mask in enumerate(masks):
            both = np.zeros((len(queries), columns.shape[1]), np.uint16)
            for w, column in enumerate(columns):
                both += np.bitwise_count(mask[:, w, None] & column)
            sums[:, at : at + 2048] += both.astype(np.int32) << plane
    ones = np.bitwise_count(words).sum(1, dtype=np.int64)
    rounded = low[:, None] * bits + step[:, None] * level.sum(1, dtype=np.int64)[:, None]
    signed = 2 * (step[:, None] * sums + low[:, None] * ones) - rounded
    scale = length / (fit * np.sqrt(bits))
    found = signed * scale + (queries @ centre)[:, None]
    norm = np.linalg.norm(queries, axis=1)
    spread = length * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, bits - 1))
    return found, SURE * np.hypot(norm[:, None] * spread, (step / np.sqrt(12))[:, None] * length / fit)


def search_block(ids, x, words, length, fit, query_ids, queries, centre, turn, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: positions of queries, row ids, scores."""
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(queries), 64):
        part = queries[at : at + 64]
        found, bound = estimate(words, length, fit, part, centre, turn)
        for r, q in enumerate(part):
            other = ids != query_ids[at + r]
            est = np.where(other, found[r], -np.inf)
            n = min(k, int(other.sum()))
            if not n:
                continue
            first = np.argpartition(-est, n - 1)[:n]
            least = np.sort((x[first] * q).sum(1))[-n]
            rank = np.flatnonzero(other & (est + bound[r] >= least - 1e-12))
            rank = np.union1d(rank, first)
            score = (x[rank] * q).sum(1)
            best = np.lexsort((ids[rank], -score))[:n]
            out_q.append(np.full(n, at + r))
            out_id.append(ids[rank[best]])
            out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product
    found for every row that is a query, nearest first."""
    spark = rows.sparkSession
    reach_workers(spark)
    dim = dimension(rows, vector)
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"
    good = rows.where(usable(vector, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).cast("array<double>").alias("v"))
    seen = sample(good, "id", "v", SAMPLE) if dim else np.zeros((0, 0))
    if not len(seen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    model = spark.sparkContext.broadcast((seen.mean(0), rotation(dim)))

    def coded(batches):
        centre, turn = model.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), dim)
                words, length, fit = encode(x, centre, turn)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("is_query"), packed(words), pa.array(length), pa.array(fit), packed(x.astype(kind))], names=["id", "is_query", "code", "length", "fit", "x"])

    index = stored(good.mapInArrow(coded, "id long, is_query boolean, code binary, length double, fit double, x binary").withColumn("number", F.monotonically_increasing_id()), "rabitq")
    queries = stored(index.where("is_query").groupBy("id", "x").agg(F.min("number").alias("number")), "rabitq-queries")
    n, m = index.count(), queries.count()
    across = max(1, -(-n // ROW_BLOCK), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    down = max(1, -(-m // QUERY_BLOCK))
    # Rows of one id would hash alike; their stored numbers part them.
    deal = F.xxhash64("number")
    data = index.select(F.pmod(deal, F.lit(across)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("d"), F.lit(False).alias("asks"), "number", "id", "code", "length", "fit", "x")
    asks = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("a"), F.pmod(deal, F.lit(down)).cast("int").alias("d"), F.lit(True).alias("asks"), "number", "id", "x")

    def block(part: pa.Table) -> pa.Table:
        centre, turn = model.value
        row, ask = part.filter(pa.compute.invert(part["asks"])), part.filter(part["asks"])
        ids, asked, number = row["id"].to_numpy(), ask["id"].to_numpy(), ask["number"].to_numpy()
        words = fixed(row["code"], "<u8", turn.shape[1] // 64)
        x, queries = fixed(row["x"], kind, dim).astype(np.float64), fixed(ask["x"], kind, dim).astype(np.float64)
        q, near, score = search_block(ids, x, words, row["length"].to_numpy(), row["fit"].to_numpy(), asked, queries, centre, turn, k)
        return pa.table({"number": number[q], "query_id": asked[q], "vec_id": near, "score": score})

    met = data.unionByName(asks, allowMissingColumns=True).groupBy("a", "d")
    near = met.applyInArrow(block, "number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
