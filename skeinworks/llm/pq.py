"""Embedding near-duplicates by product quantisation.

Equal vectors fold into one first. A coarse quantiser deals unit vectors into inverted
lists; what is left after the list's centre is coded by subspace codebooks. Distances of
vectors to a list's codes are sums of table look-ups; a code's own error bounds how far its
distance can be off, so the filter loses nothing, and what passes is compared by exact cosine.

Two vectors at the threshold are `reach` apart, so their distances to the border between their
lists add up to no more than that, whatever the directions in which data vary: the nearer one
lies within half of it. A vector visits each list whose border is that near and meets the
members there whose own distance to that border fits in what is left. A pair that would meet
in both lists meets in the one of the higher number.

The number of lists grows up to the root of the number of vectors where that pays: half of the
sample fits lists and the other half tells how many of them a vector visits and how many rows
it meets there. Vectors without clusters visit a like share of any lists, and get few. Large
lists are cut into tiles. A task returns, for each of its vectors, the number
of rows linked and one star link, and never its pairs.

Defined results
* vectors null, zero, of another length than most, or holding null or non-finite components
  link with nothing: n_links 0, a component of their own.
* rows without an id link with nothing: n_links 0, component null, kept true; no other row
  counts them.
* repeated rows link with each other. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from skeinworks.llm.components import components, local_stars
from skeinworks.llm.vectors import dimension, kmeans, matrix, nearest, packed, rows_of, sample, usable
from skeinworks.session import reach_workers, stored

#: Cosine from which two vectors link.
COSINE = 0.9
#: Inverted lists, from few to many vectors; dimensions of a subspace, centres of its codebook.
LISTS, MOST_LISTS, SUBSPACE, CENTRES = 64, 1024, 4, 256
#: What a visit (a row shuffled and unpacked) costs besides comparisons, in comparisons.
VISIT = 2000
#: Vectors of the sample that fits the quantisers.
SAMPLE = 8192
#: Rows of a tile.
TILE = 4096


class Quantiser:
    def __init__(self, x: np.ndarray, lists: int = LISTS, subspace: int = SUBSPACE, centres: int = CENTRES) -> None:
        self.coarse = kmeans(x, min(lists, max(1, len(x) // 8)))
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = [slice(k, min(k + subspace, x.shape[1])) for k in range(0, x.shape[1], subspace)]
        self.books = [kmeans(rest[:, cut], centres, 6) for cut in self.cuts]
        self.apart = between(self.coarse)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, subspace codes and the length of what the codes leave out."""
        of = nearest(x, self.coarse)
        rest = x - self.coarse[of]
        code = np.stack([nearest(rest[:, cut], book) for cut, book in zip(self.cuts, self.books)], 1)
        left = sum(((rest[:, cut] - book[code[:, k]]) ** 2).sum(1) for k, (cut, book) in enumerate(zip(self.cuts, self.books)))
        return of, code.astype(np.uint8), np.sqrt(left)

    def borders(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return borders(x, of, self.coarse, self.apart)

    def distances(self, x: np.ndarray, number: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of whole vectors to codes of one list, by table look-up."""
        rest = x - self.coarse[number]
        total = np.zeros((len(x), len(code)), np.float32)
        for k, (cut, book) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, cut]
            look = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            total += look.astype(np.float32)[:, code[:, k]]
        return total


def borders(x: np.ndarray, of: np.ndarray, coarse: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Distances to the border between the own list and every list; 0 for the own."""
    d = (coarse**2).sum(1) - 2 * x @ coarse.T
    own = d[np.arange(len(x)), of][:, None]
    return (d - own) / (2 * np.maximum(apart[of], 1e-12))


def between(coarse: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (coarse**2).sum(1)[:, None] - 2 * coarse @ coarse.T + (coarse**2).sum(1)))


def number_of_lists(x: np.ndarray, count: int, reach: float, least: int = LISTS, most: int = MOST_LISTS) -> int:
    """The number of lists with the least cost for `count` vectors like the unit vectors x."""
    fitted, other = x[::2], x[1::2]
    best, lists = None, least
    while lists == least or lists <= min(most, count**0.5, len(fitted) / 4):
        coarse = kmeans(fitted, min(lists, max(1, len(fitted))), 6)
        of = nearest(other, coarse)
        near = borders(other, of, coarse, between(coarse)) <= reach / 2 if len(other) else np.zeros((1, len(coarse)), bool)
        size = np.bincount(of, minlength=len(coarse)) / max(1, len(other))
        cost = float((near * (VISIT + count * size)).sum(1).mean())
        if best is None or cost < best[0]:
            best = cost, lists
        lists *= 2
    return best[1]


def close_pairs(quantiser: Quantiser, x, y, number: int, code, left, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of pairs with at least the cosine; y are coded in list `number`.
    x and y are not normalised. same: x is y, each pair once."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-4 + left
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        near = quantiser.distances(x[part] / nx[part, None], number, code) <= reach**2
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            link = (x[a] * y[b]).sum(1) / (nx[a] * ny[b]) >= cosine
            out_i.append(a[link])
            out_j.append(b[link])
    return np.concatenate(out_i), np.concatenate(out_j)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    spark = rows.sparkSession
    reach_workers(spark)
    dim = dimension(rows, vector)
    slim = rows.select(F.col(key).cast("long").alias(key), F.when(usable(vector, dim) & F.col(key).isNotNull(), F.col(vector).cast("array<double>")).alias("__v"))
    heads = stored(slim.where(F.col("__v").isNotNull()).groupBy("__v").agg(F.min(key).alias("head"), F.count("*").alias("n")), "pq-heads")
    seen = sample(heads, "head", "__v", SAMPLE) if dim else np.zeros((0, 0))
    alone = F.lit(0).cast("long")
    if not len(seen):
        return slim.select(key, alone.alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
    seen = unit(seen)
    model = spark.sparkContext.broadcast(Quantiser(seen, number_of_lists(seen, heads.count(), reach)))
    kind = "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"

    def dealt(batches):
        q = model.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = matrix(part.column("__v"), dim)
                of, code, left = q.codes(unit(x))
                edge = q.borders(unit(x), of)
                go = edge <= reach / 2
                go[np.arange(len(x)), of] = True
                i, other = np.nonzero(go)
                mine = of[i]
                guest = mine != other
                take = pa.array(i)
                # Only members are met by their codes and need the lists that they visit.
                member = pa.array(np.where(guest, -1, i), mask=guest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(other.astype(np.int32)), pa.array(guest.astype(np.int32)), pa.array(mine.astype(np.int32)), pa.array(edge[i, other]), packed(np.packbits(go, axis=1)).take(member), part.column("head").take(take), part.column("n").take(take), packed(code).take(member), pa.array(left[i]), packed(x.astype(kind)).take(take)],
                    names=["list", "side", "own", "edge", "visits", "head", "n", "code", "rest", "x"],
                )

    met = heads.mapInArrow(dealt, "list int, side int, own int, edge double, visits binary, head long, n long, code binary, rest double, x binary")
    # At most one row for each list.
    size = stored(met.groupBy("list").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).where("n0 > 0"), "pq-sizes")
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    placed = met.join(F.broadcast(size), "list").withColumn("t", F.pmod(F.xxhash64("head"), F.when(F.col("side") == 0, tiles("n0")).otherwise(tiles("n1"))).cast("int"))
    # Members' tiles face each other (guests false) and every tile of guests (true).
    facing = lambda c, guests: F.transform(F.sequence(F.lit(1), tiles(c)), lambda o: F.struct(F.lit(guests).alias("guests"), (o - 1).alias("o")))
    hosts = F.when(F.col("n1") > 0, F.concat(facing("n0", False), facing("n1", True))).otherwise(facing("n0", False))
    placed = placed.withColumn("f", F.explode(F.when(F.col("side") == 0, hosts).otherwise(facing("n0", True)))).withColumns({"guests": F.col("f.guests"), "o": F.col("f.o")})
    first = F.when(~F.col("guests"), F.least("t", "o")).when(F.col("side") == 0, F.col("t")).otherwise(F.col("o"))
    second = F.when(~F.col("guests"), F.greatest("t", "o")).when(F.col("side") == 0, F.col("o")).otherwise(F.col("t"))
    grid = placed.select("list", "guests", first.alias("ta"), second.alias("tb"), "side", "t", "own", "edge", "visits", "head", "n", "code", "rest", "x")

    def tile(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = model.value
        number, guests, ta, tb = group
        pdf = pdf.sort_values(["side", "head"], kind="stable")
        if guests:
            a, b = pdf[pdf.side == 1], pdf[pdf.side == 0]
        else:
            a, b = pdf[pdf.t == ta], pdf[pdf.t == tb]
        same = not guests and ta == tb
        if not len(a) or not len(b):
            return pd.DataFrame({"head": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        code = np.frombuffer(b"".join(b.code), np.uint8).reshape(len(b), -1)
        xa, xb, rest = rows_of(a.x, dim, kind), rows_of(b.x, dim, kind), b["rest"].to_numpy()
        if guests:
            own, edge = a["own"].to_numpy(), a["edge"].to_numpy()
            apart = q.borders(unit(xb), np.full(len(b), number))
            visits = np.unpackbits(np.frombuffer(b"".join(b.visits), np.uint8).reshape(len(b), -1), axis=1)
            out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for home in np.unique(own):
                u = np.flatnonzero(own == home)
                meets = apart[:, home] <= reach - edge[u].min() + 1e-6
                if home > number:  # members that visit the guests' list meet them there
                    meets &= visits[:, home] == 0
                v = np.flatnonzero(meets)
                if len(v):
                    p, r = close_pairs(q, xa[u], xb[v], number, code[v], rest[v], cosine, False)
                    out_i.append(u[p])
                    out_j.append(v[r])
            i, j = np.concatenate(out_i), np.concatenate(out_j)
        else:
            i, j = close_pairs(q, xa, xb, number, code, rest, cosine, same)
        heads_ = np.concatenate([a["head"].to_numpy(), b["head"].to_numpy()]) if not same else a["head"].to_numpy()
        n = np.concatenate([a["n"].to_numpy(), b["n"].to_numpy()]) if not same else a["n"].to_numpy()
        if not same:
            j = j + len(a)
        links = np.bincount(i, n[j], len(heads_)) + np.bincount(j, n[i], len(heads_))
        root = heads_[local_stars(len(heads_), i, j)]
        some = np.flatnonzero(links)
        return pd.DataFrame({"head": heads_[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = stored(grid.groupBy("list", "guests", "ta", "tb").applyInPandas(tile, "head long, links long, root long"), "pq-links")
    linked = found.groupBy("head").agg(F.sum("links").alias("links"))
    of = components(found, "head", "root")
    classes = stored(heads.join(linked, "head", "left").join(of, F.col("head") == F.col("id"), "left").select("__v", (F.col("n") - 1 + F.coalesce("links", alone)).alias("n_links"), F.coalesce("component", "head").alias("component_id")), "pq-classes")
    out = slim.join(classes, "__v", "left")
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", alone).alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
