"""SimHash near-duplicates, compared on bit planes.

Fingerprints: the majority bit over the XXH64 of every 3-word shingle, repeats included.
Equal fingerprints fold into one before anything is compared. The 64 bits fall into five
bands; fingerprints with up to three differing bits agree on two bands at least, so each goes
to the ten keys of two bands. The fingerprints of all keys of a task, in the order of their
keys, are stored as bit planes, 64 of them to a word; a lane mask keeps keys apart, so small
keys share words and large ones fill many. A fingerprint meets the words of its key: differences
are added up by carry-save counters, which start so that they overflow beyond the radius, and a
block is left as soon as all its lanes did. A key with more fingerprints than one task should
hold is cut into tiles and compared tile against tile, so no link is lost. A task emits its
links as stars, at most one per fingerprint, and never its pairs.

`near_duplicates` links fingerprints of 64 bits that differ in three or fewer: all such pairs.
`similar` and `keep` are for texts that share 0.8 of their 5-word shingles or more: fingerprints
of 1,024 bits, mixed from the same hashes, which differ in 155 of them at that similarity, 106
at 0.9, 217 at 0.65 and 512 when unrelated, give or take 12. They link up to `NEAR_RADIUS`;
measured against the true overlap in tests. Keys are the least of the same mixed hashes, three
to a key: texts without a common shingle share none, whatever the number of texts, and eight
keys find 0.997 of the pairs at 0.8. Fingerprints travel only to keys that several have.

Defined results
* null text: as the empty text. No word: fingerprint zero, linked like any other.
* repeated rows: one component. Empty table: no rows. Extra columns are ignored, or kept by
  `keep`. Ties of a group go to the least key; keys that are null count as one key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skeinworks.llm.batches import sliced, texts_of
from skeinworks.llm.components import components, local_stars
from skeinworks.session import reach_workers, stored

#: Differing bits up to which two fingerprints link.
RADIUS = 3
#: Words to a shingle, and the seed of XXH64.
WORDS, SEED = 3, 42
#: Bits of the five bands.
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints of one key that a task holds; more are cut into tiles of this size.
TILE = 4096
#: Keyed fingerprints that a task compares at once, about; the number of groups follows.
GROUP_ROWS = 100_000
#: Words to a shingle, words of 64 bits to a fingerprint and differing bits of `similar`.
NEAR_WORDS, NEAR_WIDTH, NEAR_RADIUS = 5, 16, 175
#: Keys of a text in `similar`, and least hashes of a key.
NEAR_KEYS, NEAR_HASHES = 8, 3


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle. Fewer words than a shingle has: one of them all; none: nothing."""
    # On bytes, lower() changes A-Z only, and split() parts at 0x20 and 0x09-0x0D only.
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else [], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[: -words]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """key, fp (the fingerprint's 64 bits as a long) of every row."""
    reach_workers(docs.sparkSession)

    def run(batches):
        for b in sliced(batches, text):
            fps = np.array([fingerprint(t, words, seed) for t in texts_of(b, text)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(fps.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, fp long")


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def wide_fingerprint(text: str, words: int = NEAR_WORDS, width: int = NEAR_WIDTH, seed: int = SEED) -> np.ndarray:
    """`width` words of majority bits, each over another mix of the shingles' hashes."""
    return wide_fingerprint_and_keys(text, words, width, seed)[0]


def wide_fingerprint_and_keys(text: str, words: int = NEAR_WORDS, width: int = NEAR_WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint, and NEAR_KEYS keys of the least halves of the same mixes; a text without
    a word has no key."""
    h = shingle_hashes(text, words, seed)
    ones, least = np.zeros(64 * width, np.int64), np.full(2 * width, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 255):
        mixed = h[at : at + 255, None] + np.arange(width, dtype=np.uint64) * _MIX[0]
        mixed ^= mixed >> np.uint64(30)
        mixed *= _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        least = np.minimum(least, mixed.view("<u4").min(0))
    fp = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")
    if not len(h):
        return fp, np.zeros(0, np.int64)
    keys = np.zeros(NEAR_KEYS, np.uint64)
    for part in least[: NEAR_KEYS * NEAR_HASHES].reshape(NEAR_KEYS, NEAR_HASHES).T.astype(np.uint64):
        keys = (keys ^ part) * _MIX[0]
        keys ^= keys >> np.uint64(29)
    return fp, keys.view(np.int64)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """One row for each bit of the fingerprints (a word each, or rows of words); in each, 64
    fingerprints to a word. The last word is padded."""
    wide = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, wide.shape[1]), "<u8")
    padded[: len(fps)] = wide
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


FULL = np.uint64(2**64 - 1)


def links_in_lanes(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int = RADIUS, blocks: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs within the radius with first[i] <= j < end[i]."""
    planes = planes_of(fps)
    low = first // 64
    words = np.where(first < end, (end - 1) // 64 - low + 1, 0)
    total = np.concatenate([[0], np.cumsum(words)])
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, int(total[-1]), blocks):
        # Blocks: a fingerprint and a word of 64 lanes, of which those of its range count.
        block = np.arange(at, min(at + blocks, int(total[-1])))
        q = np.searchsorted(total, block, side="right") - 1
        w = low[q] + block - total[q]
        below, above = np.maximum(first[q] - 64 * w, 0).astype(np.uint64), np.maximum(64 * (w + 1) - end[q], 0).astype(np.uint64)
        i, j = _near_lanes(fps.reshape(len(fps), -1), planes, q, w, ~((FULL << below) & (FULL >> above)), radius)
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _near_lanes(fps: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius of blocks (q, w); lanes set in `over` are out from the start."""
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius  # so that radius + 1 differences overflow
    count = [np.full(len(q), FULL if start >> level & 1 else np.uint64(0)) for level in range(levels)]
    for bit in range(len(planes)):
        if bit % 64 == 0:
            own = fps[q, bit // 64]
        carry = (np.uint64(0) - ((own >> np.uint64(bit % 64)) & np.uint64(1))) ^ planes[bit, w]
        for level in range(levels):  # carry-save: add one bit to 64 counters at once
            count[level], carry = count[level] ^ carry, count[level] & carry
        over = over | carry
        if bit % 4 == 3 and bit > 2 * radius:
            live = np.flatnonzero(over != FULL)
            if len(live) < len(q):
                q, w, own, over = q[live], w[live], own[live], over[live]
                count = [c[live] for c in count]
                if not len(q):
                    break
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(hit)
    return q[k], w[k] * 64 + lane


def links_between(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs within the radius."""
    lanes = np.repeat([0, len(right)], [len(right), len(left)])
    i, j = links_in_lanes(np.concatenate([right, left]), np.zeros(len(lanes), np.int64), lanes, radius)
    return i - len(right), j


def _band_keys() -> list:
    """(shift, mask) pairs of each key's two bands."""
    at, spans = 0, []
    for size in BANDS:
        spans.append((at, (1 << size) - 1))
        at += size
    return list(combinations(spans, 2))


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b that join all distinct fingerprints within the radius (3 at most), as stars."""
    if radius > len(BANDS) - 2:
        raise ValueError(f"the bands find up to {len(BANDS) - 2} differing bits")
    band = lambda s: F.expr(f"shiftrightunsigned(fp, {s[0]}) & {s[1]}L")
    keys_of = _band_keys()
    keys = F.array(*(F.struct(F.lit(k).alias("which"), (band(x) * F.lit(1 << 13) + band(y)).alias("value")) for k, (x, y) in enumerate(keys_of)))
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.value")
    size = keyed.groupBy("which", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = keyed.join(size.select("which", "value", "tiles"), ["which", "value"]).withColumn("t", own)
    groups = max(1, -(-len(keys_of) * distinct.count() // GROUP_ROWS))
    return _compare(tiled.withColumn("node", F.col("fp")), radius, groups)


def wide_links(distinct: DataFrame, radius: int = NEAR_RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b that join the nodes of distinct (node long, fp binary, keys array of long) of
    fingerprints that share a key and differ in no more bits than the radius, as stars."""
    reach_workers(distinct.sparkSession)
    light = distinct.select("node", F.posexplode("keys").alias("which", "value"))
    # Keys that only one has, nearly all, are left behind before fingerprints move.
    size = light.groupBy("which", "value").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    shared = stored(light.join(size, ["which", "value"]), "wide-shared")
    tiled = shared.join(distinct.select("node", "fp"), "node").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    return _compare(tiled, radius, max(1, -(-shared.count() // GROUP_ROWS)))


def links_of_keys(batch: pd.DataFrame, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (a, b) joined by star links, within each (which, value, x, y) of a batch with the
    node, fp and tile t of each fingerprint: tile x against tile y, or x with itself."""
    batch = batch.sort_values(["which", "value", "x", "y", "t"], kind="stable")
    node = batch.node.to_numpy()
    fps = batch.fp.to_numpy()
    fps = fps.view(np.uint64) if fps.dtype == np.int64 else np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)
    keys = batch[["which", "value", "x", "y"]].to_numpy()
    edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    size = np.diff(np.append(edge, len(fps)))
    end = np.repeat(edge + size, size)
    # Within a tile: those after it. Between tiles: the other tile's, for those of the first.
    one = batch.x.to_numpy() == batch.y.to_numpy()
    second = batch.t.to_numpy() == batch.y.to_numpy()
    other = np.repeat(edge + np.add.reduceat(~second, edge), size)
    first = np.where(one, np.arange(len(fps)) + 1, np.where(second, end, other))
    i, j = links_in_lanes(fps, first, end, radius)
    root = local_stars(len(fps), i, j)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return node[root[moved]], node[moved]


def _compare(tiled: DataFrame, radius: int, groups: int) -> DataFrame:
    """Stars of tiled (node, fp, which, value, t, tiles)."""
    reach_workers(tiled.sparkSession)

    def group(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = links_of_keys(batch, radius)
        return pd.DataFrame({"a": a, "b": b})

    # Tile t meets itself and every other tile: (x, y) with x <= y holds the two.
    met = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("node", "fp", "which", "value", "t", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"))
    # A group's keys hash together; a tiled key's pairs of tiles are groups of their own.
    named = met.withColumn("g", F.when((F.col("x") == 0) & (F.col("y") == 0), F.struct(F.pmod(F.xxhash64("which", "value"), F.lit(groups)), F.lit(-1).alias("x"), F.lit(-1).alias("y"))).otherwise(F.struct(F.xxhash64("which", "value"), "x", "y")))
    return named.groupBy("g").applyInPandas(group, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fp, component_id: the least key that links reach, the row's own included."""
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    heads = stored(rows.groupBy("fp").agg(F.min(key).alias("head")), "fingerprint-heads")
    found = components(links(heads.select("fp"), radius), "a", "b")
    # Components of fingerprints, named by the least key of all their rows.
    named = stored(heads.join(found, heads.fp == found.id, "left").select("fp", "head", F.coalesce("component", "fp").alias("c")), "fingerprint-named")
    # Stored, so that a component with many fingerprints is a plain exchange, which can split.
    least = stored(named.groupBy("c").agg(F.min("head").alias("component_id")), "fingerprint-least")
    of = stored(named.join(least, "c").select("fp", "component_id"), "fingerprint-components")
    return rows.join(of, "fp").select(key, "fp", "component_id")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, radius: int = NEAR_RADIUS) -> DataFrame:
    """key, component_id: the least key that links of wide fingerprints reach."""
    reach_workers(docs.sparkSession)

    def run(batches):
        for b in sliced(batches, text):
            made = [wide_fingerprint_and_keys(t, words) for t in texts_of(b, text)]
            offsets = np.concatenate([[0], np.cumsum([len(k) for _, k in made])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *(k for _, k in made)])))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([fp.tobytes() for fp, _ in made], pa.binary()), keys], names=[key, "fp", "keys"])

    rows = stored(docs.select(key, text).mapInArrow(run, f"{key} long, fp binary, keys array<long>"), "wide-fingerprints")
    heads = stored(rows.groupBy("fp").agg(F.min(key).alias("head"), F.min("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "wide-heads")
    rows = rows.select(key, "fp")
    found = components(wide_links(heads.select("node", "fp", "keys"), radius), "a", "b")
    named = stored(heads.join(found, heads.node == found.id, "left").select("fp", "head", F.coalesce("component", "node").alias("c")), "wide-components")
    # Stored, so that a component with many fingerprints is a plain exchange, which can split.
    least = stored(named.groupBy("c").agg(F.min("head").alias("component_id")), "wide-least")
    return rows.join(named.join(least, "c").select("fp", "component_id"), "fp").select(key, "component_id")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = NEAR_WORDS, radius: int = NEAR_RADIUS) -> DataFrame:
    """One document of each component of `similar`, the one with the least key, with docs'
    columns. Rows of one key stay or go together; of those equal in text too, one stays."""
    own = F.col(key).eqNullSafe(F.col("component_id"))
    heads = stored(similar(docs, key, text, words, radius).groupBy(key).agg(F.max(own).alias("__own"), (F.count("*") > 1).alias("__many")).where("__own").select(F.col(key).alias("__head"), "__many"), "wide-kept")
    kept = docs.join(heads, F.col(key).eqNullSafe(F.col("__head")))
    once, many = (kept.where(c).select(*docs.columns) for c in ("NOT __many", "__many"))
    # Only keys that several rows carry need their texts compared.
    return once if heads.where("__many").isEmpty() else once.unionByName(many.dropDuplicates([key, text]))
