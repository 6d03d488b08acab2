"""Suffix-array deduplication with run-length compressed indexes.

Every byte that a `LENGTH`-byte string covers which also starts anywhere else is removed.

1. Windows. Each LENGTH-byte window is named by the least hash among its GRAM-byte grams, its
   anchor. Consecutive windows of one anchor form a fragment; equal windows have equal
   anchors wherever they are, so only fragments of one anchor can share a window.
2. Anchors that occur once go; the rest is about the repeated share of the input. Equal
   fragments fold into one with a multiplicity, as equal texts only lengthen the runs of a
   Burrows-Wheeler transform; a fragment with a multiplicity is matched whole.
3. Index. Different fragments of an anchor meet in a bucket. Over a bucket's fragments the
   suffix array gives the Burrows-Wheeler transform; kept of it are its runs, with the text
   positions at both ends of each run and their longest matches with the suffix before and
   after. Between samples a match shrinks by one a byte, so one pass over the text streams
   the matching statistics of every position, and marks windows whose match is long enough.
4. An anchor with more different fragments than a bucket should hold parts by what stands
   around it: windows that hold it within `STEP` places of each other share all bytes but
   those at their ends, and the hash of these bytes names a part. Equal windows stay in one
   part. Parts fold and go to the index like anchors. Of a part that is still too large, whose
   windows differ in their last few bytes only, single windows are counted by a 128-bit
   digest, so that no task holds it and no window is left out.

Texts are compressed for the two joins that bring them to their fragments and spans.

Defined results
* null text: empty. Shorter than LENGTH: kept. Very long texts: cut into overlapping pieces.
* repeated rows: all copies lose what repeats, the first too. Judged on the input throughout.
* empty table: no rows. Extra columns are kept by `remove`; names from `__` on are its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from skeinworks.llm.batches import ragged, sliced
from skeinworks.session import reach_workers, stored

#: Bytes of a window, and of the grams that name it.
LENGTH, GRAM = 200, 32
#: Bytes of a text that are looked at together; positions must fit 24 bits.
PIECE = 1 << 23
#: Bytes of a packed run; their number has 20 bits.
RUN = 1 << 19
#: Bytes of fragments that a bucket indexes at a time, about, and different fragments of an
#: anchor that go there whole. An index takes about 60 bytes of memory for a byte of text,
#: and HOT fragments of up to 2 * LENGTH bytes are less than a bucket.
BUCKET_BYTES, HOT = 1 << 19, 1000
#: Places of an anchor in a window that a part of it covers.
STEP = 24


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z ^= y
    z += np.uint64(0x632BE59BD9B4E019)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def _words(data: bytes, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n positions on, zeros after the end."""
    padded = data + b"\0" * 16
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        out[r::8] = np.frombuffer(padded, "<u8", (n - r + 7) // 8, r)
    return out


def fragments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the fragments of all texts: text number, start, bytes, anchor, hash of the bytes."""
    parts, row, base = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            if len(t) - at >= length:
                parts.append(t[at : at + PIECE + length - 1])
                row.append(k)
                base.append(at)
    found = [_fragments(parts[k], r, b, length, gram) for k, r, b in _together(parts, row, base)]
    if not found:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _together(parts, row, base):
    """Runs of parts of about a megabyte, as slices."""
    at, size = 0, 0
    for k, p in enumerate(parts):
        if size and size + len(p) > 1 << 20:
            yield slice(at, k), row[at:k], base[at:k]
            at, size = k, 0
        size += len(p)
    if size:
        yield slice(at, len(parts)), row[at:], base[at:]


def _fragments(parts: list[bytes], row: list[int], base: list[int], length: int, gram: int):
    data = b"".join(parts)
    n = len(data)
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    h = _words(data, n)
    span = 8
    while span < gram:
        h[: n - span] = _mix(h[: n - span], h[span:])
        span *= 2
    width = length - gram + 1
    v = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    fill = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    fill[:n] = v
    grid = fill.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    least &= np.uint64(0xFFFFFF)
    begin = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    owner = least[begin].astype(np.int64)
    # A run of windows of one anchor, less those that leave the anchor's text.
    t = np.searchsorted(ends, owner, side="right")
    stop = np.minimum(np.append(begin[1:], len(least)), ends[t] - length + 1)
    begin = np.maximum(begin, ends[t] - size[t])
    some = begin < stop
    begin, stop, owner, t = begin[some], stop[some] + length - 1, owner[some], t[some]
    digest = xxhash.xxh3_64_intdigest
    frag = np.array([digest(data[a:z]) for a, z in zip(begin.tolist(), stop.tolist())], np.uint64)
    at = begin - (ends - size)[t] + np.array(base)[t]
    return np.array(row)[t], at, stop - begin, h[owner].view(np.int64), frag.view(np.int64)


def parts_of(data: bytes, anchor: int, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> list[tuple[int, int, int]]:
    """Name, start and end of the parts of one fragment. The anchor is the first gram of its
    hash among those that all windows of the fragment hold."""
    last = len(data) - length  # the last window's start
    inside = data[last:length]
    h = _words(inside, len(inside))
    span = 8
    while span < gram:
        h[: len(inside) - span] = _mix(h[: len(inside) - span], h[span:])
        span *= 2
    at = last + int(np.flatnonzero(h[: len(inside) - gram + 1].view(np.int64) == anchor)[0])
    out = []
    for part in range((at - last) // step, at // step + 1):
        low, high = at - (part + 1) * step + 1, at - part * step  # starts of the part's windows
        name = xxhash.xxh3_64_intdigest(data[high : low + length], part + 1)
        out.append((name - (name >> 63 << 64), max(0, low), min(last, high) + length))
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling, on symbols that make all suffixes differ. A group of suffixes that
    are equal so far is ranked by its first slot, so only such groups are sorted again."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    held = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(held):
        key <<= bits
        key[: n - k] |= symbols[k:] if k else symbols
    order = np.argsort(key).astype(np.int32)
    slots, key = np.arange(n, dtype=np.int32), key[order]
    rank = np.empty(n, np.int32)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        del key
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, np.int32(0)))
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        at = order[slots]
        after = np.minimum(at, n - 1 - held) + held if held < n else np.zeros_like(at)
        key = rank[at].astype(np.int64) * (n + 1)
        key += np.where(at.astype(np.int64) + held < n, rank[after] + 1, 0)
        turn = np.argsort(key)
        order[slots], key = at[turn], key[turn]
        held *= 2


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of some texts, with the text positions at the
    ends of the runs and their matches with the neighbouring suffix outside the run."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.array([len(t) for t in texts])
        self.starts = np.cumsum(size + 1) - (size + 1)
        data = b"\0".join(texts) + b"\0"
        n = len(data)
        mark = self.starts + size
        symbols = np.frombuffer(data, np.uint8).astype(np.int32) + np.int32(len(texts))
        symbols[mark] = np.arange(len(texts))  # each end its own symbol: all suffixes differ
        self.room = np.repeat(mark.astype(np.int32), size + 1) - np.arange(n, dtype=np.int32)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]
        heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        tails = np.append(heads[1:], n) - 1
        self.runs, self.run_symbols, self.n = len(heads), bwt[heads], n
        self.run_lengths = np.diff(np.append(heads, n))
        words = _words(data, n)
        before, after = heads[heads > 0], tails[tails < n - 1]
        self.head_at, self.head_match = sa[before], self._match(words, sa[before], sa[before - 1])
        self.tail_at, self.tail_match = sa[after], self._match(words, sa[after], sa[after + 1])

    def _match(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(self.room[a], self.room[b])
        got = np.zeros(len(a), np.int32)
        live = np.flatnonzero(most > 0)
        while len(live):
            x = words[a[live] + got[live]] ^ words[b[live] + got[live]]
            low = x & (~x + np.uint64(1))  # the lowest differing bit gives the equal bytes
            equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int32)
            got[live] = np.minimum(got[live] + equal, most[live])
            live = live[(x == 0) & (got[live] < most[live])]
        return got

    def matching_statistics(self) -> np.ndarray:
        """At each position, the longest match with a suffix that starts elsewhere: a sample's
        match end holds for the positions after it until another sample reaches further."""
        reach = np.arange(self.n, dtype=np.int32)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            np.maximum.at(reach, at, at + match)
        return np.maximum.accumulate(reach) - np.arange(self.n, dtype=np.int32)


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of some different texts, the maximal runs of bytes covered by windows that
    also start elsewhere in them."""
    index = RunLengthIndex(texts)
    long = index.matching_statistics() >= length
    edge = np.diff(np.concatenate([[0], long.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    of = np.searchsorted(index.starts, first, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k, a, z in zip(of.tolist(), (first - index.starts[of]).tolist(), (last - index.starts[of]).tolist()):
        out[k].append((a, z - 1 + length))
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _pack(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return at << 20 | size


#: What names a text: its id, a 64-bit hash, and its bytes (inverted where it has no id).
NAME = ["__d", "__t", "__u"]


def _name(key: str, text: str) -> dict[str, Column]:
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return dict(zip(NAME, (F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.xxhash64(text), F.when(F.col(key).isNull(), F.bitwise_not(size)).otherwise(size))))


def _places(row, doc, txt, long, at, size, a, f) -> pa.RecordBatch:
    """One row for each fragment of a text: how often it has it, its first span, and, if it
    has it more than once, the runs of bytes that its spans cover together. A text that
    repeats one line a thousand times has one row for it."""
    order = np.lexsort((at, f, a, row))
    row, at, size, a, f = row[order], at[order], size[order], a[order], f[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (f[1:] != f[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(row)))
    # Equal fragments have equal sizes, so their spans join while each starts in the last.
    gap = new.copy()
    gap[1:] |= at[1:] > at[:-1] + size[:-1]
    begin = np.flatnonzero(gap)
    stop = np.append(begin[1:], len(row))[: len(begin)] - 1
    start, length = at[begin], at[stop] + size[stop] - at[begin]
    whole = -(-length // RUN)
    k = ragged(np.zeros(len(whole), np.int64), whole)
    start = np.repeat(start, whole) + k * RUN
    runs = _pack(start, np.minimum(RUN, np.repeat(length, whole) - k * RUN))
    each = np.bincount(np.searchsorted(first, begin, side="right") - 1, weights=whole, minlength=len(first)).astype(np.int64)
    once = n == 1
    runs = runs[np.repeat(~once, each)]
    offsets = np.concatenate([[0], np.cumsum(np.where(once, 0, each))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(once, False)), pa.array(runs))
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(f[first]), pa.array(doc[row[first]]), pa.array(txt[row[first]]), pa.array(long[row[first]]), pa.array(n), pa.array(_pack(at[first], size[first])), lists], names=["a", "f", *NAME, "n", "span", "runs"])


def spans(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """NAME, __spans: packed runs of bytes (start << 20 | size),
    overlapping and in any order, that together are what repeats."""
    spark = docs.sparkSession
    reach_workers(spark)
    named = docs.select(*(c.alias(n) for n, c in _name(key, text).items()), F.col(text).alias("__x"))

    def columns(b: pa.RecordBatch):
        row, at, size, anchor, frag = fragments(_texts(b.column("__x")), length)
        return row, *(b.column(c).to_numpy() for c in NAME), at, size, anchor, frag

    def anchors(batches):
        for b in sliced(batches, "__x"):
            a, f = columns(b)[6:]
            # Sums within a slice: a text that repeats one line sends one row for it.
            at, each, n = np.unique(a, return_inverse=True, return_counts=True)
            low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
            np.minimum.at(low, each, f)
            np.maximum.at(high, each, f)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(low), pa.array(high)], names=["a", "n", "low", "high"])

    def places(batches):
        for b in sliced(batches, "__x"):
            yield _places(*columns(b))

    # Stored, so that both sides of the join are plain exchanges, whose large partitions split.
    repeated = stored(
        named.mapInArrow(anchors, "a long, n long, low long, high long").groupBy("a").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where("n > 1").select("a", (F.col("low") != F.col("high")).alias("mixed")),
        "rl-repeated",
    )
    seen = stored(named.mapInArrow(places, "a long, f long, __d long, __t long, __u int, n long, span long, runs array<long>").join(repeated, "a"), "rl-places")
    mixed = seen.where("mixed").withColumn("rep", F.xxhash64(*NAME, "span"))
    kinds = stored(mixed.groupBy("a", "f").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")), "rl-kinds")
    # Different fragments of an anchor; an anchor without a single one needs no index.
    groups = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("single > 0")
    needed = kinds.join(groups, "a").select("a", "f", F.col("rep").alias("r"), (F.col("kinds") > HOT).alias("hot"))
    sent = stored(mixed.join(needed, ["a", "f"]).where("rep = r").select("a", "hot", *NAME, "span").distinct(), "rl-sent")
    whole = F.coalesce("runs", F.array("span")).alias("runs")
    folded = seen.where("NOT mixed").select(*NAME, whole).unionAll(mixed.join(kinds.where("n > 1").select("a", "f"), ["a", "f"]).select(*NAME, whole))

    wanted = sent.groupBy(*NAME).agg(F.collect_set(F.struct("a", "hot", "span")).alias("want"))
    joined = _squeezed(named, NAME, "__x").dropDuplicates(NAME).join(wanted, NAME)

    def cut(batches):
        undo = zstandard.ZstdDecompressor()
        for b in sliced(batches, "__x"):
            out = {c: [] for c in shape.names}

            def put(*values):
                for c, x in zip(out.values(), values):
                    c.append(x)

            for d, t, u, x, want in zip(*(b.column(c).to_pylist() for c in (*NAME, "__x", "want"))):
                data = undo.decompress(x)
                for w in want:
                    at, size = w["span"] >> 20, w["span"] & 0xFFFFF
                    if not w["hot"]:
                        put(w["a"], None, d, t, u, w["span"], data[at : at + size])
                        continue
                    for name, low, high in parts_of(data[at : at + size], w["a"], length):
                        part = data[at + low : at + high]
                        digest = xxhash.xxh3_64_intdigest(part)
                        put(name, digest - (digest >> 63 << 64), d, t, u, at + low << 20 | high - low, part)
                if len(out["a"]) > 1 << 13:
                    yield pa.RecordBatch.from_pydict(out, schema=shape)
                    out = {c: [] for c in out}
            yield pa.RecordBatch.from_pydict(out, schema=shape)

    def cut_windows(batches):
        for b in batches:
            row, start, digest = [], [], []
            for k, (at, data) in enumerate(zip(b.column("span").to_pylist(), b.column("data").to_pylist())):
                for s in range(len(data) - length + 1):
                    row.append(k)
                    start.append((at >> 20) + s << 20 | length)
                    digest.append(xxhash.xxh3_128_digest(data[s : s + length]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in NAME), pa.array(start, pa.int64()), pa.array(digest, pa.binary())], names=[*NAME, "span", "data"])

    shape = pa.schema([("a", pa.int64()), ("f", pa.int64()), ("__d", pa.int64()), ("__t", pa.int64()), ("__u", pa.int32()), ("span", pa.int64()), ("data", pa.binary())])
    pieces = stored(joined.mapInArrow(cut, "a long, f long, __d long, __t long, __u int, span long, data binary"), "rl-pieces")
    chosen = pieces.where("f IS NULL").select("a", *NAME, "span", "data")
    more = []
    if not sent.where("hot").isEmpty():
        sub = pieces.where("f IS NOT NULL").withColumn("rep", F.xxhash64(*NAME, "span"))
        parts = stored(sub.groupBy("a", "f").agg(F.count("*").alias("n"), F.min("rep").alias("r")), "rl-parts")
        whole_parts = sub.join(parts.where("n > 1").select("a", "f"), ["a", "f"]).select(*NAME, F.array("span").alias("runs"))
        open_ = parts.groupBy("a").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("single > 0 AND kinds > 1")
        wanted_parts = parts.join(open_, "a").select("a", "f", "r", (F.col("kinds") > HOT).alias("hot"))
        left = sub.join(wanted_parts, ["a", "f"]).where("rep = r")
        chosen = chosen.unionAll(left.where("NOT hot").select("a", *NAME, "span", "data"))
        windows = left.where("hot").select(*NAME, "span", "data").mapInArrow(cut_windows, "__d long, __t long, __u int, span long, data binary")
        windows = stored(windows, "rl-windows")
        twice = windows.groupBy("data").agg(F.count("*").alias("n")).where("n > 1").select("data")
        more = [whole_parts, windows.join(twice, "data").select(*NAME, F.array("span").alias("runs"))]
    total = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        # Only fragments of one anchor need to meet: whole anchors, as many as one index holds.
        pdf = pdf.sort_values(["a", *NAME, "span"], kind="stable")
        total = pdf["data"].map(len).groupby(pdf["a"], sort=False).sum().cumsum()
        part = pdf["a"].map(total.sub(1) // BUCKET_BYTES).to_numpy()
        marks = [m for k in np.unique(part) for m in repeated_windows(list(pdf["data"][part == k]), length)]
        n = [len(m) for m in marks]
        at = np.repeat(pdf["span"].to_numpy() >> 20, n)
        run = np.array([r for m in marks for r in m], np.int64).reshape(-1, 2)
        return pd.DataFrame({**{c: np.repeat(pdf[c].to_numpy(), n) for c in NAME}, "span": _pack(at + run[:, 0], run[:, 1] - run[:, 0])})

    indexed = chosen.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(buckets))).groupBy("g").applyInPandas(bucket, "__d long, __t long, __u int, span long")
    found = folded.unionAll(indexed.select(*NAME, F.array("span")))
    for rows in more:
        found = found.unionAll(rows)
    return found.groupBy(*NAME).agg(F.flatten(F.collect_set("runs")).alias("__spans"))


def _squeezed(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The named columns, and the text as zstd-compressed bytes (null as empty)."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([squeeze.compress(x) for x in _texts(b.column(text))], pa.binary())], names=[*keep, text])

    return rows.select(*keep, text).mapInArrow(run, StructType([*(rows.schema[c] for c in keep), StructField(text, BinaryType())]))


def removed_runs(packed: list[int] | None) -> list[tuple[int, int]]:
    """Packed runs as maximal ones, in order."""
    out: list[list[int]] = []
    for p in sorted(packed or ()):
        a, z = p >> 20, (p >> 20) + (p & 0xFFFFF)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


FORMS = {"kept": bytes, "kept_sha256": lambda x: hashlib.sha256(x).hexdigest(), "kept_text": lambda x: x.decode(errors="ignore")}


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, form: str = "kept", prefix: str = "") -> DataFrame:
    """docs with the text's remaining bytes in place of the text, and n_bytes, n_removed,
    n_spans. form: `kept` (the bytes), `kept_sha256`, or `kept_text` (without characters
    that were cut in two). New names start with prefix; columns of those names are replaced."""
    names = [prefix + n for n in ("n_bytes", "n_removed", "n_spans", form)]
    docs = docs.drop(*(n for n in names if n not in (key, text)))
    found = spans(docs, key, text, length)
    named = docs.withColumns(_name(key, text))
    others = [c for c in docs.columns if c != text]
    finish = FORMS[form]
    joined = _squeezed(named, [*others, *NAME], text).join(found, NAME, "left")
    kind = pa.binary() if form == "kept" else pa.string()

    def run(batches):
        undo = zstandard.ZstdDecompressor()
        for b in sliced(batches, text):
            size, gone, runs, out = [], [], [], []
            for x, s in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist()):
                data = undo.decompress(x)
                cut = removed_runs(s)
                rest = b"".join(data[a:z] for a, z in zip([0, *(z for _, z in cut)], [*(a for a, _ in cut), len(data)]))
                size.append(len(data))
                gone.append(len(data) - len(rest))
                runs.append(len(cut))
                out.append(finish(rest))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, kind)], names=[*others, *names])

    more = [*(StructField(n, LongType()) for n in names[:3]), StructField(names[3], BinaryType() if form == "kept" else StringType())]
    return joined.mapInArrow(run, StructType([*(docs.schema[c] for c in others), *more]))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without what repeats; characters cut in two go as well. Documents of which
    nothing is left go; those that were empty before stay, with an empty text."""
    named = remove(docs, key, text, length, "kept_text", "__")
    out = named.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_bytes"))).withColumnRenamed("__kept_text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
