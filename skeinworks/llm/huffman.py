"""Token ids in files of canonical, length-limited Huffman codes.

Ids are counted over the whole input; package-merge gives the best code lengths up to
`LIMIT` bits, and canonical codes follow from the lengths alone. Documents are coded where
they are, dealt by ranges of their id, one range to a file, and written in ascending order. A
file row is an independent block: header, documents, bit-offset checkpoints every `STRIDE`
ids, and bits. Decoding takes all checkpoints of a block at once, one table look-up an id in
each step.

Layout of `path`: `codebook` (one row, the code length of every id) and `blocks` (part,
block, first token in the part, tokens, payload), both Parquet as a container, so that
reading and writing work in any store that Spark reaches. A payload is little-endian:
magic `SKH1`, then uint32 documents, uint32 checkpoints, uint64 tokens; int64 ids and uint8
null flags of documents, uint32 tokens and uint32 bytes of each; uint32 bit offsets of
checkpoints within their document; the bits of every document, from a byte bound on.

Defined results
* null text: the end id alone. Null ids of documents: first. Very long texts: whole.
* added tokens of the tokenizer's file that occur in a text: their own ids, as the library's.
* equal ids of documents: all are kept, next to each other in an order of their own. An id
  (or null) that many rows carry is dealt over as many ranges as its share of the rows is.
* empty table: a codebook without codes, no blocks, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skeinworks.llm.batches import ragged, sliced, texts_of
from skeinworks.llm.pretokens import Splitter, WordIds, encode_slice
from skeinworks.session import discard, reach_workers, stored

#: Bits of the longest code.
LIMIT = 20
#: Ids between two checkpoints, and ids to a block, about.
STRIDE, BLOCK_IDS = 512, 1 << 20
#: Ids to a range of documents; a range is streamed, never held. Small inputs get up to four
#: ranges a core, down to the second number of ids.
PART_IDS, LEAST_IDS = 1 << 26, 1 << 22
#: Bytes of a row group of the files.
ROW_GROUP = 8 << 20
MAGIC = b"SKH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the lengths, 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order >= len(weight))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for packed in reversed(levels):
        inner = int(packed[:take].sum())
        lengths[used[: take - inner]] += 1
        take = 2 * inner
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that ascend by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for k in order.tolist():
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k] = code
        code += 1
    return codes


def encode_bits(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bits of rows of `counts` ids, each from a byte bound on; their bytes; the bit
    offsets of their checkpoints within them; their number of checkpoints."""
    size = lengths[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.cumsum(counts)
    first = ends - counts
    row_bytes = (total[ends] - total[first] + 7) // 8
    base = (np.cumsum(row_bytes) - row_bytes) * 8
    inside = total[:-1] - np.repeat(total[first], counts)
    at = np.repeat(base, counts) + inside
    out = np.zeros(int(row_bytes.sum()) // 8 + 2, np.uint64)
    if len(ids):
        word, off = at >> 6, at & 63
        over = off + size - 64
        code = codes[ids]
        part = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[starts]] = np.add.reduceat(part, starts)
        spill = np.flatnonzero(over > 0)
        out[word[spill] + 1] += code[spill] << (64 - over[spill]).astype(np.uint64)
    points = (counts + stride - 1) // stride
    k = ragged(np.zeros(len(counts), np.int64), points)
    offsets = inside[np.repeat(first, points) + k * stride] if len(k) else np.zeros(0, np.int64)
    return out.astype(">u8").tobytes()[: int(row_bytes.sum())], row_bytes, offsets, points


class Decoder:
    """Look-up tables of a canonical code."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.bits = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = np.int64(1) << (self.bits - lengths[order])
        self.ids = np.zeros(1 << self.bits, np.int32)
        self.size = np.ones(1 << self.bits, np.int32)
        self.ids[: spans.sum()] = np.repeat(order, spans)
        self.size[: spans.sum()] = np.repeat(lengths[order], spans)

    def decode(self, bits: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of lanes in turn: counts[i] ids from bit starts[i] on. All lanes go in step,
        longest first, so that finished lanes are a tail."""
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        order = np.argsort(-counts, kind="stable")
        at = starts[order].copy()
        place = (np.cumsum(counts) - counts)[order]
        live = np.searchsorted(-counts[order], -np.arange(int(counts.max(initial=0))), side="left")
        out = np.zeros(int(counts.sum()), np.int32)
        shift = np.uint32(32 - self.bits)
        for step, n in enumerate(live.tolist()):
            p = at[:n]
            key = (window[p >> 3] << (p & 7).astype(np.uint32)) >> shift
            out[place[:n] + step] = self.ids[key]
            p += self.size[key]
        return out


def pack_block(keys: list, tokens: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, bits: bytes) -> bytes:
    null = np.array([k is None for k in keys], np.uint8)
    ids = np.array([0 if k is None else k for k in keys], "<i8")
    head = MAGIC + struct.pack("<IIQ", len(keys), len(offsets), int(tokens.sum()))
    return b"".join([head, ids.tobytes(), null.tobytes(), tokens.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), bits])


def unpack_block(payload: bytes, decoder: Decoder, stride: int = STRIDE) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their tokens, and all token ids in turn."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of Huffman-coded ids")
    n, points, _ = struct.unpack_from("<IIQ", payload, 4)
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(payload, kind, count, at)
        at += got.nbytes
        return got

    ids, null = take("<i8", n), take("u1", n)
    tokens, sizes, offsets = take("<u4", n).astype(np.int64), take("<u4", n).astype(np.int64), take("<u4", points).astype(np.int64)
    lanes = (tokens + stride - 1) // stride
    base = np.repeat((np.cumsum(sizes) - sizes) * 8, lanes)
    k = ragged(np.zeros(n, np.int64), lanes)
    counts = np.minimum(stride, np.repeat(tokens, lanes) - k * stride)
    out = decoder.decode(payload[at:], base + offsets, counts)
    return [None if z else int(i) for i, z in zip(ids, null)], tokens, out


_HERE: dict[str, tuple] = {}


def added_tokens(tokenizer) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern that cuts texts at the added tokens, longest first, and their ids."""
    found = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
    odd = [c for c, (_, t) in found.items() if t.single_word or t.lstrip or t.rstrip or t.normalized]
    if odd:
        raise ValueError(f"added tokens with rules on their surroundings: {odd}")
    longest = "|".join(map(re.escape, sorted(found, key=len, reverse=True)))
    return re.compile(f"({longest})") if found else None, {c: i for c, (i, _) in found.items()}


def cut_at_added(texts: list[str], pattern: re.Pattern | None, added: dict[str, int], end_id: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts in segments without added tokens; the id after each segment, the added token's
    or, at the end of a text, end_id; each text's number of segments."""
    segments, after, n = [], [], []
    for t in texts:
        parts = pattern.split(t) if pattern else [t]
        segments += parts[::2]
        after += [added[c] for c in parts[1::2]] + [end_id]
        n.append(len(parts) // 2 + 1)
    return segments, np.array(after, np.int64), np.array(n, np.int64)


def _tokenizer(spec: str) -> tuple[Splitter, WordIds, re.Pattern | None, dict[str, int]]:
    """A worker's tokenizer, the pre-tokens it has met and the added tokens, kept between its tasks."""
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _HERE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        # A byte-level token has a character for each of its bytes.
        length = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            length[i] = len(token)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Words go to the library many at a time, as one text split beforehand; where
            each one's ids end is told by their bytes."""
            sizes, flat = [], []
            for k in range(0, len(words), 1024):
                part = words[k : k + 1024]
                ids = np.array(tokenizer.encode_batch_fast([[w.decode() for w in part]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
                reach, ends = np.cumsum(length[ids]), np.cumsum([len(w) for w in part])
                stop = np.searchsorted(reach, ends) + 1
                if len(ids) != stop[-1] or (reach[stop - 1] != ends).any():
                    raise ValueError("the tokenizer's ids do not spell its pre-tokens")
                sizes.append(np.diff(stop, prepend=0))
                flat.append(ids)
            return np.concatenate(sizes), np.concatenate(flat)

        _HERE[key] = Splitter(), WordIds(encode, 1_000_000), *added_tokens(tokenizer)
    return _HERE[key]


def token_ids(docs: DataFrame, spec: str, end_id: int, key: str = "doc_id", text: str = "text", wide: bool = True) -> DataFrame:
    """key, ids: little-endian uint32 (uint16 if not wide) with end_id at the end. Texts are
    cut at added tokens, then the tokenizers library encodes each distinct pre-token that a
    worker meets; as it cuts at the same tokens and its byte-level pre-tokenizer splits at
    the same bounds, texts come out the same."""
    reach_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        splitter, words, pattern, added = _tokenizer(shared.value)
        for b in sliced(batches, text):
            segments, after, n = cut_at_added(texts_of(b, text), pattern, added, end_id)
            ids, counts = encode_slice(splitter, words, segments)
            out = np.insert(ids, np.cumsum(counts), after).astype("<u4" if wide else "<u2")
            ends = np.cumsum((counts + 1) * out.itemsize)[np.cumsum(n) - 1].tolist()
            data = out.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([data[a:e] for a, e in zip([0, *ends], ends)], pa.binary())], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode docs and write them to `path`, which must not exist."""
    import json

    spark = docs.sparkSession
    spec = open(tokenizer_path, encoding="utf-8").read()
    known = json.loads(spec)
    vocab = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens") or []), end_id]) + 1
    kind = "<u4" if vocab > 1 << 16 else "<u2"
    rows = token_ids(docs, spec, end_id, key, text, wide=kind == "<u4")
    # Ids wait in the shared folder for the counts; zstd brings them near their entropy. The
    # salt is stored with them: it orders the rows of one id, on every later read alike.
    waiting = stored(
        rows.select(key, "ids", F.coalesce(key, F.lit(-(1 << 63))).alias("place"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).alias("salt")),
        "huffman-ids", compression="zstd", row_group=ROW_GROUP,
    )

    def histogram(batches):
        count = np.zeros(vocab, np.int64)
        for b in batches:
            for x in b.column("ids"):
                count += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocab)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["id", "n"])

    counts = np.zeros(vocab, np.int64)
    # At most one row for each id of the vocabulary.
    for row in waiting.select("ids").mapInArrow(histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.astype(np.uint8).tobytes()), STRIDE, int(counts.sum()))], "lengths binary, stride int, tokens long").coalesce(1).write.parquet(f"{path}/codebook")

    total = int(counts.sum())
    parts = max(1, -(-total // PART_IDS), min(4 * spark.sparkContext.defaultParallelism, total // LEAST_IDS))
    # One bound for each range: quantiles of the ids, off by a tenth of a range at most.
    cuts = waiting.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)], 10 * parts + 10_000)).first()[0] if parts > 1 else []
    code = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), np.array(cuts, np.int64)))

    def coded(batches):
        size, codes, bounds = code.value
        for b in sliced(batches, "ids", 1 << 20):
            place = b.column("place").to_numpy()
            # Rows of an id that fills ranges of its own go to them by their salt.
            low, high = np.searchsorted(bounds, place, side="left"), np.searchsorted(bounds, place, side="right")
            part = low + (b.column("salt").to_numpy() * (high - low + 1) >> 30)
            each = [np.frombuffer(x.as_buffer(), kind) for x in b.column("ids")]
            n = np.array([len(x) for x in each], np.int64)
            bits, sizes, offsets, points = encode_bits(np.concatenate(each).astype(np.int64), n, size, codes)
            ends, marks = np.cumsum(sizes).tolist(), np.cumsum(points).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)), b.column(key), b.column("place"), b.column("salt"), pa.array(n),
                    pa.array([bits[e - s : e] for e, s in zip(ends, sizes.tolist())], pa.binary()),
                    pa.array([offsets[e - p : e].astype("<u4").tobytes() for e, p in zip(marks, points.tolist())], pa.binary()),
                ],
                names=["part", key, "place", "salt", "n", "bits", "offsets"],
            )

    def blocks(batches):
        part, block, first, held, tokens = None, 0, 0, [], 0

        def done():
            payload = pack_block([h[0] for h in held], np.array([h[1] for h in held], np.int64), np.array([len(h[2]) for h in held], np.int64), np.frombuffer(b"".join(h[3] for h in held), "<u4"), b"".join(h[2] for h in held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": [first], "tokens": [tokens], "payload": pa.array([payload], pa.binary())})

        for b in batches:
            for p, k, n, bits, offsets in zip(*(b.column(c).to_pylist() for c in ("part", key, "n", "bits", "offsets"))):
                if held and (p != part or tokens >= BLOCK_IDS):
                    yield done()
                    block, first, held, tokens = block + 1, first + tokens, [], 0
                if p != part:
                    part, block, first = p, 0, 0
                held.append((k, n, bits, offsets))
                tokens += n
        if held:
            yield done()

    dealt = waiting.mapInArrow(coded, f"part int, {key} long, place long, salt long, n long, bits binary, offsets binary")
    ranged = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "place", "salt").select("part", key, "n", "bits", "offsets")
    files = ranged.mapInArrow(blocks, "part int, block int, first long, tokens long, payload binary").write
    files.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    discard(waiting)


def read(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """key, start (ids before the document), n_tokens and ids; with digest, ids_crc32 (of
    the ids as little-endian uint32) in place of ids."""
    reach_workers(spark)
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = spark.sparkContext.broadcast(np.frombuffer(bytes(book.lengths), np.uint8).astype(np.int64))
    stride = book.stride
    blocks = spark.read.schema("part int, block int, first long, tokens long, payload binary").parquet(f"{path}/blocks")
    # One row a range, of PART_IDS ids or more but for small inputs.
    base = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")

    def run(batches):
        decoder = Decoder(lengths.value)
        for b in batches:
            for base, first, payload in zip(b.column("base").to_pylist(), b.column("first").to_pylist(), b.column("payload").to_pylist()):
                keys, tokens, ids = unpack_block(payload, decoder, stride)
                ends = np.cumsum(tokens)
                starts = base + first + ends - tokens
                if digest:
                    data = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip((ends - tokens).tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(tokens), last], names=[key, "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.select("part", "first", "payload").join(F.broadcast(base), "part").mapInArrow(run, f"{key} long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))
