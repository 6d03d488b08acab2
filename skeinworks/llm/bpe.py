"""Byte-level BPE on padded matrices.

Distinct pre-tokens are bucketed by length into padded matrices of ids, beside matrices of
their neighbouring pairs' ranks from a hash table of merges. In each round every row merges
its leftmost pair of the least rank, both matrices are compacted by one column, and the two
new pairs are looked up; finished rows leave the matrix. A pre-token longer than the widest
bucket is a matrix of one row, which in a round merges all pairs of the least rank at once
where no other merge could come between them, and the leftmost alone where one could.

Defined results
* null text: encoded as the empty text, no ids. Ids of very long texts: encoded in full; the
  text is cut only where the pattern always has a bound.
* repeated rows: each gives its row. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinworks.llm.batches import ragged, sliced, texts_of
from skeinworks.llm.pretokens import Splitter, WordIds, encode_slice
from skeinworks.session import reach_workers

NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices; a longer pre-token is a row of its own width.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    pairs = (line.split() for line in open(path, "rb") if line.strip())
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class MergeTable:
    """Open-addressed hash table from a pair of ids to the id of their merge. A merge of any
    two tokens whose bytes together are a token is one, of that token's rank."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens) if t}
        left, right, into = [], [], []
        for t, i in rank.items():
            for cut in range(1, len(t)):
                a = rank.get(t[:cut])
                if a is not None and (b := rank.get(t[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.into = np.full(size, NONE, np.int32)
        waiting, value, slot = keys, np.array(into, np.int32), self._slot(keys)
        self.probes = 0
        while len(waiting):
            free = np.flatnonzero(self.keys[slot] == np.uint64(2**64 - 1))
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.into[slot[put]] = waiting[put], value[put]
            rest = np.ones(len(waiting), bool)
            rest[put] = False
            waiting, value, slot = waiting[rest], value[rest], (slot[rest] + 1) & (size - 1)
            self.probes += 1
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE if it has none. Padding is -1."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.where(self.keys[slot] == flat, self.into[slot], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == flat[open_]
            out[open_[hit]] = self.into[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        out[right.ravel() < 0] = NONE
        return out.reshape(left.shape)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each pre-token, and all ids in turn."""
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        ids = self.byte_id[data]  # each pre-token's ids replace the first of its bytes' ids
        size = length.astype(np.int32)
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for at in range(0, len(rows), max(1, (1 << 18) // width)):
                self._merge(ids, begin, length, size, rows[at : at + max(1, (1 << 18) // width)], width)
        for r in np.flatnonzero(length > low):
            one = self._merge_row(ids[begin[r] : begin[r] + length[r]])
            ids[begin[r] : begin[r] + len(one)] = one
            size[r] = len(one)
        return size, ids[ragged(begin, size.astype(np.int64))]

    def _merge(self, ids, begin, length, size, rows, width) -> None:
        column = np.arange(width)
        inside = column < length[rows, None]
        m = np.where(inside, ids[np.minimum(begin[rows, None] + column, len(ids) - 1)], -1).astype(np.int32)
        rank = self.ranks(m[:, :-1], m[:, 1:])
        count = length[rows].copy()
        while True:
            r = np.arange(len(m))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(m), np.int64)
            best = rank[r, at] if rank.shape[1] else np.full(len(m), NONE)
            stop = best == NONE
            if stop.any():
                done = np.flatnonzero(stop)
                ids[ragged(begin[rows[done]], count[done])] = m[done][np.arange(m.shape[1]) < count[done, None]]
                size[rows[done]] = count[done]
                going = ~stop
                m, rank, rows, count, at, best = m[going], rank[going], rows[going], count[going], at[going], best[going]
                r = np.arange(len(m))
            if not len(m):
                return
            m[r, at] = best
            keep = np.ones(m.shape, bool)
            keep[r, at + 1] = False
            m = m[keep].reshape(len(m), -1)
            keep = np.ones(rank.shape, bool)
            keep[r, at] = False
            rank = rank[keep].reshape(len(m), -1)
            count -= 1
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < rank.shape[1])
            row = np.concatenate([left, right])
            pair = np.concatenate([at[left] - 1, at[right]])
            rank[row, pair] = self.ranks(m[row, pair], m[row, pair + 1])

    def _merge_row(self, m: np.ndarray) -> np.ndarray:
        rank = self.ranks(m[:-1], m[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # Of pairs that overlap (three equal ids) the first, third and so on can merge.
            first = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            while True:
                keep = np.ones(len(m), bool)
                keep[at + 1] = False
                merged = m.copy()
                merged[at] = best
                merged = merged[keep]
                place = at - np.arange(len(at))
                before = place[place > 0]
                left = self.ranks(merged[before - 1], merged[before])
                if len(at) == 1:
                    break
                # A merge sees its left side done and its right side not: had one of those
                # pairs a lower rank, it would come before the next merge of this rank.
                beside = m[at[at + 2 < len(m)] + 2]
                if (left > best).all() and (self.ranks(np.full(len(beside), best), beside) > best).all():
                    break
                at = at[:1]
            m, rank = merged, np.delete(rank, at)
            rank[before - 1] = left
            after = place[place < len(rank)]
            rank[after] = self.ranks(m[after], m[after + 1])
        return m

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in turn, and the number of bytes of each row of `counts` ids."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        out = self.bytes[ragged(self.offsets[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        return out, total[ends] - total[ends - counts]


_HERE: dict[str, tuple] = {}


def _tools(tokens: list[bytes]) -> tuple[Splitter, WordIds, MergeTable]:
    """A worker's splitter, merges and known pre-tokens, kept between its tasks."""
    name = hashlib.sha1(b"\0".join(tokens)).hexdigest()
    if name not in _HERE:
        merges = MergeTable(tokens)
        _HERE[name] = Splitter(), WordIds(merges.encode), merges
    return _HERE[name]


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of every text."""
    reach_workers(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        splitter, words, _ = _tools(tokens.value)
        for b in sliced(batches, text):
            ids, counts = encode_slice(splitter, words, texts_of(b, text))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """key, text_bytes: the bytes of each row's ids. Null ids: no bytes."""
    reach_workers(encoded.sparkSession)
    tokens = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        merges = _tools(tokens.value)[2]
        for b in batches:
            lists = [np.asarray(x or [], np.int64) for x in b.column("ids").to_pylist()]
            out, sizes = merges.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([out[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())], names=[key, "text_bytes"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, text_bytes binary")


def digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: key, n_tokens, ids_sha256 (of the decimal ids, joined by
    a blank), decoded_sha256 (of the decoded bytes), round_trip. Only digests leave the task."""
    reach_workers(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        splitter, words, merges = _tools(tokens.value)
        width = len(str(len(merges.tokens))) + 1
        digits = np.frombuffer("".join(f"{i} ".ljust(width, "\0") for i in range(len(merges.tokens))).encode(), np.uint8).reshape(-1, width)
        digit_len = (digits != 0).sum(1)
        for b in sliced(batches, text):
            texts = texts_of(b, text)
            ids, counts = encode_slice(splitter, words, texts)
            chars = digits[ids].ravel()
            chars = chars[chars != 0].tobytes()
            total = np.concatenate([[0], np.cumsum(digit_len[ids])])
            ends = np.cumsum(counts)
            a, z = total[ends - counts].tolist(), total[ends].tolist()
            out, sizes = merges.decode(ids, counts)
            out = out.tobytes()
            stop = np.cumsum(sizes)
            parts = [out[e - s : e] for s, e in zip(sizes.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key),
                    pa.array(counts),
                    pa.array([hashlib.sha256(chars[x : max(x, y - 1)]).hexdigest() for x, y in zip(a, z)]),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                    pa.array([p == t.encode() for p, t in zip(parts, texts)]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
