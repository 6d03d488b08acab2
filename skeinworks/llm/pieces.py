"""SentencePiece BPE on flat symbol arrays.

A text's blanks become U+2581, one is put before it, and it is cut into words wherever two
characters stand side by side in no piece of the vocabulary: no merge can cross such a place.
The distinct words of a slice are one flat array of symbols. In each round every word finds the
least rank among its pairs (a segmented minimum) and merges that pair at all its places from the
left at once, up to the first merge beside which a pair of no greater rank appears, as
that one has to come next; the array is compacted, and words without a pair leave it. So
every word, of any length, merges in the order in which a queue by rank and place would.
Characters of no piece become their UTF-8 bytes. Words that a worker has merged are kept, in
bounded memory.

Defined results
* null text: encoded as the empty text: the end id alone. Very long texts: encoded whole.
* repeated rows: each gives its row; a null key is kept. Empty table: no rows. Extra columns
  are ignored, whatever their names.
* decoding: unknown ids raise an error; control ids give no text; bytes that are no UTF-8 give
  U+FFFD each. U+2581 in a text comes back as a blank, as the library has it.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinworks.llm.batches import ragged, sliced, texts_of
from skeinworks.llm.pretokens import CUT, MARK, Splitter, WordIds, encode_slice
from skeinworks.session import reach_workers

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """piece, score and kind by id. Models of other forms than this encoder's are refused: it
    takes BPE with a leading blank, kept white space, bytes for unknown characters, and neither
    a map of characters nor pieces that the user defined."""
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(open(path, "rb").read()):
        if field == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    as_expected = trainer.get(3) == 2 and trainer.get(35) and not trainer.get(24) and not normaliser.get(2) and normaliser.get(3, 1) and not normaliser.get(4, 1) and normaliser.get(5, 1)
    if not as_expected or {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback, identity normalisation and a leading blank")
    return pieces


class Merges:
    """Symbols (pieces by id, then characters that only occur inside pieces), the pairs that
    merge, and the pairs of characters that stand side by side in a piece."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        symbol = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        inside = sorted({c for p in symbol for c in p})
        for c in inside:
            symbol.setdefault(c, len(symbol) + len(pieces))
        names = {i: p for p, i in symbol.items()}
        self.size = max(names) + 1
        # Equal scores share a rank: the left one of such pairs comes first.
        score = np.array([s for _, s, _ in pieces], np.float32)
        self.rank = np.append(np.unique(-score, return_inverse=True)[1].astype(np.int32), NONE)
        found = {}
        for p, i in symbol.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    found[a * self.size + b] = i
        self.keys = np.array(sorted(found), np.int64)
        self.into = np.array([found[k] for k in self.keys.tolist()], np.int32)
        # A character's symbol, and its number among the characters of pieces.
        self.symbol_of = np.full(MARK + 1, -1, np.int32)
        self.number_of = np.full(MARK + 1, -1, np.int32)
        points = np.array([ord(c) for c in inside], np.int64)
        self.symbol_of[points] = [symbol[c] for c in inside]
        self.number_of[points] = np.arange(len(inside))
        self.inside = len(inside)
        beside = np.zeros(self.inside**2, bool)
        for p in symbol:
            n = self.number_of[[ord(c) for c in p]]
            beside[n[:-1].astype(np.int64) * self.inside + n[1:]] = True
        self.beside = np.packbits(beside, bitorder="little")
        #: Whether a blank only ever begins the characters of a piece, so that texts can be cut before one.
        at = int(self.number_of[ord(BLANK)])
        others = np.flatnonzero(beside.reshape(self.inside, -1)[:, at]) if at >= 0 else np.zeros(0, int)
        self.parts = not set(others.tolist()) - {at}
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.end = next(i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == "</s>")
        # What every id says: a blank for U+2581, a byte's own byte, nothing for control ids.
        said = [p.replace(BLANK, " ").encode() if kind == NORMAL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" for p, _, kind in pieces]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        self.bytes = np.frombuffer(b"".join(said), np.uint8)
        self.leads = np.array([kind == NORMAL and p.startswith(BLANK) for p, _, kind in pieces])
        self.silent = np.array([kind == CONTROL for _, _, kind in pieces])

    def apart(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece holds a character and the one after it side by side."""
        n = self.number_of[codes].astype(np.int64)
        known = (n[:-1] >= 0) & (n[1:] >= 0)
        key = np.where(known, n[:-1] * self.inside + n[1:], 0)
        return ~(known & (self.beside[key >> 3] >> (key & 7) & 1).astype(bool))

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair; -1 where there is none. Symbols of no piece are -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.into[at], np.int32(-1))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in turn."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        codes = np.frombuffer(b"".join(words).decode().encode("utf-32-le"), "<u4").astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = heads[np.cumsum([len(w) for w in words])] if words else np.zeros(0, np.int64)
        length = np.diff(ends, prepend=0)
        # Every symbol keeps the place of its first character; at the end places hold the ids.
        place = np.arange(len(codes))
        word = np.repeat(np.arange(len(words)), length)
        out = np.full(len(codes), -2, np.int32)
        sym = self.symbol_of[codes]
        into = np.append(self.merged(sym[:-1], sym[1:]), np.int32(-1)) if len(sym) else sym
        into[ends - 1] = -1
        while len(sym):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(np.append(first, len(word)))
            rank = self.rank[into]
            least = np.minimum.reduceat(rank, first)
            going = np.repeat(least != NONE, count)
            out[place[~going]] = sym[~going]
            hit = going & (rank == np.repeat(least, count))
            if not going.all():
                sym, into, place, word, hit = sym[going], into[going], place[going], word[going], hit[going]
            if not len(sym):
                break
            at = self._places(sym, into, word, hit)
            sym, into = sym.copy(), into.copy()
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            now = at - np.arange(len(at))
            sym, into, place, word = sym[stay], into[stay], place[stay], word[stay]
            last = np.append(np.diff(word) > 0, True)
            for pair in (now, now[now > 0] - 1):
                pair = pair[~last[pair]]
                into[pair] = self.merged(sym[pair], sym[pair + 1])
            into[last] = -1
        return self._spelt(out, codes, np.repeat(np.arange(len(words)), length), len(words))

    def _places(self, sym: np.ndarray, into: np.ndarray, word: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Where to merge at once: of pairs of the least rank that overlap, the first, third and
        so on; in every word up to the first that brings a pair of no greater rank."""
        at = np.flatnonzero(hit)
        begin = np.append(True, np.diff(at) > 1)
        run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        made, rank = into[at], self.rank[into[at]]
        # What stands on the left has merged by then, what stands on the right has not.
        merged = np.full(len(sym), -1, np.int32)
        merged[at] = made
        before = np.where((at > 1) & (merged[at - 2] >= 0), merged[at - 2], sym[at - 1])
        left = np.where((at > 0) & (word[at - 1] == word[at]), self.rank[self.merged(before, made)], NONE)
        after = np.minimum(at + 2, len(sym) - 1)
        right = np.where((at + 2 < len(sym)) & (word[after] == word[at]), self.rank[self.merged(made, sym[after])], NONE)
        stop = np.flatnonzero(np.minimum(left, right) <= rank)
        if len(stop):
            bound = np.full(word[-1] + 1, len(sym))
            np.minimum.at(bound, word[at[stop]], at[stop])
            at = at[at <= bound[word[at]]]
        return at

    def _spelt(self, out: np.ndarray, codes: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols in `out` (-2: no symbol here), unknown characters as bytes."""
        here = np.flatnonzero(out != -2)
        ids, char = out[here], codes[here]
        strange = np.flatnonzero((ids < 0) | (ids >= len(self.pieces)))
        size = np.ones(len(ids), np.int64)
        if len(strange):
            spelt = char[strange].astype("<u4").tobytes().decode("utf-32-le").encode()
            data = np.frombuffer(spelt, np.uint8)
            head = np.flatnonzero((data & 0xC0) != 0x80)
            size[strange] = np.diff(np.append(head, len(data)))
            flat = np.repeat(ids, size)
            flat[ragged((np.cumsum(size) - size)[strange], size[strange])] = self.byte_id[data]
            ids = flat
        return np.bincount(word[here], weights=size, minlength=words).astype(np.int64), ids

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row of `counts` ids."""
        ends = np.cumsum(counts)
        spoken = np.cumsum(np.append(0, ~self.silent[ids]))
        row = np.repeat(np.arange(len(counts)), counts)
        first = ~self.silent[ids] & (spoken[:-1] == spoken[(ends - counts)[row]])
        strip = (first & self.leads[ids]).astype(np.int64)  # the blank before the text
        size = self.offsets[ids + 1] - self.offsets[ids] - strip
        data = self.bytes[ragged(self.offsets[ids] + strip, size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        return [data[a:z].decode(errors="skeinworks-each") for a, z in zip(total[ends - counts].tolist(), total[ends].tolist())]


codecs.register_error("skeinworks-each", lambda e: ("�", e.start + 1))


class Words(Splitter):
    """Cuts slices of texts, blanks replaced, into words that no merge crosses."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def bounds(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint32)
        marks = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[marks] = MARK
        start = np.append(True, self.merges.apart(codes))
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(codes))
        real = codes[begin] != MARK
        begin, end = begin[real], end[real]
        return joined, codes, begin, end, np.searchsorted(marks, begin)


_CUT_AT = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def _parts(text: str, merges: Merges) -> list[str]:
    """The text as the model sees it, in parts of about CUT characters where it can be cut."""
    if not text:
        return [""]
    text, out, at = BLANK + text.replace(" ", BLANK), [], 0
    while merges.parts and len(text) - at > CUT and (m := _CUT_AT.search(text, at + CUT - 1)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


_HERE: dict[str, tuple] = {}


def _tools(pieces: list) -> tuple[Words, WordIds, Merges]:
    """A worker's words, kept ids and merges, held between its tasks."""
    name = hashlib.sha1(repr(pieces).encode()).hexdigest()
    if name not in _HERE:
        merges = Merges(pieces)
        _HERE[name] = Words(merges), WordIds(merges.encode), merges
    return _HERE[name]


def encoded(tools: tuple[Words, WordIds, Merges], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, each with the end id, and each text's number of ids."""
    words, known, merges = tools
    parts = [_parts(t, merges) for t in texts]
    ids, counts = encode_slice(words, known, [p for part in parts for p in part])
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    of_text = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
    return np.insert(ids, np.cumsum(of_text), merges.end), of_text + 1


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of every text, with the end id."""
    reach_workers(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches):
        tools = _tools(pieces.value)
        for b in sliced(batches, text):
            ids, counts = encoded(tools, texts_of(b, text))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode(rows: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """key, text of each row's ids. Null ids: the empty text."""
    reach_workers(rows.sparkSession)
    pieces = rows.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches):
        merges = _tools(pieces.value)[2]
        for b in batches:
            lists = [np.asarray(x or [], np.int64) for x in b.column("ids").to_pylist()]
            texts = merges.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(key, "ids").mapInArrow(run, f"{key} long, text string")


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: key, n_tokens, ids_sha256 (of the decimal ids, joined by a
    blank), decoded_sha256 (of the decoded text). Only digests leave the task."""
    reach_workers(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches):
        tools = _tools(pieces.value)
        merges = tools[2]
        width = len(str(len(merges.pieces))) + 1
        digits = np.frombuffer("".join(f"{i} ".ljust(width, "\0") for i in range(len(merges.pieces))).encode(), np.uint8).reshape(-1, width)
        digit_len = (digits != 0).sum(1)
        for b in sliced(batches, text):
            ids, counts = encoded(tools, texts_of(b, text))
            chars = digits[ids].ravel()
            chars = chars[chars != 0].tobytes()
            total = np.concatenate([[0], np.cumsum(digit_len[ids])])
            ends = np.cumsum(counts)
            spans = zip(total[ends - counts].tolist(), total[ends].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(key), pa.array(counts), pa.array([hashlib.sha256(chars[x : y - 1]).hexdigest() for x, y in spans]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in merges.decode(ids, counts)]),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
