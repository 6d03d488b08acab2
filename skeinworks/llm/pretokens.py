"""Vectorised pre-tokens of byte-level BPE: the matches of public_tokenizers.PATTERN.

A slice of texts becomes one array of code points. Runs of letters, numbers, white space and
other characters, with the rules on a leading blank and on contractions, give every match's
bounds without a regex engine. A 64-bit polynomial hash brings likely equal pre-tokens
together; their code points are then compared, so merges run once for each distinct pre-token
that a worker has not met yet, and two that only share a hash never share ids.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from skeinworks.llm.batches import ragged

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
#: Stands between texts; as the last code point it cannot occur in them.
MARK = 0x110000
#: The white space of the pattern's \s.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Odd base of the hash, invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Characters between the cuts of a long text.
CUT = 1 << 20
_CUT_AT = re.compile(r"(?<=\S) (?=\S)")


def _classes(top: int) -> np.ndarray:
    kinds = np.full(top + 1, OTHER, np.uint8)
    for c in range(top + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    for c in WHITE:
        if c <= top:
            kinds[c] = SPACE
    return kinds


def pieces_of(text: str) -> list[str]:
    """text cut where every pre-token rule has a bound: before a single blank between other
    characters. Short texts are one piece; a text without such a blank too."""
    if len(text) <= CUT:
        return [text]
    out, at = [], 0
    while len(text) - at > CUT and (m := _CUT_AT.search(text, at + CUT - 1)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Splitter:
    """Finds and hashes the pre-tokens of slices of texts."""

    def __init__(self) -> None:
        self.kinds = _classes(0x24FF)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            x = np.full(n, BASE, np.uint64)
            x[0] = 1
            self.powers = np.cumprod(x)
            x[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = np.cumprod(x)

    def bounds(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, their code points (MARK after every text), and for each
        pre-token its start, end and text number."""
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint32)
        marks = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[marks] = 0
        top = int(codes.max())
        if top >= len(self.kinds):
            self.kinds = _classes(min(0x10FFFF, max(top, 2 * len(self.kinds))))
        kind = self.kinds[codes]
        kind[marks] = EDGE
        codes[marks] = MARK
        n = len(codes)
        start = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        blank = codes == 0x20
        # The last white space before other characters stands alone, or leads them if a blank.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
        start[last] = True
        start[last + 1] = ~blank[last]
        start[marks] = True
        quote = np.flatnonzero(codes == 0x27)
        if len(quote):
            before = np.maximum(quote - 1, 0)
            first = (quote == 0) | ((kind[before] != OTHER) & ~blank[before])
            quote = quote[first & (quote + 1 < n)]
            one = codes[quote + 1]
            two = codes[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at] = True
                start[at + 1] = False
                start[np.minimum(at + size, n - 1)] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        real = kind[begin] != EDGE
        begin, end = begin[real], end[real]
        return joined, codes, begin, end, np.searchsorted(marks, begin)

    def hashes(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial over the code points of each span. Different spans may share it."""
        n = len(codes)
        self._grow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        out = (total[end] - total[begin]) * self.inverse[begin]
        return out ^ out >> np.uint64(31)


def differ(x: np.ndarray, x_at: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether span i of x and span i of y differ, for every i."""
    out = x_size != y_size
    some = np.flatnonzero(~out)
    size = x_size[some]
    odd = np.flatnonzero(x[ragged(x_at[some], size)] != y[ragged(y_at[some], size)])
    if len(odd):
        out[some[np.searchsorted(np.cumsum(size), odd, side="right")]] = True
    return out


class WordIds:
    """Ids of pre-tokens by hash, kept by a worker in flat arrays with the pre-tokens' code
    points. When it holds more than `most` pre-tokens or `points` code points, it forgets those
    that it has met once since it last did, and then ever more frequent ones, down to half of
    both; so frequent pre-tokens stay, and its memory is bounded."""

    def __init__(self, encode, most: int = 500_000, points: int = 1 << 23) -> None:
        self.encode, self.most, self.points = encode, most, points
        self.keys = np.zeros(0, np.uint64)  # ascending, with the slot of each
        self.slots = np.zeros(0, np.int32)
        # Columns by slot: where the ids and the code points start, and how many; slices met.
        self.columns = {"at": np.zeros(1024, np.int64), "size": np.zeros(1024, np.int32), "text_at": np.zeros(1024, np.int64), "text_size": np.zeros(1024, np.int32), "hits": np.zeros(1024, np.int32)}
        self.flat, self.text = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint32)
        self.held = self.used = self.text_used = 0

    def _forget(self) -> None:
        c = {n: x[: self.held] for n, x in self.columns.items()}
        least, points = 2, self.points // 2
        while (stay := c["hits"] >= least).sum() > self.most // 2 or c["text_size"][stay].sum() > points:
            least *= 2
        keep = np.flatnonzero(stay)
        size, text_size = c["size"][keep], c["text_size"][keep]
        self.flat = self.flat[ragged(c["at"][keep], size.astype(np.int64))]
        self.text = self.text[ragged(c["text_at"][keep], text_size.astype(np.int64))]
        self.columns = {"at": np.cumsum(size, dtype=np.int64) - size, "size": size, "text_at": np.cumsum(text_size, dtype=np.int64) - text_size, "text_size": text_size, "hits": np.ones(len(keep), np.int32)}
        old = np.flatnonzero(stay[self.slots])
        self.keys, self.slots = self.keys[old], (np.cumsum(stay) - 1).astype(np.int32)[self.slots[old]]
        self.held, self.used, self.text_used = len(keep), len(self.flat), len(self.text)

    def rows(self, keys: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, word_of) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the ascending distinct keys, each of the span of codes beside it, and
        whether the slot is another pre-token's. word_of(positions) gives the UTF-8 pre-tokens
        of those that are new."""
        if self.held > self.most or self.text_used > self.points:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        other = np.zeros(len(keys), bool)
        met, new = np.flatnonzero(known), np.flatnonzero(~known)
        slot = np.empty(len(keys), np.int64)
        slot[met] = self.slots[at[met]]
        other[met] = differ(codes, begin[met], length[met], self.text, self.columns["text_at"][slot[met]], self.columns["text_size"][slot[met]])
        if len(new):
            size, flat = self.encode(word_of(new))
            size, text_size = size.astype(np.int64), length[new]
            slot[new] = self.held + np.arange(len(new))
            self.flat = _with(self.flat, self.used, flat)
            self.text = _with(self.text, self.text_used, codes[ragged(begin[new], text_size)])
            fresh = {"at": self.used + np.cumsum(size) - size, "size": size, "text_at": self.text_used + np.cumsum(text_size) - text_size, "text_size": text_size, "hits": np.zeros(len(new))}
            self.columns = {n: _with(x, self.held, fresh[n]) for n, x in self.columns.items()}
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], slot[new])
            self.held, self.used, self.text_used = self.held + len(new), self.used + len(flat), self.text_used + int(text_size.sum())
        self.columns["hits"][slot] += 1
        return slot, other


def _with(held: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """held with values from place `used` on, grown where they do not fit."""
    if used + len(values) > len(held):
        held = np.concatenate([held[:used], np.zeros(max(used // 2, len(values)), held.dtype)])
    held[used : used + len(values)] = values
    return held


def encode_slice(splitter: Splitter, words: WordIds, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, and each text's number of ids."""
    parts = [pieces_of(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    joined, codes, begin, end, piece = splitter.bounds([p for part in parts for p in part])
    length = end - begin
    keys, first, inverse = np.unique(splitter.hashes(codes, begin, end), return_index=True, return_inverse=True)

    def word_of(which: np.ndarray) -> list[bytes]:
        return [joined[x:y].encode() for x, y in zip(begin[which].tolist(), end[which].tolist())]

    rows, other = words.rows(keys, codes, begin[first], length[first], lambda new: word_of(first[new]))
    same = first[inverse]
    odd = np.flatnonzero(other[inverse] | differ(codes, begin, length, codes, begin[same], length[same]))
    at, size, flat = words.columns["at"][rows][inverse], words.columns["size"][rows][inverse].astype(np.int64), words.flat
    if len(odd):  # pre-tokens that share a hash with a different one: encoded, not kept
        spelt: dict[bytes, int] = {}
        which = np.array([spelt.setdefault(w, len(spelt)) for w in word_of(odd)])
        own_size, own = words.encode(list(spelt))
        at[odd], size[odd] = (words.used + np.cumsum(own_size) - own_size)[which], own_size[which]
        flat = np.concatenate([flat[: words.used], own])
    return flat[ragged(at, size)], np.bincount(owner[piece], weights=size, minlength=len(texts)).astype(np.int64)
