"""Tokenising, fingerprints, classifiers and deduplication of texts, against plain versions."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skeinworks.llm import bpe, huffman, langid, pretokens, quality, rlindex, simhash
from skeinworks.llm.components import components, local_stars
from skeinworks.session import shared_folder, table
from tests.conftest import SMALL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.load_ranks(RANKS)
MERGES = bpe.MergeTable(TOKENS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
PIECES = ["a", "it's", "'s", "'S", "'re", "''ll", " ", "  ", "\n", "\r\n", "\t", " 12", "3²", "½", "é", "漢字", "🙂", " ", " ", "\x1c", "\x85", "!!", "<|endoftext|>", "_", " the", "x'd", "'", "​", "\0"]


def test_bpe_equals_library():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["", "a" * 3000, " " * 700, "ab " * 500, "é" * 400]
    ids, counts = pretokens.encode_slice(pretokens.Splitter(), pretokens.WordIds(MERGES.encode, 50), texts)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    out, sizes = MERGES.decode(ids, counts)
    assert out.tobytes() == "".join(texts).encode() and sizes.sum() == len(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_bpe_any_text(texts):
    texts = [t.encode(errors="ignore").decode() for t in texts]
    ids, _ = pretokens.encode_slice(pretokens.Splitter(), pretokens.WordIds(MERGES.encode), texts or [""])
    assert ids.tolist() == [i for t in texts for i in TIKTOKEN.encode_ordinary(t)]


def test_bpe_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(pretokens, "CUT", 50)
    text = "some words  and\n more don't stop " * 20
    assert len(pretokens.pieces_of(text)) > 5
    ids, _ = pretokens.encode_slice(pretokens.Splitter(), pretokens.WordIds(MERGES.encode), [text])
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)


def thue_morse(k):
    """Two different words of 2**k letters whose polynomials modulo 2**64 are equal, for any odd base, from k = 11 on."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("k", [10, 11, 12])
def test_pre_tokens_of_one_hash(k):
    a, b = thue_morse(k)
    splitter = pretokens.Splitter()
    _, codes, begin, end, _ = splitter.bounds([a, b])
    assert k < 11 or len(set(splitter.hashes(codes, begin, end).tolist())) == 1
    want = [TIKTOKEN.encode_ordinary(t) for t in (a, b)]
    assert want[0] != want[1]
    words = pretokens.WordIds(MERGES.encode)
    for texts in ([a, b], [b], [a], [b, "x", b, a]):  # in one batch, and against what is kept
        ids, _ = pretokens.encode_slice(splitter, words, texts)
        assert ids.tolist() == [i for t in texts for i in TIKTOKEN.encode_ordinary(t)]


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "é漢", "0123", "=-_"])
def test_long_pre_tokens(letters):
    rnd = random.Random(7)
    for n in (255, 257, 300, 3000):
        word = "".join(rnd.choice(letters) for _ in range(n))
        size, ids = MERGES.encode([word.encode(), b"it"])
        assert ids.tolist() == TIKTOKEN.encode_ordinary(word) + TIKTOKEN.encode_ordinary("it") and size.sum() == len(ids)


def test_colliding_texts_in_queries(spark):
    texts = [*thue_morse(11), "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS).collect()}
    assert [got[k] for k in range(3)] == [TIKTOKEN.encode_ordinary(t) for t in texts]
    path = f"{shared_folder(spark)}/huffman-test-colliding"
    huffman.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(huffman.read(spark, path).collect(), key=lambda r: r.doc_id)
    assert [list(r.ids) for r in rows] == library_ids(texts)


def test_bpe_query(spark, odd):
    got = [r for r in bpe.digests(odd, RANKS).collect()]
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    want = TIKTOKEN.encode_ordinary("bonjour le monde entier")
    assert by[4].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    encoded = bpe.encode(odd, RANKS)
    assert {r.doc_id: r.ids for r in encoded.collect()}[4] == want
    assert {r.doc_id: bytes(r.text_bytes) for r in bpe.decode(encoded, RANKS).collect()}[0] == b"Hello there world of words"
    assert bpe.digests(odd.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("n, limit", [(0, 8), (1, 8), (2, 8), (50, 6), (300, 9), (4000, 14)])
def test_code_lengths(n, limit):
    counts = (np.random.default_rng(n).pareto(0.5, n) * 10 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max(initial=0) <= limit
    if n > 1:
        assert (2.0 ** -lengths).sum() == 1
        p = counts / counts.sum()
        assert (p * lengths).sum() < -(p * np.log2(p)).sum() + (1 if limit > np.log2(n) + 2 else 4)


def test_optimal_lengths():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (counts * huffman.code_lengths(counts, 20)).sum() == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=1200), max_size=5))
def test_huffman_blocks(rows):
    ids = np.array([i for r in rows for i in r], np.int64)
    counts = np.array([len(r) for r in rows], np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301))
    bits, sizes, offsets, _ = huffman.encode_bits(ids, counts, lengths, huffman.canonical_codes(lengths))
    keys, tokens, out = huffman.unpack_block(huffman.pack_block([None, *range(9)][: len(rows)], counts, sizes, offsets, bits), huffman.Decoder(lengths))
    assert out.tolist() == ids.tolist() and tokens.tolist() == counts.tolist() and keys == [None, *range(9)][: len(rows)]


def library_ids(texts):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_huffman_files(spark, odd):
    for name, docs in (("odd", odd), ("small", table(spark, SMALL, "documents")), ("none", odd.limit(0))):
        path = f"{shared_folder(spark)}/huffman-test-{name}"
        huffman.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        want = library_ids([r.text or "" for r in rows])
        got = sorted(huffman.read(spark, path, digest=True).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
        assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]


def test_huffman_added_tokens(spark):
    """Added tokens of the file inside texts, against the library as it comes."""
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x", f" it's{end}'s  {end}\n", "<|endoftext", f"<|{end}|>", "", None, "plain words", f"é{end}" * 300]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids + [0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert want[0] == [64, 50256, 65, 0]
    path = f"{shared_folder(spark)}/huffman-test-added"
    huffman.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(huffman.read(spark, path, digest=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(want)]
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]


def test_huffman_ranges(spark, monkeypatch):
    """Files ascend by id; an id and a null that many rows carry fill ranges of their own."""
    monkeypatch.setattr(huffman, "PART_IDS", 300)
    rows = [(k, f"text number {k}") for k in range(200)] + [(77, f"again {k}") for k in range(150)] + [(None, f"no id {k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"{shared_folder(spark)}/huffman-test-ranges"
    huffman.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(huffman.read(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == sorted((i is not None, i or 0, x) for (i, _), x in zip(rows, library_ids([t for _, t in rows])))
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("file", F.input_file_name())
    files = blocks.groupBy("file").agg(F.collect_set("part").alias("parts"), F.sum("tokens").alias("n")).orderBy("file").collect()
    assert [r.parts[0] for r in files] == sorted(r.parts[0] for r in files) and all(len(r.parts) == 1 for r in files)
    assert len(files) > 5 and max(r.n for r in files) < 900


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    fps = np.repeat(rng.integers(0, 2**63, 20, dtype=np.uint64), 10)
    for i in range(len(fps)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    want = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    i, j = simhash.links_between(fps, fps, radius)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))


@pytest.mark.parametrize("most", [3, 16, 17, 200])
def test_keys_share_planes(most):
    """Keys of every size, tiled or not, side by side in the planes: links stay within a key."""
    rng = np.random.default_rng(most)
    rows = []
    for key in range(60):
        base = rng.integers(0, 2**63)
        tiled = key % 3 == 0
        for _ in range(rng.integers(1, most + 1)):
            fp = int(base)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                fp ^= 1 << int(b)
            rows.append((fp - (fp >> 63 << 64), key % 10, key, 2 if tiled else 0, 5 if tiled else 0, int(rng.choice([2, 5])) if tiled else 0))
    batch = pd.DataFrame(rows, columns=["fp", "which", "value", "x", "y", "t"]).sample(frac=1, random_state=1)
    batch["node"] = batch.fp
    a, b = simhash.links_of_keys(batch)
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for name, (left, right) in (("got", (a, b)),):
        for x, y in zip(left.tolist(), right.tolist()):
            got[x].add(y), got[y].add(x)
    for _, part in batch.groupby(["which", "value"]):
        fps, t = part.fp.to_numpy(), part.t.to_numpy()
        near = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 3
        if part.x.iloc[0] != part.y.iloc[0]:
            near &= t[:, None] != t[None]
        root = local_stars(len(fps), *np.nonzero(near))
        for i, r in enumerate(root):
            want[int(fps[r])].add(int(fps[i]))
    reach = lambda links: {frozenset(c) for c in union(links) if len(c) > 1}
    assert reach(got) == reach(want)


def union(links):
    left, out = {k: set(v) | {k} for k, v in links.items()}, []
    for v in [x for v in links.values() for x in v]:
        left.setdefault(v, {v})
    while left:
        k, group = left.popitem()
        waiting = set(group)
        while waiting:
            x = waiting.pop()
            more = left.pop(x, set()) - group
            group |= more
            waiting |= more
            for y in [y for y, v in left.items() if x in v]:
                group |= left.pop(y)
                waiting |= group - {x}
        out.append(group)
    return out


@pytest.mark.parametrize("tile", [4096, 5])
def test_simhash_query(spark, odd, tile, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, tile))
    for docs in (odd, table(spark, SMALL, "documents")):
        rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect()
        fps = np.array([slow_fingerprint(r.text or "") for r in rows], np.uint64)
        root = local_stars(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3))
        least = {}
        for r, c in zip(rows, root):
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
        got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect())
        assert got == sorted((r.doc_id, int(f), least[c]) for r, f, c in zip(rows, fps, root))
    kept = simhash.keep(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def slow_wide(text, words=5):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] if len(parts) >= words else [" ".join(parts)] * bool(parts)
    bits = 0
    for k in range(simhash.NEAR_WIDTH):
        mixed = []
        for s in shingles:
            x = (xxhash.xxh64_intdigest(s.encode(), 42) + k * 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            mixed.append(x ^ x >> 31)
        bits |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)) << 64 * k
    return bits


def test_wide_fingerprints():
    rnd = random.Random(3)
    for n in (0, 1, 4, 5, 6, 300, 700):
        text = " ".join(rnd.choice(["Alpha", "beta", "gamma", "Δ", "e"]) for _ in range(n))
        assert int.from_bytes(simhash.wide_fingerprint(text).tobytes(), "little") == slow_wide(text)


@pytest.mark.parametrize("tile", [4096, 40])
def test_similar_texts(spark, tile, monkeypatch):
    """Edited copies that share 0.8 to 1 of their 5-word shingles meet; other texts do not."""
    monkeypatch.setattr(simhash.wide_links, "__defaults__", (simhash.NEAR_RADIUS, tile))
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    sets = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    rows, pairs = [], []
    for group in range(300):
        base = [rnd.choice(words) for _ in range(rnd.randint(150, 400))]
        edited = list(base)
        for _ in range(rnd.randint(1, len(base) // 45)):
            edited[rnd.randrange(len(edited))] = rnd.choice(words)
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(edited))]
        a, b = sets(base), sets(edited)
        pairs.append(len(a & b) / len(a | b))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert all(got[2 * g] == 2 * g and got[2 * g + 1] in (2 * g, 2 * g + 1) for g in range(300))
    near = [g for g in range(300) if pairs[g] >= 0.8]
    assert len(near) > 200 and sum(got[2 * g + 1] == 2 * g for g in near) / len(near) > 0.95
    assert sorted(r.doc_id for r in simhash.keep(docs).collect()) == sorted(i for i, c in got.items() if i == c)


def test_similar_texts_by_overlap(spark):
    """Planted pairs by their true overlap: 0.8 and more meet, clearly less stays apart."""
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows, pairs = [], []
    for group in range(1200):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 80, 200, 600]))]
        edited = list(base)
        for _ in range(max(1, int(len(base) * rnd.uniform(0.005, 0.07)))):
            edited[rnd.randrange(len(edited))] = f"e{rnd.randrange(10**6)}"
        a, b = " ".join(base), " ".join(edited)
        rows += [(2 * group, a), (2 * group + 1, b)]
        x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
        pairs.append(len(x & y) / len(x | y))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    share = lambda low, high: np.mean([got[2 * g + 1] == 2 * g for g, j in enumerate(pairs) if low <= j < high])
    assert share(0.8, 0.85) > 0.92 and share(0.85, 1.1) > 0.99
    assert share(0.6, 0.7) < 0.06 and share(0, 0.6) == 0


def test_simhash_hot_key(spark):
    """One key's fingerprints in tiles: a chain of single-bit steps stays one component."""
    base = 0x0123456789ABCDEF
    fps = [(base ^ (1 << b)) - (1 << 64) * ((base ^ (1 << b)) >> 63) for b in range(40)]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, 4), "a", "b")
    assert {r.component for r in found.collect()} == {min(fps)} and found.count() == 40


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(30)] + [(5, 5), (None, 3)]
    known = [(a, b) for a, b in pairs if a is not None]
    root = local_stars(200, np.array([a for a, _ in known]), np.array([b for _, b in known]))
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "x int, y int"), "x", "y").collect()}
    ends = {x for a, b in known if a != b for x in (a, b)}
    assert got == {x: root[x] for x in ends}
    assert components(spark.createDataFrame([], "x int, y int"), "x", "y").count() == 0


def test_quality(spark, odd, labels):
    docs, real = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.train(docs, real)
    scored = quality.score(docs, model).join(real.select("doc_id", "quality"), "doc_id").where(quality.held_out()).toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97
    assert scored[scored.quality == 1].predicted.mean() > 0.98
    got = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[2].score
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns
    assert quality.keep(odd.limit(0), labels.limit(0)).count() == 0
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def slow_trees(x, y, trees, depth, bins, rate):
    """Boosting one node, feature and cut at a time. Returns a function from a row to its score."""
    edges = [sorted(set(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for k in range(x.shape[1])]
    bin_of = lambda row, k: sum(e < row[k] for e in edges[k])
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, grown = np.log(share / (1 - share)), []

    def walk(node, row):
        while not isinstance(node, float):
            k, cut, low, high = node
            node = high if bin_of(row, k) > cut else low
        return node

    raw = [base] * len(y)
    for _ in range(trees):
        g = [1 / (1 + np.exp(-r)) - t for r, t in zip(raw, y)]
        h = [(1 / (1 + np.exp(-r))) * (1 - 1 / (1 + np.exp(-r))) for r in raw]

        def grow(rows, left, g=g, h=h):
            ga, ha = sum(g[i] for i in rows), sum(h[i] for i in rows)
            if not left:
                return float(-rate * ga / (ha + 1.0))
            best = (1e-6, None)
            for k in range(x.shape[1]):
                for cut in range(bins + 1):
                    low = [i for i in rows if bin_of(x[i], k) <= cut]
                    gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                    if hl < 1 or ha - hl < 1:
                        continue
                    gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (k, cut))
            if best[1] is None:
                return grow(rows, left - 1)  # all rows stay together down to the leaf
            k, cut = best[1]
            return k, cut, grow([i for i in rows if bin_of(x[i], k) <= cut], left - 1), grow([i for i in rows if bin_of(x[i], k) > cut], left - 1)

        tree = grow(list(range(len(y))), depth)
        grown.append(tree)
        raw = [r + walk(tree, row) for r, row in zip(raw, x)]
    return lambda row: 1 / (1 + np.exp(-base - sum(walk(t, row) for t in grown)))


@pytest.mark.parametrize("seed, depth", [(0, 1), (1, 2), (2, 3)])
def test_trees_equal_plain_ones(seed, depth):
    """Split finding, leaf values and the flattened walk, against nodes built one by one."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(160, 4)), 2)
    x[:, 2] = rng.integers(0, 3, 160)  # few values: bins of equal edges
    y = ((x[:, 0] + 0.5 * (x[:, 2] == 1) + rng.normal(size=160) * 0.3) > 0).astype(float)
    score = slow_trees(x, y, 4, depth, 8, 0.3)
    fresh = np.concatenate([x, np.round(rng.normal(size=(60, 4)), 2), [[-99.0] * 4, [99.0] * 4]])
    assert np.allclose(quality.fit(x, y, 4, depth, 8, 0.3).score(fresh), [score(row) for row in fresh], atol=1e-9)


def test_quality_statistics():
    """The statistics of a text, counted plainly."""
    text = "Ab CD 12, x. x. x\n\nAB!! é|%\nab"
    got = dict(zip(quality.STATISTICS, quality.statistics(text)))
    data, words = text.encode(), text.split()
    n, w = len(data), len(words)
    assert got["log_bytes"] == pytest.approx(np.log1p(n)) and got["upper"] == 5 / n and got["digits"] == 2 / n and got["lines"] == 3 / n and got["multibyte"] == 2 / n
    assert got["distinct_words"] == len(set(words)) / w and got["top_word"] == 2 / w and got["same_next"] == 1 / w and got["distinct_lines"] == 1
    assert got["caps_words"] == 2 / w and got["line_upper"] == pytest.approx(0.5) and got["bangs"] == 2 / n
    assert got["word_len"] == pytest.approx(np.mean([len(x.encode()) for x in words]))


def test_language(spark, odd):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    model = langid.train(odd)
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 5)] == ["und"] * 3 and rows[1].score == 0 and rows[3].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = langid.keep(odd)
    assert kept.columns == odd.columns and not {1, 2, 5} & {r.doc_id for r in kept.collect()}
    none = langid.train(odd.limit(0))
    assert none.predict(["abc"])[0] == ["und"]
    one = langid.train(odd.where("lang = 'en'"))
    assert one.predict(["abc", "1"])[0] == ["en", "und"]


def slow_shares(text):
    """Shares of hashed trigrams, one trigram at a time."""
    clean = b" " + b" ".join(text.lower().encode().translate(langid._LETTERS).split()) + b"  "
    x = np.zeros(langid.WIDTH)
    for k in range(len(clean) - 2):
        code = clean[k] << 16 | clean[k + 1] << 8 | clean[k + 2]
        x[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 13)] += 1
    return x / (len(clean) - 2)


def slow_machine(x, y, rounds=200, ridge=1e-4):
    """The machine of langid.linear_machine by its weights: one inner product a row."""
    each = [0.5 / (y > 0).sum() if v > 0 else 0.5 / (y < 0).sum() for v in y]
    scale = np.sqrt(np.mean([r @ r for r in x]))
    x = [r / scale for r in x]
    w, b = np.zeros(len(x[0])), 0.0
    vw, vb, step = w.copy(), b, 0.5 / (2 * sum(e * (r @ r + 1) for e, r in zip(each, x)) + ridge)
    for n in range(rounds):
        gw, gb = ridge * vw, 0.0
        for e, r, t in zip(each, x, y):
            slack = max(0.0, 1 - t * (r @ vw + vb))
            gw, gb = gw - 2 * e * t * slack * r, gb - 2 * e * t * slack
        nw, nb = vw - step * gw, vb - step * gb
        vw, vb = nw + n / (n + 3) * (nw - w), nb + n / (n + 3) * (nb - b)
        w, b = nw, nb
    margin = [t * (r @ w + b) for r, t in zip(x, y)]
    return w / scale, b, 3.0 / max(0.05, float(np.median(margin)))


def test_language_equals_plain_version():
    """Trigrams, machines, the family step and the vote, against a plain version of each."""
    rnd = random.Random(4)
    letters = {"de": "enirst", "nl": "enatrd", "en": "etaoin", "fr": "esaitn", "it": "eaionl", "xx": "qzjkvw"}
    word = lambda c: "".join(rnd.choice(letters[c] * 3 + "abcdefgh") for _ in range(rnd.randint(2, 8)))
    text = lambda c: " ".join(word(c) for _ in range(rnd.randint(5, 40))) + rnd.choice(["", " 12!", "\nÄé ß"])
    rows = [(text(c), c) for c in letters for _ in range(9)]
    langs = [c for _, c in rows]
    x = np.stack([slow_shares(t) for t, _ in rows])
    assert np.allclose(x, np.stack([langid.shares(t) for t, _ in rows]), atol=1e-6)
    model = langid.fit(x.astype(np.float32), langs)
    machines = []
    by = {f: sorted(c for c in letters if langid.family(c) == f) for f in sorted(set(map(langid.family, letters)))}
    for f in by:
        machines.append(slow_machine(x, np.array([1.0 if langid.family(c) == f else -1.0 for c in langs])))
    pairs = {}
    for f in by:
        for i, a in enumerate(by[f]):
            for b in by[f][i + 1 :]:
                rows_of = [k for k, c in enumerate(langs) if c in (a, b)]
                pairs[a, b] = len(machines)
                machines.append(slow_machine(x[rows_of], np.array([1.0 if langs[k] == a else -1.0 for k in rows_of])))
    for k, (w, b, scale) in enumerate(machines):
        assert np.allclose(model.weights[:, k], w, rtol=2e-2, atol=2e-2 * np.abs(w).max()) and model.bias[k] == pytest.approx(b, abs=2e-2) and model.scale[k] == pytest.approx(scale, rel=3e-2)

    def decide(t):
        p = [1 / (1 + np.exp(-np.clip((slow_shares(t) @ model.weights[:, k] + model.bias[k]) * model.scale[k], -30, 30))) for k in range(len(machines))]
        f, of = max(((f, p[k]) for k, f in enumerate(by)), key=lambda c: c[1])
        votes, least = {c: 0 for c in by[f]}, {c: 1.0 for c in by[f]}
        for (a, b), k in pairs.items():
            if a in votes:
                votes[a if p[k] >= 0.5 else b] += 1
                least[a], least[b] = min(least[a], p[k]), min(least[b], 1 - p[k])
        won = max(by[f], key=lambda c: (votes[c], least[c]))
        return won, of * least[won]

    fresh = [text(c) for c in letters for _ in range(12)] + ["a", "É"]
    got = model.predict(fresh)
    want = [decide(t) for t in fresh]
    assert got[0] == [w for w, _ in want] and np.allclose(got[1], [v for _, v in want], atol=1e-4)


def test_language_of_hot_id(spark):
    """An id with many rows leaves room for the other ids of its language and for others."""
    words = {"de": "der die das und ist nicht", "en": "the and of with this that", "fr": "le la les des une avec"}
    rows = [(k, f"{w} {k}", lang) for lang, w in words.items() for k in range(sum(map(ord, lang)) * 100, sum(map(ord, lang)) * 100 + 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out())
    hot = docs.where("lang = 'de'").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).first().doc_id
    docs = docs.union(spark.createDataFrame([(hot, f"der hund {k}", "de") for k in range(3000)], docs.schema))
    model = langid.train(docs, sample=90)
    assert model.predict(["the and of with this", "le la les des une", "der die das und"])[0] == ["en", "fr", "de"]


def test_more_languages_than_the_sample_is_for(spark):
    rows = [(k * 10 + i, chr(0x4E00 + k) * 9 + f" {i}", f"l{k:02d}") for k in range(70) for i in range(10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(map(len, model.languages.values())) == 70


def test_quality_of_hot_id(spark):
    """An id with many rows does not fill the sample."""
    free = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5]
    good, bad = "A plain sentence about the harbour and its ships. " * 4, "!!! 000 ### $$$ 111 " * 9
    rows = [(k, good if k % 2 else bad) for k in free]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in free], "doc_id long, quality int")
    hot = marks.orderBy(F.xxhash64("doc_id")).first().doc_id
    docs = docs.union(spark.createDataFrame([(hot, f"{dict(rows)[hot]} {k}") for k in range(1000)], "doc_id long, text string"))
    model = quality.train(docs, marks, sample=200)
    low, high = model.score(np.array([quality.statistics(t) for t in (bad, good)]))
    assert low < 0.3 and high > 0.7


def repeats(texts, length=200):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append([(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mark))])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_index_equals_counting(seed):
    rnd = random.Random(seed)
    length, letters = rnd.choice([5, 12, 40]), rnd.choice([b"ab", b"abcdefgh \0"])
    base = [bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 200))) for _ in range(6)]
    texts = sorted({b"".join(rnd.choice(base)[rnd.randint(0, 30) : rnd.randint(31, 200)] for _ in range(rnd.randint(1, 4))) for _ in range(12)} - {b""})
    got = [rlindex.removed_runs([a << 20 | z - a for a, z in runs]) for runs in rlindex.repeated_windows(texts, length)]
    assert got == repeats(texts, length)


def test_index_runs_spell_the_transform():
    texts = [b"banana band", b"bandana"]
    index = rlindex.RunLengthIndex(texts)
    assert index.run_lengths.sum() == index.n == sum(map(len, texts)) + 2 and index.runs < index.n


@pytest.mark.parametrize("seed", range(4))
def test_parts_keep_equal_windows_together(seed):
    """Every window of a fragment is in the part of each place of its anchor, and equal windows
    of different fragments are in parts of one name."""
    rnd = random.Random(seed)
    core = bytes(rnd.choice(b"abcdefghijklmnop \n") for _ in range(500))
    texts = [bytes(rnd.choice(b"abcxyz") for _ in range(rnd.randint(0, 90))) + core[rnd.randint(0, 120) : rnd.randint(330, 500)] + bytes(rnd.choice(b"abcxyz") for _ in range(90)) for _ in range(12)]
    names = collections.defaultdict(set)
    row, at, size, anchor, _ = rlindex.fragments(texts)
    for r, a, n, h in zip(row.tolist(), at.tolist(), size.tolist(), anchor.tolist()):
        covered = []
        for name, low, high in rlindex.parts_of(texts[r][a : a + n], h):
            for s in range(low, high - 200 + 1):
                covered.append(s)
                names[texts[r][a + s : a + s + 200]].add(name)
        assert sorted(covered) == list(range(n - 200 + 1))
    assert all(len(n) == 1 for n in names.values())


def odd_texts():
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    prose = lambda n: b" ".join(rnd.choice(words) for _ in range(n))
    p, q = prose(60), prose(120)
    texts = [prose(rnd.randint(1, 300)) for _ in range(20)] + [prose(20) + b" " + p[rnd.randint(0, 50) :] + b" " + prose(30) for _ in range(12)]
    texts += [q, q, q + b"x", b"", None, b"a" * 1000, b"ab" * 500, (p[:90] + b"\n") * 12, p[:199], p[:200], p[:200]]
    return texts + [texts[3][:100] + b"Z" + texts[3][101:]]


@pytest.mark.parametrize("hot, bucket", [(8000, 1 << 20), (3, 3000), (0, 3000)])
def test_removal_equals_counting(spark, hot, bucket, monkeypatch):
    monkeypatch.setattr(rlindex, "HOT", hot)
    monkeypatch.setattr(rlindex, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(rlindex, "PIECE", 700)
    texts = odd_texts()
    df = spark.createDataFrame([(k, t.decode() if t is not None else None, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int, extra string")
    got = {r.doc_id: r for r in rlindex.remove(df).collect()}
    for k, (t, runs) in enumerate(zip([t or b"" for t in texts], repeats([t or b"" for t in texts]))):
        rest = b"".join(t[a:z] for a, z in zip([0, *(z for _, z in runs)], [*(a for a, _ in runs), len(t)]))
        r = got[k]
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.extra) == (rest, len(t), len(t) - len(rest), len(runs), "x")


def test_removal_without_ids(spark):
    """Different texts without an id whose 32-bit hashes are equal; a real id of -1."""
    text = lambda k: "".join(hashlib.sha512(f"{k}{c}".encode()).hexdigest() for c in "abc")
    a, b = text(83668), text(243672)
    rows = [(None, a), (None, b), (1, a[:250] + "!"), (-1, b[100:] + "?"), (-1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.select(F.hash("text").alias("h")).where("doc_id IS NULL").distinct().count() == 1
    got = sorted((r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in rlindex.remove(docs).collect())
    assert got == sorted([(384, 250, a[250:]), (384, 284, b[:100]), (251, 250, "!"), (285, 284, "?"), (5, 0, "short")])


def test_removal_keeps_columns_and_characters(spark, odd):
    out = rlindex.deduplicate(odd)
    assert out.columns == odd.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[0] == "Hello there world of words" and rows[1] == "" and 3 not in rows and 6 not in rows
    assert rlindex.remove(odd.limit(0)).count() == 0
    words = ["é" + chr(0x4E00 + k) for k in range(150)]
    text = "a" + "".join(words)
    two = spark.createDataFrame([(1, text + "!"), (2, "ü" + text[1:] + "?")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in rlindex.deduplicate(two).collect()} == {1: "a!", 2: "ü?"}
