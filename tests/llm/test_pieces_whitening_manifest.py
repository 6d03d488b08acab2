"""SentencePiece, whitening and the manifest, against the library, dense algebra and brute force."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skeinworks.llm import merkle, pieces, queries, whitening
from skeinworks.session import table
from tests.conftest import SMALL
from tests.llm.conftest import CLASHING

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MERGES = pieces.Merges(pieces.load_pieces(MODEL))
PARTS = ["a", "it's", " ", "  ", "   ", "\n", "\r\n", "\t", "12", "½", "é", "é", "漢字", "🙂", "\xa0", "▁", "▁▁", "!!", "<s>", "</s>", "<0x0A>", "====", "the", "\0", "　", "ﬁ", "qx", "       ", "\U0010ffff", "ing", "00000"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def compare(texts, most=2000):
    ids, counts = pieces.encoded((pieces.Words(MERGES), pieces.WordIds(MERGES.encode, most), MERGES), texts)
    ends = np.cumsum(counts)
    want = [LIBRARY.encode(t, add_eos=True) for t in texts]
    assert [ids[z - c : z].tolist() for z, c in zip(ends, counts)] == want
    assert MERGES.decode(ids, counts) == [LIBRARY.decode(w) for w in want]


def test_pieces_equal_library():
    rnd = random.Random(3)
    compare(["", " ", "▁", "\n", *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(1500))])
    words = [p.replace("▁", " ") for p, _, kind in MERGES.pieces if kind == pieces.NORMAL]
    compare(["".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(1500)], 50)


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "0123", "=-_", " ", "▁ ", "\n ", "漢字日本"])
def test_pieces_long_words(letters):
    rnd = random.Random(5)
    compare(["".join(rnd.choice(letters) for _ in range(n)) for n in (2, 7, 60, 700, 20000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_pieces_any_text(texts):
    compare([t.encode(errors="ignore").decode() for t in texts] or [""])


def test_pieces_cut_long_texts(monkeypatch):
    monkeypatch.setattr(pieces, "CUT", 50)
    text = "some words  and▁ more ▁ don't\n stop   " * 20
    assert len(pieces._parts(text, MERGES)) > 5
    compare([text, "x" * 200, " " * 200])


def test_pieces_decode_any_ids():
    rnd = random.Random(9)
    rows = [[rnd.randrange(3, 259) if rnd.random() < 0.7 else rnd.randrange(len(MERGES.pieces)) for _ in range(rnd.randint(0, 12))] for _ in range(2000)]
    assert MERGES.decode(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows])) == [LIBRARY.decode(r) for r in rows]


def test_pieces_query(spark, odd):
    for docs in (odd, table(spark, SMALL, "documents")):
        got = collections.Counter(tuple(r) for r in pieces.digests(docs, MODEL).collect())
        want = collections.Counter()
        for r in docs.collect():
            ids = LIBRARY.encode(r.text or "", add_eos=True)
            want[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))] += 1
        assert got == want
    assert pieces.digests(odd.limit(0), MODEL).count() == 0
    back = pieces.decode(pieces.encode(odd, MODEL), MODEL)
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert queries.op11_sentence_pieces(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pieces_refuses_other_models(tmp_path):
    data = open(MODEL, "rb").read()
    (tmp_path / "m").write_bytes(data + b"\x1a\x04\x12\x02ab")  # a map of characters
    with pytest.raises(ValueError):
        pieces.load_pieces(str(tmp_path / "m"))


# --- whitening ----------------------------------------------------------------------------


def dense(rows, dim):
    kept = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding is not None and len(r.embedding) == dim and None not in r.embedding]
    kept = [(i, v) for i, v in kept if np.isfinite(v).all()]
    x = np.stack([np.floor(1024 * v) + 100000 for _, v in kept])
    c = x - x.mean(0)
    _, s, right = np.linalg.svd(c, full_matrices=False)
    return [i for i, _ in kept], x, s**2 / len(x), right.T, c


def check_whitening(df, dim, width=whitening.WIDTH, vectors=True, close=1e-9):
    got = whitening.whiten(df, width=width).toPandas()
    ids, x, e, q, c = dense(df.collect(), dim)
    k = got.component.nunique()
    n, whole = len(x), x.astype(np.int64).astype(object)
    assert k == min(8, int((e > 1e-22 * e[0]).sum())) and len(got) == n * k and set(got.n) == {n}
    assert (got.groupby("component").explained.first() / (e[:k] / e.sum()) - 1).abs().max() < 1e-10
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    deviation = collections.Counter((i, int(v)) for i, v in zip(ids, ((n * whole - whole.sum(0)) ** 2).sum(1)))
    first = got[got.component == 1]
    assert collections.Counter(zip(first.vec_id.fillna(-1), first.deviation)) == collections.Counter({(-1 if i is None else i, v): m for (i, v), m in deviation.items()})
    if not vectors:
        return
    want = c @ q[:, :k] / np.sqrt(e[:k])
    place = {i: p for p, i in enumerate(ids) if ids.count(i) == 1}
    wide = got[got.vec_id.isin([i for i in place if i is not None])].pivot(index="vec_id", columns="component", values="whitened")
    mine, plain = wide.to_numpy(), want[[place[i] for i in wide.index]]
    assert np.abs(mine * np.sign((mine * plain).sum(0)) - plain).max() < close


@pytest.mark.parametrize("width", [1, 3, 8])
def test_whitening_equals_dense(spark, width):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(300, 12)) * np.logspace(0, -2, 12))]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [None] + [1.0] * 11), (903, [float("inf")] * 12), (904, [1.0]), (905, []), (906, [0.0] * 12), (7, rows[7][1]), (None, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit(1) for c in (*CLASHING, "x", "key", "component", "deviation")})
    check_whitening(df, 12, width)


@pytest.mark.parametrize("shape", ["few", "flat", "twice", "equal", "steep", "one"])
def test_whitening_of_odd_shapes(spark, shape):
    rng = np.random.default_rng(4)
    a = {
        "few": rng.normal(size=(5, 16)), "flat": np.hstack([rng.normal(size=(50, 3)), np.ones((50, 4))]), "twice": np.repeat(rng.normal(size=(60, 6)), 2, 1),
        "equal": np.vstack([np.eye(12), -np.eye(12)]) * 5, "steep": rng.normal(size=(100, 20)) * np.logspace(0, -4, 20) * 1000, "one": rng.normal(size=(40, 1)),
    }[shape]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(a)], "vec_id long, embedding array<double>")
    check_whitening(df, a.shape[1], vectors=shape != "equal")


def test_whitening_without_deviation(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [3.0, 3.0]) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], schema)).collect()


def test_whitening_query(spark):
    check_whitening(table(spark, SMALL, "embeddings"), len(table(spark, SMALL, "embeddings").first().embedding))
    assert queries.op12_lanczos_whitening(spark, SMALL).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# --- manifest -----------------------------------------------------------------------------


def leaf_of(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def built(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            path.append((nodes[i - 1] if i % 2 else "", nodes[i + 1] if i % 2 == 0 and i + 1 < len(nodes) else ""))
        at, nodes = [i // 2 for i in at], [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[x] = built([leaf_of(r) for r in by[x]])
    root, above = built([trees[x][0] for x in langs])
    for x, more in zip(langs, above):
        for r, path in zip(by[x], trees[x][1]):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now = leaf_of(r, int(tampered))
            for a, b in path + more:
                now = sha(a, now, b)
            yield (r.doc_id, leaf_of(r), trees[x][0], root, sha(*(s for p in path + more for s in p)), now, now == root)


def manifest_equals_brute(docs):
    got = merkle.manifest(docs)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute(docs.collect()))


def test_manifest(spark):
    manifest_equals_brute(table(spark, SMALL, "documents"))


@pytest.mark.parametrize("levels, digits", [(1, 2), (2, 2), (3, 2)])
def test_manifest_of_many_tiers(spark, monkeypatch, levels, digits):
    for name, value in (("LEVELS", levels), ("DIGITS", digits), ("BASE", 1 << levels), ("BLOCK", levels * digits)):
        monkeypatch.setattr(merkle, name, value)
    rows = [(k, f"l{k % 11 if k % 3 else 0}", None if k % 9 == 0 else k, f"t{k}", "s") for k in range(150)]
    manifest_equals_brute(spark.createDataFrame(rows, "doc_id long, lang string, n_chars long, text string, source string"))


def test_manifest_of_odd_rows(spark, odd):
    odd = odd.drop("n").withColumns({"source": F.when(F.col("doc_id") % 2 == 0, "web"), "n_chars": F.length("text").cast("long")})
    manifest_equals_brute(odd.withColumns({c: F.lit(1) for c in ("at", "hash", "node", "deep", "leaf", "root", "path", "above", "all", "n")}))
    copies = odd.where("doc_id = 0").crossJoin(spark.range(70)).drop("id")
    manifest_equals_brute(odd.unionByName(copies))
    manifest_equals_brute(odd.where("doc_id = 3"))
    assert merkle.manifest(odd.limit(0)).count() == 0


def test_manifest_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet' UNION ALL SELECT 5000 + i, 'x', NULL, NULL, CASE WHEN i = 1 THEN NULL ELSE i END FROM range(6) t(i)")
    want = con.execute(queries.OP13_SQL).df()
    docs = spark.createDataFrame(con.execute("SELECT * FROM documents").fetchall(), table(spark, SMALL, "documents").schema)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, merkle.manifest(docs).select(columns).collect())) == sorted(map(tuple, want[columns].itertuples(index=False)))
