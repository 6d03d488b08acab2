"""Neighbours, near-duplicate vectors, packing, sharding and the pipeline, against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinworks.llm import packing, pq, queries, rabitq, sharding, simhash
from skeinworks.llm.components import local_stars
from skeinworks.session import table
from tests.conftest import SF, SMALL


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = [base[k % 40] + rng.normal(size=16) * rng.uniform(0.02, 0.25) for k in range(200)]
    rows = [(k, [float(np.float32(v)) for v in x], k % 3) for k, x in enumerate([*base, *near])]
    rows += [(1000 + k, rows[5][1], 0) for k in range(60)] + [(2000, [2 * v for v in rows[5][1]], 0), (7, rows[7][1], 0)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [float("inf")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1), (3005, [1.0], 1), (3006, [], 1), (3020, None, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).withColumns({"n": F.lit(1), "x": F.lit("y"), "code": F.lit(2)})


def usable(rows):
    ok = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows if r.embedding and len(r.embedding) == 16 and None not in r.embedding]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    return np.array([i for i, _ in ok]), np.stack([v for _, v in ok])


@pytest.mark.parametrize("row_block, query_block", [(16384, 2048), (90, 7)])
def test_neighbours(spark, vectors, row_block, query_block, monkeypatch):
    monkeypatch.setattr(rabitq, "ROW_BLOCK", row_block)
    monkeypatch.setattr(rabitq, "LEAST_BLOCK", row_block)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", query_block)
    ids, x = usable(vectors.collect())
    got = {}
    for r in rabitq.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        other = ids != ids[q]
        best = np.lexsort((ids, -score))
        best = best[other[best]][:20]
        mine = got[ids[q]]
        assert len(mine) == 20 and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        assert all(any(abs(s - v) < 1e-9 for v in score[ids == i]) for i, s in mine)
        hit += len({i for i, _ in mine} & set(ids[best].tolist()))
        total += 20
    assert hit / total >= 0.98
    assert not {3000, 3020} & set(got)


def test_neighbours_few(spark, vectors):
    few = vectors.where("vec_id IN (0, 3, 9)")
    assert [(r.query_id, r.rank) for r in rabitq.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert rabitq.search(vectors.limit(0), F.lit(True)).count() == 0
    assert rabitq.search(vectors.where("vec_id >= 3000"), F.lit(True)).where("query_id >= 3007").count() == 0


def test_repeated_queries(spark):
    """Copies of a query are one query; another vector of its id is a query of its own."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(101, 8)).tolist()
    rows = [(k, v) for k, v in enumerate(x)]
    ids, known = np.array([i for i, _ in rows]), np.array([v for _, v in rows])

    def best(v, own):
        score = np.where(ids == own, -np.inf, known @ np.array(v))
        return np.lexsort((ids, -score))[:20].tolist()

    def found(more):
        got = {}
        for r in rabitq.search(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 20 == 0).collect():
            got.setdefault((r.query_id, r.rank), []).append(r.vec_id)
        return got

    twice = found([rows[20]] * 3)
    assert all(len(v) == 1 for v in twice.values())
    assert [twice[20, k][0] for k in range(1, 21)] == best(x[20], 20)
    other = rng.normal(size=8).tolist()
    both = found([(20, other)])
    assert sorted(v for k in range(1, 21) for v in both[20, k]) == sorted(best(x[20], 20) + best(other, 20))


def test_recall_on_embeddings(spark):
    rows = table(spark, SF, "embeddings")
    ids, x = (lambda p: (p.vec_id.to_numpy(), np.stack(p.embedding).astype(np.float64)))(rows.toPandas())
    got = rabitq.search(rows, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.where(ids == ids[q], -np.inf, x @ x[q])
        hit += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.95


@pytest.mark.parametrize("tile", [4096, 30])
def test_near_duplicate_vectors(spark, vectors, tile, monkeypatch):
    monkeypatch.setattr(pq, "TILE", tile)
    rows = vectors.collect()
    ids, x = usable(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = local_stars(len(ids), *np.nonzero(link))
    least = {}
    for i, c in zip(ids.tolist(), root):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, int(n), least[c]) for i, n, c in zip(ids.tolist(), link.sum(1), root))
    out = pq.near_duplicates(vectors).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id in set(ids.tolist()))
    same = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want) and same / len(want) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in out) and len(out) == len(rows)
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in out if r.vec_id >= 3000)
    assert pq.near_duplicates(vectors.limit(0)).count() == 0


def test_near_duplicates_without_id(spark):
    rows = [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.01]), (None, None)]
    got = pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, None, True)] * 3 + [(0, 1, 0, True), (3, 1, 0, False)], key=str)


@pytest.mark.parametrize("tile", [4096, 150])
def test_near_duplicates_of_uneven_spread(spark, tile, monkeypatch):
    """Vectors that vary in few directions, along which lists part: no link may be lost."""
    monkeypatch.setattr(pq, "TILE", tile)
    x = np.random.default_rng(4).normal(size=(3000, 64)) / np.arange(1, 65)
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = local_stars(len(x), *np.nonzero(link))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pq.near_duplicates(rows).collect())
    assert link.sum() > 10_000 and got == [(k, int(n), int(c)) for k, (n, c) in enumerate(zip(link.sum(1), root))]


def test_number_of_lists():
    """Clusters get many lists; directions without any get few."""
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    reach = np.sqrt(0.2)
    even = unit(rng.normal(size=(4000, 48)))
    grouped = unit(unit(rng.normal(size=(300, 48)))[rng.integers(0, 300, 4000)] + 0.02 * rng.normal(size=(4000, 48)))
    assert pq.number_of_lists(even, 200_000, reach) == pq.LISTS < pq.number_of_lists(grouped, 200_000, reach)
    assert pq.number_of_lists(grouped, 5000, reach) == pq.LISTS and pq.number_of_lists(even[:1], 1, reach) == pq.LISTS


def slow_packing(lengths, capacities, opening):
    bins, where = [], []
    for k, n in enumerate(lengths):
        fits = [(c - sum(b), i) for i, (c, b) in enumerate(bins) if c - sum(b) >= n]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((opening(k), []))
        bins[i][1].append(n)
        where.append(i)
    return where, [min(c for c in capacities if c >= sum(b)) for _, b in bins]


def slow_opening(lengths, k, capacities, cost):
    """Fill each bin that could open by walking all later pieces, and take the cheapest a token."""
    prices = []
    for c in capacities:
        if c >= lengths[k]:
            used = lengths[k]
            for n in lengths[k + 1 :]:
                used += n if used + n <= c else 0
            prices.append((cost(min(x for x in capacities if x >= used)) / used, c))
    return min(prices)[1]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rnd = random.Random(seed)
    capacities = [16, 32, 64, 128]
    cost = lambda c: c + c * c / 500 + 4
    lengths = sorted((min(128, int(rnd.paretovariate(0.6))) for _ in range(200)), reverse=True)
    rules = [lambda k: slow_opening(lengths, k, capacities, cost), *(lambda k, least=c: min(x for x in capacities if x >= max(least, lengths[k])) for c in capacities)]
    want = [slow_packing(lengths, capacities, rule) for rule in rules]
    where, offsets, sizes = packing.best_fit(lengths, capacities, cost)
    assert (where, sizes) == min(want, key=lambda w: sum(map(cost, w[1])))
    used = [0] * len(sizes)
    for b, o, n in zip(where, offsets, lengths):
        assert o == used[b]
        used[b] += n
    assert all(u <= c for u, c in zip(used, sizes))


def test_lengths_compete():
    """Pieces that fill short sequences get short ones; pieces that would leave them half
    empty get the length where they fit; one length alone costs more than the choice."""
    total = lambda sizes: sum(map(packing.sequence_cost, sizes))
    assert set(packing.best_fit([2048] * 40)[2]) == {2048}
    assert set(packing.best_fit([2730] * 36)[2]) == {8192}
    mixed = [2730] * 36 + [2048] * 40
    chosen = packing.best_fit(mixed)[2]
    assert set(chosen) == {2048, 8192}
    for alone in packing.CAPACITIES:
        fixed = packing._packed(mixed, list(packing.CAPACITIES), lambda k: next(c for c in packing.CAPACITIES if c >= max(alone, mixed[k])))[2]
        assert total(chosen) < total(fixed)


@pytest.mark.parametrize("group", [8192, 4])
def test_packing(spark, odd, group):
    got = packing.pack(odd, F.octet_length("text"), group_pieces=group).toPandas()
    size = {None: 0}
    for r in odd.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n + 1
    assert got[got.doc_id.notna()].groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in size.items() if k is not None}
    each = got.groupby("bin")
    assert (each.n_tokens.sum() == each.bin_used.first()).all() and (each.bin_used.first() <= each.bin_capacity.first()).all()
    assert got.n_tokens.max() <= 32768 and got[got.doc_id == 3].part.max() == 6
    for _, b in each:
        b = b.sort_values("bin_offset")
        assert (b.bin_offset.to_numpy() == np.cumsum(b.n_tokens) - b.n_tokens).all()
    assert packing.pack(odd.limit(0), F.octet_length("text")).count() == 0


@pytest.mark.parametrize("limit", [1, 60, 10_000, 10**9])
def test_shards(spark, odd, limit):
    got = sharding.assign(odd, limit).toPandas()
    assert len(got) == odd.count()
    total, rows = got.groupby("shard").n_bytes.sum(), got.groupby("shard").size()
    assert (got.shard.map(total) == got.shard_bytes).all() and (got.shard.map(rows) == got.shard_rows).all()
    assert ((got.shard_bytes <= limit) == got.fits).all() and (got[~got.fits].shard_rows == 1).all()
    plain = sorted(s for s in set(got.shard) if "+" not in s)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]))
    assert sharding.assign(odd.limit(0), limit).count() == 0


def test_copies_of_one_row_part(spark):
    same = spark.createDataFrame([(1, "x" * 10)] * 50 + [(2, "y" * 10)], "doc_id long, text string").repartition(3)
    got = sharding.assign(same, 35).toPandas()
    assert got.fits.all() and (got.groupby("shard").n_bytes.sum() <= 35).all() and len(got) == 51


def test_deep_splits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLACK_BITS", 1)
    docs = table(spark, SMALL, "documents")
    a = sharding.assign(docs, 3000).toPandas().sort_values("doc_id")
    monkeypatch.undo()
    b = sharding.assign(docs, 3000).toPandas().sort_values("doc_id")
    assert a.shard.tolist() == b.shard.tolist()


def test_sharding_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.OP8_SQL).df()
    got = queries.op8_extendible_sharding(spark, SF).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].to_numpy())) == sorted(map(tuple, want[cols].to_numpy()))


def test_written_shards(spark, odd, tmp_path):
    sharding.write(odd, str(tmp_path / "s"), 10_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_written_shards_fit(spark, tmp_path):
    """Repeated and null keys: different texts, and copies of one row."""
    rows = [(1, f"{k:020d}") for k in range(60)] + [(None, f"{k:020d}") for k in range(60)] + [(2, "x" * 20)] * 40 + [(None, "y" * 20)] * 40
    sharding.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "s"), 100)
    shards = {d: spark.read.parquet(str(d)).collect() for d in (tmp_path / "s").glob("shard=*")}
    assert all(sum(len(r.text) for r in found) <= 100 for found in shards.values())
    name = lambda r: (r[0] or 0, r[1])
    assert sorted(map(name, rows)) == sorted(name(r) for found in shards.values() for r in found)


def test_pipeline(spark, odd, labels, tmp_path):
    """Each stage against a plain version of its rule, on whole small tables."""
    from skeinworks.llm import langid, quality
    from tests.llm.test_texts import repeats

    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    rows = docs.toPandas()
    good = rows[model.score(np.array([quality.statistics(t) for t in rows.text])) >= quality.THRESHOLD]
    stage = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(good.doc_id)
    lang, sure = langid.train(stage).predict(good.text.tolist())
    known = good[(np.array(lang) != "und") & (sure >= langid.TRUSTED)]
    stage = corpus_pipeline.language_id(spark, stage, SF)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(known.doc_id)
    known = known.sort_values("doc_id")
    fps = [int.from_bytes(simhash.wide_fingerprint(t).tobytes(), "little") for t in known.text]  # test_wide_fingerprints has the slow form
    differ = np.array([[(x ^ y).bit_count() for y in fps] for x in fps])
    keys = [simhash.wide_fingerprint_and_keys(t)[1] for t in known.text]
    keys = np.array([k if len(k) else np.full(simhash.NEAR_KEYS, -1 - n) for n, k in enumerate(keys)])
    meet = (keys[:, None] == keys[None]).any(2) | (differ == 0)
    root = local_stars(len(fps), *np.nonzero(meet & (differ <= simhash.NEAR_RADIUS)))
    one = known[root == np.arange(len(known))]
    stage = spark.createDataFrame(known[docs.columns])
    stage = corpus_pipeline.simhash_near_dedup(spark, stage, SF)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(one.doc_id)
    data = [t.encode() for t in one.text]
    rest = {i: b"".join(t[a:z] for a, z in zip([0, *(z for _, z in runs)], [*(a for a, _ in runs), len(t)])).decode(errors="ignore") for i, t, runs in zip(one.doc_id, data, repeats(data))}
    stage = corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(one[docs.columns]), SF)
    assert {r.doc_id: r.text for r in stage.collect()} == {i: t for i, t in rest.items() if t}
    packed = corpus_pipeline.best_fit_packing(spark, stage, SF).toPandas()
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(t.encode()) + 1 for i, t in rest.items() if t}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_pipeline_on_odd_rows(spark, odd, labels, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 1").count() == 0
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0
