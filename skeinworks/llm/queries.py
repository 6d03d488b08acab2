"""The registered queries of this package: each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinworks.llm import bpe, huffman, langid, merkle, packing, pieces, pq, quality, rabitq, rlindex, sharding, simhash, whitening
from skeinworks.session import shared_folder, table

def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; it is read on the driver and broadcast."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of text to a shard in op8.
SHARD_BYTES = 1 << 20


def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, against all rows."""
    return rabitq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_product_quantised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.9 or more, as components over all embeddings."""
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of byte-level tokens: a token for each UTF-8 byte, one at the end."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, F.octet_length("text"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public ranks, and its ids decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the components of those 3 or fewer bits apart."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by trees that never saw a held-out row's label."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by machines that never saw a held-out row."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents, up to SHARD_BYTES of text each."""
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op9_run_length_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start elsewhere too."""
    found = rlindex.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), form="kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as Huffman-coded blocks and read back."""
    path = f"{shared_folder(spark)}/huffman-{uuid.uuid4().hex}"
    huffman.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return huffman.read(spark, path, digest=True)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the public SentencePiece model, and its ids decoded again."""
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their eight strongest components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_nested_rollup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, root and proof, a seventh of them checked after tampering."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
nodes AS (
  SELECT d.depth, r.h >> (60 - d.depth) AS node, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
  FROM rows r, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY ALL),
fit AS (SELECT * FROM nodes WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1),
least AS (
  SELECT r.doc_id, r.h, r.n_bytes, min(f.depth) AS depth
  FROM rows r JOIN fit f ON (r.h >> (60 - f.depth)) = f.node GROUP BY ALL)
SELECT l.doc_id, CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(f.node), CAST(l.depth AS INTEGER), '0') END AS shard,
       CAST(l.depth AS INTEGER) AS depth, CAST(l.n_bytes AS BIGINT) AS n_bytes, CAST(f.shard_bytes AS BIGINT) AS shard_bytes,
       f.shard_rows, f.shard_bytes <= {SHARD_BYTES} AS fits
FROM least l JOIN fit f ON f.depth = l.depth AND f.node = (l.h >> (60 - l.depth))
"""

#: CRC-32 of the decimal id, bit by bit, as a bigint; null for null.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""


def _leaf_sql(n_chars: str) -> str:
    spelt = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(spelt)})"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} END AS altered FROM documents)),
nodes(lang, level, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops(level, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT l.lang, l.pos, o.level, o.h, (l.pos >> o.level) & 1 AS after FROM leaves l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.pos = xor(l.pos >> o.level, 1)
  UNION ALL SELECT l.lang, l.pos, 100 + o.level, o.h, (s.pos >> o.level) & 1 FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops o ON o.pos = xor(s.pos >> o.level, 1)),
-- Levels at which a node stands alone have no other; they still hash once.
sizes AS (
  SELECT s.lang, s.pos AS lang_at, (SELECT max(level) FROM nodes n WHERE n.lang IS NOT DISTINCT FROM s.lang) AS deep, (SELECT max(level) FROM tops) AS high FROM subroots s),
paths AS (
  SELECT l.lang, l.pos, list_transform(range(z.deep + z.high), lambda k: CASE WHEN k < z.deep THEN k ELSE 100 + k - z.deep END) AS levels,
    coalesce((SELECT map(list(level), list({{'h': h, 'after': after}})) FROM steps s WHERE s.lang IS NOT DISTINCT FROM l.lang AND s.pos = l.pos), MAP {{}}) AS others
  FROM leaves l JOIN sizes z ON z.lang IS NOT DISTINCT FROM l.lang),
folded AS (
  SELECT l.doc_id, l.leaf, l.lang, sha256(coalesce(list_aggregate(list_transform(list_filter(levels, lambda k: others[k] IS NOT NULL), lambda k: others[k].h), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(list_prepend({{'h': coalesce(l.altered, l.leaf), 'after': 0::BIGINT}}, list_transform(levels, lambda k: coalesce(others[k], {{'h': '', 'after': 0::BIGINT}}))),
      lambda a, b: {{'h': sha256(CASE WHEN b.after = 1 THEN b.h || a.h ELSE a.h || b.h END), 'after': 0::BIGINT}}).h AS folded_root
  FROM leaves l JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos)
SELECT f.doc_id, f.leaf, s.subroot, t.h AS root, f.proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang, tops t WHERE t.n = 1
"""

QUERIES = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op3_product_quantised_duplicates": op3_product_quantised_duplicates,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_quality_trees": op6_quality_trees,
    "op7_language_families": op7_language_families,
    "op8_extendible_sharding": op8_extendible_sharding,
    "op9_run_length_deduplication": op9_run_length_deduplication,
    "op10_huffman_ids": op10_huffman_ids,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_lanczos_whitening": op12_lanczos_whitening,
    "op13_nested_rollup_manifest": op13_nested_rollup_manifest,
}

ORACLES = {"op8_extendible_sharding": OP8_SQL, "op13_nested_rollup_manifest": OP13_SQL}
