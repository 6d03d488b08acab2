"""A training-data pipeline over `documents`: filters, deduplication, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns documents with the same columns, but for the last, which returns packed pieces.

Odd rows: a null text counts as an empty one in every stage, and a row without an id takes
part like any other. Repeated rows are judged alike; the near-duplicate stage keeps one of
those equal in id and text. Very long texts are read whole. An empty table passes through.
Columns beyond those of documents are kept up to the last stage; names from `__` on are the
stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinworks.llm import langid, packing, quality, rlindex, simhash
from skeinworks.session import discard, settled, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees predict good; trained on the labels of documents still here.
    Empty and null texts are scored too; without any label all stay."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by a trusted prediction. Texts without a letter go."""
    return langid.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: texts that share
    about 0.8 of their five-word shingles or more, by 256-bit fingerprints. All texts without
    a word are copies of each other."""
    return simhash.keep(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat: every byte of a 200-byte string that also starts
    elsewhere. Documents left empty by that go; those that were empty before stay."""
    return rlindex.deduplicate(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of byte-level tokens, one for each UTF-8 byte and one at the end: which bin and
    offset each piece of a document has. Documents longer than a sequence are split."""
    return packing.pack(docs, F.octet_length("text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, language machines, fingerprints and best-fit have no SQL; tests/llm compares the
#: pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again before the next. What a stage
    stores on its way, and the stage before, are deleted once it is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = settled(lambda stage=stage, before=before: stage(spark, before, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
