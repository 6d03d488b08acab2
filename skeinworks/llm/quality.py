"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, in one vectorised pass over their bytes. Trees are fitted
on the driver from a bounded sample of labelled rows (`SAMPLE`), each level from histograms
of gradients over quantile bins, and flattened into arrays; a batch of documents walks all
trees at once by array indexing.

Defined results
* null text: scored as the empty text. Very long texts: whole. Repeated rows: each scored.
* no labels, or labels of one kind only: that share of ones is every score, 0.5 without any.
* labels null or other than 0 and 1: not learnt. Several labels of one id: the least counts.
* ties: of splits of equal gain the first statistic's lowest cut; a value on a bin's edge
  belongs below it; a score on the threshold is good.
* empty table: no rows. Extra columns are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skeinworks.llm.batches import sliced, texts_of
from skeinworks.session import reach_workers

#: Labelled rows that training sees at most, chosen by a hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 1.0
#: Score from which a document is predicted good.
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "upper", "lower", "digits", "blanks", "lines", "multibyte", "stops", "commas", "bars", "bangs", "at_signs", "markup", "symbols",
    "word_len", "word_len_sd", "distinct_words", "top_word", "same_next", "distinct_lines", "squeezed", "caps_words", "marked_words", "line_upper", "line_marked", "long_words",
)

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = [ord(c) for c in "#$%&*+/=^_~\\`"]


def statistics(text: str) -> list[float]:
    """The values named by STATISTICS."""
    data = text.encode()
    n = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    _, each = np.unique(codes, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    caps = marked = 0
    for x in words:
        caps += x.isupper()
        marked += not (x[-1:].isalnum() or x[-1] >= 128 or x[-1:] in b".,;:")
    line_caps = [sum(map(bytes.isupper, p)) / len(p) for x in lines if (p := x.split())]
    line_marks = [sum(x.count(c) for c in (b"%", b"$", b"#", b"*", b"&", b"!", b"|")) / len(x) for x in lines]
    return [
        np.log1p(len(data)), upper / n, lower / n, count[_DIGIT].sum() / n, count[32] / n, count[10] / n, count[128:].sum() / n, count[46] / n, count[44] / n, count[124] / n,
        count[33] / n, count[64] / n, (count[60] + count[62] + count[123] + count[125]) / n, count[_SYMBOLS].sum() / n,
        sizes.mean(), sizes.std(), len(each) / w, (each.max() if len(each) else 0) / w, float((codes[1:] == codes[:-1]).sum()) / w, len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(data, 1)) / n, caps / w, marked / w, max(line_caps, default=0.0), max(line_marks, default=0.0), float((sizes > 24).sum()) / w,
    ]


def statistics_of(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The named columns, and `stats`, an array of doubles."""
    reach_workers(docs.sparkSession)

    def run(batches):
        for b in sliced(batches, text):
            stats = [statistics(t) for t in texts_of(b, text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", stats array<double>"
    return docs.select(*keep, text).mapInArrow(run, schema)


@dataclass
class Trees:
    """All trees, flattened: node i of tree t goes left if its feature's bin is at most cut."""

    edges: list[np.ndarray]
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            bins, row = self.binned(x), np.arange(len(x))[:, None]
            tree = np.arange(len(self.feature))[None]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            while True:
                node = 2 * node + 1 + (bins[row, self.feature[tree, node]] > self.cut[tree, node])
                if node[0, 0] >= self.feature.shape[1]:
                    break
            total += self.leaf[tree, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Log-loss boosting of complete trees of one depth."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) and 0 < y.sum() < len(y) else (float(y.mean()) if len(y) else 0.5)
    base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    inner, none = (1 << depth) - 1, np.zeros((0, 0), np.int64)
    if not len(y) or not 0 < y.sum() < len(y):
        return Trees([], none, none, none, base)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Trees(edges, none, none, none, base)
    binned, width = model.binned(x), bins + 1
    columns = np.arange(x.shape[1])
    raw = np.full(len(y), base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), width, np.int64), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            many = 1 << level
            slot = ((node[:, None] * x.shape[1] + columns) * width + binned).ravel()
            shape = (many, x.shape[1], width)
            gs = np.bincount(slot, np.repeat(g, x.shape[1]), many * x.shape[1] * width).reshape(shape).cumsum(2)
            hs = np.bincount(slot, np.repeat(h, x.shape[1]), many * x.shape[1] * width).reshape(shape).cumsum(2)
            ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hs < 1) | (ha - hs < 1)] = 0
            best = gain.reshape(many, -1).argmax(1)
            won = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            at = many - 1 + np.arange(many)
            feature[t, at], cut[t, at] = np.where(won, best // width, 0), np.where(won, best % width, width)
            right = binned[np.arange(len(y)), feature[t, many - 1 + node]] > cut[t, many - 1 + node]
            node = 2 * node + right
        gl, hl = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = -rate * gl / (hl + RIDGE)
        raw += leaf[t, node]
    return Trees(edges, feature, cut, leaf, base)


def held_out(key: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows whose crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from up to `sample` labelled rows, held-out rows left aside."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key).agg(F.min(label).cast("double").alias("__y"))
        .orderBy(F.xxhash64(key), key).limit(sample)
    )
    # The sample is bounded by its parameter: at most `sample` pairs of an id and a label.
    # Only ids of labels are used. An id that many rows carry counts once, with its text of
    # least hash.
    each = docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key, "__y").agg(F.min_by(text, F.xxhash64(text)).alias(text))
    rows = statistics_of(each, [key, "__y"], text).orderBy(F.xxhash64(key), key).limit(sample)
    got = rows.select("__y", "stats").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit(np.stack(got["stats"].tolist()), got["__y"].to_numpy())


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (0 to 1, higher: good likelier) and predicted (1 from the threshold on)."""
    return scored(docs.select(key, text), model, text).select(key, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def scored(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """docs with all columns, and the score. A column of that name is replaced."""
    reach_workers(docs.sparkSession)
    docs = docs.drop(name)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches, text):
            stats = np.array([statistics(t) for t in texts_of(b, text)], np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known.value.score(stats))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted good, with docs' columns."""
    return scored(docs, train(docs, labels, key, text), text, "__quality").where(F.col("__quality") >= threshold).drop("__quality")
