"""Language identification by families.

Hashed byte trigrams of the whole text, as shares, are the features. Linear support vector
machines choose the family first, one against the rest; within the family, machines of every
pair of languages vote. A text's margin is the mean weight of its trigrams, so all machines
are read in one pass of array look-ups, whatever the length.

Training sees up to `SAMPLE` ids, as many of each language, chosen by a hash of the id; their
trigram shares come to the driver. With more than `LANGUAGES` languages the sample grows, so
that every language is learnt from SAMPLE / LANGUAGES ids.

Defined results
* null text or no letter: `und`, score 0. Very long texts: whole. Repeated rows: each.
* one learned language: every text with a letter has it. None: `und`.
* ties: the first family, and the first language of those with equal votes and equal least
  probability, in the order of their names.
* empty table: no rows. Extra columns are ignored by `predict` and kept by `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from skeinworks.llm.batches import sliced, texts_of
from skeinworks.session import reach_workers

#: Ids that training sees at most, for up to so many languages; for more it grows with them.
SAMPLE, LANGUAGES = 2000, 64
#: Hash values of trigrams.
WIDTH = 1 << 13
#: Scores below this are no prediction that `keep` trusts.
TRUSTED = 0.3

#: Families of languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "semitic": "am ar he mt ti",
    "indic": "as bn gu hi mr ne or pa sd si ur",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Bytes other than ASCII letters and those of longer characters part words.
_LETTERS = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"other-{lang}")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash values of all trigrams of all texts in turn, and each text's number of them."""
    clean = [b" " + b" ".join(t.lower().encode().translate(_LETTERS).split()) + b"  " for t in texts]
    data = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(c) for c in clean])
    code = np.zeros(len(data), np.uint32)
    code[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    slot = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - WIDTH.bit_length() + 1)
    return slot.astype(np.int64), np.array([len(c) - 2 for c in clean], np.int64)


def shares(text: str) -> np.ndarray:
    slot, count = trigrams([text])
    return np.bincount(slot, minlength=WIDTH).astype(np.float32) / count[0]


def linear_machine(k: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Row factors, bias and the scale of a logistic link, of a squared-hinge machine for y
    in (-1, 1), both kinds weighing the same, by accelerated gradient steps. The weights are
    the rows' sum by their factors; k holds the rows' inner products."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    norm = float(np.trace(k) / len(y)) or 1.0
    k = (k / norm).astype(np.float32)
    a, b = np.zeros(len(y)), 0.0
    va, vb, step = a.copy(), b, 0.5 / (2 * float((each * (np.diag(k) + 1)).sum()) + ridge)
    for n in range(rounds):
        slack = np.maximum(0, 1 - y * (k @ va.astype(np.float32) + vb))
        g = -2 * each * y * slack
        na, nb = va - step * (g + ridge * va), vb - step * g.sum()
        va, vb = na + n / (n + 3) * (na - a), nb + n / (n + 3) * (nb - b)
        a, b = na, nb
    margin = y * (k @ a.astype(np.float32) + b)
    return a / norm, b, 3.0 / max(0.05, float(np.median(margin)))


@dataclass
class Model:
    """Columns of `weights` are machines: families first, then pairs within families."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], int]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, sure = ["und"] * len(texts), np.zeros(len(texts))
        some = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not some or not self.families:
            return lang, sure
        slot, count = trigrams([texts[k] for k in some])
        begin = np.cumsum(count) - count
        m = np.add.reduceat(self.weights[slot], begin, axis=0) / count[:, None] if self.weights.shape[1] else np.zeros((len(some), 0))
        p = 1 / (1 + np.exp(-np.clip((m + self.bias) * self.scale, -30, 30)))
        for row, k in enumerate(some):
            f, of = 0, 1.0
            if len(self.families) > 1:
                f = int(p[row, : len(self.families)].argmax())
                of = p[row, f]
            best = self.languages[self.families[f]]
            votes = dict.fromkeys(best, 0)
            least = dict.fromkeys(best, 1.0)
            for a, b in combinations(best, 2):
                x = p[row, self.pairs[a, b]]
                votes[a if x >= 0.5 else b] += 1
                least[a], least[b] = min(least[a], x), min(least[b], 1 - x)
            won = max(best, key=lambda c: (votes[c], least[c]))
            lang[k], sure[k] = won, of * least[won]
        return lang, sure


def fit(x: np.ndarray, langs: list[str]) -> Model:
    kinds = np.array(langs, object)
    by: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        by.setdefault(family(code), []).append(code)
    families = sorted(by)
    of = np.array([family(c) for c in langs], object)
    inner = x @ x.T
    found, pairs = [], {}

    def machine(rows: np.ndarray, y: np.ndarray) -> None:
        factors, bias, scale = linear_machine(inner[np.ix_(rows, rows)], y)
        found.append((x[rows].T @ factors.astype(np.float32), bias, scale))

    if len(families) > 1:
        for f in families:
            machine(np.arange(len(x)), np.where(of == f, 1.0, -1.0))
    elif families:
        found.append((np.zeros(x.shape[1]), 0.0, 1.0))
    for f in families:
        for a, b in combinations(by[f], 2):
            rows = np.flatnonzero((kinds == a) | (kinds == b))
            pairs[a, b] = len(found)
            machine(rows, np.where(kinds[rows] == a, 1.0, -1.0))
    w = np.stack([m[0] for m in found], 1).astype(np.float32) if found else np.zeros((WIDTH, 0), np.float32)
    return Model(families, by, pairs, w, np.array([m[1] for m in found]), np.array([m[2] for m in found]))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows whose crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    reach_workers(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike("\\p{L}") & ~held_out(key)).select(key, lang, text)
    top = known.select(key, lang).distinct().groupBy(lang).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), lang)
    count = top.count()
    each = sample // min(max(1, count), languages)
    # Ids with the least hashes of a language. A language of many ids keeps three times as
    # many ids as are wanted by their hash alone, so no window holds more of them.
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    near = known.join(F.broadcast(top), lang).where(place <= F.lit(3.0 * each * (1 << 40)) / F.col("__n")).select(key, lang).distinct()
    first = Window.partitionBy(lang).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key)
    ids = near.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= each).select(key, lang)
    # At most `each` ids to a language. An id that many rows carry counts once in a language,
    # with its text of least hash.
    rows = known.join(F.broadcast(ids), [key, lang]).groupBy(key, lang).agg(F.min_by(text, F.xxhash64(text)).alias(text))

    def run(batches):
        for b in sliced(batches, text):
            x = [shares(t) for t in texts_of(b, text)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(lang), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=[key, lang, "x"])

    got = rows.select(key, lang, text).mapInArrow(run, f"{key} long, {lang} string, x binary").orderBy(lang, F.xxhash64(key), key).limit(max(1, each * count)).toPandas()
    if not len(got):
        return fit(np.zeros((0, WIDTH)), [])
    return fit(np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32), got[lang].tolist())


def predicted(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with all columns, the language and the score. Columns of their names are replaced."""
    reach_workers(docs.sparkSession)
    docs = docs.drop(*names)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches, text):
            lang, sure = known.value.predict(texts_of(b, text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(sure)], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1)."""
    return predicted(docs.select(key, text), model, text).drop(text)


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", trusted: float = TRUSTED) -> DataFrame:
    """The documents in a learned language with at least the score `trusted`, with docs' columns."""
    names = ("__lang_pred", "__score")
    found = predicted(docs, train(docs, key, text, lang), text, names)
    return found.where((F.col("__lang_pred") != "und") & (F.col("__score") >= trusted)).drop(*names)
