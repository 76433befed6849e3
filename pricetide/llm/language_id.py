"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

``train`` counts document frequencies over all learning rows, fits FTRL with elastic net on a bounded sample of
them, and calibrates the softmax with a temperature on held-back rows of that sample. ``predict`` scores whole texts.

Defined results: a null text, an empty text and a text without a letter give ``und`` with score 0. Without
learning rows every text gives ``und``. Rows with a null id or language are not learned from. Ties between classes
go to the language that comes first in code-point order. Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import class_sample, crc_of_id, prepared, whole_row
from .linear import Ftrl, softmax, temperature

BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
# Bounds of the sample the weights are fitted on; document frequencies are counted over all learning rows.
SAMPLE_PER_CLASS = 800
SAMPLE_ROWS = 160_000

_LETTER = regex.compile(r"\p{L}")
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((i if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)), np.uint32))
    return _letters[0]


def buckets(text: str) -> np.ndarray:
    """Hash buckets of all character 1-, 2- and 3-grams of a text; runs of other characters count as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    c = _letter_table()[points]
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    one = c * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + c[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(3266489917)
    mixed = np.concatenate([one[c != 0], two, three])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    return mixed >> np.uint32(32 - BITS)


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(buckets(text), minlength=SIZE)
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all texts hold each bucket: one vector of fixed size per task, summed by Spark."""

    def count(batches):
        seen, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    seen[:SIZE] += np.bincount(buckets(t), minlength=SIZE) > 0
                    n += 1
        seen[SIZE] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(SIZE + 1, np.int64)
    for row in sums:
        found[row.bucket] = row.n
    return found[:SIZE], int(found[SIZE])


def train(docs: DataFrame, per_class: int = SAMPLE_PER_CLASS, most: int = SAMPLE_ROWS) -> Model:
    """A model from the rows whose crc32(doc_id) mod 5 is not 0. At most ``per_class`` rows of each language, and
    about ``most`` of all, are fitted on; every language is learned."""
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(crc_of_id("doc_id", 5) != 0)
    found, n = _document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + found)) + 1

    def vectors(batches):
        for batch in batches:
            pairs = [_features(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("lang"),
                    pa.array([a.astype("<i4").tobytes() for a, _ in pairs], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in pairs], pa.binary()),
                ],
                ["doc_id", "lang", "at", "value"],
            )

    sample = class_sample(rows, "lang", "doc_id", per_class, most)
    got = sorted(
        sample.mapInArrow(vectors, "doc_id long, lang string, at binary, value binary").collect(),
        key=lambda r: (r.doc_id, r.lang, r["at"], r.value),
    )
    langs = sorted({r.lang for r in got})
    data = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r.value, "<f4").astype(float), langs.index(r.lang)) for r in got]
    if not langs:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    held = [i % 6 == 5 for i in range(len(data))]
    learner = Ftrl(SIZE, max(2, len(langs)), alpha=1.0, beta=1.0, l1=0.02, l2=0.1)
    weights = learner.fit([r for r, h in zip(data, held) if not h], epochs=3)
    kept = [r for r, h in zip(data, held) if h]
    scores = np.array([v @ weights[at] + weights[-1] for at, v, _ in kept]).reshape(len(kept), -1)
    if len(langs) == 1:
        return Model(langs, idf, weights[:, :1], 1.0)
    return Model(langs, idf, weights, temperature(scores, np.array([y for _, _, y in kept], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; the model is broadcast (32,769 weights per language)."""
    shared = prepared(docs.sparkSession).sparkContext.broadcast(model)

    def label(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if not m.langs or text is None or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, value = _features(text, m.idf)
                p = softmax((value @ m.weights[at] + m.weights[-1]) / m.temperature)
                best = int(p.argmax())
                langs.append(m.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        label, "doc_id long, lang_pred string, score double"
    )


def op10_language_id(docs: DataFrame) -> DataFrame:
    """Contract columns for every document."""
    labelled = predict(docs, train(docs))
    held = F.coalesce(crc_of_id("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return labelled.select("doc_id", held, "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents whose language is recognised: not ``und`` and, where asked for, a calibrated score of at least ``least``.

    Their ``lang`` is the language recognised. Decided within one pass over the rows, so repeated ids are judged by their own text.
    """
    model = train(docs)
    shared = prepared(docs.sparkSession).sparkContext.broadcast(model)

    def keep(batches):
        m = shared.value
        for batch in batches:
            kept, langs = [], []
            for text in batch.column("text").to_pylist():
                ok = bool(m.langs) and text is not None and bool(_LETTER.search(text))
                if ok:
                    at, value = _features(text, m.idf)
                    p = softmax((value @ m.weights[at] + m.weights[-1]) / m.temperature)
                    best = int(p.argmax())
                    ok = float(p[best]) >= least
                kept.append(ok)
                langs.append(m.langs[best] if ok else None)
            found = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, pa.string())], ["row", "found"])
            yield found.filter(pa.array(kept, pa.bool_()))

    # The row goes through as one column, as names with dots do not.
    rows = docs.select("text", whole_row(docs).alias("row"))
    found = rows.mapInArrow(keep, StructType([rows.schema["row"], StructField("found", StringType())]))
    return found.select(F.col("row").withField("lang", F.col("found")).alias("row")).select("row.*")
