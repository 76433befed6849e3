"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: presence of each word, word pair and skip pair (one word between), hashed into 2^18
coordinates. Per-coordinate rates and L1 leave few weights, which are broadcast as (coordinate, weight) arrays.

Defined results: null and empty texts score as the bias alone. Without learning rows every score is 0. Labels that
are null, repeated for one document (the largest counts) or of a null id are not an error; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sample, crc_of_id, prepared
from .linear import Ftrl

BITS = 18
SIZE = 1 << BITS
# Bound of the sample the weights are fitted on.
SAMPLE_PER_CLASS = 3000
# Toxic rows are the fewer ones.
TOXIC_WEIGHT = 2.0
WORDS_KEPT = 200_000

_CUT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


class _Codes(dict):
    """Word -> hash, filled as words come; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = self[word] = zlib.crc32(word)
        return code


_codes = _Codes()


def coordinates(text: str | None) -> np.ndarray:
    """Coordinates of all n-grams in order of the text, repeats included."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_CUT).split()
    c = np.fromiter(map(_codes.__getitem__, words), np.uint32, len(words))
    mixed = np.concatenate([
        c * np.uint32(2654435761),
        c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917) + np.uint32(1),
        c[:-2] * np.uint32(668265263) + c[2:] * np.uint32(374761393) + np.uint32(2),
    ])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    return mixed >> np.uint32(32 - BITS)


@dataclass
class Model:
    at: np.ndarray
    weight: np.ndarray
    bias: float
    known: bool

    def dense(self) -> np.ndarray:
        full = np.zeros(SIZE)
        full[self.at] = self.weight
        return full


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from labelled rows whose crc32(doc_id) mod 3 is not 1; at most ``per_class`` rows of each label."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(crc_of_id("doc_id", 3) != 1)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = class_sample(marks, "toxic", "doc_id", per_class, 2 * per_class)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def vectors(batches):
        for batch in batches:
            rows = [np.unique(coordinates(t)).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], ["doc_id", "toxic", "at"]
            )

    got = sample.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        vectors, "doc_id long, toxic int, at binary"
    )
    rows = sorted(got.collect(), key=lambda r: (r.doc_id, r["at"]))
    if not rows:
        return Model(np.zeros(0, int), np.zeros(0), 0.0, False)
    data = [(a := np.frombuffer(r["at"], "<u4"), np.ones(len(a)), r.toxic, TOXIC_WEIGHT if r.toxic else 1.0) for r in rows]
    learner = Ftrl(SIZE, 1, alpha=1.0, beta=1.0, l1=15.0, l2=0.0)
    weights = learner.fit(data, epochs=8)[:, 0]
    at = np.flatnonzero(weights[:-1])
    return Model(at, weights[at], float(weights[-1]), True)


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = prepared(docs.sparkSession).sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        full = m.dense()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                at = coordinates(text)
                total = m.bias + full[np.unique(at[full[at] != 0])].sum()
                out.append(float(1 / (1 + np.exp(-np.clip(total, -40, 40)))) if m.known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double, predicted int"
    )


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns for every document."""
    held = F.coalesce(crc_of_id("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs, train(docs, labels)).select("doc_id", held, "score", "predicted")
