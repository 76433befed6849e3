"""Tables of vectors: which take part, and packing them in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACK = "dim int, shard int, part int, ids binary, vectors binary"


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id, dim, vector (doubles) of the vectors without null or non-finite components, one row per vec_id.

    Of rows that share a vec_id the smallest vector counts. Empty vectors and, unless ``zero``, all-zero ones are left out.
    """
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = out.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").where(~wrong)
    if not zero:
        out = out.where(F.exists("vector", lambda x: x != 0))
    return out.groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", F.size("vector").alias("dim"), "vector")


def packed(rows: DataFrame) -> DataFrame:
    """One row per (dim, shard, part) with its ids and vectors as flat arrays, in order of vec_id."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({
            "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "part": [pdf["part"].iloc[0]],
            "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vectors": [np.stack(pdf["vector"].to_list()).astype("<f8").tobytes()],
        })

    keyed = rows.select("vec_id", "vector", "dim", F.col("shard").cast("int").alias("shard"), F.col("part").cast("int").alias("part"))
    return keyed.groupBy("dim", "shard", "part").applyInPandas(pack, PACK)


def unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)


def bucket(column: str, parts: int, seed: str) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(parts)).cast("int")
