"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and again; together they share 150 % of all words, and
a target stops at 2 times its source's size, the excess going to the others by weight.

Rates: within a source the document rates r in (0, 2) that are nearest in entropy to one copy each, among all that
give the target number of words, are r = 2 / (1 + exp(-tilt * size / mean size)). The tilts solve the convex dual; all
sources take their Newton steps together, each step one aggregation over a histogram (source, size, documents), with
a bracket that halves steps which leave it. A source whose target is 2 times its size takes everything twice.

Copies: per source, cells of equal size go from the largest to the smallest and carry the words that rounding left
over, so the sum misses the target by less than about half the smallest document. Which documents of a cell get the
extra copy is decided by the hash of doc_id. Large cells are split by another hash first, so no task ranks more than
about ``CELL_ROWS`` documents. Reruns agree: tilts are rounded to 7 digits, far above the noise of summation.

Defined results: null and empty texts have size 0 and take nothing. A null source is a source of its own. Rows with a
null or repeated doc_id count like any other row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, whole_row, written

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2

CELL_ROWS = 5000
MAX_STEPS = 60
TOLERANCE = 1e-10


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row, kept as a table: the texts are read once."""

    def count(batches):
        for batch in batches:
            # bytes.split() cuts at exactly \x20 and \x09-\x0D
            sizes = [len((t or "").encode("utf-8", "replace").split()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"]
            )

    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return written(rows.mapInArrow(count, "doc_id long, source string, size long"), "sized")


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: sid (its place), source, source_size, n_docs, target. Windows run over sources, not rows."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int"))
    totals = totals.withColumn("sid", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    every = Window.partitionBy()
    # Fullest first: the order in which growing targets reach their caps.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(BUDGET)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    marked = totals.withColumn("full", left * F.col("weight") / weights >= F.col("cap")).withColumn("budget", budget)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    share = (F.col("budget") - taken) * F.col("weight") / open_weight
    target = F.when(F.col("full"), F.col("cap")).otherwise(share)
    return marked.select("sid", "source", "source_size", "n_docs", target.alias("target"), "full")


def tilts(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """(sid, tilt) of every source that is not full, by distributed Newton steps on the dual.

    ``cells`` has sid, size, n. The state is one row per source and is kept as a table between steps.
    """
    mean = F.col("source_size") / F.col("n_docs")
    state = goals.where("NOT full AND target > 0").select(
        "sid", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("miss"),
    )
    state = written(state, "tilts")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        half = 1 / (1 + F.exp(-F.col("tilt") * x))
        words = F.col("n") * F.col("size")
        sums = cells.where("size > 0").join(state.select("sid", "mean", "tilt"), "sid").groupBy("sid").agg(
            F.sum(words * MOST_COPIES * half).alias("have"), F.sum(words * x * MOST_COPIES * half * (1 - half)).alias("slope")
        )
        gap = F.col("have") - F.col("target")
        joined = state.join(sums, "sid").withColumn("miss", F.abs(gap) / F.col("target"))
        joined = joined.withColumn("high", F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")))
        joined = joined.withColumn("low", F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")))
        reach = 1 + F.abs("tilt")
        step = F.greatest(-reach, F.least(reach, -gap / F.col("slope")))
        inside = F.coalesce(F.col("tilt") + step > F.col("low"), F.lit(True)) & F.coalesce(F.col("tilt") + step < F.col("high"), F.lit(True))
        following = F.when(F.col("miss") <= TOLERANCE, F.col("tilt")).when(inside, F.col("tilt") + step).otherwise(
            (F.col("low") + F.col("high")) / 2
        )
        state = written(joined.select("sid", "target", "mean", following.alias("tilt"), "low", "high", "miss"), "tilts")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("sid", F.round("tilt", 7).alias("tilt"), "mean")


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Extra copies per cell of one source, from the largest size down; what rounding leaves is carried on."""
    pdf = pdf.sort_values(["size", "part"], ascending=[False, True], ignore_index=True)
    extra, over = np.zeros(len(pdf), np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(pdf["size"], pdf["n"], pdf["rate"], strict=True)):
        if size:
            wanted = over + size * (rate - int(rate)) * n
            extra[i] = min(n, max(0, int(np.floor(wanted / size + 0.5))))
            over = wanted - size * extra[i]
    return pd.DataFrame({"sid": pdf["sid"], "size": pdf["size"], "part": pdf["part"], "copies": pdf["rate"].astype(np.int64), "extra": extra})


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row."""
    rows = sized(docs)
    goals = written(targets(rows), "targets")
    placed = rows.join(goals.select("sid", "source", "source_size", "target"), rows["source"].eqNullSafe(goals["source"]))
    placed = written(placed.select("doc_id", "size", "sid", "source_size", "target"), "placed")
    cells = written(placed.groupBy("sid", "size").agg(F.count("*").alias("n")), "cells")
    solved = tilts(cells, goals)
    rate = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(
        F.coalesce(MOST_COPIES / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))), F.lit(0.0))
    )
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    rated = cells.join(goals.select("sid", "full"), "sid").join(solved, "sid", "left").select(
        "sid", "size", rate.alias("rate"), F.ceil(F.col("n") / CELL_ROWS).alias("parts")
    )
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))
    spread = written(placed.join(rated, ["sid", "size"]).withColumn("part", part).drop("parts"), "spread")
    counted = spread.groupBy("sid", "size", "part", "rate").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("sid").applyInPandas(_carry, "sid int, size long, part long, copies long, extra long")
    own = Window.partitionBy("sid", "size", "part").orderBy(F.xxhash64("doc_id", F.lit("extra")), "doc_id")
    ranked = spread.withColumn("place", F.row_number().over(own)).join(chosen, ["sid", "size", "part"])
    copies = F.col("copies") + (F.col("place") <= F.col("extra")).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def op4_entropy_mix(docs: DataFrame) -> DataFrame:
    """Contract columns for every document, and its copies."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed(docs).select("doc_id", "size", "source_size", "target", taken, "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies.

    Rows that repeat a doc_id, or have none, get the copies of the one with most.
    """
    copies = mixed(docs).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_row(docs).alias("row"))
    joined = rows.join(copies, rows["id"].eqNullSafe(copies["doc_id"]))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
