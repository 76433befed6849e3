"""How rows are laid out before heavy per-row work."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows over several tasks per core, only if the scan has too few splits.

    A large input has more splits than that and passes through without a shuffle.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def read_once(df: DataFrame, on: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with the columns that ``read`` adds to the ``on`` columns, which it is given once per distinct value.

    For long text rules over texts that come again. ``read`` keeps the ``on`` columns and at most one row per value; rows whose value
    it drops are dropped. Null is a value like any other.
    """
    found = read(spread_distinct(df.select(*on)))
    new = [c for c in found.columns if c not in on]
    named = found.select(*[F.col(c).alias(f"__on_{c}") for c in on], *new)
    match = reduce(lambda a, b: a & b, [df[c].eqNullSafe(named[f"__on_{c}"]) for c in on])
    return df.join(named, match).drop(*[f"__on_{c}" for c in on])


def spread_distinct(df: DataFrame) -> DataFrame:
    """Distinct rows over several tasks per core, however few bytes they are."""
    return df.distinct().repartition(df.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` holds, with the columns it uses computed once.

    A plain filter is pushed below the projection that computed its columns and repeats
    their expressions there. With long text rules that costs more than the rows it saves.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*df.columns)))))
