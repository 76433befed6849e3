"""Replace-by-key refresh, back-fill work lists, tidy output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], refetched: DataFrame | None = None) -> DataFrame:
    """Old rows of every re-fetched key go as a whole, then the new rows come in.

    ``refetched`` lists keys fetched again even if they brought no rows; by default the
    keys of ``new``.
    """
    done = (new if refetched is None else refetched).select(*keys).distinct()
    return old.join(done, keys, "left_anti").unionByName(new)


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def backfill_plan(
    available: DataFrame, fetched: DataFrame, keys: list[str], period: str, n_recent: int, stale_before: str,
    priority: str = "priority",
) -> DataFrame:
    """Missing periods plus stale ones among the newest ``n_recent``, newest first.

    ``fetched`` has ``fetched_on`` per row; a period is stale if its oldest row is older
    than ``stale_before``. Both sides are one row per key and period, so windows are small.
    """
    oldest = fetched.groupBy(*keys, period).agg(F.min("fetched_on").alias("fetched_on"))
    newest = Window.partitionBy(*keys).orderBy(F.desc(period))
    ranked = available.withColumn("__rank", F.row_number().over(newest))
    state = ranked.join(oldest, [*keys, period], "left")
    stale = (F.col("__rank") <= n_recent) & (F.col("fetched_on") < F.lit(stale_before).cast("date"))
    reason = F.when(F.col("fetched_on").isNull(), "missing").when(stale, "stale")
    return (
        state.withColumn("reason", reason).where(F.col("reason").isNotNull())
        .select(*keys, priority, period, "reason")
        .orderBy(priority, F.desc(period), *keys)
    )


def write_tidy(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Parquet partitioned for pruning; only partitions present in ``df`` are replaced.

    Rows are rebalanced by partition: a partition that holds a large share of the rows gets as
    many writers as its size asks for, and small ones stay few files.
    """
    out = df.hint("rebalance", *[F.col(c) for c in partition]) if partition else df
    if sort:
        out = out.sortWithinPartitions(*(partition or []), *sort)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
