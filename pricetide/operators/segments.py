"""Ordered look-around inside a key without one task per key.

A window over a raw key would sort all rows of that key in one task. Here every key is cut
into segments (normally spans of time); windows run per (key, segment), and only the rows
next to a segment border are looked at again per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equi_depth(df: DataFrame, keys: list[str], order: str, name: str = "__segment", parts: int = 64) -> DataFrame:
    """Add a segment that cuts each key's line, wherever its rows lie, into about ``parts`` pieces of like many rows.

    The cuts come from a mergeable sketch of the key's own order (a number), so one key that holds all rows within a short span of
    time is spread like any other. A run of one order value stays in one piece.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 50 * parts).alias("__cuts"))
    below = F.aggregate("__cuts", F.lit(0), lambda n, cut: n + F.when(cut < F.col(order), 1).otherwise(0))
    if not keys:  # one row of cuts, as a subquery rather than a join
        return df.withColumn("__cuts", cuts.scalar()).withColumn(name, F.coalesce(below, F.lit(0))).drop("__cuts")
    renamed = cuts.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "__cuts")
    match = F.lit(True)
    for k in keys:
        match = match & df[k].eqNullSafe(renamed[f"__c_{k}"])
    return df.join(renamed, match, "left").withColumn(name, F.coalesce(below, F.lit(0))).drop("__cuts", *[f"__c_{k}" for k in keys])


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    segment: Column,
    lags: dict[str, tuple[str, int]] | None = None,
    leads: dict[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Add ``lag``/``lead`` columns: output name -> (column, distance).

    ``order`` must be total within a key and ``segment`` must not decrease along it. A row
    needs a second look only if fewer than ``reach`` rows of its own segment lie before it
    (lags) or after it (leads); at most ``2 * reach`` rows per segment do.
    """
    lags, leads = lags or {}, leads or {}
    reach = max([k for _, k in lags.values()] + [k for _, k in leads.values()])
    tagged = df.withColumn("__seg", segment)
    local = Window.partitionBy(*keys, "__seg").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    seen = (
        tagged.withColumns(_looks(local, lags, leads, ""))
        .withColumn("__head", F.lag(F.lit(1), reach).over(local).isNull())
        .withColumn("__tail", F.lead(F.lit(1), reach).over(local).isNull())
    )
    edge = F.col("__head") | F.col("__tail")
    fixed = seen.where(edge).withColumns(_looks(per_key, lags, leads, "__fix_"))
    for name in lags:
        fixed = fixed.withColumn(name, F.when(F.col("__head"), F.col(f"__fix_{name}")).otherwise(F.col(name)))
    for name in leads:
        fixed = fixed.withColumn(name, F.when(F.col("__tail"), F.col(f"__fix_{name}")).otherwise(F.col(name)))
    out = df.columns + list(lags) + list(leads)
    return seen.where(~edge).select(*out).unionByName(fixed.select(*out))


def _looks(window, lags, leads, prefix) -> dict[str, Column]:
    found = {f"{prefix}{name}": F.lag(c, k).over(window) for name, (c, k) in lags.items()}
    found.update({f"{prefix}{name}": F.lead(c, k).over(window) for name, (c, k) in leads.items()})
    return found


def carry(
    df: DataFrame,
    keys: list[str],
    order: str,
    segment: Column,
    columns: dict[str, str],
    backward: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Carry the nearest non-null value along a key: output name -> input column.

    Forward takes the last value at or before a row, ``backward`` the first at or after it.
    The last value of every segment goes through a small (key, segment) table.
    """
    direction = F.desc if backward else F.asc
    tagged = df.withColumn("__seg", segment)
    local = (
        Window.partitionBy(*keys, "__seg").orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    inside = tagged.withColumns({f"__in_{n}": F.last(c, ignorenulls=True).over(local) for n, c in columns.items()})
    pick = F.min_by if backward else F.max_by
    per_segment = tagged.groupBy(*keys, "__seg").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__out_{n}") for n, c in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(direction("__seg")).rowsBetween(Window.unboundedPreceding, -1)
    borders = per_segment.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__seg").alias("__k_seg"),
        *[F.last(f"__out_{n}", ignorenulls=True).over(earlier).alias(f"__out_{n}") for n in columns],
    )
    match = inside["__seg"].eqNullSafe(borders["__k_seg"])
    for k in keys:
        match = match & inside[k].eqNullSafe(borders[f"__k_{k}"])
    joined = inside.join(borders, match, "left")
    return joined.select(
        *[inside[c] for c in df.columns],
        *[F.coalesce(F.col(f"__in_{n}"), F.col(f"__out_{n}")).alias(n) for n in columns],
    )
