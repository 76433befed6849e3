"""Exact quantiles per group in one lazy plan, for small groups and for one that holds most rows.

Groups are dealt to ``BUCKETS`` buckets by the hash of their keys and rows are counted per bucket. A bucket of at most four times
``ACCURACY`` rows holds small groups only: these are gathered whole, in one aggregation. The groups of crowded buckets take two
passes, each one aggregation that combines before its shuffle. The first counts each group and brackets the wanted ranks with
a mergeable rank sketch of bounded size. The second counts what lies at or below each bracket and gathers only the values strictly
inside it, from which the exact rank is taken; ties at the ends of a bracket are counted, not gathered. The sketch is right within
1 / ``ACCURACY`` of a group's rows, so a bracket holds less than a thousandth of a large group, however its values are
distributed. A group of at most four times ``ACCURACY`` rows is one bracket. No job runs while the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 20_000
BUCKETS = 1 << 16

_FOLD = {"min": F.min, "max": F.max, "sum": F.sum}


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    count: str | None = None,
    extra: dict[str, tuple[str, Column]] | None = None,
    weight: str | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key group with the named quantiles of ``value`` (nulls ignored), linearly interpolated.

    ``count`` names an optional row-count column; ``extra`` maps an output name to
    ``("min" | "max" | "sum", column)``. ``weight`` is a column of whole numbers: how many
    rows each row stands for. Without keys there is one row, also for an empty input. ``accuracy`` sets the size
    of the sketch and, four times that, how many rows of a group are gathered whole.
    """
    extra = extra or {}
    ranks = list(quantiles.values())
    stands_for = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    source = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__v"),
        stands_for.alias("__times"), *[c.alias(f"__x_{n}") for n, (_, c) in extra.items()],
    )
    if weight:  # rows again, a thousand at a time
        source = source.where("__times > 0").select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / 1000))).alias("__k")
        ).select("*", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(1000), F.col("__times") - F.col("__k") * 1000).cast("int"))))
    if not keys:
        return _named(_in_two_passes(source, keys, ranks, extra, accuracy), keys, quantiles, count, extra)
    # At most BUCKETS rows, so a broadcast is safe; without a crowded bucket its whole branch falls away at run time.
    source = source.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    crowded = F.broadcast(source.groupBy("__bucket").agg(F.count("*").alias("__rows")).where(F.col("__rows") > 4 * accuracy).select("__bucket"))
    gathered = source.join(crowded, "__bucket", "left_anti").groupBy(*keys).agg(
        F.count("*").alias("__n"), F.collect_list("__v").alias("__whole"), *_folds(extra)
    )
    few = gathered.select(*keys, "__n", _blends(ranks, lambda i, rank, whole: F.get(whole, rank.cast("int"))).alias("__p"), *[f"__x_{n}" for n in extra])
    many = _in_two_passes(source.join(crowded, "__bucket", "left_semi").drop("__bucket"), keys, ranks, extra, accuracy)
    return _named(few.unionByName(many), keys, quantiles, count, extra)


def _named(found: DataFrame, keys: list[str], quantiles: dict[str, float], count: str | None, extra) -> DataFrame:
    counts = [F.coalesce("__n", F.lit(0)).cast("long").alias(count)] if count else []
    picked = [F.get("__p", F.lit(i)).alias(name) for i, name in enumerate(quantiles)]
    return found.select(*keys, *picked, *counts, *[F.col(f"__x_{n}").alias(n) for n in extra])


def _blends(ranks: list[float], value_at) -> Column:
    """The quantiles of a group, from ``value_at(rank, the gathered values in order)``."""
    def blended(whole: Column) -> Column:
        out = []
        for i, q in enumerate(ranks):
            at = F.lit(float(q)) * (F.col("__n") - 1)
            lower, upper = (value_at(i, end(at), whole) for end in (F.floor, F.ceil))
            out.append(F.when(lower == upper, lower).otherwise(lower + (upper - lower) * (at - F.floor(at))))
        return F.array(*out)

    return F.get(F.transform(F.array(F.sort_array("__whole")), blended), F.lit(0))


def _in_two_passes(source: DataFrame, keys: list[str], ranks: list[float], extra, accuracy: int) -> DataFrame:
    """Keys, ``__n``, ``__p`` (an array in the order of ``ranks``) and the folds, gathering only what lies inside brackets."""
    # Three times the sketch's error to both sides: in a group of more than 4 x accuracy rows the rank lies between them.
    ends = [min(1.0, max(0.0, q + side / accuracy)) for q in ranks for side in (-3, 3)]
    first = source.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, accuracy).alias("__ends"), *_folds(extra))
    within = _beside(source, first.select(*keys, "__n", "__ends"), keys)
    v, small = F.col("__v"), F.col("__n") <= 4 * accuracy
    low, high = ([F.get("__ends", F.lit(2 * i + up)) for i in range(len(ranks))] for up in (0, 1))
    inside = [F.collect_list(F.when(~small & (v > lo) & (v < hi), v)).alias(f"__in{i}") for i, (lo, hi) in enumerate(zip(low, high, strict=True))]
    below = [F.count_if(~small & (v <= lo)).alias(f"__upto{i}") for i, lo in enumerate(low)]
    # The sum reads all columns, so that both passes read the same rows.
    read = F.sum(F.hash("__v", *[f"__x_{n}" for n in extra])).alias("__read")
    second = within.groupBy(*keys).agg(F.collect_list(F.when(small, v)).alias("__whole"), *inside, *below, read)
    found = _beside(second.where(F.col("__read").isNotNull()) if keys else second, first, keys)

    def value_at(i: int, rank: Column, whole: Column) -> Column:
        place = (rank - F.col(f"__upto{i}")).cast("int")
        large = F.when(place < 0, low[i]).otherwise(F.coalesce(F.get(F.sort_array(f"__in{i}"), place), high[i]))
        return F.when(small, F.get(whole, rank.cast("int"))).otherwise(large)

    return found.select(*keys, "__n", _blends(ranks, value_at).alias("__p"), *[f"__x_{n}" for n in extra])


def _folds(extra) -> list[Column]:
    return [_FOLD[how](f"__x_{name}").alias(f"__x_{name}") for name, (how, _) in extra.items()]


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of the right row with the same keys, where null is a key like any other; without keys, of its one row."""
    if not keys:
        held = left.withColumn("__row", right.select(F.struct(*right.columns)).scalar())
        return held.select(*left.columns, *[F.col("__row")[c].alias(c) for c in right.columns])
    r = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__k_{k}"]) for k in keys])
    return left.join(r, match).drop(*[f"__k_{k}" for k in keys])
