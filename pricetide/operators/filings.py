"""Filed facts: vintages, discrete quarters from year-to-date sums, equivalents, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_per

QUARTER_DAYS = (75, 105)


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The most recently filed row per key; ``order`` is e.g. (filed, accession)."""
    return first_per(df, keys, [F.col(c) for c in order], last=True)


def ytd_to_discrete(
    facts: DataFrame, keys: list[str], start: str = "start", end: str = "end", val: str = "val",
    gap: tuple[int, int] = QUARTER_DAYS,
) -> DataFrame:
    """Quarters as reported, plus differences of sums with one start and ends a quarter apart.

    ``facts`` is one row per (keys, start, end). Earlier ends are read from a range frame of
    ``gap`` days, which holds at most that many rows, so no pairs are formed. A reported
    quarter beats a difference; of two differences for one quarter the earliest start wins.
    """
    length = F.datediff(end, start)
    reported = facts.where(length.between(*gap)).withColumn("derivation", F.lit("reported"))
    back = Window.partitionBy(*keys, start).orderBy(F.unix_date(end)).rangeBetween(-gap[1], -gap[0])
    earlier = F.collect_list(F.struct(F.col(end).alias("e"), F.col(val).alias("v"))).over(back)
    differences = (
        facts.withColumn("__earlier", earlier).withColumn("__prev", F.explode("__earlier")).drop("__earlier")
        .withColumn("__ytd_start", F.col(start))
        .withColumn(start, F.date_add(F.col("__prev.e"), 1))
        .withColumn(val, F.col(val) - F.col("__prev.v"))
        .withColumn("derivation", F.lit("ytd_diff"))
        .drop("__prev")
    )
    every = reported.withColumn("__ytd_start", F.lit(None).cast("date")).unionByName(differences)
    best = first_per(
        every, [*keys, start, end], [(F.col("derivation") != "reported").alias("r"), F.col("__ytd_start").alias("s")]
    )
    return best.drop("__ytd_start")


def fiscal_years(facts: DataFrame, entity: str, start: str = "start", end: str = "end", form: str = "form") -> DataFrame:
    """Fiscal years from about annual facts of annual reports, plus one provisional year."""
    annual = facts.where(F.col(form).startswith("10-K") & F.datediff(end, start).between(350, 380))
    known = annual.select(entity, F.col(start).alias("fy_start"), F.col(end).alias("fy_end")).distinct()
    last = known.groupBy(entity).agg(F.max(F.struct("fy_start", "fy_end")).alias("__y"))
    ahead = last.select(
        entity, F.date_add("__y.fy_end", 1).alias("fy_start"), F.date_add("__y.fy_end", 364).alias("fy_end")
    )
    return known.unionByName(ahead)


def calendar_quarter(start: str, end: str) -> Column:
    """Calendar quarter of the middle of a period."""
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return F.concat(F.year(middle).cast("string"), F.lit("Q"), F.quarter(middle).cast("string"))


def _standing(derivation: str, order: list[str]) -> list[Column]:
    return [(F.col(derivation) == "reported").alias("reported"), *[F.col(c) for c in order]]


def priority_coalesce(
    df: DataFrame, keys: list[str], group_rank: str, derivation: str, order: list[str], tie: str
) -> DataFrame:
    """Best row of the first group that has one: reported, then latest filed, then first ``tie``."""
    return first_per(
        df, keys,
        [(-F.col(group_rank)).alias("g"), *_standing(derivation, order), (-F.col(tie)).alias("t")],
        last=True,
    )


def conflicts(
    df: DataFrame, keys: list[str], sequence: str, val: str, derivation: str, order: list[str], tag: str,
    rel_tol: float = 0.005,
) -> DataFrame:
    """Equivalents that disagree by more than ``rel_tol``: each against the best one before it.

    One row per equivalent and key, so a group is as small as the list of equivalents. The first column of ``order`` is the
    filing date.
    """
    before = Window.partitionBy(*keys).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct(*_standing(derivation, order), (-F.col(sequence)).alias("s"), F.col(tag).alias("tag"), F.col(val).alias("val"))
    seen = df.withColumn("__me", me).withColumn("__best", F.max("__me").over(before))
    best, this = F.col("__best"), F.col("__me")
    differs = F.abs(best["val"] - this["val"]) / F.abs(best["val"]) > rel_tol
    rows = seen.where(best["reported"] & this["reported"] & (best["val"] != 0)).where(differs)
    newer = F.struct(*[this[c] for c in order]) > F.struct(*[best[c] for c in order])
    kept, other = F.when(newer, this).otherwise(best), F.when(newer, best).otherwise(this)
    return rows.select(
        *keys, kept["tag"].alias("kept_tag"), kept["val"].alias("kept_value"), kept[order[0]].alias("kept_filed"),
        other["tag"].alias("other_tag"), other["val"].alias("other_value"), other[order[0]].alias("other_filed"),
    )
