"""Turning points, cycles and the decay of an upswing.

After the monthly roll-up a series is as short as the calendar, so it travels as one array
and a whole series is worked on inside its own row: one shuffle by series, no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import months_apart, quarters_apart

_TURN = "struct<t:date,kind:string>"


def series_arrays(series: DataFrame, key: str = "series", month: str = "month", value: str = "value") -> DataFrame:
    """One row per series with ``obs``: its points in time order, nulls left out."""
    points = series.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(month).alias("t"), F.col(value).cast("double").alias("v")))).alias("obs")
    )
    return points.select(F.col(key).alias("series"), "obs")


def _zigzag(obs: Column, threshold: Column) -> Column:
    """Confirmed reversals of the log series as ``array<struct<t, kind>>``.

    The state is the trend (null until the first reversal), the running high and low with
    their dates, and the reversals so far. A new high or low must be strictly beyond the old
    one; a reversal needs at least ``threshold``.
    """

    def state(mode, hi_t, hi, lo_t, lo, turns) -> Column:
        return F.struct(
            mode.cast("string").alias("mode"), hi_t.alias("hi_t"), hi.alias("hi"),
            lo_t.alias("lo_t"), lo.alias("lo"), turns.alias("turns"),
        )

    first = obs[0]
    start = state(F.lit(None), first["t"], F.ln(first["v"]), first["t"], F.ln(first["v"]), F.array().cast(f"array<{_TURN}>"))

    def turn(s: Column, t: Column, kind: str) -> Column:
        return F.array_append(s["turns"], F.struct(t.alias("t"), F.lit(kind).alias("kind")))

    def step(s: Column, p: Column) -> Column:
        t, v = p["t"], F.ln(p["v"])
        rising, falling = s["mode"] == "up", s["mode"] == "down"
        # The extreme that follows the trend moves on; before the first reversal both do.
        moves_up = ~F.coalesce(falling, F.lit(False)) & (v > s["hi"])
        moves_down = ~F.coalesce(rising, F.lit(False)) & (v < s["lo"])
        hi_t, hi = F.when(moves_up, t).otherwise(s["hi_t"]), F.when(moves_up, v).otherwise(s["hi"])
        lo_t, lo = F.when(moves_down, t).otherwise(s["lo_t"]), F.when(moves_down, v).otherwise(s["lo"])
        bottomed = ~F.coalesce(rising, F.lit(False)) & (v - lo >= threshold)
        topped = ~F.coalesce(falling, F.lit(False)) & (hi - v >= threshold)
        return (
            F.when(bottomed, state(F.lit("up"), t, v, lo_t, lo, turn(s, lo_t, "T")))
            .when(topped, state(F.lit("down"), hi_t, hi, t, v, turn(s, hi_t, "P")))
            .otherwise(state(s["mode"], hi_t, hi, lo_t, lo, s["turns"]))
        )

    found = F.aggregate(obs, start, step, lambda s: s["turns"])
    return F.when(F.size(obs) > 0, found).otherwise(F.array().cast(f"array<{_TURN}>"))


def _with_turns(series: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """``thresholds``: one log threshold, or a table ``(series, threshold)``."""
    arrays = series_arrays(series)
    if isinstance(thresholds, DataFrame):
        arrays = arrays.join(thresholds.select("series", "threshold"), "series")
    else:
        arrays = arrays.withColumn("threshold", F.lit(float(thresholds)))
    return arrays.withColumn("turns", _zigzag(F.col("obs"), F.col("threshold")))


def turning_points(series: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """``(series, month, kind)``, kind ``T`` for a trough and ``P`` for a peak."""
    return _with_turns(series, thresholds).select("series", F.inline("turns")).withColumnRenamed("t", "month")


def cycle_table(
    series: DataFrame, thresholds: DataFrame | float, levels: dict[str, float] | None = None
) -> DataFrame:
    """One row per peak that has an earlier trough: size, times up, back and down, fall rate.

    ``levels`` names the return times: column -> multiple of the earlier trough.
    """
    levels = levels or {"back_months": 1.0, "back_months_120": 1.2}
    turned = _with_turns(series, thresholds)
    peaks = turned.select("series", "obs", "turns", F.posexplode("turns").alias("at", "turn")).where(
        F.col("turn.kind") == "P"
    )

    def troughs(part: Column) -> Column:
        return F.filter(part, lambda p: p["kind"] == "T")

    earlier = troughs(F.slice("turns", 1, F.col("at")))
    later = troughs(F.slice("turns", F.col("at") + 2, F.size("turns")))
    spans = peaks.where(F.size(earlier) > 0).select(
        "series", "obs", F.try_element_at(earlier, F.lit(-1))["t"].alias("trough0"), F.col("turn.t").alias("peak"),
        F.get(later, F.lit(0))["t"].alias("trough1"),
    )

    def at(day: str) -> Column:
        return F.get(F.filter("obs", lambda p: p["t"] == F.col(day)), F.lit(0))["v"]

    priced = spans.withColumns({
        "p_trough0": at("trough0"), "p_peak": at("peak"), "p_trough1": at("trough1"),
        "__after": F.filter("obs", lambda p: p["t"] > F.col("peak")),
    })
    rise = F.ln(F.col("p_peak") / F.col("p_trough0"))

    def first_month(test) -> Column:
        return months_apart(F.col("peak"), F.get(F.filter("__after", test), F.lit(0))["t"])

    def at_most(multiple: float):
        return lambda p: p["v"] <= multiple * F.col("p_trough0")

    backs = {name: first_month(at_most(multiple)) for name, multiple in levels.items()}
    fall_months = months_apart(F.col("peak"), F.col("trough1"))
    return priced.select(
        "series", "trough0", "peak", "trough1", "p_trough0", "p_peak", "p_trough1",
        (F.col("p_peak") / F.col("p_trough0")).alias("rise_x"),
        months_apart(F.col("trough0"), F.col("peak")).alias("up_months"),
        *[c.alias(n) for n, c in backs.items()],
        first_month(lambda p: F.ln(p["v"] / F.col("p_trough0")) <= rise / 2).alias("half_life"),
        fall_months.alias("fall_months"),
        F.when(fall_months > 0, F.ln(F.col("p_peak") / F.col("p_trough1")) / fall_months).alias("fall_rate"),
    )


def quarterly_levels(series: DataFrame) -> DataFrame:
    """``(series, quarter, level)``: log of each quarter's mean; quarters without data are absent."""
    return (
        series.where(F.col("value").isNotNull())
        .groupBy("series", F.trunc("month", "QUARTER").alias("quarter")).agg(F.ln(F.avg("value")).alias("level"))
    )


def log_increments(series: DataFrame) -> DataFrame:
    """``(series, quarter, inc)``: change to the last quarter with data, which may be further back."""
    return _increments(quarterly_levels(series)).select("series", F.inline("incs")).select(
        "series", F.col("q").alias("quarter"), "inc"
    )


def _increments(levels: DataFrame) -> DataFrame:
    """One row per series: ``levels`` and ``incs`` arrays in time order."""
    rows = levels.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct(F.col("quarter").alias("q"), F.col("level").alias("l")))).alias("levels")
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.size("levels") - 1),
        lambda i: F.struct(
            F.col("levels")[i]["q"].alias("q"), (F.col("levels")[i]["l"] - F.col("levels")[i - 1]["l"]).alias("inc")
        ),
    )
    none = F.array().cast("array<struct<q:date,inc:double>>")
    return rows.withColumn("incs", F.when(F.size("levels") > 1, steps).otherwise(none))


def upswing_decay(series: DataFrame, cycles: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per cycle: the quarter of the largest increase, the lag to the peak, decay ratios after it.

    The upswing runs over the quarters after the trough up to the peak's own quarter, at
    least two. Ratios stop at the first increase that is not positive.
    """
    keep = keep or []
    rows = cycles.select("series", "trough0", "peak", *keep).join(_increments(quarterly_levels(series)), "series")
    boundary = F.trunc("peak", "QUARTER")
    rows = rows.withColumn(
        "__up", F.filter("incs", lambda x: (x["q"] > F.col("trough0")) & (x["q"] <= boundary))
    ).where(F.size("__up") >= 2)
    top = F.aggregate(
        "__up", F.get("__up", F.lit(0)), lambda best, x: F.when(x["inc"] > best["inc"], x).otherwise(best)
    )
    rows = rows.withColumn("__top", top)
    rows = rows.withColumn("__after", F.filter("incs", lambda x: x["q"] > F.col("__top.q")))
    stop = F.array_position(F.transform("__after", lambda x: x["inc"] <= 0), True)
    rising = F.when(stop > 0, F.slice("__after", 1, (stop - 1).cast("int"))).otherwise(F.col("__after"))
    rows = rows.withColumn("__rising", F.when(F.col("__top.inc") > 0, rising).otherwise(F.slice("__after", 1, 0)))
    ratios = F.transform(
        "__rising",
        lambda x, i: x["inc"] / F.when(i == 0, F.col("__top.inc")).otherwise(F.get("__rising", i - 1)["inc"]),
    )
    return rows.select(
        "series", "peak", *keep, F.col("__top.q").alias("max_q"), F.col("__top.inc").alias("max_inc"),
        F.trunc("peak", "QUARTER").alias("peak_q"),
        quarters_apart(F.col("__top.q"), F.col("peak")).alias("lag_q"),
        ratios.alias("decay_ratios"),
    ).withColumn("decay_first", F.coalesce(F.get("decay_ratios", F.lit(0)), F.lit(0.0)))


def pooled_ratios(timing: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per decay ratio; an upswing without any counts once as 0."""
    ratios = F.when(F.size("decay_ratios") > 0, F.col("decay_ratios")).otherwise(F.array(F.lit(0.0)))
    return timing.select(*(keep or []), F.explode(ratios).alias("ratio"))
