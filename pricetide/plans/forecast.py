"""Projection: decay path of the rise, scenarios, monthly paths, back-test, bias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import months_apart, months_to, shift_months
from ..operators.quantiles import exact_quantiles
from ..session import settle
from .cycles import _increments, pooled_ratios, quarterly_levels, upswing_decay

STOP_INCREMENT = 0.02


def fall_sample(
    cycles: DataFrame, since: str, min_rise: float = 1.3, members: list[str] | None = None,
    artefacts: dict[str, str] | None = None,
) -> DataFrame:
    """Cycles whose fall rate is used. ``artefacts``: series -> peaks before that day are dropped."""
    used = cycles.where(
        (F.col("peak") >= F.lit(since).cast("date")) & (F.col("rise_x") >= min_rise) & F.col("fall_rate").isNotNull()
    )
    for name, day in (artefacts or {}).items():
        used = used.where(~((F.col("series") == name) & (F.col("peak") < F.lit(day).cast("date"))))
    return used.where(F.col("series").isin(members)) if members else used


def param_quantiles(df: DataFrame, value: str, names: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    return exact_quantiles(df, keys or [], value, names)


def decay_path(
    rows: DataFrame, inc: str, ratio: str, start: str, cap: str | None = None, stop: float = STOP_INCREMENT
) -> DataFrame:
    """Add ``peak_q`` and ``further_rise``: increments ``inc * ratio^k`` per quarter while >= ``stop``.

    With a ratio below 1 the increments only shrink, so their number follows from the
    logarithm of ``stop / inc``, or from the months to the cap if these are fewer, and their
    sum is a geometric one. Increments of at least ``stop`` with a ratio of 1 or more never end, so they are an error unless
    a cap ends them.
    """
    i, r = F.col(inc), F.col(ratio)
    refuse = F.raise_error(F.lit("decay ratio must be below 1")).cast("double")
    endless = (r >= 1) & (i * r >= stop) & (F.col(cap).isNotNull() if cap else F.lit(False))
    grows = (r >= 1) & (F.col(cap).isNull() if cap else F.lit(True))
    safe = F.when(grows, refuse).when(r < 1, r).when(r.isNotNull(), F.lit(0.5))
    rough = F.floor(F.ln(F.lit(stop) / i) / F.ln(safe))
    # The logarithms may be off by one at a whole number.
    counted = F.when(i * F.pow(safe, rough + 1) >= stop, rough + 1).when(i * F.pow(safe, rough) >= stop, rough).otherwise(rough - 1)
    steps = F.when((i > 0) & (safe > 0) & (r < 1), F.greatest(counted, F.lit(0))).otherwise(F.lit(0))
    if cap:
        # A growing increment below the stop ends at once; any other goes on to the cap.
        steps = F.when(endless, F.lit(1 << 30)).otherwise(steps)
        left = months_apart(F.col(start), F.col(cap)) - (F.dayofmonth(cap) < F.dayofmonth(start)).cast("int")
        steps = F.when(F.col(cap).isNull(), steps).otherwise(F.least(steps, F.greatest(F.floor(left / 3), F.lit(0))))
    walked = rows.withColumn("__steps", steps.cast("int"))
    n = F.col("__steps")
    total = F.when(r == 1, i * n).when(r > 1, i * r * (F.pow(r, n) - 1) / (r - 1)).otherwise(i * safe * (1 - F.pow(safe, n)) / (1 - safe))
    return walked.withColumn("peak_q", F.add_months(F.col(start), F.col("__steps") * 3)).withColumn(
        "further_rise", F.when(F.col("__steps") > 0, total).otherwise(F.lit(0.0))
    ).drop("__steps")


def cross_scenarios(params: DataFrame, scenarios: dict[str, dict[str, Column]]) -> DataFrame:
    """A row per parameter row and scenario; a scenario names the columns it sets."""
    options = [
        F.struct(F.lit(name).alias("scenario"), *[c.alias(k) for k, c in values.items()])
        for name, values in scenarios.items()
    ]
    return params.select("*", F.inline(F.array(*options)))


def standard_scenarios(cap: str | None = None) -> dict[str, dict[str, Column]]:
    """fast / base / slow from quartiles, crash = no further rise and the fastest fall."""
    none, late = F.lit(None).cast("date"), F.lit(cap).cast("date")
    return {
        "fast": dict(decay_ratio=F.col("decay_q25"), fall_rate=F.col("fall_q75"), cap=none),
        "base": dict(decay_ratio=F.col("decay_q50"), fall_rate=F.col("fall_q50"), cap=none),
        "slow": dict(decay_ratio=F.col("decay_q75"), fall_rate=F.col("fall_q25"), cap=late),
        "crash": dict(decay_ratio=F.lit(0.0), fall_rate=F.col("fall_max"), cap=none),
    }


def rising_peak(rows: DataFrame, asof: str) -> DataFrame:
    """Peak month and size: mid-quarter of the last increment, never before the month after ``asof``.

    ``rows`` has ``ratio_now, last_q, last_inc, decay_ratio, cap``.
    """
    out = decay_path(rows, "last_inc", "decay_ratio", "last_q", "cap")
    next_month = F.add_months(F.lit(asof).cast("date"), 1)
    return out.withColumn("peak", F.greatest(F.add_months("peak_q", 1), next_month)).withColumn(
        "peak_ratio", F.col("ratio_now") * F.exp("further_rise")
    )


def crossing_dates(rows: DataFrame, targets: dict[str, Column | float], bias: Column | int) -> DataFrame:
    """``date_<name>`` and ``date_<name>_adj``: when each target is crossed after the peak."""
    late = bias if isinstance(bias, Column) else F.lit(bias)
    out = {}
    for name, target in targets.items():
        goal = target if isinstance(target, Column) else F.lit(float(target))
        months = F.bround(months_to("peak_ratio", goal, "fall_rate")).cast("int")
        out[f"date_{name}"] = shift_months("peak", months)
        out[f"date_{name}_adj"] = shift_months("peak", months + late)
    return rows.withColumns(out)


def scenario_table(
    levels: DataFrame, scenarios: dict[str, dict[str, Column]], targets: dict[str, Column | float], asof: str,
    bias: Column | int = 0, peaks: dict[str, str] | None = None,
) -> DataFrame:
    """All series times all scenarios in one plan.

    ``levels``: one row per series with ``ratio_now`` and the fitted parameters (and
    ``last_q, last_inc`` unless the peak dates are given in ``peaks``).
    """
    rows = cross_scenarios(levels, scenarios)
    if peaks is None:
        rows = rising_peak(rows, asof)
    else:
        given = F.create_map(*[F.lit(x) for pair in peaks.items() for x in pair])
        rows = rows.withColumns({
            "peak": given[F.col("scenario")].cast("date"), "peak_ratio": F.col("ratio_now"), "further_rise": F.lit(0.0),
        })
    return crossing_dates(rows, targets, bias)


def scenario_paths(table: DataFrame, start: str, end: str, asof: str, bias: Column | int, keep: list[str]) -> DataFrame:
    """Monthly ratio per scenario: nothing up to ``asof``, log-linear to the peak, ``bias`` months
    held, then a steady log decline. ``table`` has ``ratio_now, further_rise, peak, peak_ratio, fall_rate``."""
    late = bias if isinstance(bias, Column) else F.lit(bias)
    now = F.lit(asof).cast("date")
    months = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month")))
    rows = table.select("*", months.alias("month"))
    span = F.greatest(months_apart(now, F.col("peak")), F.lit(1))
    climb = F.col("ratio_now") * F.exp(F.col("further_rise") * months_apart(now, F.col("month")) / span)
    held = F.greatest(months_apart(F.col("peak"), F.col("month")) - late, F.lit(0))
    decline = F.col("peak_ratio") * F.exp(-F.col("fall_rate") * held)
    level = F.when(F.col("month") <= now, F.lit(None).cast("double")).when(
        F.col("month") <= F.col("peak"), climb
    ).otherwise(decline)
    return rows.select(*keep, "month", level.alias("ratio"))


def prior_params(
    decisions: DataFrame, params: DataFrame, at: str, value: str, name: str, min_n: int, weight: str | None = None
) -> DataFrame:
    """For each decision day (a quarter start), the median of parameters strictly before it.

    Decisions share quarters, so parameters are laid out over the quarters that follow them
    and decisions look their quarter up: no decision is paired with every parameter, and
    there are only as many quarters as the calendar has.
    ``weight`` counts source rows (``min_n`` of them are needed), not values.
    """
    days = decisions.select(F.col(at).alias("__d")).distinct()
    last = days.agg(F.max("__d")).scalar()
    following = F.add_months(F.trunc("peak", "QUARTER"), 3)
    laid = (
        params.withColumn("__weight", F.col(weight) if weight else F.lit(1.0))
        .where(following <= last)
        .select(value, "__weight", F.explode(F.sequence(following, last, F.expr("interval 3 month"))).alias("__d"))
        .join(days, "__d", "left_semi")
    )
    medians = exact_quantiles(laid, ["__d"], value, {name: 0.5}, extra={"__n": ("sum", F.col("__weight"))})
    used = medians.where(F.bround("__n") >= min_n).select(F.col("__d").alias(at), name)
    return decisions.join(used, at)


def backtest(series: DataFrame, cycles: DataFrame, timing: DataFrame, fall: DataFrame, min_fall: int = 3, min_timing: int = 2) -> DataFrame:
    """The base method at the matching stage of past cycles, from earlier data only.

    ``cycles`` are the cycles tested, ``timing`` and ``fall`` the pools to learn from. The
    decision falls two quarters after the quarter of the largest increase.
    """
    done = cycles.where(F.col("back_months").isNotNull())
    cases = settle(upswing_decay(series, done, ["p_trough0", "back_months"]).select(
        "series", "peak", "p_trough0", "back_months", "max_q"
    ))  # one row per past cycle, read by both pools
    # Ratios of one upswing share a weight of 1, so that the count is of upswings.
    pool = pooled_ratios(
        timing.withColumn("__w", 1.0 / F.greatest(F.size("decay_ratios"), F.lit(1))), ["peak", "__w"]
    )
    cases = prior_params(cases, pool, "max_q", "ratio", "decay_used", min_timing, weight="__w")
    cases = prior_params(cases, fall.select("peak", "fall_rate"), "max_q", "fall_rate", "fall_used", min_fall)
    cases = cases.withColumn("decision_q", F.add_months("max_q", 6)).join(
        _increments(quarterly_levels(series)), "series"
    )
    known = F.filter("incs", lambda x: x["q"] <= F.col("decision_q"))
    level = F.try_element_at(F.filter("levels", lambda x: x["q"] <= F.col("decision_q")), F.lit(-1))["l"]
    cases = cases.withColumns({"__known": known, "__level": level})
    rising = F.filter("__known", lambda x: x["inc"] > 0)
    last = F.try_element_at("__known", F.lit(-1))
    cases = cases.withColumns({
        "__inc": last["inc"], "__last_q": last["q"],
        "__rose_q": F.coalesce(F.get(rising, F.size(rising) - 1)["q"], last["q"]),
    })
    cases = decay_path(cases, "__inc", "decay_used", "__last_q")
    fallen = F.col("__inc") <= 0
    peak_q = F.when(fallen, F.col("__rose_q")).otherwise(F.col("peak_q"))
    rise = F.when(fallen, F.lit(0.0)).otherwise(F.col("further_rise"))
    months = (F.col("__level") + rise - F.ln("p_trough0")) / F.col("fall_used")
    out = cases.withColumn("pred_peak", F.add_months(peak_q, 1)).withColumns({
        "pred_back": F.add_months("pred_peak", F.bround(months).cast("int")),
        "actual_back": F.add_months("peak", F.col("back_months")),
    })
    return out.select(
        "series", F.col("peak").alias("actual_peak"), "decision_q", "pred_peak", "actual_back", "pred_back",
        months_apart(F.col("peak"), F.col("pred_peak")).alias("peak_err_m"),
        months_apart(F.col("actual_back"), F.col("pred_back")).alias("back_err_m"),
        "decay_used", "fall_used",
    )


def bias_months(tested: DataFrame) -> DataFrame:
    """One row: minus the rounded median return error."""
    found = exact_quantiles(tested, [], "back_err_m", {"__m": 0.5})
    return found.select((-F.bround("__m")).cast("int").alias("bias"))


def latest_increment(series: DataFrame) -> DataFrame:
    """``(series, last_q, last_inc)`` of the newest quarter."""
    rows = _increments(quarterly_levels(series)).where(F.size("incs") > 0)
    last = F.try_element_at("incs", F.lit(-1))
    return rows.select("series", last["q"].alias("last_q"), last["inc"].alias("last_inc"))


def parameter_table(fall: DataFrame, timing: DataFrame) -> DataFrame:
    """The fitted sample as one long table, fall rows and timing rows."""
    a = fall.select(F.lit("fall").alias("kind"), "series", "peak", "rise_x", "fall_rate", "back_months")
    b = timing.select(F.lit("timing").alias("kind"), "series", "peak", "max_q", "lag_q", "decay_first")
    return a.unionByName(b, allowMissingColumns=True)
