"""Roll-ups: series by period, shares, baskets, coverage, catalogues, comparisons.

Every aggregate here combines on the map side; quantiles go through ``exact_quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket, guarded_ratio
from .quantiles import exact_quantiles
from .segments import equi_depth


def monthly(
    df: DataFrame, keys: list[str], ts: str, value: str, how: str = "median", grain: str = "month",
    name: str = "value", count: str | None = None,
) -> DataFrame:
    """One row per key and period: the median or minimum of the observations."""
    placed = df.withColumn(grain, bucket(ts, grain)).where(F.col(value).isNotNull())
    if how == "min":
        extra = [F.count(F.lit(1)).alias(count)] if count else []
        return placed.groupBy(*keys, grain).agg(F.min(value).alias(name), *extra)
    return exact_quantiles(placed, [*keys, grain], value, {name: 0.5}, count=count)


def distribution(
    df: DataFrame, keys: list[str], ts: str, value: str, grain: str = "month",
    quantiles: dict[str, float] | None = None,
) -> DataFrame:
    wanted = quantiles or {"median": 0.5, "p25": 0.25, "p75": 0.75}
    placed = df.withColumn(grain, bucket(ts, grain))
    return exact_quantiles(placed, [*keys, grain], value, wanted, count="n")


def series_rows(df: DataFrame, definitions: dict[str, tuple[Column, str]], keep: list[str]) -> DataFrame:
    """One pass for many named series: a row for each definition whose predicate holds."""
    members = [
        F.when(predicate, F.struct(F.lit(name).alias("series"), F.col(value).cast("double").alias("value")))
        for name, (predicate, value) in definitions.items()
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*members))))


def series_union(df: DataFrame, definitions: dict[str, tuple[Column, str]], ts: str, **options) -> DataFrame:
    return distribution(series_rows(df, definitions, [ts]), ["series"], ts, "value", **options)


def item_month(
    quotes: DataFrame, keys: list[str], ts: str, value: str, item: str, tie: str | None = None,
) -> DataFrame:
    """Median price, last item name and date, and count per key and month."""
    last = F.struct(F.col(ts).cast("date").alias("date"), *([F.col(tie).alias("tie")] if tie else []), F.col(item).alias("item"))
    found = exact_quantiles(
        quotes.withColumn("month", bucket(ts)), [*keys, "month"], value, {"p": 0.5}, count="n",
        extra={"last": ("max", last)},
    )
    return found.select(*keys, "month", "p", F.col("last.item").alias("item"), F.col("last.date").alias("date"), "n")


def two_level(df: DataFrame, outer: list[str], inner: list[str], value: str, name: str = "value", **options) -> DataFrame:
    """Median per inner member, then the mean over members."""
    members = exact_quantiles(df, [*outer, *inner], value, {"__m": 0.5}, **options)
    return members.groupBy(*outer).agg(F.avg("__m").alias(name))


def basket(df: DataFrame, keys: list[str], price: str, in_stock: str) -> DataFrame:
    """Lowest price in stock, lowest and median of all listings, listing counts."""
    available = F.coalesce(F.col(in_stock), F.lit(False))
    return exact_quantiles(
        df, keys, price, {"median_listing": 0.5}, count="n_listings",
        extra={
            "price": ("min", F.when(available, F.col(price))),
            "min_any_listing": ("min", F.col(price)),
            "n_in_stock": ("sum", available.cast("long")),
        },
    )


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "value") -> DataFrame:
    """Mean by positive weights; rows without value or weight do not count."""
    used = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    return used.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(name))


def share(df: DataFrame, keys: list[str], num: str, den: str, scale: float = 1.0, name: str = "share") -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum(num).alias(num), F.sum(den).alias(den))
    return sums.withColumn(name, scale * guarded_ratio(num, den))


def complete_only(
    df: DataFrame, keys: list[str], member: str, n_members: int, sums: list[str], members: list[str] | None = None
) -> DataFrame:
    """Sums only for groups in which every member reported."""
    used = df.where(F.col(member).isin(members)) if members else df
    per_member = used.groupBy(*keys, member).agg(*[F.sum(c).alias(c) for c in sums])
    whole = per_member.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), *[F.sum(c).alias(c) for c in sums])
    return whole.where(F.col("__m") == n_members).drop("__m")


def rollup_alias(df: DataFrame, alias: DataFrame, term: str, keys: list[str], value: str, suffix: str = "+aliases") -> DataFrame:
    """Total over a title and its former titles; ``alias`` is ``(alias, target)``."""
    named = df.join(alias.withColumnRenamed("alias", term), term, "left")
    return (
        named.withColumn(term, F.coalesce("target", term)).groupBy(term, *keys).agg(F.sum(value).alias(value))
        .withColumn(term, F.concat(term, F.lit(suffix)))
    )


def top_categories(
    df: DataFrame, category: str, k: int, ts: str | None = None, recent_since: str | None = None, k_recent: int = 0
) -> DataFrame:
    """The k most frequent categories, plus the most frequent since a date; ties by name."""
    recent = F.count_if(F.col(ts) >= F.lit(recent_since).cast("date")) if recent_since else F.lit(0).cast("long")
    counts = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("n"), recent.alias("n_recent"))
    best = limit_top(counts, [F.desc("n"), F.asc(category)], k).select(category)
    if not recent_since:
        return best
    newest = limit_top(counts.where(F.col("n_recent") > 0), [F.desc("n_recent"), F.asc(category)], k_recent)
    return best.union(newest.select(category)).distinct()


def limit_top(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def keep_keys(df: DataFrame, keys_df: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys_df.select(*on), on, "left_semi")


def status_crosstab(df: DataFrame, category: str, status: str, statuses: list[str]) -> DataFrame:
    """Category by status counts, with a total column."""
    counts = df.groupBy(category).pivot(status, statuses).count().na.fill(0, statuses)
    total = sum((F.col(f"`{s}`") for s in statuses[1:]), F.col(f"`{statuses[0]}`"))
    return counts.withColumn("total", total)


def volume_by_category(df: DataFrame, category: str, month: str) -> DataFrame:
    """Posts per month by category and, with a null category, overall."""
    sets = [[F.col(month), F.col(category)], [F.col(month)]]
    return df.groupingSets(sets, month, category).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(category).cast("int").alias("is_total")
    )


def id_span(df: DataFrame, id_col: str, ts: str, grain: str = "month") -> DataFrame:
    """Items per period from the growth of a running id: last id minus the previous last id."""
    last = df.groupBy(bucket(ts, grain).alias(grain)).agg(F.max(id_col).alias("last_id"))
    in_order = Window.partitionBy(F.lit(1)).orderBy(grain)  # one row per period
    return last.withColumn("n_items", F.col("last_id") - F.lag("last_id").over(in_order))


def growth(df: DataFrame, keys: list[str], ratio: str, years: str) -> DataFrame:
    """Geometric mean step and annualised total of chained ratios; rows without a ratio do not count."""
    logs = F.ln(ratio)
    used = F.when(F.col(ratio).isNotNull(), F.col(years))
    return df.groupBy(*keys).agg(
        F.count(ratio).alias("n_steps"),
        F.sum(used).alias("years"),
        (F.exp(F.avg(logs)) - 1).alias("geo_mean"),
        F.when(F.sum(used) > 0, F.exp(F.sum(logs) / F.sum(used)) - 1).alias("annualized"),
    )


def baseline_ratio(
    df: DataFrame, keys: list[str], ts: str, value: str, normal: tuple[str, str], now: tuple[str, str]
) -> DataFrame:
    """Means over the normal and the present window in one pass, and their ratio."""
    day = F.col(ts).cast("date")

    def mean(span: tuple[str, str]) -> Column:
        return F.avg(F.when(day.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")), F.col(value)))

    means = df.groupBy(*keys).agg(mean(normal).alias("normal"), mean(now).alias("now"))
    return means.withColumn("ratio", guarded_ratio("now", "normal"))


def before_after(
    df: DataFrame, keys: list[str], ts: str, value: str, before: tuple[str, str], after: tuple[str, str],
    units: str | None = None, unit_cost: Column | None = None,
) -> DataFrame:
    """Medians and counts of two windows, the change, and the part a unit cost explains."""
    day = F.col(ts).cast("date")

    def within(span: tuple[str, str]) -> Column:
        return day.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))

    tagged = df.withColumn("__w", F.when(within(before), "before").when(within(after), "after")).where("__w IS NOT NULL")
    held = [*keys, *([units] if units else [])]
    medians = exact_quantiles(tagged, [*held, "__w"], value, {"m": 0.5}, count="n")

    def side(name: str, col: str) -> Column:
        return F.max(F.when(F.col("__w") == name, F.col(col)))

    out = medians.groupBy(*held).agg(
        side("before", "m").alias("deal_before"), F.coalesce(side("before", "n"), F.lit(0)).alias("n_before"),
        side("after", "m").alias("deal_now"), F.coalesce(side("after", "n"), F.lit(0)).alias("n_now"),
    ).withColumn("change", F.col("deal_now") - F.col("deal_before"))
    return attribute(out, units, unit_cost) if units else out


def attribute(df: DataFrame, units: str, unit_cost: Column, change: str = "change") -> DataFrame:
    """Cost change per unit times units, and its share of the whole change."""
    cost = unit_cost * F.col(units)
    return df.withColumn("cost_change", cost).withColumn("share_of_change", F.try_divide(cost, F.col(change)))


def derive_ratios(df: DataFrame, keys: list[str], metric: str, value: str, start: str, end: str) -> DataFrame:
    """Margin % and inventory days from metrics in rows, each with its fallback; ``margin_from`` tells what the margin is of."""
    wanted = ["revenue", "gross_profit", "cost_of_revenue", "inventory"]
    held = list(dict.fromkeys([*keys, start, end]))
    wide = df.where(F.col(metric).isin(wanted)).groupBy(*held).pivot(metric, wanted).agg(F.first(value, ignorenulls=True))
    profit = F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue"))
    cost = F.coalesce("cost_of_revenue", F.col("revenue") - profit)
    days = F.datediff(end, start) + 1
    source = F.when(F.col("gross_profit").isNotNull(), "gross_profit/revenue").otherwise("(revenue-cost_of_revenue)/revenue")
    return (
        wide.where(F.col("revenue").isNotNull())
        .withColumn("gross_margin_pct", F.bround(100 * F.try_divide(profit, F.col("revenue")), 2))
        .withColumn("inventory_days", F.when(cost > 0, F.bround(F.col("inventory") / cost * days, 1)))
        .withColumn("margin_from", F.when(F.col("gross_margin_pct").isNotNull(), source))
        .select(*held, "gross_margin_pct", "inventory_days", "margin_from")
    )


def catalogue(df: DataFrame, key: str, ts: str, value: str, wanted: DataFrame | None = None) -> DataFrame:
    """First and last date, count and last value per series; wanted series without rows have n = 0."""
    day = F.col(ts).cast("date")
    found = df.groupBy(key).agg(
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.count(value).alias("n"), F.max(F.struct(day.alias("d"), F.col(value).alias("v"))).alias("__last"),
    ).select(key, "first_date", "last_date", "n", F.col("__last.v").alias("last_value"))
    if wanted is None:
        return found
    absent = wanted.select(key).distinct().join(found, key, "left_anti")
    return found.unionByName(absent.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)


def coverage(df: DataFrame, reference: DataFrame, keys: list[str], got: str, total: str, digits: int = 3) -> DataFrame:
    return df.join(reference, keys, "left").withColumn("ratio", F.bround(guarded_ratio(got, total), digits))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of each distinct value, ties averaged.

    Values are counted first, then cut into pieces of like many distinct values: the running count is a window over the
    pieces, a bounded number for each key, plus a window inside each piece.
    """
    counts = equi_depth(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), keys, value, "__b")
    per_piece = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__nb"))
    lower = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.withColumn("__below", F.coalesce(F.sum("__nb").over(lower), F.lit(0))).drop("__nb")
    inside = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("__below") + F.col("__in") - (F.col("__n") - 1) / 2.0
    return (
        counts.withColumn("__in", F.sum("__n").over(inside)).join(offsets, [*keys, "__b"])
        .select(*keys, value, rank.alias(name))
    )


def rank_corr(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Spearman correlation: Pearson correlation of the average ranks."""
    keys = keys or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both
    for value in (x, y):
        ranked = ranked.join(average_ranks(both, keys, value, f"__r_{value}"), [*keys, value])
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(f"__r_{x}", f"__r_{y}").alias("rank_corr")
    )


def peak_latest(df: DataFrame, keys: list[str], ts: str, value: str, drop_partial: bool = False) -> DataFrame:
    """Maximum and when (first of ties), and the last value; optionally without the newest period."""
    used = df.where(F.col(value).isNotNull())
    if drop_partial:
        newest = used.groupBy(*keys).agg(F.max(ts).alias("__newest"))
        used = used.join(newest, keys).where(F.col(ts) < F.col("__newest"))
    return used.groupBy(*keys).agg(
        F.max(value).alias("peak"),
        F.min_by(ts, F.struct((-F.col(value)).alias("v"), F.col(ts).alias("t"))).alias("peak_at"),
        F.max_by(value, ts).alias("latest"), F.max(ts).alias("latest_at"),
    )


def align(frames: list[DataFrame], on: str, metric: str, value: str, names: list[str]) -> DataFrame:
    """Many long series side by side: one union and one pivot instead of chained outer joins."""
    long = frames[0]
    for frame in frames[1:]:
        long = long.unionByName(frame)
    return long.groupBy(on).pivot(metric, names).agg(F.first(value, ignorenulls=True))


def zero_fill(grid: DataFrame, counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts on every covered key, zero where nothing was seen; uncovered keys stay absent."""
    return grid.select(*keys).distinct().join(counts.select(*keys, *columns), keys, "left").na.fill(0, columns)


def horizon(df: DataFrame, ts: str, measure: str, reference: str) -> DataFrame:
    """Drop rows later than the last date of the reference measure."""
    last = df.where(F.col(measure) == reference).agg(F.max(ts)).scalar()
    return df.where(F.col(ts) <= last)


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table on every row, as a scalar subquery rather than a join."""
    names = one_row.columns
    held = df.withColumn("__one", one_row.select(F.struct(*names)).scalar())
    return held.select(*df.columns, *[F.col("__one")[n].alias(n) for n in names])
