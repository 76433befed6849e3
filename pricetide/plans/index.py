"""Matched-model chain index over item-months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cutover, item_spec
from ..operators.joins import drop_stale
from ..operators.quantiles import exact_quantiles
from ..session import settle


def _observed_months(items: DataFrame, section: list[str], month: str) -> DataFrame:
    """Each section's observed months with the observed month before."""
    before = Window.partitionBy(*section).orderBy(month)
    return items.select(*section, month).distinct().withColumn("__prev_month", F.lag(month).over(before))


def matched_links(items: DataFrame, section: list[str], key: str, month: str, price: str) -> DataFrame:
    """Log price change of every item quoted in two consecutive observed months of its section.

    Rows of one (item, month) are averaged first. An item's earlier price is a ``lag`` along
    the item; it links only if it stands in the section's previous observed month. Items have
    at most one row per calendar month here, so the window is small for any item.
    """
    points = settle(items.groupBy(*section, key, month).agg(F.avg(price).alias("__p")))  # read for its months and for its links
    along = Window.partitionBy(*section, key).orderBy(month)
    seen = points.withColumns({"__last_month": F.lag(month).over(along), "__last_p": F.lag("__p").over(along)})
    linked = seen.join(_observed_months(points, section, month), [*section, month])
    return linked.where(F.col("__last_month") == F.col("__prev_month")).select(
        *section, key, month, F.ln(F.col("__p") / F.col("__last_p")).alias("change")
    )


def chain_index(
    items: DataFrame, base: str, section: list[str] | None = None, key: str = "key", month: str = "month",
    price: str = "price", unit_price: str | None = None,
) -> DataFrame:
    """Running product of median matched changes, 100 in the ``base`` month (YYYY-MM-01).

    A month without matched items carries the level on with ``n_link_items = 0``; the first
    month has level 0 and no count. A section that lacks the base month is an error.
    """
    section = section or []
    items = settle(items)  # read for links, months and the unit summary
    links = exact_quantiles(
        matched_links(items, section, key, month, price), [*section, month], "change", {"__step": 0.5},
        count="__n",
    )
    months = _observed_months(items, section, month).join(links, [*section, month], "left")
    # From here on one row per section and calendar month.
    part = section or [F.lit(1)]
    order = Window.partitionBy(*part).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    level = months.withColumn("log_level", F.sum(F.coalesce("__step", F.lit(0.0))).over(order)).withColumn(
        "n_link_items", F.when(F.col("__prev_month").isNotNull(), F.coalesce("__n", F.lit(0)))
    )
    at_base = F.max(F.when(F.col(month) == F.lit(base).cast("date"), F.col("log_level"))).over(Window.partitionBy(*part))
    lacking = F.raise_error(F.lit(f"base month {base} not observed")).cast("double")
    index = level.withColumn("__base", at_base).withColumn(
        "index", 100 * F.exp(F.col("log_level") - F.coalesce("__base", lacking))
    ).select(*section, month, "log_level", "n_link_items", "index")
    if not unit_price:
        return index
    return index.join(unit_summary(items, [*section, month], unit_price), [*section, month], "left")


def unit_summary(items: DataFrame, keys: list[str], unit_price: str) -> DataFrame:
    return exact_quantiles(
        items, keys, unit_price, {f"{unit_price}_median": 0.5}, count="n_items",
        extra={f"{unit_price}_min": ("min", F.col(unit_price))},
    )


def select_items(df: DataFrame, name: str, pattern: str, exclude: str | None = None) -> DataFrame:
    chosen = F.col(name).rlike(pattern)
    return df.where(chosen & ~F.col(name).rlike(exclude) if exclude else chosen)


def spliced(df: DataFrame, section: str, ts: str, after: str, day: str) -> DataFrame:
    """Several sections as one series: ``after`` throughout, the others before ``day``."""
    return df.where(cutover(section, ts, after, day))


def monthly_items(months: DataFrame, sections: list[str], frozen_run: int | None = None) -> DataFrame:
    """Item-months of the sections with generation, density and price per Gb.

    ``months`` is ``item_month`` output with ``section`` and ``key``. ``frozen_run`` drops the
    repeats of a price that stands still for so many rows of an item: right for spot prices,
    which move daily, and wrong for contract prices.
    """
    rows = months.where(F.col("section").isin(*sections))
    if frozen_run:
        rows = drop_stale(rows, ["key"], ["date", "section"], "p", F.trunc("date", "YEAR"), frozen_run)
    rows = rows.withColumn("__spec", item_spec("item"))
    return rows.select(
        "section", "month", "key", "item", F.col("p").alias("price"), "__spec.generation", "__spec.density_gb",
        F.col("n").alias("n_obs"), (F.col("p") / F.col("__spec.density_gb")).alias("usd_per_gb"),
    )
