"""Labelled quarters from filed facts: equivalent tags merged, year-to-date sums taken apart, ratios derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import filings as L
from ..operators.joins import first_per, interval_label

# Forms that count, and the tags of each metric. Tags of one group are equivalents; later groups are fallbacks.
FORMS = ["10-K", "10-Q", "10-K/A", "10-Q/A", "10-KT", "10-QT"]
METRICS = {
    "revenue": ("duration", [
        ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
        ["SalesRevenueGoodsNet"],
    ]),
    "cost_of_revenue": ("duration", [["CostOfRevenue", "CostOfGoodsAndServicesSold"], ["CostOfGoodsSold"]]),
    "gross_profit": ("duration", [["GrossProfit"]]),
    "operating_income": ("duration", [["OperatingIncomeLoss"]]),
    "capex": ("duration", [["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]]),
    "inventory": ("instant", [["InventoryNet"]]),
}
# Columns that place a fact: its metric and the tag's rank in it.
PLACE = ["metric", "kind", "group_rank", "tag_no", "tag"]


def latest_facts(facts: DataFrame, entity: str, metrics: dict = METRICS) -> DataFrame:
    """The last filed value per entity, metric, tag and period.

    ``facts`` has ``entity, tag, start, end, val, form, filed, accn``. Tags without a metric, other forms and flows without a
    start go; a tag of two metrics counts for both. The start of a stock is not heeded, so it is null here.
    """
    uses: dict[str, list] = {}
    for metric, (kind, groups) in metrics.items():
        ranked = [(rank, tag) for rank, tags in enumerate(groups) for tag in tags]
        for number, (rank, tag) in enumerate(ranked):
            values = zip((metric, kind, rank, number), PLACE, strict=False)
            uses.setdefault(tag, []).append(F.struct(*[F.lit(v).alias(c) for v, c in values]))
    by_tag = F.create_map(*[x for tag, places in uses.items() for x in (F.lit(tag), F.array(*places))])
    counted = facts.where(F.col("form").isin(FORMS) & F.col("tag").isin(list(uses)))
    placed = counted.select(
        entity, "tag", "start", "end", F.col("val").cast("double").alias("val"), "form", "filed", "accn", F.inline(by_tag[F.col("tag")])
    )
    stock = F.col("kind") == "instant"
    rows = placed.where(stock | F.col("start").isNotNull()).withColumn("start", F.when(~stock, F.col("start")))
    return L.latest_wins(rows, [entity, *PLACE, "start", "end"], ["filed", "accn"])


def quarter_candidates(latest: DataFrame, entity: str) -> DataFrame:
    """One value per entity, tag and quarter end.

    Starts that are off by a day do not make a second quarter: reported beats differences, then the last filed counts, then
    the earliest start.
    """
    flows = L.ytd_to_discrete(latest.where("kind = 'duration'"), [entity, *PLACE])
    order = [
        (F.col("derivation") == "reported").alias("r"), F.col("filed").alias("f"), F.col("accn").alias("a"),
        (-F.unix_date("start")).alias("s"),
    ]
    one = first_per(flows, [entity, *PLACE, "end"], order, last=True)
    return one.unionByName(latest.where("kind = 'instant'").withColumn("derivation", F.lit("reported")))


def quarterly_conflicts(latest: DataFrame, entity: str, rel_tol: float = 0.005) -> DataFrame:
    """Reported equivalents of one quarter that disagree, with tags, values and filing dates of both."""
    rows = quarter_candidates(latest, entity)
    return L.conflicts(rows, [entity, "metric", "group_rank", "end"], "tag_no", "val", "derivation", ["filed", "accn"], "tag", rel_tol).drop("group_rank")


def quarterly_financials(latest: DataFrame, entity: str, first_year: int = 2014) -> DataFrame:
    """Quarters per entity and metric with fiscal and calendar labels, then margin and inventory days.

    A metric takes the first group that has the quarter. Stocks count at ends of quarters that some flow has, and get its
    earliest start. Quarters that end before ``first_year`` go. Derived rows have no tag, form and filing.
    """
    keys = [entity, "metric", "kind", "end"]
    chosen = L.priority_coalesce(quarter_candidates(latest, entity), keys, "group_rank", "derivation", ["filed", "accn"], "tag_no")
    # One row per metric in a window.
    earliest = F.min("start").over(Window.partitionBy(entity, "end"))
    dated = chosen.withColumn("start", F.coalesce("start", earliest)).where(F.col("start").isNotNull() & (F.year("end") >= first_year))
    years = L.fiscal_years(latest.where("kind = 'duration'"), entity)
    labelled = interval_label(dated, years, entity).withColumn("fiscal_quarter", F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string")))
    labels = [entity, "period_start", "period_end", "fiscal_year", "fiscal_quarter", "calendar_quarter"]
    rows = labelled.withColumn("calendar_quarter", L.calendar_quarter("start", "end")).withColumnsRenamed(
        {"start": "period_start", "end": "period_end", "val": "value"}
    ).select(*labels, "metric", "value", F.lit("USD").alias("unit"), "tag", "derivation", "form", "filed", "accn")
    wide = A.derive_ratios(rows, labels, "metric", "value", "period_start", "period_end")

    def derived(metric: str, unit: str, how: Column) -> Column:
        row = F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("value"), F.lit(unit).alias("unit"), how.alias("derivation"))
        return F.when(F.col(metric).isNotNull(), row)

    ratios = wide.select(*labels, F.inline(F.array_compact(F.array(
        derived("gross_margin_pct", "pct", F.col("margin_from")),
        derived("inventory_days", "days", F.lit("inventory/cost_of_revenue*days_in_quarter")),
    ))))
    return rows.unionByName(ratios, allowMissingColumns=True)
