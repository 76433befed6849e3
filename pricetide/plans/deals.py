"""Deal posts to accepted prices, reject reasons and monthly series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import deal_rules as R
from ..functions.columns import bucket, in_range, month_number
from ..functions.deals import (
    categorize, chip_model, extract_price, memory_spec, storage_spec, tidy, title_rejects,
)
from ..operators.aggregate import distribution, keep_keys, series_rows, top_categories
from ..operators.joins import repost_gap
from ..operators.layout import keep_rows, read_once
from ..operators.quantiles import exact_quantiles
from ..session import settle

SPEC_COLUMNS = {
    "capacity_gb": "double", "kit": "string", "ddr": "string", "ddr_inferred": "boolean", "speed_mts": "int",
    "cas": "int", "form": "string", "interface": "string", "pcie_gen": "int", "enterprise": "boolean", "model": "string",
}


def parse_titles(posts: DataFrame) -> DataFrame:
    """Posts of a known category with ``reject`` (null = accepted), price and all spec columns.

    ``posts`` has ``id, ts, title, link_flair_text, domain``. Titles that come again are read once: the rules see the text, the
    flair, the domain and whether the post is older than DDR5, and nothing else of a post.
    """
    launch = F.lit(R.DDR5_LAUNCH).cast("date")
    old = F.col("ts").cast("date") < launch
    rows = posts.withColumns({"title": tidy(F.col("title")), "__old": old})
    read = read_once(rows, ["title", "link_flair_text", "domain", "__old"], lambda titles: _read_titles(
        titles.withColumn("ts", F.when(F.col("__old"), F.date_sub(launch, 1)).when(~F.col("__old"), launch))
    ).drop("ts"))
    out = read.select(*posts.columns, "category", "body", "price", *SPEC_COLUMNS, "reject")
    ok = F.col("reject").isNull()
    return out.withColumns({
        "month": bucket("ts"),
        "usd_per_gb": F.when(ok & (F.col("category") == "RAM"), F.col("price") / F.col("capacity_gb")),
        "usd_per_tb": F.when(ok & (F.col("category") == "SSD"), F.col("price") / (F.col("capacity_gb") / 1000)),
    })


def _read_titles(titles: DataFrame) -> DataFrame:
    """Category, reject reason, price and specification of tidied titles, in one projection.

    Later rules see a null text where an earlier rule has rejected the title or the category is another, and skip it.
    """
    rows = categorize(titles, "title", "link_flair_text")
    rows = keep_rows(rows, F.col("category").isNotNull())
    early = title_rejects(
        F.col("title"), F.col("body"), F.col("category"), F.col("multi_tag"), F.col("domain"), F.col("link_flair_text")
    )
    rows = rows.withColumn("__early", early).withColumn("__open", F.when(F.col("__early").isNull(), F.col("body")))
    rows = extract_price(rows, "__open")
    readers = {
        "RAM": lambda df, text: memory_spec(df, text, "ts"),
        "SSD": lambda df, text: storage_spec(df, text, "link_flair_text"),
        "CPU": lambda df, text: chip_model(df, text, "CPU"),
        "GPU": lambda df, text: chip_model(df, text, "GPU"),
    }
    held, names = rows.columns, ["spec_reject", *SPEC_COLUMNS]
    for category, reader in readers.items():
        text = f"__{category}"
        readable = (F.col("category") == category) & F.col("price").isNotNull()
        read = reader(rows.withColumn(text, F.when(readable, F.col("__open"))), text)
        new = [c for c in read.columns if c in names]
        rows = read.select(*[c for c in read.columns if c not in [*names, text]], *[F.col(c).alias(f"{category}_{c}") for c in new])

    def read_column(name: str) -> Column:
        value = F.lit(None)
        for category in readers:
            if f"{category}_{name}" in rows.columns:
                value = F.when(F.col("category") == category, F.col(f"{category}_{name}")).otherwise(value)
        return value

    spec_reject = F.when(F.col("price").isNotNull(), read_column("spec_reject"))
    outside = ~in_range("price", "category", R.PRICE_BOUNDS)
    reject = F.coalesce(
        F.col("__early"), F.col("price_reason"), spec_reject, F.when(outside, F.lit("price_out_of_range"))
    )
    return rows.select(
        *[c for c in held if c not in ("__early", "__open", "price_reason", "multi_tag")],
        *[read_column(n).cast(t).alias(n) for n, t in SPEC_COLUMNS.items()], reject.alias("reject"),
    )


def flag_outliers(
    df: DataFrame, group: list[str], month: str, value: str, low: float | Column, high: float | Column,
    min_n: int = R.OUTLIER_MIN_ROWS,
) -> DataFrame:
    """Add ``is_outlier``: value over the median of its group in months m-1..m+1 outside [low, high].

    ``month`` is an integer period. Values are counted per (group, month) before they are
    laid out over the three windows they belong to. Rows with a null group key are never
    flagged, nor windows with fewer than ``min_n`` rows.
    """
    known = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])
    counted = df.where(known & F.col(value).isNotNull()).groupBy(*group, month, F.col(value).alias("__v")).agg(
        F.count(F.lit(1)).alias("__times")
    )
    laid = counted.select(
        *group, "__v", "__times", F.explode(F.array(*[F.col(month) + k for k in (-1, 0, 1)])).alias(month)
    )
    wide = exact_quantiles(
        laid, [*group, month], "__v", {"__median": 0.5}, count="__n", weight="__times"
    )
    joined = df.join(wide, [*group, month], "left")
    ratio = F.col(value) / F.col("__median")
    flagged = (F.col("__n") >= min_n) & ((ratio > high) | (ratio < low))
    return joined.withColumn("is_outlier", F.coalesce(flagged, F.lit(False))).drop("__median", "__n")


def judge(parsed: DataFrame) -> DataFrame:
    """Add reposts and outliers to ``reject``; a repost wins, and medians still count reposts."""
    parsed = settle(parsed)  # read by every check below, and no filter is pushed into the title rules
    accepted = parsed.where(F.col("reject").isNull())
    norm = F.trim(F.regexp_replace(F.lower("title"), r"[^a-z0-9$.]+", " "))
    seen = repost_gap(accepted.withColumn("__norm", norm), ["__norm", "price"], "ts", "id", R.REPOST_DAYS)
    by_unit = F.col("category").isin("RAM", "SSD")
    seen = seen.withColumns({
        "__group": F.coalesce(F.when(F.col("category") == "RAM", F.col("ddr")).when(F.col("category") == "SSD", F.col("interface")).otherwise(F.col("model"))),
        "__period": month_number("ts"),
        "__value": F.when(F.col("category") == "RAM", F.col("usd_per_gb")).when(F.col("category") == "SSD", F.col("usd_per_tb")).otherwise(F.col("price")),
    })
    low = F.when(by_unit, R.OUTLIER_BOUNDS["unit"][0]).otherwise(R.OUTLIER_BOUNDS["model"][0])
    high = F.when(by_unit, R.OUTLIER_BOUNDS["unit"][1]).otherwise(R.OUTLIER_BOUNDS["model"][1])
    seen = flag_outliers(seen, ["category", "__group"], "__period", "__value", low, high)
    reject = F.when(F.col("is_repost"), "duplicate_repost").when(F.col("is_outlier"), "outlier")
    judged = seen.withColumn("reject", reject).select(*parsed.columns)
    return judged.unionByName(parsed.where(F.col("reject").isNotNull()))


def series_definitions() -> dict[str, tuple[Column, str]]:
    """The named memory and storage series."""
    c = F.col
    dimm = (c("category") == "RAM") & (c("form") == "dimm") & c("capacity_gb").between(8, 128)
    drive = (c("category") == "SSD") & ~F.coalesce(c("enterprise"), F.lit(False)) & c("capacity_gb").between(900, 4200)

    def kit(gen: str, size: int, config: str) -> Column:
        return dimm & (c("ddr") == gen) & (c("capacity_gb") == size) & (c("kit").isNull() | (c("kit") == config))

    return {
        "ram_ddr4_usd_per_gb": (dimm & (c("ddr") == "DDR4"), "usd_per_gb"),
        "ram_ddr5_usd_per_gb": (dimm & (c("ddr") == "DDR5"), "usd_per_gb"),
        "ram_ddr5_32gb_kit_usd": (kit("DDR5", 32, "2x16GB"), "price"),
        "ram_ddr4_16gb_kit_usd": (kit("DDR4", 16, "2x8GB"), "price"),
        "ssd_nvme_usd_per_tb": (drive & (c("interface") == "NVMe"), "usd_per_tb"),
        "ssd_sata_usd_per_tb": (drive & (c("interface") == "SATA"), "usd_per_tb"),
        "ssd_nvme_2tb_usd": (drive & (c("interface") == "NVMe") & c("capacity_gb").between(1900, 2100), "price"),
    }


def monthly_series(accepted: DataFrame, recent_since: str = "2025-01-01") -> DataFrame:
    """Monthly quartiles of the named series and of the most posted chip models, in one roll-up."""
    rows = series_rows(accepted, series_definitions(), ["ts"])
    for category in ("CPU", "GPU"):
        chips = accepted.where(F.col("category") == category)
        top = top_categories(chips, "model", 15, "ts", recent_since, 8)
        name = F.concat(F.lit(category.lower() + ":"), F.col("model"))
        rows = rows.unionByName(keep_keys(chips, top, ["model"]).select("ts", name.alias("series"), F.col("price").alias("value")))
    return distribution(rows, ["series"], "ts", "value")


def post_counts(judged: DataFrame) -> DataFrame:
    """``(series, month, n)``: posts of each category before any rejection, accepted ones, and all posts.

    A post counts in up to three series, all in one pass and one combining aggregation.
    """
    known = F.col("category").isNotNull()
    names = F.array_compact(F.array(
        F.lit("posts_all"), F.when(known, F.concat(F.lit("posts_"), F.lower("category"))),
        F.when(known & F.col("reject").isNull(), F.concat(F.lit("accepted_"), F.lower("category"))),
    ))
    return judged.select(F.explode(names).alias("series"), bucket("ts").alias("month")).groupBy("series", "month").agg(F.count(F.lit(1)).alias("n"))
