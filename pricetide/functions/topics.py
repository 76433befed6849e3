"""Topic and tone flags of discussion titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists that decide a title's flags. Titles are lower-cased first.
TOPIC = [r"\b(ram|rams|dram|ddr4|ddr5)\b"]
PRICE = [
    r"\b(price|prices|priced|pricing|cost|costs|costly|expensive|cheap|cheaper|cheapest|"
    r"overpriced|afford|affordable|msrp|shortage|shortages|inflation|inflated|gouging|scalp\w*)\b"
]
NEGATIVE = [
    r"price (hike|hikes|increase|increases|surge|spike|spikes|jump)", r"prices? (went|going|are going|keep going) up",
    r"\bsky ?rocket\w*", r"\bshortage", r"\bexpensive\b", r"\boverpriced\b", r"\binsane\b", r"\bridiculous\b",
    r"\bcrazy\b", r"\babsurd\b", r"\bgouging\b", r"\bscalp\w*", r"\binflat\w*", r"\brising\b", r"\bdoubled\b",
    r"\btripled\b", r"can'?t afford", r"\bcrisis\b", r"\bexplod\w*", r"through the roof", r"\bspik\w*", r"\bsurg\w*",
    r"higher prices?", r"prices? (are |is )?(so |still |too )?high\b", r"\bworsen\w*",
]
POSITIVE = [
    r"\bcheaper\b", r"\bcheap\b", r"price (drop|drops|dropped|cut|cuts|fall|falling)",
    r"prices? (dropp?\w*|fell|falling|crash\w*)", r"(came|coming|going|come|go) (back )?down", r"back to normal",
    r"\bfinally\b", r"(good|great) deal", r"\bsteal\b", r"all[- ]time low", r"lowest price", r"\bon sale\b",
]
WAITING = [
    r"\bwait\b", r"\bwaiting\b", r"hold off", r"\bbuy (it )?now\b", r"now or later",
    r"should i (buy|get) (it |ram |this )?now", r"when will", r"will (ram |memory |ddr\d )?prices", r"\bhedge\b",
    r"before prices", r"will .{0,40}(go|come) (back )?down",
]
TITLE_RULES = {"topic": TOPIC, "price": PRICE, "neg": NEGATIVE, "pos": POSITIVE, "wait": WAITING}


def any_of(col: Column, patterns: list[str]) -> Column:
    return col.rlike("|".join(f"(?:{p})" for p in patterns))


def topic_flags(df: DataFrame, title: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Boolean columns per rule list; a waiting title is not counted as relief."""
    text = F.lower(F.coalesce(F.col(title), F.lit("")))
    flags = {name: any_of(text, patterns) for name, patterns in (rules or TITLE_RULES).items()}
    if "pos" in flags and "wait" in flags:
        flags["pos"] = flags["pos"] & ~flags["wait"]
    return df.withColumns({f"is_{name}": flag for name, flag in flags.items()})


def attention(posts: DataFrame, totals: DataFrame, covered: DataFrame, members: list[str]) -> DataFrame:
    """Counts per covered (term, date), the all-members sum, rates per 1,000 posts and net tone.

    ``posts`` is ``(term, date, title)``, ``totals`` ``(term, date, posts_total)`` and
    ``covered`` the ``(term, date)`` pairs scanned: those get real zeros, others no rows.
    """
    from ..operators.aggregate import complete_only, zero_fill
    from .columns import guarded_ratio, net_tone

    tagged = topic_flags(posts, "title").where("is_topic")
    counted = {
        "posts": F.lit(True), "price": F.col("is_price"), "price_neg": F.col("is_price") & F.col("is_neg"),
        "price_pos": F.col("is_price") & F.col("is_pos"), "neg": F.col("is_neg"), "pos": F.col("is_pos"),
        "wait": F.col("is_wait"),
    }
    keys = ["term", "date"]
    counts = tagged.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    filled = zero_fill(covered, counts, keys, list(counted)).join(totals, keys, "left")
    every = complete_only(filled, ["date"], "term", len(members), [*counted, "posts_total"], members)
    wide = filled.unionByName(every.withColumn("term", F.lit("ALL")))
    rates = {
        f"{n}_per_1k": 1000 * guarded_ratio(n, "posts_total") for n in ("posts", "price", "price_neg", "neg", "wait")
    }
    # Tone uses every topic title, not only those about price.
    return wide.withColumns({**rates, "net_tone": net_tone("pos", "neg")})


def news_monthly(daily: DataFrame, articles: str, monitored: str, tone: str) -> DataFrame:
    """Daily ``(date, term, metric, value)`` news volume and tone to months.

    Tone is weighted by articles; days without articles report 0 and do not count, and a
    term without volume yields nothing.
    """
    from .columns import bucket, guarded_ratio

    wide = daily.groupBy("term", "date").pivot("metric", [articles, monitored, tone]).agg(F.first("value", ignorenulls=True))
    n, all_n, t = F.col(f"`{articles}`"), F.col(f"`{monitored}`"), F.col(f"`{tone}`")
    counts = (n > 0) & t.isNotNull()
    months = wide.groupBy("term", bucket("date").alias("month")).agg(
        F.count(n).alias("__days"), F.sum(n).alias("articles"), F.sum(all_n).alias("__all"),
        F.sum(F.when(counts, t * n)).alias("__tn"), F.sum(F.when(counts, n)).alias("__n"),
    ).where("__days > 0")
    return months.select(
        "term", "month", "articles", guarded_ratio("articles", "__all").alias("share_of_monitored"),
        guarded_ratio("__tn", "__n").alias("avg_tone"),
    )
