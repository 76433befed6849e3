"""Index and series roll-ups over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..functions.deals import reject_reason
from ..operators import aggregate as A
from ..plans import cycles as C
from ..plans import index as I
from .base import PART_QUOTES_SQL, QUOTES_SQL, part_quotes, query, quotes, rounded, table

BASE_MONTH = "1998-01-01"

ITEM_MONTH_SQL = f"""
  q AS ({QUOTES_SQL}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY section, key, month ORDER BY day DESC, tie DESC, item DESC) AS rn FROM q),
  im AS (SELECT section, key, month, quantile_cont(price, 0.5) AS p, max(CASE WHEN rn = 1 THEN item END) AS item,
                max(day) AS date, count(*) AS n FROM ranked GROUP BY section, key, month)
"""


def item_months(spark, folder):
    return A.item_month(quotes(spark, folder), ["section", "key"], "day", "price", "item", "tie")


@query("item_month", f"WITH {ITEM_MONTH_SQL} SELECT section, key, month, round(p, 9) AS p, item, date, n FROM im")
def item_month(spark, folder):
    return rounded(item_months(spark, folder), 9, "p")


LINKS_SQL = f"""{ITEM_MONTH_SQL},
  months AS (SELECT section, month, lag(month) OVER (PARTITION BY section ORDER BY month) AS prev
             FROM (SELECT DISTINCT section, month FROM im)),
  links AS (SELECT c.section, c.key, c.month, ln(c.p / b.p) AS change
            FROM im c JOIN months m ON m.section = c.section AND m.month = c.month
            JOIN im b ON b.section = c.section AND b.key = c.key AND b.month = m.prev)
"""


@query("chain_links", f"WITH {LINKS_SQL} SELECT section, key, month, round(change, 6) AS change FROM links")
def chain_links(spark, folder):
    return rounded(I.matched_links(item_months(spark, folder), ["section"], "key", "month", "p"), 6, "change")


@query("chain_index", f"""WITH {LINKS_SQL},
  steps AS (SELECT section, month, quantile_cont(change, 0.5) AS step, count(*) AS n FROM links GROUP BY section, month),
  lv AS (SELECT m.section, m.month, m.prev, s.n,
                sum(coalesce(s.step, 0)) OVER (PARTITION BY m.section ORDER BY m.month) AS lvl
         FROM months m LEFT JOIN steps s ON s.section = m.section AND s.month = m.month),
  su AS (SELECT section, month, quantile_cont(p, 0.5) AS med, min(p) AS lo, count(*) AS n FROM im GROUP BY section, month)
  SELECT lv.section, lv.month, round(lv.lvl, 6) AS log_level,
         CASE WHEN lv.prev IS NULL THEN NULL ELSE coalesce(lv.n, 0) END AS n_link_items,
         round(100 * exp(lv.lvl - b.lvl), 4) AS index,
         round(su.med, 9) AS p_median, su.n AS n_items, round(su.lo, 9) AS p_min
  FROM lv JOIN lv b ON b.section = lv.section AND b.month = DATE '{BASE_MONTH}'
  JOIN su ON su.section = lv.section AND su.month = lv.month""")
def chain_index(spark, folder):
    index = I.chain_index(item_months(spark, folder), BASE_MONTH, ["section"], price="p", unit_price="p")
    return rounded(rounded(rounded(index, 6, "log_level"), 4, "index"), 9, "p_median", "p_min")


@query("intersect_items", f"""WITH q AS ({QUOTES_SQL}), m AS (SELECT DISTINCT month, section, key FROM q)
  SELECT month, section, key FROM m INTERSECT SELECT CAST(month - INTERVAL 1 MONTH AS DATE), section, key FROM m""")
def intersect_items(spark, folder):
    """Items of each month that the next month has too."""
    q = quotes(spark, folder).select(bucket("day").alias("month"), "section", "key").distinct()
    return q.intersect(q.withColumn("month", F.add_months("month", -1)))


@query("monthly_median", f"""WITH q AS ({PART_QUOTES_SQL})
  SELECT p_type AS series, month, round(quantile_cont(price, 0.5), 9) AS value, count(*) AS n FROM q GROUP BY 1, 2""")
def monthly_median(spark, folder):
    q = part_quotes(spark, folder).withColumnRenamed("p_type", "series")
    return rounded(A.monthly(q, ["series"], "day", "price", count="n"), 9, "value")


@query("monthly_min", f"""WITH q AS ({PART_QUOTES_SQL})
  SELECT p_type AS series, month, round(min(price), 9) AS value FROM q GROUP BY 1, 2""")
def monthly_min(spark, folder):
    q = part_quotes(spark, folder).withColumnRenamed("p_type", "series")
    return rounded(A.monthly(q, ["series"], "day", "price", "min"), 9, "value")


@query("monthly_quartiles", f"""WITH q AS ({PART_QUOTES_SQL})
  SELECT p_brand AS series, month, round(quantile_cont(price, 0.5), 9) AS median, round(quantile_cont(price, 0.25), 9) AS p25,
         round(quantile_cont(price, 0.75), 9) AS p75, count(*) AS n FROM q GROUP BY 1, 2""")
def monthly_quartiles(spark, folder):
    q = part_quotes(spark, folder).withColumnRenamed("p_brand", "series")
    return rounded(A.distribution(q, ["series"], "day", "price"), 9, "median", "p25", "p75")


@query("quarterly_pool", f"""WITH q AS ({PART_QUOTES_SQL})
  SELECT p_type AS series, CAST(date_trunc('quarter', day) AS DATE) AS quarter,
         round(quantile_cont(price, 0.5), 9) AS median, count(*) AS n FROM q GROUP BY 1, 2""")
def quarterly_pool(spark, folder):
    q = part_quotes(spark, folder).withColumnRenamed("p_type", "series")
    return rounded(A.monthly(q, ["series"], "day", "price", grain="quarter", name="median", count="n"), 9, "median")


@query("two_level_mean", f"""WITH q AS ({PART_QUOTES_SQL}),
  m AS (SELECT p_type, month, p_brand, quantile_cont(price, 0.5) AS med FROM q GROUP BY 1, 2, 3)
  SELECT p_type, month, round(avg(med), 4) AS value FROM m GROUP BY 1, 2""")
def two_level_mean(spark, folder):
    q = part_quotes(spark, folder).withColumn("month", bucket("day"))
    return rounded(A.two_level(q, ["p_type", "month"], ["p_brand"], "price"), 4, "value")


@query("quarterly_increments", f"""WITH q AS ({PART_QUOTES_SQL}),
  m AS (SELECT p_type AS series, month, quantile_cont(price, 0.5) AS value FROM q GROUP BY 1, 2),
  l AS (SELECT series, CAST(date_trunc('quarter', month) AS DATE) AS quarter, ln(avg(value)) AS level FROM m GROUP BY 1, 2),
  i AS (SELECT series, quarter, level - lag(level) OVER (PARTITION BY series ORDER BY quarter) AS inc FROM l)
  SELECT series, quarter, round(inc, 6) AS inc FROM i WHERE inc IS NOT NULL""")
def quarterly_increments(spark, folder):
    q = part_quotes(spark, folder).withColumnRenamed("p_type", "series")
    return rounded(C.log_increments(A.monthly(q, ["series"], "day", "price")), 6, "inc")


@query("series_union", f"""WITH q AS ({PART_QUOTES_SQL}),
  s AS (SELECT month, 'economy_price' AS series, price AS value FROM q WHERE p_type = 'ECONOMY'
        UNION ALL SELECT month, 'small_parts_price', price FROM q WHERE p_size <= 10
        UNION ALL SELECT month, 'large_parts_quantity', l_quantity FROM q WHERE p_size > 40
        UNION ALL SELECT month, 'brand1_discount', l_discount FROM q WHERE p_brand = 'Brand#1')
  SELECT series, month, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.25), 9) AS p25,
         round(quantile_cont(value, 0.75), 9) AS p75, count(*) AS n FROM s GROUP BY 1, 2""")
def series_union(spark, folder):
    definitions = {
        "economy_price": (F.col("p_type") == "ECONOMY", "price"),
        "small_parts_price": (F.col("p_size") <= 10, "price"),
        "large_parts_quantity": (F.col("p_size") > 40, "l_quantity"),
        "brand1_discount": (F.col("p_brand") == "Brand#1", "l_discount"),
    }
    return rounded(A.series_union(part_quotes(spark, folder), definitions, "day"), 9, "median", "p25", "p75")


@query("topk_series", f"""WITH q AS ({PART_QUOTES_SQL}),
  c AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE day >= DATE '2001-01-01') AS r FROM q GROUP BY 1),
  top AS (SELECT p_brand FROM (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 8)
          UNION SELECT p_brand FROM (SELECT p_brand FROM c WHERE r > 0 ORDER BY r DESC, p_brand LIMIT 4))
  SELECT p_brand AS series, month, round(quantile_cont(price, 0.5), 9) AS value
  FROM q WHERE p_brand IN (SELECT p_brand FROM top) GROUP BY 1, 2""")
def topk_series(spark, folder):
    q = part_quotes(spark, folder)
    top = A.top_categories(q, "p_brand", 8, "day", "2001-01-01", 4)
    kept = A.keep_keys(q, top, ["p_brand"]).withColumnRenamed("p_brand", "series")
    return rounded(A.monthly(kept, ["series"], "day", "price"), 9, "value")


STATUSES = {"F": "filled", "O": "open", "P": "partial"}


@query("status_crosstab", """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P,
  count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS total FROM orders GROUP BY 1""")
def status_crosstab(spark, folder):
    return A.status_crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", list(STATUSES))


@query("volume_by_category", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS category,
  count(*) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS is_total FROM orders
  GROUP BY GROUPING SETS ((date_trunc('month', o_orderdate), o_orderpriority), (date_trunc('month', o_orderdate)))""")
def volume_by_category(spark, folder):
    orders = table(spark, folder, "orders").select(bucket("o_orderdate").alias("month"), F.col("o_orderpriority").alias("category"))
    return A.volume_by_category(orders, "category", "month")


CASCADE_SQL = f"""WITH q AS ({PART_QUOTES_SQL}),
  r AS (SELECT p_type, p_brand, CASE
    WHEN l_discount >= 0.09 THEN 'deep_discount'
    WHEN p_name LIKE '%ring%' THEN 'accessory'
    WHEN l_quantity > 45 THEN 'bulk'
    WHEN p_size < 3 THEN 'too_small'
    WHEN (p_type = 'ECONOMY' AND price NOT BETWEEN 500 AND 3000) OR (p_type = 'SMALL' AND price NOT BETWEEN 100 AND 2500)
      THEN 'price_out_of_range' END AS reason FROM q)
  SELECT p_type, coalesce(reason, 'accepted') AS status, count(*) AS n FROM r GROUP BY 1, 2"""


@query("reject_cascade", CASCADE_SQL)
def reject_cascade(spark, folder):
    from ..functions.columns import in_range

    q = part_quotes(spark, folder)
    bounds = {"ECONOMY": (500, 3000), "SMALL": (100, 2500)}
    reason = reject_reason([
        ("deep_discount", F.col("l_discount") >= 0.09),
        ("accessory", F.col("p_name").contains("ring")),
        ("bulk", F.col("l_quantity") > 45),
        ("too_small", F.col("p_size") < 3),
        ("price_out_of_range", ~in_range("price", "p_type", bounds)),
    ])
    status = F.coalesce(reason, F.lit("accepted")).alias("status")
    return q.groupBy("p_type", status).agg(F.count(F.lit(1)).alias("n"))
