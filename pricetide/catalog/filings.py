"""Vintages, fiscal labels and year-to-date sums over orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..operators import aggregate as A
from ..operators import filings as L
from ..operators import joins as J
from ..plans import financials as Q
from ..sources.readers import explode_facts
from .base import day, query, rounded, table


def orders(spark, folder):
    return table(spark, folder, "orders").withColumn("filed", day("o_orderdate"))


@query("latest_wins", """SELECT o_custkey, month, o_orderkey, o_totalprice FROM (SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_wins(spark, folder):
    rows = orders(spark, folder).withColumn("month", bucket("filed"))
    rows = rows.select("o_custkey", "month", "filed", "o_orderkey", "o_totalprice")
    return L.latest_wins(rows, ["o_custkey", "month"], ["filed", "o_orderkey"]).drop("filed")


def ranked(spark, folder):
    """Orders as equivalent facts: two groups by priority, reported when filled."""
    tag = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders(spark, folder).select(
        "o_custkey", bucket("filed", "quarter").alias("quarter"), "filed", "o_orderkey", "o_totalprice",
        tag.alias("tag_no"), F.col("o_orderpriority").alias("tag"), F.when(tag <= 2, 0).otherwise(1).alias("group_rank"),
        F.when(F.col("o_orderstatus") == "F", "reported").otherwise("ytd_diff").alias("derivation"),
    )


RANKED = """SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(o_orderdate AS DATE) AS filed, o_orderkey, o_totalprice,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS tag_no, o_orderpriority AS tag,
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 0 ELSE 1 END AS group_rank,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS rep FROM orders"""


@query("priority_coalesce", f"""WITH r AS ({RANKED}) SELECT o_custkey, quarter, tag, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey, quarter ORDER BY group_rank, rep DESC, filed DESC, o_orderkey DESC) AS rn FROM r) WHERE rn = 1""")
def priority_coalesce(spark, folder):
    best = L.priority_coalesce(
        ranked(spark, folder), ["o_custkey", "quarter"], "group_rank", "derivation", ["filed", "o_orderkey"], "tag_no"
    )
    return best.select("o_custkey", "quarter", "tag", "o_totalprice", "o_orderkey")


@query("conflict_log", f"""WITH r AS ({RANKED}),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, quarter, tag ORDER BY filed DESC, o_orderkey DESC) AS rn FROM r) WHERE rn = 1),
  pairs AS (SELECT c.o_custkey, c.quarter, c.tag AS ct, c.o_totalprice AS cv, c.filed AS cf, c.o_orderkey AS ck, c.rep AS cr,
      b.tag AS bt, b.o_totalprice AS bv, b.filed AS bf, b.o_orderkey AS bk, b.rep AS br,
      row_number() OVER (PARTITION BY c.o_custkey, c.quarter, c.tag ORDER BY b.rep DESC, b.filed DESC, b.o_orderkey DESC, b.tag_no) AS k
    FROM one c JOIN one b ON b.o_custkey = c.o_custkey AND b.quarter = c.quarter AND b.tag_no < c.tag_no)
  SELECT o_custkey, quarter, CASE WHEN (cf, ck) > (bf, bk) THEN ct ELSE bt END AS kept_tag, CASE WHEN (cf, ck) > (bf, bk) THEN cv ELSE bv END AS kept_value,
         greatest(cf, bf) AS kept_filed, least(cf, bf) AS other_filed,
         CASE WHEN (cf, ck) > (bf, bk) THEN bt ELSE ct END AS other_tag, CASE WHEN (cf, ck) > (bf, bk) THEN bv ELSE cv END AS other_value
  FROM pairs WHERE k = 1 AND cr = 1 AND br = 1 AND bv <> 0 AND abs(bv - cv) / abs(bv) > 0.005""")
def conflict_log(spark, folder):
    one = L.latest_wins(ranked(spark, folder), ["o_custkey", "quarter", "tag"], ["filed", "o_orderkey"])
    return L.conflicts(one, ["o_custkey", "quarter"], "tag_no", "o_totalprice", "derivation", ["filed", "o_orderkey"], "tag")


OBS = """SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
  CAST(date_trunc('month', l_shipdate) + (l_linenumber - 3) * INTERVAL 1 MONTH AS DATE) AS reported_in, min(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2, 3"""


@query("first_reported", f"""WITH o AS ({OBS}), u AS (SELECT * FROM o WHERE reported_in >= period),
  f AS (SELECT l_partkey, period, arg_min(value, reported_in) AS value, min(reported_in) AS reported_in, count(*) AS n_reports,
        max(value) AS hi, min(value) AS lo FROM u GROUP BY 1, 2)
  SELECT l_partkey, period, value, reported_in, reported_in = period AS as_first_reported, n_reports,
         round(greatest(hi - value, value - lo), 6) AS max_abs_diff FROM f""")
def first_reported(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", bucket("l_shipdate").alias("period"), "l_linenumber", "l_extendedprice"
    )
    obs = lines.groupBy("l_partkey", "period", F.add_months("period", F.col("l_linenumber") - 3).alias("reported_in")).agg(
        F.min("l_extendedprice").alias("value")
    )
    return rounded(J.first_reported(obs, ["l_partkey"], "period", "reported_in", "value"), 6, "max_abs_diff")


YTD = """quarters AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3),
  facts AS (SELECT o_custkey, make_date(y, 1, 1) AS start, CAST(qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end",
            sum(v) OVER (PARTITION BY o_custkey, y ORDER BY qs) AS val FROM quarters)"""


def ytd_facts(spark, folder):
    """Order value of a customer since the start of the year, at each quarter end with orders."""
    quarters = orders(spark, folder).groupBy(
        "o_custkey", F.trunc("filed", "YEAR").alias("start"), bucket("filed", "quarter").alias("qs")
    ).agg(F.sum("o_totalprice").alias("v"))
    order = Window.partitionBy("o_custkey", "start").orderBy("qs").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    end = F.date_sub(F.add_months("qs", 3), 1)
    return quarters.select("o_custkey", "start", end.alias("end"), F.sum("v").over(order).alias("val"))


@query("ytd_to_discrete", f"""WITH {YTD},
  rep AS (SELECT o_custkey, start, "end", val, 'reported' AS derivation FROM facts WHERE "end" - start BETWEEN 75 AND 105),
  dif AS (SELECT a.o_custkey, CAST(b."end" + 1 AS DATE) AS start, a."end", a.val - b.val AS val, 'ytd_diff' AS derivation
    FROM facts a JOIN facts b ON b.o_custkey = a.o_custkey AND b.start = a.start AND a."end" - b."end" BETWEEN 75 AND 105)
  SELECT o_custkey, start, "end", round(val, 4) AS val, derivation FROM rep UNION ALL
  SELECT o_custkey, start, "end", round(val, 4), derivation FROM dif d
  WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.o_custkey = d.o_custkey AND r.start = d.start AND r."end" = d."end")""")
def ytd_to_discrete(spark, folder):
    return rounded(L.ytd_to_discrete(ytd_facts(spark, folder), ["o_custkey"]), 4, "val")


SEGMENT_YEARS = """seg AS (SELECT DISTINCT c_mktsegment, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
  known AS (SELECT DISTINCT c_mktsegment, make_date(year(o_orderdate), length(c_mktsegment), 1) AS fs FROM seg WHERE year(o_orderdate) < 2001),
  yrs AS (SELECT c_mktsegment, fs, CAST(fs + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS fe FROM known),
  fys AS (SELECT * FROM yrs UNION ALL SELECT c_mktsegment, CAST(max(fe) + 1 AS DATE), CAST(max(fe) + 364 AS DATE) FROM yrs GROUP BY 1),
  per AS (SELECT DISTINCT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS start,
          CAST(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end" FROM seg)"""


@query("interval_label", f"""WITH {SEGMENT_YEARS},
  hit AS (SELECT p.*, f.fs, f.fe, row_number() OVER (PARTITION BY p.c_mktsegment, p.start, p."end" ORDER BY f.fs) AS rn
    FROM per p LEFT JOIN fys f ON f.c_mktsegment = p.c_mktsegment AND f.fs <= p.start AND p."end" <= f.fe + 8)
  SELECT c_mktsegment, start, "end", year(fe) AS fiscal_year,
    CASE WHEN fs IS NOT NULL THEN CAST(greatest(1, least(4, round_even(("end" - fs + 1) / 91.3, 0))) AS INTEGER) END AS fiscal_quarter FROM hit WHERE rn = 1""")
def interval_label(spark, folder):
    seg = orders(spark, folder).join(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    start = F.make_date(F.year("filed"), F.length("c_mktsegment"), F.lit(1))
    annual = seg.where(F.year("filed") < 2001).select(
        "c_mktsegment", start.alias("start"), F.date_sub(F.add_months(start, 12), 1).alias("end"), F.lit("10-K").alias("form")
    ).distinct()
    month = bucket("filed")
    periods = seg.select("c_mktsegment", month.alias("start"), F.date_sub(F.add_months(month, 3), 1).alias("end")).distinct()
    return J.interval_label(periods, L.fiscal_years(annual, "c_mktsegment"), "c_mktsegment")


@query("first_event_after", """WITH p AS (SELECT DISTINCT o_custkey, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end FROM orders)
  SELECT o_custkey, period_end, (SELECT min(CAST(o.o_orderdate AS DATE)) FROM orders o WHERE o.o_custkey = p.o_custkey
    AND CAST(o.o_orderdate AS DATE) - p.period_end BETWEEN 1 AND 100) AS first_event FROM p""")
def first_event_after(spark, folder):
    rows = orders(spark, folder)
    ends = F.date_sub(F.add_months(bucket("filed", "quarter"), 3), 1)
    periods = rows.select("o_custkey", ends.alias("period_end")).distinct()
    return J.first_event_after(periods, rows.select("o_custkey", "filed"), "o_custkey", "period_end", "filed")


@query("pivot_ratios", """WITH s AS (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS start,
    CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", sum(l_extendedprice) AS revenue,
    sum(l_quantity * 1000) AS cost, sum(l_quantity) * 70 AS inventory FROM lineitem GROUP BY 1, 2, 3),
  w AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE revenue - cost END AS gp, CASE WHEN l_suppkey % 3 = 1 THEN NULL ELSE cost END AS cr FROM s),
  x AS (SELECT *, coalesce(gp, revenue - cr) AS g FROM w), y AS (SELECT *, coalesce(cr, revenue - g) AS c FROM x)
  SELECT l_suppkey, start, "end", round_even(100 * g / revenue, 2) AS gross_margin_pct,
    CASE WHEN c > 0 THEN round_even(inventory / c * ("end" - start + 1), 1) END AS inventory_days FROM y""")
def pivot_ratios(spark, folder):
    start = bucket("l_shipdate", "quarter")
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey", start.alias("start")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_quantity") * 1000).alias("cost"),
        (F.sum("l_quantity") * 70).alias("inventory"),
    ).withColumn("end", F.date_sub(F.add_months("start", 3), 1))
    kind = F.col("l_suppkey") % 3
    rows = sums.withColumn("gross_profit", F.when(kind != 0, F.col("revenue") - F.col("cost"))).withColumn(
        "cost_of_revenue", F.when(kind != 1, F.col("cost"))
    ).unpivot(["l_suppkey", "start", "end"], ["revenue", "gross_profit", "cost_of_revenue", "inventory"], "metric", "value")
    return A.derive_ratios(rows, ["l_suppkey"], "metric", "value", "start", "end").drop("margin_from")


@query("fact_explode", """SELECT o_orderkey, o_orderpriority AS tag, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start, CAST(o_orderdate AS DATE) AS "end",
  o_totalprice AS val, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form FROM orders WHERE o_orderstatus <> 'P'""")
def fact_explode(spark, folder):
    """Each order as a filing document ``{tag: {units: {USD: [fact]}}}``, then taken apart."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    fact = F.struct(
        bucket("filed", "quarter").alias("start"), F.col("filed").alias("end"), F.col("o_totalprice").alias("val"),
        form.alias("form"), "filed", F.col("o_orderkey").cast("string").alias("accn"),
    )
    units = F.struct(F.create_map(F.lit("USD"), F.array(fact)).alias("units"))
    documents = orders(spark, folder).select("o_orderkey", F.to_json(F.create_map("o_orderpriority", units)).alias("body"))
    return explode_facts(documents, "body", ["o_orderkey"]).select("o_orderkey", "tag", "start", "end", "val", "form")


# Nations as filers: priorities 1 to 3 are tags of revenue, 4 of cost, 5 of stock; sums since January, but for tag 2, and later
# restatements of tag 1 for every second filer.
FILED = """b AS (SELECT c_nationkey AS company, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs,
    sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
  y AS (SELECT *, make_date(year(qs), 1, 1) AS jan, CAST(qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS e, CASE WHEN month(qs) = 10 THEN '10-K' ELSE '10-Q' END AS form,
    CAST(v AS DOUBLE) AS own, CAST(sum(v) OVER (PARTITION BY company, p, year(qs) ORDER BY qs) AS DOUBLE) AS ytd FROM b),
  f AS (SELECT company, p, jan AS s, e, ytd AS val, form, e + 40 AS filed, 'a' AS accn FROM y WHERE p IN (1, 3, 4)
    UNION ALL SELECT company, p, jan, e, ytd + 1000, form, e + 400, 'b' FROM y WHERE p = 1 AND company % 2 = 0
    UNION ALL SELECT company, p, qs, e, own, '10-Q', e + 60, 'a' FROM y WHERE p = 2
    UNION ALL SELECT company, p, NULL, e, own, form, e + 40, 'a' FROM y WHERE p = 5),
  l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY company, p, s, e ORDER BY filed DESC, accn DESC) = 1),
  c AS (SELECT *, 'reported' AS how FROM l WHERE p = 5 OR e - s BETWEEN 75 AND 105 UNION ALL
    SELECT a.company, a.p, CAST(b.e + 1 AS DATE), a.e, a.val - b.val, a.form, a.filed, a.accn, 'ytd_diff'
    FROM l a JOIN l b ON a.company = b.company AND a.p = b.p AND a.s = b.s AND a.e - b.e BETWEEN 75 AND 105),
  m AS (SELECT *, CASE WHEN p <= 3 THEN 'revenue' WHEN p = 4 THEN 'cost_of_revenue' ELSE 'inventory' END AS metric, CASE WHEN p = 3 THEN 1 ELSE 0 END AS grp,
    ['Sales', 'SalesNet', 'SalesGoods', 'Cost', 'Stock'][p] AS tag FROM c)"""
FILED_TAGS = {
    "revenue": ("duration", [["Sales", "SalesNet"], ["SalesGoods"]]), "cost_of_revenue": ("duration", [["Cost"]]), "inventory": ("instant", [["Stock"]]),
}


def filed_facts(spark, folder):
    """Facts of every nation, one per tag, period and filing."""
    nations = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("company"))
    quarters = orders(spark, folder).join(nations, "o_custkey").groupBy(
        "company", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"), bucket("filed", "quarter").alias("qs")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    order = Window.partitionBy("company", "p", F.year("qs")).orderBy("qs").rowsBetween(Window.unboundedPreceding, 0)  # four rows
    p, end = F.col("p"), F.date_sub(F.add_months("qs", 3), 1)
    form = F.when(F.month("qs") == 10, "10-K").otherwise("10-Q")
    ytd, own = F.sum("v").over(order).cast("double"), F.col("v").cast("double")

    def fact(start, val, of, after: int, accn: str):
        return F.struct(start.alias("start"), val.alias("val"), of.alias("form"), F.date_add("end", after).alias("filed"), F.lit(accn).alias("accn"))

    january = F.trunc("qs", "YEAR")
    first = F.when(p == 2, fact(F.col("qs"), own, F.lit("10-Q"), 60, "a")).when(
        p == 5, fact(F.lit(None).cast("date"), own, F.col("form"), 40, "a")
    ).otherwise(fact(january, F.col("ytd"), F.col("form"), 40, "a"))
    again = F.when((p == 1) & (F.col("company") % 2 == 0), fact(january, F.col("ytd") + 1000, F.col("form"), 400, "b"))
    tags = F.array(*[F.lit(t) for t in ("Sales", "SalesNet", "SalesGoods", "Cost", "Stock")])
    known = quarters.withColumns({"ytd": ytd, "end": end, "form": form, "tag": F.element_at(tags, p)})
    return known.select("company", "tag", "end", F.inline(F.array_compact(F.array(first, again))))


@query("quarterly_financials", f"""WITH {FILED},
  pick AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY company, metric, e ORDER BY grp, how = 'reported' DESC, filed DESC, accn DESC, p) = 1),
  w AS (SELECT * REPLACE (coalesce(s, min(s) OVER (PARTITION BY company, e)) AS s) FROM pick),
  yrs AS (SELECT DISTINCT company, s AS fs, e AS fe FROM l WHERE p <> 5 AND form LIKE '10-K%' AND e - s BETWEEN 350 AND 380),
  fys AS (SELECT * FROM yrs UNION ALL SELECT company, CAST(max(fe) + 1 AS DATE), CAST(max(fe) + 364 AS DATE) FROM yrs GROUP BY 1),
  h AS (SELECT w.*, fs, fe, row_number() OVER (PARTITION BY w.company, metric, w.e ORDER BY fs) AS k FROM w
    LEFT JOIN fys y ON y.company = w.company AND fs <= s AND e <= fe + 8 WHERE s IS NOT NULL AND year(e) >= 1993),
  q AS (SELECT company, s AS period_start, e AS period_end, year(fe) AS fiscal_year,
    'Q' || CAST(greatest(1, least(4, round_even((e - fs + 1) / 91.3, 0))) AS INTEGER) AS fiscal_quarter,
    year(s + CAST(floor((e - s) / 2) AS INTEGER)) || 'Q' || quarter(s + CAST(floor((e - s) / 2) AS INTEGER)) AS calendar_quarter,
    metric, val AS value, 'USD' AS unit, tag, how AS derivation, form, CAST(filed AS DATE) AS filed, accn FROM h WHERE k = 1),
  x AS (SELECT company, period_start, period_end, fiscal_year, fiscal_quarter, calendar_quarter, max(value) FILTER (WHERE metric = 'revenue') AS r,
    max(value) FILTER (WHERE metric = 'cost_of_revenue') AS c, max(value) FILTER (WHERE metric = 'inventory') AS i FROM q GROUP BY 1, 2, 3, 4, 5, 6)
  SELECT * FROM q UNION ALL
  SELECT company, period_start, period_end, fiscal_year, fiscal_quarter, calendar_quarter, 'gross_margin_pct', round_even(100 * ((r - c) / r), 2), 'pct', NULL,
    '(revenue-cost_of_revenue)/revenue', NULL, NULL, NULL FROM x WHERE r <> 0 AND c IS NOT NULL UNION ALL
  SELECT company, period_start, period_end, fiscal_year, fiscal_quarter, calendar_quarter, 'inventory_days', round_even(i / c * (period_end - period_start + 1), 1), 'days', NULL,
    'inventory/cost_of_revenue*days_in_quarter', NULL, NULL, NULL FROM x WHERE r IS NOT NULL AND i IS NOT NULL AND c > 0""")
def quarterly_financials(spark, folder):
    return Q.quarterly_financials(Q.latest_facts(filed_facts(spark, folder), "company", FILED_TAGS), "company", first_year=1993)


@query("quarterly_conflicts", f"""WITH {FILED}, g AS (SELECT * FROM m WHERE how = 'reported' AND metric = 'revenue' AND grp = 0)
  SELECT a.company, 'revenue' AS metric, a.e AS "end", CASE WHEN (b.filed, b.accn) > (a.filed, a.accn) THEN b.tag ELSE a.tag END AS kept_tag,
    CASE WHEN (b.filed, b.accn) > (a.filed, a.accn) THEN b.val ELSE a.val END AS kept_value, CAST(greatest(a.filed, b.filed) AS DATE) AS kept_filed,
    CASE WHEN (b.filed, b.accn) > (a.filed, a.accn) THEN a.tag ELSE b.tag END AS other_tag,
    CASE WHEN (b.filed, b.accn) > (a.filed, a.accn) THEN a.val ELSE b.val END AS other_value, CAST(least(a.filed, b.filed) AS DATE) AS other_filed
  FROM g a JOIN g b ON a.company = b.company AND a.e = b.e AND a.p = 1 AND b.p = 2 WHERE a.val <> 0 AND abs(a.val - b.val) / abs(a.val) > 0.005""")
def quarterly_conflicts(spark, folder):
    return Q.quarterly_conflicts(Q.latest_facts(filed_facts(spark, folder), "company", FILED_TAGS), "company")
