"""Scalar rules, refreshes, labels, sampling, aging and generations over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import quality as Q
from ..plans import aging as G
from ..plans import index as I
from ..sources import upsert as U
from ..sources.pages import reclassify
from ..sources.readers import melt
from .base import PART_QUOTES_SQL, QUOTES_SQL, day, part_quotes, query, quotes, rounded, table

REFERENCE_UNTIL, NOW_FROM = "2000-06-30", "2001-03-01"
GAP = ("1998-01-01", "1998-06-30")


# --- scalar rules ---------------------------------------------------------------

@query("unpivot_prices", """SELECT p_partkey, 'p_retailprice' AS metric, p_retailprice AS value FROM part
  UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part""")
def unpivot_prices(spark, folder):
    part = table(spark, folder, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return melt(part, ["p_partkey"], ["p_retailprice", "p_size"])


@query("price_fallback", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (p_retailprice * 1.5 + p_retailprice * 0.5) / 2
  WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part""")
def price_fallback(spark, folder):
    price = F.when(F.col("p_size") % 3 == 0, None).when(F.col("p_size") % 7 == 0, 0.0).otherwise(F.col("p_retailprice"))
    bounds = table(spark, folder, "part").select(
        "p_partkey", price.alias("p"), (F.col("p_retailprice") * 1.5).alias("high"), (F.col("p_retailprice") * 0.5).alias("low")
    )
    return bounds.select("p_partkey", K.fallback_price("p", "high", "low").alias("price"))


@query("guarded_unit_value", """SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_linestatus = 'O' AND l_quantity > 0 THEN l_extendedprice / l_quantity END), 3) AS unit_value,
  count(CASE WHEN l_linestatus = 'O' AND l_quantity > 0 THEN 1 END) AS n FROM lineitem GROUP BY 1, 2""")
def guarded_unit_value(spark, folder):
    unit = K.guarded_ratio("l_extendedprice", "l_quantity", F.col("l_linestatus") == "O")
    rows = table(spark, folder, "lineitem").withColumn("unit", unit)
    sums = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("unit").alias("unit_value"), F.count("unit").alias("n"))
    return rounded(sums, 3, "unit_value")


@query("reclassify_case", """SELECT p_partkey, section FROM (SELECT p_partkey, CASE WHEN p_name LIKE '%rod' THEN NULL WHEN p_type = 'PROMO' AND p_name LIKE 'blue%' THEN 'blue_promo'
  WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'compact' ELSE lower(p_type) END AS section FROM part) WHERE section IS NOT NULL""")
def reclassify_case(spark, folder):
    name, kind = F.col("p_name"), F.col("p_type")
    section = reclassify([
        (name.endswith("rod"), F.lit(None).cast("string")),
        ((kind == "PROMO") & name.startswith("blue"), F.lit("blue_promo")),
        (kind.isin("SMALL", "MEDIUM"), F.lit("compact")),
    ], default=F.lower(kind))
    return table(spark, folder, "part").select("p_partkey", section.alias("section")).where("section IS NOT NULL")


@query("item_key_norm", """SELECT p_partkey, replace(replace(replace(lower(regexp_replace(p_name || ' ' || p_size || ' MHz 1G*8', '\\s+', '', 'g')), '*', 'x'), 'mbps', ''), 'mhz', '') AS key FROM part""")
def item_key_norm(spark, folder):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" MHz 1G*8"))
    return table(spark, folder, "part").select("p_partkey", K.item_key(name).alias("key"))


@query("item_spec", """SELECT p_partkey, 'DDR' || (3 + p_size % 3) AS generation, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS DOUBLE) / 1024 ELSE CAST(p_size AS DOUBLE) END AS density_gb FROM part""")
def item_spec(spark, folder):
    size = F.col("p_size").cast("string")
    unit = F.element_at(F.array(F.lit("GB SO-DIMM"), F.lit("Mb"), F.lit("Gb"), F.lit("G (1Gx8)")), (F.col("p_size") % 4 + 1).cast("int"))
    item = F.concat(F.lit("DDR"), (3 + F.col("p_size") % 3).cast("string"), F.lit(" "), size, unit, F.lit(" 1600"))
    return table(spark, folder, "part").withColumn("__s", K.item_spec(item)).select("p_partkey", "__s.generation", "__s.density_gb")


@query("select_items_regex", """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ') AND NOT regexp_matches(p_name, 'ring|rod')""")
def select_items_regex(spark, folder):
    return I.select_items(table(spark, folder, "part"), "p_name", "^(red|blue) ", "ring|rod").select("p_partkey", "p_name")


@query("clean_number", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_totalprice AS DOUBLE) END AS value FROM orders""")
def clean_number(spark, folder):
    shown = F.format_number("o_totalprice", 2)
    text = F.element_at(F.array(shown, F.concat(F.lit(" "), shown), shown, F.lit("null"), F.lit("n/a")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", K.clean_number(text).alias("value"))


@query("norm_model", """SELECT p_partkey, lower(replace(p_name, ' ', '')) || p_size || 'x' AS key FROM part""")
def norm_model(spark, folder):
    words = ["geforce ", "ryzen 7 ", "ryzen ", "core "]
    model = F.concat(F.lit("Ryzen 7 "), F.initcap("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("X"))
    return table(spark, folder, "part").select("p_partkey", K.norm_model(model, words).alias("key"))


@query("version_sort", """WITH v AS (SELECT DISTINCT (p_size % 4) || '.' || p_size || '.' || length(p_name) AS version FROM part)
  SELECT version, row_number() OVER (ORDER BY CAST(split_part(version, '.', 1) AS INTEGER), CAST(split_part(version, '.', 2) AS INTEGER), CAST(split_part(version, '.', 3) AS INTEGER)) AS place FROM v""")
def version_sort(spark, folder):
    text = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), F.col("p_size").cast("string"), F.length("p_name").cast("string"))
    versions = table(spark, folder, "part").select(text.alias("version")).distinct().withColumn("k", K.version_key("version"))
    # The place of each version is how many sort before it within its major number, plus the majors before.
    major = F.col("k")[0]
    inside = Window.partitionBy("major").orderBy("k")
    counts = versions.groupBy(major.alias("major")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("major").rowsBetween(Window.unboundedPreceding, -1)  # one row per major
    offsets = counts.select("major", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    ranked = versions.withColumn("major", major).withColumn("r", F.row_number().over(inside)).join(offsets, "major")
    return ranked.select("version", (F.col("below") + F.col("r")).alias("place"))


@query("cost_mismatch_flag", f"""WITH q AS ({PART_QUOTES_SQL}) SELECT p_type, count(*) FILTER (WHERE price / p_retailprice < 0.8 OR price / p_retailprice > 1.25) AS n_mismatch, count(*) AS n FROM q GROUP BY 1""")
def cost_mismatch_flag(spark, folder):
    return part_quotes(spark, folder).groupBy("p_type").agg(
        F.count_if(K.mismatch_flag("price", "p_retailprice")).alias("n_mismatch"), F.count(F.lit(1)).alias("n")
    )


@query("required_key_check", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS s FROM orders) WHERE trim(s) = ''")
def required_key_check(spark, folder):
    status = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))
    return Q.missing_required(table(spark, folder, "orders").select("o_orderkey", status.alias("s")), "s").select("o_orderkey")


@query("value_in_text", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'within_1mn' WHEN 2 THEN NULL ELSE 'exact' END AS match_type FROM orders""")
def value_in_text(spark, folder):
    """Order values in sentences made from them: exact, one off, far from the keyword, with separators."""
    v = F.floor("o_totalprice").cast("long") + 1000
    plain, off, shown = v.cast("string"), (v + 1).cast("string"), F.format_number(v, 0)
    text = F.element_at(F.array(
        F.concat(F.lit("Total revenue was $"), plain, F.lit(" for the quarter.")),
        F.concat(F.lit("Net sales of "), off, F.lit(" this quarter.")),
        F.concat(F.lit("Headcount "), plain, F.lit(".")),
        F.concat(F.lit("Revenue $ "), shown, F.lit(" up.")),
    ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", v.alias("v"), text.alias("text"), F.lit(True).alias("derived"))
    return Q.value_in_text(rows, "text", "v", "revenue|sales", "derived").select("o_orderkey", "match_type")


@query("sample_hash", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 40")
def sample_hash(spark, folder):
    return Q.sample(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 40)


# --- sections, horizons, refreshes ---------------------------------------------

@query("cutover_union", f"""WITH q AS ({QUOTES_SQL}), u AS (SELECT month, price FROM q WHERE section = 'N' OR day < DATE '1998-07-01')
  SELECT month, round(quantile_cont(price, 0.5), 9) AS value, count(*) AS n FROM u GROUP BY 1""")
def cutover_union(spark, folder):
    used = I.spliced(quotes(spark, folder), "section", "day", "N", "1998-07-01")
    return rounded(A.monthly(used, [], "day", "price", count="n"), 9, "value")


@query("horizon_filter", """WITH m AS (SELECT 'orders' AS measure, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2
  UNION ALL SELECT 'lines', CAST(date_trunc('month', l_shipdate) AS DATE), count(*) FROM lineitem GROUP BY 1, 2)
  SELECT * FROM m WHERE month <= (SELECT max(month) FROM m WHERE measure = 'orders')""")
def horizon_filter(spark, folder):
    def counts(name: str, col: str, measure: str):
        rows = table(spark, folder, name).groupBy(K.bucket(col).alias("month")).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(F.lit(measure).alias("measure"), "month", "n")

    both = counts("orders", "o_orderdate", "orders").unionByName(counts("lineitem", "l_shipdate", "lines"))
    return A.horizon(both, "month", "measure", "orders")


@query("upsert_orders", """WITH new AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P'),
  done AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM done) UNION ALL SELECT * FROM new""")
def upsert_orders(spark, folder):
    orders = table(spark, folder, "orders")
    new = orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return U.upsert(orders.select("o_orderkey", "o_custkey", "o_totalprice"), new, ["o_custkey"])


@query("backfill_plan", """WITH av AS (SELECT DISTINCT c_mktsegment AS reporter, length(c_mktsegment) % 2 AS priority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period
    FROM orders JOIN customer ON o_custkey = c_custkey),
  fe AS (SELECT c_mktsegment AS reporter, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, min(CAST(o_orderdate AS DATE)) AS fetched_on
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 2 GROUP BY 1, 2),
  r AS (SELECT av.*, row_number() OVER (PARTITION BY reporter ORDER BY period DESC) AS k FROM av)
  SELECT r.reporter, r.priority, r.period, CASE WHEN fetched_on IS NULL THEN 'missing' ELSE 'stale' END AS reason
  FROM r LEFT JOIN fe ON fe.reporter = r.reporter AND fe.period = r.period WHERE fetched_on IS NULL OR (k <= 24 AND fetched_on < DATE '2001-03-01')""")
def backfill_plan(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("reporter"), "c_nationkey")
    rows = table(spark, folder, "orders").select("o_custkey", day("o_orderdate").alias("fetched_on")).join(customers, "o_custkey")
    rows = rows.withColumn("period", K.bucket("fetched_on"))
    available = rows.select("reporter", (F.length("reporter") % 2).alias("priority"), "period").distinct()
    return U.backfill_plan(available, rows.where("c_nationkey < 2"), ["reporter"], "period", 24, "2001-03-01")


@query("reconcile_totals", """WITH s AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS lines FROM lineitem GROUP BY 1)
  SELECT o_orderstatus, m AS match, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN lines IS NULL THEN 'missing'
    WHEN abs(lines - o_totalprice) <= greatest(1000, 0.25 * lines) THEN 'ok' ELSE 'mismatch' END AS m FROM orders LEFT JOIN s USING (o_orderkey)) GROUP BY 1, 2""")
def reconcile_totals(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("lines"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    checked = J.reconcile(orders, lines, ["o_orderkey"], "o_totalprice", "lines", F.greatest(F.lit(1000.0), 0.25 * F.col("lines")))
    return checked.groupBy("o_orderstatus", "match").agg(F.count(F.lit(1)).alias("n"))


@query("label_join", """SELECT c.c_nationkey, coalesce(n.n_name, CAST(c.c_nationkey AS VARCHAR)) AS label, count(*) AS n FROM customer c
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2""")
def label_join(spark, folder):
    names = table(spark, folder, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    customers = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return J.label(customers, names, "c_nationkey")


@query("coverage_ratio", """WITH f AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(DISTINCT l_orderkey) AS fetched FROM lineitem GROUP BY 1),
  a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS archive FROM orders GROUP BY 1)
  SELECT month, fetched, archive, round(CAST(fetched AS DOUBLE) / archive, 3) AS ratio FROM f LEFT JOIN a USING (month)""")
def coverage_ratio(spark, folder):
    lines = table(spark, folder, "lineitem").select(K.bucket("l_shipdate").alias("month"), "l_orderkey").distinct()
    fetched = lines.groupBy("month").agg(F.count(F.lit(1)).alias("fetched"))
    archive = table(spark, folder, "orders").groupBy(K.bucket("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("archive"))
    return A.coverage(fetched, archive, ["month"], "fetched", "archive")


@query("series_catalogue", """SELECT c_custkey AS custkey, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(o_totalprice) AS n,
  arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS last_value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def series_catalogue(spark, folder):
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderdate", "o_totalprice")
    return A.catalogue(rows, "custkey", "o_orderdate", "o_totalprice", wanted)


# --- sampling and interpolation -------------------------------------------------

@query("nearest_sample", """WITH c AS (SELECT o_custkey % 100 AS grp, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY grp, month, t ORDER BY abs(day(d) - t), d, o_orderkey) AS rn FROM c, (VALUES (1), (16)) v(t))
  SELECT DISTINCT grp, month, d, o_orderkey FROM r WHERE rn = 1""")
def nearest_sample(spark, folder):
    captures = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 100).alias("grp"), K.bucket("o_orderdate").alias("month"), day("o_orderdate").alias("d"), "o_orderkey"
    )
    return J.nearest_sample(captures, ["grp", "month"], "d", J.month_targets(2), "o_orderkey")


@query("interpolate_at", """WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  a AS (SELECT DISTINCT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS asked FROM orders),
  p AS (SELECT a.o_custkey, a.asked, (SELECT max(d) FROM s WHERE s.o_custkey = a.o_custkey AND s.d <= a.asked) AS pd,
      (SELECT min(d) FROM s WHERE s.o_custkey = a.o_custkey AND s.d >= a.asked) AS nd FROM a)
  SELECT p.o_custkey, p.asked, round(CASE WHEN nd IS NULL THEN x.v WHEN pd IS NULL THEN y.v WHEN pd = asked THEN x.v
    ELSE x.v + (y.v - x.v) * ((asked - pd) / (nd - pd)) END, 8) AS interpolated FROM p LEFT JOIN s x ON x.o_custkey = p.o_custkey AND x.d = pd
  LEFT JOIN s y ON y.o_custkey = p.o_custkey AND y.d = nd""")
def interpolate_at(spark, folder):
    orders = table(spark, folder, "orders").withColumn("d", day("o_orderdate"))
    series = orders.groupBy("o_custkey", "d").agg(F.avg("o_totalprice").alias("v"))
    dates = orders.select("o_custkey", F.trunc("d", "YEAR").alias("asked")).distinct()
    return rounded(J.interpolate_at(series, dates, "o_custkey", "d", "v", "asked"), 8, "interpolated")


@query("basket_summary", f"""WITH q AS ({PART_QUOTES_SQL}) SELECT p_brand, month, round(quantile_cont(price, 0.5), 9) AS median_listing, count(*) AS n_listings,
  round(min(price) FILTER (WHERE l_quantity > 25), 9) AS price, round(min(price), 9) AS min_any_listing,
  count(*) FILTER (WHERE l_quantity > 25) AS n_in_stock FROM q GROUP BY 1, 2""")
def basket_summary(spark, folder):
    listings = part_quotes(spark, folder).withColumn("month", K.bucket("day")).withColumn("in_stock", F.col("l_quantity") > 25)
    return rounded(A.basket(listings, ["p_brand", "month"], "price", "in_stock"), 9, "median_listing", "price", "min_any_listing")


# One pattern per distinct name: its last character may be any letter.
@query("pattern_join", """WITH patterns AS (SELECT DISTINCT replace(p_name, ' ', '_') AS label, '^' || regexp_replace(p_name, '.$', '[a-z]') || '$' AS pattern FROM part)
  SELECT p_partkey, label FROM part JOIN patterns ON regexp_matches(p_name, pattern)""")
def pattern_join(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    pattern = F.concat(F.lit("^"), F.regexp_replace("p_name", ".$", "[a-z]"), F.lit("$")).alias("pattern")
    patterns = parts.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("label"), pattern).distinct()
    return J.pattern_join(parts, patterns, "p_name").drop("p_name")


# --- aging, attribution, generations --------------------------------------------

AGED = f"""q AS ({PART_QUOTES_SQL}), launch AS (SELECT p_partkey, min(day) AS release FROM q GROUP BY 1),
  aged AS (SELECT * FROM (SELECT q.p_partkey, q.p_brand, q.price, q.day, q.p_retailprice AS launch_price, price / q.p_retailprice AS ratio,
      CAST(round_even((CAST(q.month AS DATE) - release) / 30.44, 0) AS INTEGER) AS age_m FROM q JOIN launch USING (p_partkey)) WHERE age_m >= 0),
  binned AS (SELECT *, age_m // 6 * 6 AS age_bin FROM aged)"""


def aged(spark, folder):
    posts = part_quotes(spark, folder).select("p_partkey", "p_brand", "price", "day", K.bucket("day").alias("month"), "p_retailprice")
    launches = posts.groupBy("p_partkey").agg(F.min("day").alias("release_date"), F.first("p_retailprice").alias("launch_price"))
    return G.with_age(posts.drop("p_retailprice"), launches, "p_partkey", "month", "price", [F.col("release_date")])


@query("price_vs_launch", f"WITH {AGED} SELECT p_partkey, day, age_m, age_bin, round(ratio, 9) AS ratio FROM binned")
def price_vs_launch(spark, folder):
    return rounded(aged(spark, folder).select("p_partkey", "day", "age_m", "age_bin", "ratio"), 9, "ratio")


CURVE = f"""{AGED}, curve AS (SELECT age_bin, quantile_cont(ratio, 0.5) AS ref_ratio, count(*) AS ref_n FROM binned
  WHERE day <= DATE '{REFERENCE_UNTIL}' AND day NOT BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}' GROUP BY 1)"""


def curve(posts):
    reference = posts.where((F.col("day") <= F.lit(REFERENCE_UNTIL).cast("date")) & K.exclude_window("day", *GAP))
    return G.aging_curve(reference)


@query("aging_curve", f"WITH {CURVE} SELECT age_bin, round(ref_ratio, 6) AS ref_ratio, ref_n FROM curve")
def aging_curve(spark, folder):
    return rounded(curve(aged(spark, folder)), 6, "ref_ratio")


@query("aging_vs_normal", f"""WITH {CURVE}, r AS (SELECT b.*, ln(ratio / ref_ratio) AS rel FROM binned b JOIN curve c USING (age_bin)
    WHERE day >= DATE '{NOW_FROM}' AND ref_n >= 20)
  SELECT p_brand, round(quantile_cont(rel, 0.5), 6) AS rel, count(*) AS n, round(min(launch_price), 4) AS launch, quantile_cont(age_m, 0.5) AS age_m,
    round(quantile_cont(price, 0.5), 6) AS price, round(quantile_cont(ratio, 0.5), 6) AS ratio, round(100 * (exp(quantile_cont(rel, 0.5)) - 1), 6) AS vs_normal_pct FROM r GROUP BY 1""")
def aging_vs_normal(spark, folder):
    posts = aged(spark, folder)
    now = posts.where(F.col("day") >= F.lit(NOW_FROM).cast("date"))
    return rounded(rounded(G.relative_to_curve(now, curve(posts), "p_brand", "price"), 4, "launch"), 6, "rel", "price", "ratio", "vs_normal_pct")


@query("before_after", f"""WITH q AS ({PART_QUOTES_SQL}),
  w AS (SELECT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS units, quantile_cont(price, 0.5) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS b,
    count(*) FILTER (WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS nb, quantile_cont(price, 0.5) FILTER (WHERE day BETWEEN DATE '2001-01-01' AND DATE '2001-06-30') AS a,
    count(*) FILTER (WHERE day BETWEEN DATE '2001-01-01' AND DATE '2001-06-30') AS na FROM q GROUP BY 1, 2)
  SELECT p_brand, units, round(b, 6) AS deal_before, nb AS n_before, round(a, 6) AS deal_now, na AS n_now, round(a - b, 6) AS change, 9.5 * units AS cost_change,
    round(9.5 * units / (a - b), 6) AS share_of_change FROM w""")
def before_after(spark, folder):
    q = part_quotes(spark, folder).withColumn("units", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"))
    out = A.before_after(
        q, ["p_brand"], "day", "price", ("1997-01-01", "1997-06-30"), ("2001-01-01", "2001-06-30"), "units", F.lit(9.5)
    )
    return rounded(out, 6, "deal_before", "deal_now", "change", "share_of_change")


GENERATIONS = """gen AS (SELECT p_brand, p_type, 'size ' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS model, CAST(DATE '1990-01-01' + p_size * INTERVAL 3 MONTH AS DATE) AS released,
    avg(p_retailprice) AS price, CAST(count(*) AS DOUBLE) AS score FROM part GROUP BY 1, 2, 3, 4),
  g AS (SELECT *, score / price * 100 AS per_100, lag(model) OVER w AS pm, lag(released) OVER w AS pr, lag(price) OVER w AS pp, lag(score) OVER w AS ps,
    lag(score / price * 100) OVER w AS pv FROM gen WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY released, model)),
  gg AS (SELECT p_brand, p_type, pm AS from_model, model AS to_model, pr AS from_date, released AS to_date, round_even((released - pr) / 365.25, 2) AS years,
    (price / pp - 1) * 100 AS price_change_pct, (score / ps - 1) * 100 AS score_change_pct, (per_100 / pv - 1) * 100 AS per_100_change_pct FROM g WHERE pm IS NOT NULL)"""
CHANGES = ["price_change_pct", "score_change_pct", "per_100_change_pct"]


def generations(spark, folder):
    released = F.add_months(F.lit("1990-01-01").cast("date"), F.col("p_size") * 3)
    gen = table(spark, folder, "part").groupBy(
        "p_brand", "p_type", F.format_string("size %02d", "p_size").alias("model"), released.alias("released")
    ).agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).cast("double").alias("score"))
    gen = gen.withColumn("per_100", F.col("score") / F.col("price") * 100)
    return G.gen_over_gen(gen, ["p_brand", "p_type"], "released", "model", ["price", "score", "per_100"])


@query("gen_over_gen", f"""WITH {GENERATIONS} SELECT p_brand, p_type, from_model, to_model, from_date, to_date, years,
  {', '.join(f'round({c}, 6) AS {c}' for c in CHANGES)} FROM gg""")
def gen_over_gen(spark, folder):
    return rounded(generations(spark, folder), 6, *CHANGES)


@query("geo_mean_growth", f"""WITH {GENERATIONS} SELECT p_brand, p_type, count(*) AS n_steps, round(sum(years), 2) AS years, round(exp(avg(ln(1 + per_100_change_pct / 100))) - 1, 6) AS geo_mean,
  round(exp(sum(ln(1 + per_100_change_pct / 100)) / sum(years)) - 1, 6) AS annualized FROM gg GROUP BY 1, 2""")
def geo_mean_growth(spark, folder):
    steps = generations(spark, folder).withColumn("ratio", 1 + F.col("per_100_change_pct") / 100)
    return rounded(rounded(A.growth(steps, ["p_brand", "p_type"], "ratio", "years"), 6, "geo_mean", "annualized"), 2, "years")


@query("best_backend", """WITH s AS (SELECT p_brand, p_type, avg(p_retailprice) AS score, count(*) AS runs FROM part GROUP BY 1, 2)
  SELECT p_brand, round(score, 6) AS score, p_type, runs FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type) AS rn FROM s WHERE runs >= 10) WHERE rn = 1""")
def best_backend(spark, folder):
    scores = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("score"), F.count(F.lit(1)).alias("runs"))
    return rounded(G.best_backend(scores, "p_brand", "score", "runs", "p_type", 10), 6, "score")
