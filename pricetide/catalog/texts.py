"""Flags, quotes, page rows and parsed titles over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statements as S
from ..functions.columns import host, net_tone as tone, strip_tags
from ..functions.deals import categorize
from ..functions.topics import topic_flags as flags
from ..operators import aggregate as A
from ..operators import joins as J
from ..plans.deals import judge, monthly_series, parse_titles, post_counts
from ..session import settle
from ..sources.pages import carry_down, extract_rows
from .base import query, rounded, table, text_table


@query("net_tone", """SELECT source, CAST(sum(quality) AS BIGINT) AS pos, CAST(sum(toxic) AS BIGINT) AS neg,
  CASE WHEN sum(quality) + sum(toxic) > 0 THEN round((sum(quality) - sum(toxic)) / (sum(quality) + sum(toxic)), 6) END AS net_tone
  FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def net_tone(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    sums = rows.groupBy("source").agg(F.sum("quality").alias("pos"), F.sum("toxic").alias("neg"))
    return rounded(sums.withColumn("net_tone", tone("pos", "neg")), 6, "net_tone")


RULES = {
    "topic": ["(^| )the ", "(^| )le "], "price": ["[0-9]{2,}", "ation"], "neg": ["ing[., ]", "ment[., ]"],
    "pos": ["(and|un) ", "ouer"], "wait": ["wh", "qu"],
}


def _any(name: str) -> str:
    return f"regexp_matches(lower(text), '{'|'.join(RULES[name])}')"


@query("topic_flags", f"""SELECT doc_id, {_any('topic')} AS is_topic, {_any('price')} AS is_price, {_any('neg')} AS is_neg,
  {_any('pos')} AND NOT {_any('wait')} AS is_pos, {_any('wait')} AS is_wait FROM documents""")
def topic_flags(spark, folder):
    rows = flags(text_table(spark, folder, "documents", "doc_id", "text"), "text", RULES)
    return rows.drop("text")


@query("grid_zero_fill", """SELECT g.source, g.lang, coalesce(n_toxic, 0) AS n_toxic, coalesce(n_good, 0) AS n_good
  FROM (SELECT DISTINCT source, lang FROM documents) g LEFT JOIN (SELECT source, lang, count(*) FILTER (WHERE toxic = 1) AS n_toxic,
    count(*) FILTER (WHERE quality = 1) AS n_good FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) c USING (source, lang)""")
def grid_zero_fill(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang")
    counts = documents.join(table(spark, folder, "labels"), "doc_id").groupBy("source", "lang").agg(
        F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality") == 1).alias("n_good")
    )
    return A.zero_fill(documents, counts, ["source", "lang"], ["n_toxic", "n_good"])


@query("alias_rollup", """SELECT substr(source, 1, 4) || '+aliases' AS source, lang, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2""")
def alias_rollup(spark, folder):
    rows = table(spark, folder, "documents").select("source", "lang", "n_chars")
    alias = rows.select(F.col("source").alias("alias"), F.substring("source", 1, 4).alias("target")).distinct()
    return A.rollup_alias(rows, alias, "source", ["lang"], "n_chars")


def _norm(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '\\s+', ' ', 'g')))"


@query("quote_containment", f"""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains({_norm('d.text')}, {_norm('b.text')})""")
def quote_containment(spark, folder):
    return J.contained_passages(
        text_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text"
    )


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("quote_check", f"""WITH q AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS a,
    {_PLAIN.format("regexp_extract(html, '(?s)<p>(.*?)</p>', 1)")} AS b, {_norm(_PLAIN.format("regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g')"))} AS t FROM pages)
  SELECT page_id, CASE WHEN trim(a) = '' AND trim(b) = '' THEN NULL ELSE contains(t, {_norm('a')}) AND contains(t, {_norm('b')}) END AS quote_found
  FROM q""")
def quote_check(spark, folder):
    """A quote of a page's heading and first paragraph against the page's own text."""
    pages = text_table(spark, folder, "pages", "page_id", "html")
    part = [strip_tags(F.regexp_extract("html", rf"(?s)<{t}>(.*?)</{t}>", 1)) for t in ("h1", "p")]
    quotes = pages.select("page_id", F.concat(part[0], F.lit(" ... "), part[1]).alias("quote"))
    texts = pages.select("page_id", strip_tags("html").alias("text"))
    return J.quote_check(quotes, texts, "page_id").select("page_id", "quote_found")


@query("html_row_extract", f"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS row,
    generate_subscripts(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1), 1) - 1 AS pos FROM pages),
  c AS (SELECT page_id, pos, unnest(regexp_extract_all(row, '(?is)<a[^>]*>(.*?)</a>', 1)) AS cell,
    generate_subscripts(regexp_extract_all(row, '(?is)<a[^>]*>(.*?)</a>', 1), 1) - 1 AS place FROM r)
  SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(place AS INTEGER) AS place, {_PLAIN.format("cell")} AS cell FROM c""")
def html_row_extract(spark, folder):
    rows = extract_rows(
        text_table(spark, folder, "pages", "page_id", "html"), "html", ["page_id"], r"(?is)<li[^>]*>(.*?)</li>", r"(?is)<a[^>]*>(.*?)</a>"
    )
    return rows.select("page_id", "pos", F.posexplode("cells").alias("place", "cell"))


@query("page_host_counts", """SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1""")
def page_host_counts(spark, folder):
    return table(spark, folder, "pages").groupBy(host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("carry_down_role", """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS user_turn,
  last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS user_chars FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def carry_down_role(spark, folder):
    is_user = F.col("role") == "user"
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.when(is_user, F.col("turn")).alias("__turn"),
        F.when(is_user, F.length("text")).alias("__chars"),
    )
    return carry_down(rows, ["conv_id"], "turn", {"user_turn": "__turn", "user_chars": "__chars"}).drop("__turn", "__chars")


@query("first_clause", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([a-z%)\d])\.\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sent,
    generate_subscripts(string_split(regexp_replace(text, '([a-z%)\d])\.\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM documents),
  c AS (SELECT doc_id, i, unnest(regexp_split_to_array(sent, ',\s*(?:and\s+|while\s+|with\s+)?|\s+while\s+|;\s*')) AS clause,
    generate_subscripts(regexp_split_to_array(sent, ',\s*(?:and\s+|while\s+|with\s+)?|\s+while\s+|;\s*'), 1) AS j FROM s),
  k AS (SELECT doc_id, trim(clause, chr(32)) AS clause, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS rn FROM c
    WHERE trim(clause, chr(32)) <> '' AND regexp_matches(clause, '(?i)the ') AND regexp_matches(clause, '(?i)ing|tion'))
  SELECT d.doc_id, k.clause FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND rn = 1""")
def first_clause(spark, folder):
    return text_table(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", S.first_clause("text", "the ", mark="ing|tion").alias("clause")
    )


# Titles made from parts: the tag by size, a flair for untagged ones.
TAGGED = "CASE p_size % 8 WHEN 0 THEN '[RAM] ' WHEN 1 THEN '[SSD - M.2] ' WHEN 2 THEN '[CPU Cooler] ' WHEN 3 THEN '(GPU) ' WHEN 4 THEN '[CPU/Mobo] ' WHEN 5 THEN '[META] ' WHEN 6 THEN '[HDD] ' ELSE '' END"


@query("title_category", """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'RAM' WHEN 1 THEN 'SSD' WHEN 3 THEN 'GPU' WHEN 4 THEN 'CPU'
    WHEN 7 THEN CASE WHEN p_type = 'PROMO' THEN 'SSD' WHEN p_type = 'SMALL' THEN 'GPU' END END AS category,
  p_size % 8 = 4 AS multi_tag, p_name || ' ' || p_type AS body FROM part""")
def title_category(spark, folder):
    flair = F.when(F.col("p_type") == "PROMO", "NVMe").when(F.col("p_type") == "SMALL", "Video Card").otherwise("Other")
    titles = table(spark, folder, "part").select(
        "p_partkey", F.expr(f"concat({TAGGED}, p_name, ' ', p_type)").alias("title"), flair.alias("flair")
    )
    return categorize(titles, "title", "flair").select("p_partkey", "category", "multi_tag", "body")


def deal_posts(spark, folder):
    """One deal post per order: the order's price in one of the ways titles state prices."""
    cents = F.col("o_orderkey") % 40000 + 2000
    money = F.format_string("%d.%02d", F.floor(cents / 100), (cents % 100).cast("int"))
    forms = [
        F.concat(F.lit("[RAM] Corsair Vengeance 32GB (2x16GB) DDR5-6000 CL30 - $"), money),
        F.concat(F.lit("[SSD] Samsung 990 Pro 2TB NVMe PCIe 4.0 - $"), money),
        F.concat(F.lit("[SSD] Crucial MX500 1TB SATA - $"), money, F.lit(" - $5 coupon")),
        F.concat(F.lit("[GPU] RTX 5070 Ti - $999.99 - $50 MIR = $"), money),
        F.concat(F.lit("[CPU] AMD Ryzen 7 9800X3D - $"), money),
        F.concat(F.lit("[CPU] AMD Ryzen 7 9800X3D - $"), money, F.lit(" CAD")),
        F.concat(F.lit("[RAM] Crucial 16GB DDR4 (Used) - $"), money),
        F.concat(F.lit("[RAM] G.Skill 32GB DDR5 $"), money, F.lit(" or 64GB $900")),
        F.concat(F.lit("[GPU] ASUS RTX 4060 Ti - $"), money),
        F.concat(F.lit("[SSD] 1TB NVMe ($"), money, F.lit(" after $10 off)")),
    ]
    at = F.col("o_orderdate").cast("timestamp")
    return text_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("id"), at.alias("ts"),
        F.element_at(F.array(*forms), (F.col("o_custkey") % 10 + 1).cast("int")).alias("title"),
        F.lit("").alias("link_flair_text"), F.lit("newegg.com").alias("domain"),
    )


DEALS = """d AS (SELECT o_orderkey, o_custkey % 10 AS f, (o_orderkey % 40000 + 2000) / 100.0 AS money, CAST(o_orderdate AS DATE) AS day FROM orders),
  p AS (SELECT o_orderkey, f, day,
    CASE f WHEN 0 THEN 'RAM' WHEN 1 THEN 'SSD' WHEN 2 THEN 'SSD' WHEN 3 THEN 'GPU' WHEN 4 THEN 'CPU' WHEN 5 THEN 'CPU' WHEN 6 THEN 'RAM' WHEN 7 THEN 'RAM' WHEN 8 THEN 'GPU' ELSE 'SSD' END AS category,
    CASE WHEN f = 2 THEN round(money - 5, 2) WHEN f = 7 AND money <> 900 THEN NULL ELSE money END AS price,
    CASE WHEN f = 5 THEN 'non_usd' WHEN f = 6 THEN 'used_refurb' WHEN f = 7 THEN CASE WHEN money = 900 THEN 'multi_capacity' ELSE 'ambiguous_price' END
         WHEN f = 8 THEN 'vram_unspecified' WHEN f IN (3, 8) AND money < 40 THEN 'price_out_of_range' WHEN f = 4 AND money < 25 THEN 'price_out_of_range' END AS reject,
    CASE f WHEN 0 THEN 32.0 WHEN 1 THEN 2000.0 WHEN 2 THEN 1000.0 WHEN 9 THEN 1000.0 END AS capacity_gb,
    CASE f WHEN 0 THEN 'DDR5' END AS ddr, CASE f WHEN 1 THEN 'NVMe' WHEN 2 THEN 'SATA' WHEN 9 THEN 'NVMe' END AS interface,
    CASE f WHEN 3 THEN 'RTX 5070 Ti' WHEN 4 THEN 'Ryzen 9800X3D' END AS model FROM d)"""


@query("deal_titles", f"""WITH {DEALS} SELECT o_orderkey, category, round(price, 2) AS price, reject, capacity_gb, ddr, interface, model FROM p WHERE f NOT IN (6, 7, 5, 8)
  UNION ALL SELECT o_orderkey, category, NULL, reject, NULL, NULL, NULL, NULL FROM p WHERE f IN (5, 6, 7, 8)""")
def deal_titles(spark, folder):
    parsed = parse_titles(deal_posts(spark, folder))
    held = ["price", "capacity_gb", "ddr", "interface", "model"]
    # A rejected title keeps no reading, unless only its price range is at fault.
    kept = F.col("reject").isNull() | (F.col("reject") == "price_out_of_range")
    return parsed.select("o_orderkey", "category", "reject", *[F.when(kept, F.col(c)).alias(c) for c in held])


JUDGED = f"""{DEALS},
  a AS (SELECT *, CASE f WHEN 0 THEN 'RAM DDR5' WHEN 1 THEN 'SSD NVMe' WHEN 9 THEN 'SSD NVMe' WHEN 2 THEN 'SSD SATA' ELSE model END AS g,
      CASE WHEN category = 'RAM' THEN price / capacity_gb WHEN category = 'SSD' THEN price / (capacity_gb / 1000) ELSE price END AS v,
      year(day) * 12 + month(day) AS mi, lag(day) OVER (PARTITION BY f, price ORDER BY day, CAST(o_orderkey AS VARCHAR)) AS pd
    FROM p WHERE reject IS NULL),
  gm AS (SELECT DISTINCT g, mi FROM a),
  w AS (SELECT gm.g, gm.mi, quantile_cont(a.v, 0.5) AS med, count(*) AS n FROM gm JOIN a ON a.g = gm.g AND a.mi BETWEEN gm.mi - 1 AND gm.mi + 1 GROUP BY 1, 2),
  j AS (SELECT a.*, CASE WHEN day - pd < 3 THEN 'duplicate_repost'
      WHEN w.n >= 5 AND (v / med > CASE WHEN category IN ('RAM', 'SSD') THEN 5.0 ELSE 2.2 END OR v / med < CASE WHEN category IN ('RAM', 'SSD') THEN 0.25 ELSE 0.45 END)
      THEN 'outlier' END AS verdict FROM a JOIN w ON w.g = a.g AND w.mi = a.mi)"""


@query("deal_status", f"""WITH {JUDGED},
  u AS (SELECT category, verdict AS reject FROM j UNION ALL SELECT category, reject FROM p WHERE reject IS NOT NULL)
  SELECT category, coalesce(reject, 'ACCEPTED') AS status, count(*) AS n FROM u GROUP BY 1, 2""")
def deal_status(spark, folder):
    judged = judge(parse_titles(deal_posts(spark, folder)))
    status = F.coalesce("reject", F.lit("ACCEPTED")).alias("status")
    return judged.groupBy("category", status).agg(F.count(F.lit(1)).alias("n"))


@query("deal_monthly", f"""WITH {JUDGED}, ok AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM j WHERE verdict IS NULL),
  s AS (SELECT 'ram_ddr5_usd_per_gb' AS series, month, v AS x FROM ok WHERE f = 0 UNION ALL SELECT 'ram_ddr5_32gb_kit_usd', month, price FROM ok WHERE f = 0
    UNION ALL SELECT 'ssd_nvme_usd_per_tb', month, v FROM ok WHERE f IN (1, 9) UNION ALL SELECT 'ssd_sata_usd_per_tb', month, v FROM ok WHERE f = 2
    UNION ALL SELECT 'ssd_nvme_2tb_usd', month, price FROM ok WHERE f = 1
    UNION ALL SELECT 'gpu:' || model, month, price FROM ok WHERE f = 3 UNION ALL SELECT 'cpu:' || model, month, price FROM ok WHERE f = 4)
  SELECT series, month, round(quantile_cont(x, 0.5), 9) AS median, round(quantile_cont(x, 0.25), 9) AS p25, round(quantile_cont(x, 0.75), 9) AS p75, count(*) AS n
  FROM s GROUP BY 1, 2""")
def deal_monthly(spark, folder):
    """Monthly quartiles of the named series of accepted deals."""
    judged = settle(judge(parse_titles(deal_posts(spark, folder))))
    return rounded(monthly_series(judged.where(F.col("reject").isNull()), "2001-01-01"), 9, "median", "p25", "p75")


@query("deal_post_counts", f"""WITH {JUDGED},
  u AS (SELECT category, verdict AS reject, day FROM j UNION ALL SELECT category, reject, day FROM p WHERE reject IS NOT NULL),
  m AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM u)
  SELECT 'posts_all' AS series, month, count(*) AS n FROM m GROUP BY 1, 2
  UNION ALL SELECT 'posts_' || lower(category), month, count(*) FROM m GROUP BY 1, 2
  UNION ALL SELECT 'accepted_' || lower(category), month, count(*) FROM m WHERE reject IS NULL GROUP BY 1, 2""")
def deal_post_counts(spark, folder):
    return post_counts(judge(parse_titles(deal_posts(spark, folder))))


@query("verbal_range", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 'flat' WHEN l_linenumber % 3 = 1 THEN 'increase' ELSE 'decrease' END AS direction,
  CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 17.0 ELSE -(l_quantity + 1) END AS low,
  CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 19.0 ELSE -(l_quantity + 1) END AS high FROM lineitem""")
def verbal_range(spark, folder):
    """Statements made from line items, read back to signed ranges."""
    number = (F.col("l_quantity") + 1).cast("int").cast("string")
    kind = F.col("l_linenumber") % 3
    clause = F.when(kind == 0, F.lit("prices were roughly flat")).when(
        kind == 1, F.lit("Prices increased high-teens percentage range")
    ).otherwise(F.concat(F.lit("ASPs declined approximately "), number, F.lit("%")))
    lines = text_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", clause.alias("clause"))
    read = S.verbal_range(rows, "clause", S.PRICE_SUBJECT)
    # A flat zero keeps its sign out of the comparison.
    return read.select("l_orderkey", "l_linenumber", "l_partkey", "direction", (F.col("low") + 0.0).alias("low"), (F.col("high") + 0.0).alias("high"))


@query("statement_amounts", """WITH o AS (SELECT o_orderkey, quarter(o_orderdate) AS q, floor(o_totalprice) / 1000 AS rev, o_orderkey % 900 AS loss FROM orders)
  SELECT o_orderkey, 'revenue' AS metric, round(rev, 6) AS value FROM o UNION ALL
  SELECT o_orderkey, 'operating_profit', -round(loss * 0.001, 6) FROM o WHERE q < 4""")
def statement_amounts(spark, folder):
    """Releases made from orders: a quarter's revenue and an operating loss."""
    revenue = F.format_string("%d.%03d", F.floor(F.floor("o_totalprice") / 1000), (F.floor("o_totalprice") % 1000).cast("int"))
    text = F.concat(
        F.lit("For the full year revenues were 99 trillion won. In the fourth quarter revenues were "), revenue,
        F.lit(" trillion won. Operating loss was "), (F.col("o_orderkey") % 900).cast("string"), F.lit(" billion won."),
    )
    orders = text_table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = orders.select("o_orderkey", F.quarter("o_orderdate").alias("q"), text.alias("text"))
    return S.amounts(rows, "text", "q", ["o_orderkey"]).select("o_orderkey", "metric", (F.col("value") + 0.0).alias("value"))


@query("guidance_range", """SELECT s_suppkey, 'revenue' AS metric, 'GAAP' AS basis, (s_suppkey + 1) * 1000.0 AS mid, 200.0 AS plus_minus,
  (s_suppkey + 1) * 1000.0 - 200 AS low, (s_suppkey + 1) * 1000.0 + 200 AS high FROM supplier""")
def guidance_range(spark, folder):
    text = F.concat(F.lit("Revenue $"), (F.col("s_suppkey") + 1).cast("string"), F.lit(" billion ± $200 million"))
    rows = table(spark, folder, "supplier").select("s_suppkey", text.alias("text"))
    return S.guidance_range(rows, "text", ["s_suppkey"]).drop("unit", "text")


# Releases made from suppliers: an amount before the outlook section that must not count, and all four forms of guidance inside it.
@query("outlook_guidance", """WITH s AS (SELECT s_suppkey, 'FQ' || (s_suppkey % 4 + 1) || '-FY' || (2000 + s_nationkey) AS guidance_for, s_suppkey + 1 AS k, s_suppkey % 30 + 1.5 AS m FROM supplier WHERE s_suppkey % 5 <> 4)
  SELECT s_suppkey, guidance_for, 'revenue' AS metric, 'GAAP' AS basis, CAST(k * 1000 AS DOUBLE) AS mid, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 200 ELSE 500 END AS DOUBLE) AS plus_minus FROM s
  UNION ALL SELECT s_suppkey, guidance_for, 'gross_margin_pct', 'GAAP', m, 1.0 FROM s
  UNION ALL SELECT s_suppkey, guidance_for, 'gross_margin_pct', 'non-GAAP', m + 1, 1.0 FROM s
  UNION ALL SELECT s_suppkey, guidance_for, 'diluted_eps', 'GAAP', -m, 0.1 FROM s
  UNION ALL SELECT s_suppkey, guidance_for, 'diluted_eps', 'non-GAAP', m, 0.1 FROM s""")
def outlook_guidance(spark, folder):
    key = F.col("s_suppkey")
    k, m, more = (c.cast("string") for c in (key + 1, key % 30 + F.lit(1.5), key % 30 + F.lit(2.5)))
    quarter = F.element_at(F.array(*[F.lit(q) for q in ("first", "second", "third", "fourth")]), (key % 4 + 1).cast("int"))
    revenue = F.when(key % 2 == 0, F.concat(F.lit("Revenue $"), k, F.lit(" billion ± $200 million"))).otherwise(
        F.concat(F.lit("Revenue $"), (key + F.lit(0.5)).cast("string"), F.lit(" billion - $"), (key + F.lit(1.5)).cast("string"), F.lit(" billion"))
    )
    section = F.concat(
        F.lit("Business Outlook The following table presents "), F.col("s_name"), F.lit("'s guidance for the "), quarter, F.lit(" quarter of fiscal "),
        (F.col("s_nationkey") + 2000).cast("string"), F.lit(": "), revenue, F.lit(" Gross margin "), m, F.lit("% ± 1.0% "), more, F.lit("% ± 1.0% "),
        F.lit("Diluted earnings (loss) per share ($"), m, F.lit(") ± $0.10 $"), m, F.lit(" ± $0.10"),
    )
    text = F.concat(F.lit("Revenue $77 billion ± $1 million was the record. "), F.when(key % 5 != 4, section).otherwise("No outlook is given."))
    rows = text_table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey").select("s_suppkey", text.alias("text"))
    return S.outlook_guidance(rows, "text", ["s_suppkey"]).select("s_suppkey", "guidance_for", "metric", "basis", "mid", "plus_minus")


@query("days_of_inventory", """SELECT o_orderkey, CAST(10 + o_orderkey % 190 AS DOUBLE) AS days FROM orders WHERE o_orderkey % 6 < 5""")
def days_of_inventory(spark, folder):
    """Remarks made from orders, in each of the forms, and in none."""
    days = (10 + F.col("o_orderkey") % 190).cast("string")
    forms = [
        ("Inventory ended the quarter with days of inventory (DIO) at ", "."), ("Average days of inventory for the quarter were down to ", " days, as expected."),
        ("We hold $8.4 billion of inventory, or ", " days."), ("Days of inventory was ", ", better than before."), ("The year ended with ", " days of inventory."),
        ("Demand rose for ", " days in a row."),
    ]
    text = F.lit(None).cast("string")
    for i, (before, behind) in enumerate(forms):
        text = F.when(F.col("o_orderkey") % 6 == i, F.concat(F.lit("Sales of 99 days were fine. " + before), days, F.lit(behind))).otherwise(text)
    rows = text_table(spark, folder, "orders", "o_orderkey").select("o_orderkey", S.days_of_inventory(text).alias("found"))
    return rows.where("found IS NOT NULL").select("o_orderkey", "found.days")


@query("paired_changes", """SELECT p_partkey, 'dram_bit_shipments_qoq_pct' AS metric, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'dram_asp_qoq_pct', CAST(p_size + 1 AS DOUBLE) FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'nand_asp_qoq_pct', -CAST(p_size AS DOUBLE) FROM part WHERE p_size % 2 = 1""")
def paired_changes(spark, folder):
    size = F.col("p_size").cast("string")
    text = F.when(
        F.col("p_size") % 2 == 0,
        F.concat(F.lit("DRAM bit shipments and the average selling price rose "), size, F.lit("% and "), (F.col("p_size") + 1).cast("string"), F.lit("% respectively.")),
    ).otherwise(F.concat(F.lit("The NAND average selling price slipped by "), size, F.lit("%. Outlook is stable.")))
    rows = table(spark, folder, "part").select("p_partkey", text.alias("text"))
    return S.paired_changes(rows, "text", ["p_partkey"]).drop("source_text")


@query("date_precision", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE)
  WHEN 2 THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS date,
  CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' ELSE 'year' END AS precision FROM orders""")
def date_precision(spark, folder):
    at = F.col("o_orderdate")
    written = F.element_at(F.array(
        F.date_format(at, "MMMM d, yyyy"), F.date_format(at, "MMM yyyy"),
        F.concat(F.lit("Q"), F.quarter(at).cast("string"), F.lit(" "), F.year(at).cast("string")),
        F.concat(F.lit("released in "), F.year(at).cast("string")),
    ), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, folder, "orders").withColumn("__d", S.parse_date_precision(written))
    return rows.select("o_orderkey", "__d.date", "__d.precision")
