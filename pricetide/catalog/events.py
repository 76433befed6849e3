"""Runs, reposts, outliers, volumes and aligned series over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.topics import news_monthly
from ..operators import aggregate as A
from ..operators.joins import drop_reposts, drop_stale
from ..plans.deals import flag_outliers
from ..sources.readers import with_post_time
from ..streaming.streams import run_to_table, windowed_counts
from .base import day, query, rounded, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark, folder):
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("scan_dedup_events", """SELECT DISTINCT CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc,
  CAST(date_trunc('month', ts) AS DATE) AS month FROM events""")
def scan_dedup_events(spark, folder):
    posts = events(spark, folder).select(F.col("event_id").cast("string").alias("id"), F.unix_timestamp("ts").alias("created_utc"))
    return with_post_time(posts).dropDuplicates(["id"]).select("id", "created_utc", "month")


@query("json_props_explode", """SELECT event_id, k AS key, CAST(json_extract(props, '$.' || k) AS INTEGER) AS value
  FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_props_explode(spark, folder):
    props = F.from_json("props", "map<string,int>")
    return events(spark, folder).select("event_id", F.explode(props).alias("key", "value"))


@query("id_span", """SELECT day, last_id, last_id - lag(last_id) OVER (ORDER BY day) AS n_items
  FROM (SELECT CAST(ts AS DATE) AS day, max(event_id) AS last_id FROM events GROUP BY 1)""")
def id_span(spark, folder):
    return A.id_span(events(spark, folder), "event_id", "ts", "day")


@query("drop_stale_runs", """WITH a AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(CASE WHEN p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
  c AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS rn FROM b)
  SELECT event_id, user_id, event_type FROM c WHERE rn = 1 OR n < 3""")
def drop_stale_runs(spark, folder):
    rows = events(spark, folder).select("event_id", "user_id", "event_type", "ts")
    kept = drop_stale(rows, ["user_id"], ["ts", "event_id"], "event_type", F.date_trunc("DAY", "ts"))
    return kept.select("event_id", "user_id", "event_type")


@query("repost_dedup", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p
  FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 1 DAY""")
def repost_dedup(spark, folder):
    rows = events(spark, folder).select("event_id", "user_id", "event_type", "ts")
    return drop_reposts(rows, ["user_id", "event_type"], "ts", "event_id", 1).drop("ts")


@query("rolling_outliers", """WITH e AS (SELECT event_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
  d AS (SELECT DISTINCT event_type, day FROM e),
  w AS (SELECT d.event_type, d.day, quantile_cont(e.value, 0.5) AS med, count(*) AS n
        FROM d JOIN e ON e.event_type = d.event_type AND e.day BETWEEN d.day - 1 AND d.day + 1 GROUP BY 1, 2)
  SELECT event_id, event_type, n >= 5 AND (value / med > 2.2 OR value / med < 0.45) AS is_outlier FROM e JOIN w USING (event_type, day)""")
def rolling_outliers(spark, folder):
    rows = events(spark, folder).select("event_id", "event_type", "value", F.unix_date(day("ts")).alias("period"))
    return flag_outliers(rows, ["event_type"], "period", "value", 0.45, 2.2).select("event_id", "event_type", "is_outlier")


@query("weighted_mean", """SELECT event_type, round(sum(value * k) / sum(k), 6) AS value FROM (
  SELECT event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k > 0 GROUP BY 1""")
def weighted_mean(spark, folder):
    rows = events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(A.weighted_mean(rows, ["event_type"], "value", "k"), 6, "value")


@query("share_per_1k", """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total,
  round(1000.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS per_1k FROM events GROUP BY 1""")
def share_per_1k(spark, folder):
    rows = events(spark, folder).select(
        day("ts").alias("day"), (F.col("event_type") == "error").cast("long").alias("errors"), F.lit(1).cast("long").alias("total")
    )
    return rounded(A.share(rows, ["day"], "errors", "total", 1000.0, "per_1k"), 6, "per_1k")


@query("complete_groups_sum", """SELECT user_id, day, round(sum(v), 6) AS value FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(value) AS v FROM events
  WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 3""")
def complete_groups_sum(spark, folder):
    rows = events(spark, folder).withColumn("day", day("ts"))
    members = ["click", "view", "error"]
    return rounded(A.complete_only(rows, ["user_id", "day"], "event_type", 3, ["value"], members), 6, "value")


def daily_counts(spark, folder):
    return events(spark, folder).groupBy("event_type", day("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("align_series", """SELECT CAST(ts AS DATE) AS day, """ + ", ".join(
    f"CAST(nullif(count(*) FILTER (WHERE event_type = '{t}'), 0) AS DOUBLE) AS n_{t}" for t in TYPES
) + """, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def align_series(spark, folder):
    counts = daily_counts(spark, folder).select("day", F.concat(F.lit("n_"), "event_type").alias("metric"), "value")
    means = events(spark, folder).groupBy(day("ts").alias("day")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("mean_value"))
    return rounded(A.align([counts, means], "day", "metric", "value", [*[f"n_{t}" for t in TYPES], "mean_value"]), 6, "mean_value")


@query("peak_latest", """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
  u AS (SELECT *, max(day) OVER (PARTITION BY event_type) AS newest FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, day) AS a, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS b
        FROM u WHERE day < newest)
  SELECT event_type, max(v) AS peak, max(CASE WHEN a = 1 THEN day END) AS peak_at, max(CASE WHEN b = 1 THEN v END) AS latest,
         max(CASE WHEN b = 1 THEN day END) AS latest_at FROM k GROUP BY 1""")
def peak_latest(spark, folder):
    return A.peak_latest(daily_counts(spark, folder), ["event_type"], "day", "value", drop_partial=True)


@query("news_tone", """WITH d AS (SELECT event_type AS term, CAST(ts AS DATE) AS date, count(*) FILTER (WHERE value > 20) AS n, avg(value) AS tone FROM events GROUP BY 1, 2),
  t AS (SELECT CAST(ts AS DATE) AS date, count(*) AS total FROM events GROUP BY 1)
  SELECT term, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(n) AS DOUBLE) AS articles, round(sum(n) / sum(total), 6) AS share_of_monitored,
  round(sum(tone * n) FILTER (WHERE n > 0) / sum(n) FILTER (WHERE n > 0), 6) AS avg_tone FROM d JOIN t USING (date) GROUP BY 1, 2""")
def news_tone(spark, folder):
    rows = events(spark, folder).withColumn("date", day("ts"))
    per_term = rows.groupBy(F.col("event_type").alias("term"), "date").agg(
        F.count_if(F.col("value") > 20).cast("double").alias("articles"), F.avg("value").alias("tone")
    )
    total = rows.groupBy("date").agg(F.count(F.lit(1)).cast("double").alias("monitored"))
    daily = per_term.join(total, "date").unpivot(["date", "term"], ["articles", "monitored", "tone"], "metric", "value")
    return rounded(news_monthly(daily, "articles", "monitored", "tone"), 6, "share_of_monitored", "avg_tone")


@query("stream_daily_counts", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
  GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_daily_counts(spark, folder):
    batch = table(spark, folder, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path = run_to_table(windowed_counts(stream, "ts", ["event_type"]), "daily-counts")
    return spark.read.parquet(path)
