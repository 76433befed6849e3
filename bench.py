"""Time the headline queries once each and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pricetide.catalog import QUERIES
from pricetide.session import build_session

HEADLINE = [
    "item_month", "chain_links", "chain_index", "monthly_median", "monthly_quartiles", "quarterly_pool", "two_level_mean",
    "series_union", "topk_series", "reject_cascade", "basket_summary", "price_vs_launch", "aging_curve", "aging_vs_normal",
    "before_after", "turning_points", "cycle_table", "upswing_decay", "scenario_table", "scenario_paths", "backtest",
    "drop_stale_runs", "repost_dedup", "rolling_outliers", "weighted_mean", "share_per_1k", "align_series",
    "latest_wins", "priority_coalesce", "conflict_log", "first_reported", "ytd_to_discrete", "interval_label",
    "first_event_after", "interpolate_at", "nearest_sample", "reconcile_totals", "upsert_orders", "backfill_plan",
    "gen_over_gen", "topic_flags", "quote_containment", "html_row_extract", "carry_down_role", "first_clause",
    "deal_titles", "deal_status", "verbal_range", "statement_amounts", "value_in_text", "stream_daily_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.checkpoint.dir": scratch, "spark.local.dir": scratch,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
