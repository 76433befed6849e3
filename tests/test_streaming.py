"""Stream forms give the batch results on closed periods."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators.joins import drop_reposts
from pricetide.sources import schemas
from pricetide.streaming import streams as S


def test_intake_rewrites_a_month(spark, tmp_path):
    folder, sink, progress = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "progress")
    folder.mkdir()

    def put(name, posts):
        (folder / name).write_text("\n".join(json.dumps({"id": i, "created_utc": t, "title": x}) for i, t, x in posts))
        S.ingest_stream(spark, str(folder), schemas.POSTS, sink, progress).awaitTermination()
        return sorted((r["id"], r["title"], str(r["month"])) for r in spark.read.parquet(sink).collect())

    put("2025-01.jsonl", [("a", 1735689600, "old"), ("b", 1735689700, "b")])
    put("2025-02.jsonl", [("c", 1738368000, "c")])
    rows = put("2025-01-again.jsonl", [("a", 1735689600, "new"), ("d", 1735689800, "d")])
    assert rows == [("a", "new", "2025-01-01"), ("b", "b", "2025-01-01"), ("c", "c", "2025-02-01"), ("d", "d", "2025-01-01")]


def test_intake_after_a_failure_between_its_writes(spark, tmp_path, monkeypatch):
    """The first run dies when it publishes; the replay gives the sink of an undisturbed run, and no folder is left per batch."""
    from pyspark.sql import DataFrameWriter

    folder, sink, progress = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "progress")
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(json.dumps({"id": i, "created_utc": 1735689600, "title": t}) for i, t in [("a", "x"), ("a", "y"), ("b", "z")]))
    write = DataFrameWriter.parquet

    def failing(self, path, *args, **kwargs):
        if path == sink:
            raise RuntimeError("lost")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception):
        S.ingest_stream(spark, str(folder), schemas.POSTS, sink, progress).awaitTermination()
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    S.ingest_stream(spark, str(folder), schemas.POSTS, sink, progress).awaitTermination()
    rows = sorted((r["id"], r["title"]) for r in spark.read.parquet(sink).collect())
    assert rows == [("a", "y"), ("b", "z")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "progress", "progress-staged", "sink"]


def reposts(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(0, 40 * 86400, 300))
    rows = [(int(i), f"t{rng.integers(0, 6)}", dt.datetime(2025, 1, 1) + dt.timedelta(seconds=int(s))) for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, title string, ts timestamp")
    folder = tmp_path / "posts"
    for n in range(3):
        df.where((F.col("id") >= n * 100) & (F.col("id") < n * 100 + 100)).coalesce(1).write.mode("append").parquet(str(folder))
    return df, str(folder)


def test_repost_stream_equals_batch(spark, tmp_path):
    df, folder = reposts(spark, tmp_path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    S.repost_stream(stream, ["title"], "ts", "id", 3, f"{tmp_path}/sink", f"{tmp_path}/state", f"{tmp_path}/progress").awaitTermination()
    have = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/sink").collect())
    assert have == sorted(r["id"] for r in drop_reposts(df, ["title"], "ts", "id", 3).collect())


def test_watermark_dedup_differs_from_the_chain_rule(spark, tmp_path):
    df, folder = reposts(spark, tmp_path)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    kept = spark.read.parquet(S.run_to_table(S.dedup_stream(stream, ["title"], "ts"), "dedup")).count()
    assert 0 < kept < df.count()


def test_months_from_daily_counts(spark):
    daily = spark.createDataFrame([(dt.date(2025, 1, 3), "a", 2), (dt.date(2025, 1, 9), "a", 3), (dt.date(2025, 2, 1), "a", 1)], "day date, k string, n long")
    assert sorted((str(r["month"]), r["n"]) for r in S.monthly_from_daily(daily, ["k"]).collect()) == [("2025-01-01", 5), ("2025-02-01", 1)]
