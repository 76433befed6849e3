"""Stream forms of intake, windowed counts and repost removal.

Each takes a streaming frame (or folder) and writes Parquet under the shared folder;
``availableNow`` processes what is there in as many batches as it takes and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import bucket
from ..operators.joins import first_per, repost_gap
from ..session import fresh_path
from ..sources.readers import with_post_time


def ingest_stream(
    spark: SparkSession, folder: str, schema: str | T.StructType, sink: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """New or rewritten month files into a sink partitioned by month.

    Months found in a batch are rebuilt from the rows already there and the new ones, the
    newest file winning per id, so replaying a batch gives the same sink.
    """
    # mtime and size are part of a file's identity, so a month rewritten in place is read again.
    raw = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "FAILFAST").json(folder)
        .withColumn("source_time", F.col("_metadata.file_modification_time"))
    )

    def rebuild(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = with_post_time(batch)
        if _has_data(session, sink):
            months = rows.select("month").distinct()
            rows = session.read.parquet(sink).join(months, "month", "left_semi").unionByName(rows)
        # Of files with one time the row that comes last as text wins, so that the order of reading does not matter.
        content = F.to_json(F.struct(*[c for c in rows.columns if c != "source_time"]))
        newest = first_per(rows, ["id"], [F.col("source_time"), content], last=True)
        # The old month partitions are read while they are replaced, so the result is settled first. One folder serves all
        # batches: a replay after a failure writes it anew and publishes the same months.
        staged = f"{checkpoint.rstrip('/')}-staged"
        newest.write.mode("overwrite").partitionBy("month").parquet(staged)
        session.read.parquet(staged).withColumn("month", F.col("month").cast("date")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("month").parquet(sink)

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(rebuild).trigger(availableNow=True).start()


def _has_data(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window; a window is final once the watermark passes its end."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counts = timed.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("date").alias("day"), *keys, "n")


def monthly_from_daily(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Months rolled up from final daily counts; a late day never reopens a month."""
    return daily.groupBy(bucket("day").alias("month"), *keys).agg(F.sum("n").alias("n"))


def run_to_table(stream: DataFrame, name: str) -> str:
    """Run what is available into a new Parquet folder and return its path."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return path


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, gap: str = "3 days") -> DataFrame:
    """Drop rows within ``gap`` of the first row kept.

    Not the batch rule: that one measures from the previous row even if it was dropped, so a
    long chain of reposts is cut in other places. ``repost_stream`` follows the batch rule.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, gap).dropDuplicatesWithinWatermark(keys)


def repost_stream(
    stream: DataFrame, keys: list[str], ts: str, tie: str, days: float, sink: str, state: str, checkpoint: str
) -> StreamingQuery:
    """The batch repost rule over batches that arrive in time order.

    The last time per key is kept as a table with one version per batch: batch ``n`` reads
    version ``n - 1`` and writes its own, so a replay after a failure gives the same rows.
    """
    columns = stream.columns
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))

    def keep_first(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("__seen", F.lit(False))
        before = f"{state}/version={batch_id - 1}"
        if _has_data(session, before):
            rows = rows.unionByName(session.read.parquet(before).withColumn("__seen", F.lit(True)), allowMissingColumns=True)
        marked = repost_gap(rows, keys, ts, tie, days).where(~F.col("__seen"))
        marked.where(~F.col("is_repost")).select(*columns).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        # A key quiet for longer than the gap can be forgotten: its next row is no repost.
        latest = rows.groupBy(*keys).agg(F.max(F.struct(ts, tie)).alias("__l")).select(*keys, f"__l.{ts}", f"__l.{tie}")
        horizon = rows.agg(F.max(ts)).scalar() - F.expr(f"interval {int(days * 86400)} seconds")
        latest.where(F.col(ts) > horizon).write.mode("overwrite").parquet(f"{state}/version={batch_id}")

    return timed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep_first).trigger(availableNow=True).start()
