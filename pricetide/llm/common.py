"""What several operators share: session, tables, scratch tables, bounded samples, words."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, prepare

# Arrow batches stay small because single texts can be very long.
BATCH_ROWS = "512"
# White space of the word rule: [^\x20\x09-\x0D]+ are words. bytes.split() cuts at exactly these.
WORD = "[^\\x20\\x09-\\x0D]+"
_shipped: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the executors' path."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[quoted(c) for c in df.columns])


def count_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    cut = F.split(F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")), " ")
    return F.coalesce(F.size(F.filter(cut, lambda w: w != "")), F.lit(0)).cast("long")


def crc_of_id(ident: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % modulus


def class_sample(df: DataFrame, label: str, ident: str, per_class: int, most: int) -> DataFrame:
    """At most ``per_class`` rows of each label, and about ``most`` rows of all labels together; no label is left out.

    Rows are picked by the hash of their id, so reruns agree. One count per label goes to the driver; rows are thinned by hash
    first, so only about 1.5 x the sample is ranked.
    """
    known = df.where(F.col(label).isNotNull() & F.col(ident).isNotNull())
    counts = known.groupBy(label).count().collect()
    if not counts:
        return known.limit(0)
    each = min(per_class, max(1, most // len(counts)))
    share = F.create_map(*[F.lit(x) for r in sorted(counts, key=lambda r: str(r[0])) for x in (r[0], min(1.0, (1.5 * each + 50) / r[1]))])
    place = F.pmod(F.xxhash64(F.col(ident), F.lit("sample")), F.lit(1 << 30))
    near = known.withColumn("_place", place).where(F.col("_place") < share[F.col(label)] * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_place", ident))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank", "_place")
