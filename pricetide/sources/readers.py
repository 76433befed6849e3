"""Typed scans of long tables, post archives, nested facts, tagged XML and cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import bucket
from ..operators.joins import first_per
from . import schemas


def read_facts(spark: SparkSession, path: str, schema: str | T.StructType = schemas.FACTS) -> DataFrame:
    """Long table from CSV (by extension) or Parquet, with the declared types."""
    reader = spark.read.schema(schema)
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return reader.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return reader.parquet(path)


def read_posts(spark: SparkSession, glob: str, schema: str | T.StructType = schemas.POSTS) -> DataFrame:
    """JSON-lines archive (plain or gzip), one row per id, the first in file order, with ``ts`` and ``month``."""
    rows = with_post_time(spark.read.schema(schema).option("mode", "FAILFAST").json(glob))
    columns = rows.columns
    place = ["__file", "__block", "__line"]
    rows = rows.withColumns({
        "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id(),
    })
    return first_per(rows, ["id"], [F.col(c) for c in place]).select(*columns)


def with_post_time(posts: DataFrame) -> DataFrame:
    out = posts.withColumn("ts", F.timestamp_seconds("created_utc")).withColumn("month", bucket("ts"))
    for name in ("link_flair_text", "domain"):
        if name in posts.columns:
            out = out.withColumn(name, F.coalesce(name, F.lit("")))
    return out


def read_coverage(spark: SparkSession, glob: str) -> DataFrame:
    """One counter object per file named ``<group>_<YYYY-MM>.meta.json``."""
    name = F.col("_metadata.file_name")
    return (
        spark.read.schema(schemas.COVERAGE).option("multiLine", True).json(glob)
        .select(
            F.regexp_extract(name, r"^(.*)_\d{4}-\d{2}\.meta\.json$", 1).alias("term"),
            F.to_date(F.concat(F.regexp_extract(name, r"_(\d{4}-\d{2})\.meta\.json$", 1), F.lit("-01"))).alias("date"),
            "scanned",
            "kept",
        )
    )


# Filing forms whose facts count.
FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A", "10-KT", "10-QT")


def explode_facts(
    df: DataFrame, json_col: str, keep: list[str], unit: str = "USD", forms: tuple[str, ...] = FORMS
) -> DataFrame:
    """``{tag: {units: {unit: [fact, ...]}}}`` text to one row per fact of the listed forms."""
    parsed = df.select(*keep, F.explode(F.from_json(json_col, schemas.FACT_UNITS)).alias("tag", "__body"))
    facts = parsed.select(*keep, "tag", F.inline(F.col("__body.units")[unit]))
    return facts.where(F.col("form").isin(*forms))


# Fixed value: the axis that does not count as a breakdown.
_NEUTRAL_AXIS = "srt:ConsolidationItemsAxis"


def read_xml_facts(spark: SparkSession, path: str, tags: list[str], axes: list[str], prefix: str = "us-gaap:") -> DataFrame:
    """Facts of one instance folder whose context has exactly one breakdown axis."""
    file = F.col("_metadata.file_path").alias("file")

    def contexts_of(space: str) -> DataFrame:
        return (
            spark.read.format("xml").schema(schemas.XML_CONTEXT.replace("xbrli:", space)).option("rowTag", f"{space}context").load(path)
            .select(
                file,
                F.col("_id").alias("context"),
                F.col(f"`{space}entity`.`{space}segment`.`xbrldi:explicitMember`").alias("members"),
                F.col(f"`{space}period`.`{space}startDate`").alias("start"),
                F.col(f"`{space}period`.`{space}endDate`").alias("end"),
            )
        )

    # Instance files name the elements of XBRL with a prefix or by default.
    contexts = (
        contexts_of("xbrli:").unionByName(contexts_of(""))
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .withColumn("members", F.filter("members", lambda m: m["_dimension"] != _NEUTRAL_AXIS))
        .where(F.size("members") == 1)
        .withColumns({"axis": F.get("members", F.lit(0))["_dimension"], "member": F.trim(F.get("members", F.lit(0))["_VALUE"])})
        .where(F.col("axis").isin(*axes))
        .drop("members")
    )
    facts = None
    for tag in tags:
        part = (
            spark.read.format("xml").schema(schemas.XML_FACT).option("rowTag", prefix + tag).load(path)
            .select(file, F.lit(tag).alias("tag"), F.col("_contextRef").alias("context"), F.col("_VALUE").alias("val"))
        )
        facts = part if facts is None else facts.unionByName(part)
    joined = facts.where(F.col("val").isNotNull()).join(contexts, ["file", "context"])
    return joined.select("file", "tag", "axis", "member", "start", "end", "val")


def flatten_cube(df: DataFrame, dims: list[str]) -> DataFrame:
    """Sparse cube (flat offset -> value) to one row per filled cell.

    The offset is a mixed-radix number over the dimension sizes, last dimension fastest.
    """
    codes = {
        d: F.transform(
            F.array_sort(
                F.transform(
                    F.map_entries(F.col("dimension")[d]["category"]["index"]),
                    lambda e: F.named_struct(F.lit("at"), e["value"], F.lit("code"), e["key"]),
                )
            ),
            lambda s: s["code"],
        )
        for d in dims
    }
    cells = df.select(*[c.alias(f"__{d}") for d, c in codes.items()], F.explode("value").alias("__at", "value"))
    cells = cells.where(F.col("value").isNotNull())
    step: Column = F.lit(1)
    places = {}
    for d in reversed(dims):
        size = F.size(f"__{d}")
        offset = F.floor(F.col("__at").cast("long") / step) % size
        places[d] = F.element_at(f"__{d}", (offset + 1).cast("int")).alias(d)
        step = step * size
    return cells.select(*[places[d] for d in dims], "value")


def unpivot_year_blocks(sheet: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Sheet with year rows between region rows to ``(date, region, value)``.

    A label that is a number opens a year; it fills down over the rows below it.
    """
    keys = part or []
    year = F.col("label").try_cast("double").cast("int")
    below = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    regions = (
        sheet.withColumn("year", F.last(year, ignorenulls=True).over(below))
        .where(year.isNull() & F.col("label").isNotNull() & F.col("year").isNotNull())
        .withColumn("region", F.trim("label"))
    )
    long = regions.unpivot([*keys, "region", "year"], schemas.MONTHS, "month", "value").where(F.col("value").isNotNull())
    number = F.array_position(F.array(*[F.lit(m) for m in schemas.MONTHS]), F.col("month")).cast("int")
    return long.select(*keys, F.make_date("year", number, F.lit(1)).alias("date"), "region", "value")


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)
