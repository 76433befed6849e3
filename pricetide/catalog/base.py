"""Registration of queries over the shared tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import spread
from ..session import prepare

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows take real work each, over all cores."""
    return spread(table(spark, folder, name).select(*columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day(col: str) -> Column:
    return F.col(col).cast("date")


# Quotes of the shared tables: one line item is one quote of a part's unit price.
QUOTES_SQL = """
  SELECT l_returnflag AS section, l_partkey AS key, CAST(l_shipdate AS DATE) AS day,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         l_extendedprice / l_quantity AS price, 'S' || l_suppkey AS item,
         l_orderkey * 10 + l_linenumber AS tie
  FROM lineitem WHERE l_quantity > 0
"""


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").where("l_quantity > 0").select(
        F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("key"), day("l_shipdate").alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("item"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
    )


PART_QUOTES_SQL = """
  SELECT p_brand, p_type, p_name, p_size, p_partkey, p_retailprice, CAST(l_shipdate AS DATE) AS day,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_quantity, l_discount,
         l_extendedprice / l_quantity AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0
"""


def part_quotes(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_quantity > 0").select(
        F.col("l_partkey").alias("p_partkey"), day("l_shipdate").alias("day"), "l_quantity", "l_discount",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    return lines.join(table(spark, folder, "part"), "p_partkey")
