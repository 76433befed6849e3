"""Checks on data: schema drift, required keys, values quoted in text, inspection samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame itself when names and types agree in order, else an error naming the drift."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    if have != want:
        raise ValueError(f"columns changed: expected {want}, found {have}")
    return df


def missing_required(df: DataFrame, column: str) -> DataFrame:
    """Rows without the required text."""
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) == "")


def assert_required(df: DataFrame, column: str) -> DataFrame:
    """Fails the job at the first row without the required text."""
    present = F.trim(F.coalesce(F.col(column), F.lit(""))) != ""
    message = F.raise_error(F.lit(f"every row needs {column}")).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(present, F.col(column)).otherwise(message))


def sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """A repeatable sample for inspection: the n smallest hashes of the id."""
    return df.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)


def _spelled(number: Column) -> list[Column]:
    """A whole number with and without thousands separators, when it has any."""
    size = F.abs(number)
    return [F.when(size >= 1000, F.format_number(size, 0)), size.cast("string")]


def _found(text: Column, number: Column, keywords: str) -> Column:
    """The number stands in the text, its keyword within 200 characters before it."""
    hits = []
    for spelled in _spelled(number):
        amount = F.concat(
            F.lit(rf"(?is)(?=(?:{keywords})).{{1,200}}?(?<![\d,.])\(?\$?\s?"), spelled, F.lit(r"(?![\d,]|\.\d)")
        )
        # A pattern of the row's own is made only where the number stands in the text at all.
        hits.append(F.coalesce(F.when(F.contains(text, spelled), F.regexp(text, amount)), F.lit(False)))
    return hits[0] | hits[1]


def value_in_text(
    df: DataFrame, text: str, value: str, keywords: str, derived: str | None = None, ytd: str | None = None
) -> DataFrame:
    """How a value in millions is found in its text: exact; for derived values also one off, or the year sum."""
    body, v = F.col(text), F.col(value).cast("long")
    how = F.when(_found(body, v, keywords), "exact")
    if derived:
        soft = F.col(derived)
        how = how.when(soft & (_found(body, v + 1, keywords) | _found(body, v - 1, keywords)), "within_1mn")
        if ytd:
            how = how.when(soft & _found(body, F.col(ytd).cast("long"), keywords), "ytd_sum")
    return df.withColumn("match_type", how).withColumn("found", F.col("match_type").isNotNull())
