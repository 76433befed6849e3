"""Price as a share of launch price by age, and generation-over-generation gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import age_months
from ..operators.joins import join_curve, join_earliest
from ..operators.quantiles import exact_quantiles


def with_age(posts: DataFrame, launches: DataFrame, key: str, day: str, price: str, order: list[Column]) -> DataFrame:
    """Posts with their earliest launch row: ``age_m, ratio, age_bin``; posts before launch go."""
    joined = join_earliest(posts, launches, key, order).withColumn("age_m", age_months(day, "release_date"))
    return (
        joined.where(F.col("age_m") >= 0)
        .withColumn("ratio", F.col(price) / F.col("launch_price"))
        .withColumn("age_bin", (F.floor(F.col("age_m") / 6) * 6).cast("int"))
    )


def aging_curve(posts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median ratio and count per age bin of the reference posts."""
    return exact_quantiles(posts, [*(keys or []), "age_bin"], "ratio", {"ref_ratio": 0.5}, count="ref_n")


def relative_to_curve(
    posts: DataFrame, curve: DataFrame, model: str, price: str, min_n: int = 20, launch: str = "launch_price",
) -> DataFrame:
    """Each post against the curve at its own age, then one row per model."""
    compared = join_curve(posts, curve, ["age_bin"]).where(F.col("ref_n") >= min_n)
    compared = compared.withColumn("rel", F.ln(F.col("ratio") / F.col("ref_ratio")))
    # The four medians of a model come from one pass over (column, value) rows.
    columns = ["rel", "age_m", price, "ratio"]
    values = F.array(*[F.struct(F.lit(c).alias("__kind"), F.col(c).cast("double").alias("__value")) for c in columns])
    medians = exact_quantiles(
        compared.select(model, F.col(launch).alias("__launch"), F.inline(values)), [model, "__kind"], "__value", {"__m": 0.5}, count="__n",
        extra={"__first": ("min", F.col("__launch"))},
    )
    of = lambda kind, column: F.max(F.when(F.col("__kind") == kind, F.col(column)))
    out = medians.groupBy(model).agg(
        of("rel", "__m").alias("rel"), of("rel", "__n").alias("n"), of("rel", "__first").alias("launch"),
        *[of(c, "__m").alias(c) for c in columns[1:]],
    )
    return out.withColumn("vs_normal_pct", 100 * (F.exp("rel") - 1))


def gen_over_gen(df: DataFrame, tier: list[str], date: str, model: str, columns: list[str]) -> DataFrame:
    """Change in % of each column against the previous generation of the tier, and years between.

    A tier holds its generations only, one row each.
    """
    order = Window.partitionBy(*tier).orderBy(date, model)
    seen = df.withColumn("__n", F.row_number().over(order)).withColumns(
        {f"__prev_{c}": F.lag(c).over(order) for c in [model, date, *columns]}
    ).where(F.col("__n") > 1)
    changes = [((F.col(c) / F.col(f"__prev_{c}") - 1) * 100).alias(f"{c}_change_pct") for c in columns]
    return seen.select(
        *tier, F.col(f"__prev_{model}").alias("from_model"), F.col(model).alias("to_model"),
        F.col(f"__prev_{date}").alias("from_date"), F.col(date).alias("to_date"),
        F.bround(F.datediff(date, f"__prev_{date}") / 365.25, 2).alias("years"), *changes,
    )


def best_backend(df: DataFrame, device: str, score: str, runs: str, backend: str, min_runs: int = 5) -> DataFrame:
    """Highest score among rows with enough runs; ties go to the first backend by name."""
    ok = df.where(F.col(runs) >= min_runs)
    best = F.min_by(F.struct(score, backend, runs), F.struct((-F.col(score)).alias("s"), F.col(backend).alias("b")))
    return ok.groupBy(device).agg(best.alias("__b")).select(device, "__b.*")
