"""Brackets give the same quantiles as whole groups and as numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators.quantiles import exact_quantiles

QS = {"q25": 0.25, "q50": 0.5, "q90": 0.9}


def frame(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def groups():
    rng = np.random.default_rng(3)
    return {
        "hot": np.concatenate([rng.lognormal(3, 2, 4000), [1e12, -5.0]]),
        "ties": np.repeat([1.0, 2.0, 2.0, 9.0], 300),
        "flat": np.repeat(7.5, 500),
        "small": rng.normal(0, 1, 9),
        "one": np.array([42.0]),
    }


@pytest.mark.parametrize("accuracy", [20_000, 10, 100])
def test_matches_numpy(spark, accuracy):
    data = groups()
    out = exact_quantiles(
        frame(spark, data), ["g"], "v", QS, count="n", extra={"v": ("max", F.col("v"))}, accuracy=accuracy
    ).collect()
    assert len(out) == len(data)
    for row in out:
        values = data[row["g"]]
        assert row["n"] == len(values) and row["v"] == max(values)
        for name, q in QS.items():
            assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12), (row["g"], name)


def test_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(11)] + [("a", 1.0)], "g string, v double")
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r["m"] for r in whole] == [4.5]
    by_key = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert by_key == {None: 5.0, "a": 1.0}


@pytest.mark.parametrize("accuracy", [20_000, 10])
def test_bunched_and_extreme_values(spark, accuracy):
    rng = np.random.default_rng(5)
    data = {
        "bunched": 1e6 + rng.random(3000) * 1e-3, "below": -np.abs(rng.lognormal(0, 3, 500)), "zero": np.array([0.0, -0.0, 0.0, 1e-300, -1e300]),
        "infinite": np.array([1.0, 2.0, np.inf, np.inf, np.inf]),
        "tiny": np.array([5e-324, 1e-310, -1e-310, 2.0**-1022, 1e-300]), "powers": np.concatenate([2.0 ** np.arange(-40, 40), np.nextafter(2.0 ** np.arange(-40, 40), 0)]),
    }
    for row in exact_quantiles(frame(spark, data), ["g"], "v", {"m": 0.5, "u": 0.9}, accuracy=accuracy).collect():
        values = np.sort(data[row["g"]])
        want = [np.inf, np.inf] if row["g"] == "infinite" else np.quantile(values, [0.5, 0.9])
        assert [row["m"], row["u"]] == pytest.approx(list(want), rel=1e-12)


@pytest.mark.parametrize("accuracy", [20_000, 10])
def test_weights_and_empty_input(spark, accuracy):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("b", 2.0, 0)], "g string, v double, w long")
    rows = exact_quantiles(df, ["g"], "v", {"m": 0.5}, count="n", weight="w", accuracy=accuracy).collect()
    assert [(r["g"], r["m"], r["n"]) for r in rows] == [("a", 1.0, 4)]
    assert [tuple(r) for r in exact_quantiles(df.limit(0), [], "v", {"m": 0.5}, count="n", accuracy=accuracy).collect()] == [(None, 0)]
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, count="n", accuracy=accuracy).collect()
    assert [tuple(r) for r in whole] == [(2.0, 3)]


def test_a_million_distinct_values_in_a_narrow_range(spark):
    df = spark.range(1_000_000).selectExpr("100 + 0.2 * rand(3) AS v").union(spark.sql("SELECT 1e300D AS v"))
    row = exact_quantiles(df, [], "v", QS, count="n").first()
    values = np.array([r.v for r in df.collect()])
    assert row.n == 1_000_001 and [row[q] for q in QS] == pytest.approx(np.quantile(values, list(QS.values())).tolist(), rel=1e-13)


def test_no_job_while_the_plan_is_built(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS double) AS v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "quantiles")
    plan = exact_quantiles(df, ["g"], "v", {"m": 0.5})
    assert not tracker.getJobIdsForGroup("building")
    assert plan.count() == 3


def test_small_groups_are_gathered_once(spark):
    """No sketch is made of groups that fit: its cost per group was most of the time with many small groups."""
    rows = spark.range(4000).selectExpr("id % 2000 AS g", "CAST(id AS DOUBLE) AS v")
    found = exact_quantiles(rows, ["g"], "v", {"m": 0.5}, count="n")
    got = {r.g: (r.m, r.n) for r in found.collect()}
    assert got == {g: (g + 1000.0, 2) for g in range(2000)}
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "percentile_approx" not in final


def test_crowded_and_small_groups_side_by_side(spark):
    rows = spark.range(3000).selectExpr("IF(id < 2000, NULL, id % 100) AS g", "CAST(id * 7919 % 3001 AS DOUBLE) AS v")
    values = {}
    for r in rows.collect():
        values.setdefault(r.g, []).append(r.v)
    found = exact_quantiles(rows, ["g"], "v", {"lo": 0.25, "m": 0.5}, count="n", accuracy=100)
    for r in found.collect():
        assert (r.lo, r.m, r.n) == (*np.quantile(values.pop(r.g), [0.25, 0.5]), r.n)
    assert not values
