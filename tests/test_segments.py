"""Segmented look-around equals a plain window over the whole key."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.operators.joins import drop_reposts, drop_stale, first_event_after
from pricetide.operators.segments import carry, neighbours


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    t = np.cumsum(rng.integers(0, 4, 600))
    data = [(str(i % 2), int(t[i]), i, None if rng.random() < 0.6 else float(i), int(rng.integers(0, 2))) for i in range(600)]
    return spark.createDataFrame(data, "k string, t int, id int, v double, s int").cache()


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_neighbours(rows, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows.select("id", F.lag("s", 1).over(w).alias("a"), F.lag("id", 2).over(w).alias("b"), F.lead("id", 2).over(w).alias("c"))
    have = neighbours(rows, ["k"], ["t", "id"], F.floor(F.col("t") / width), {"a": ("s", 1), "b": ("id", 2)}, {"c": ("id", 2)})
    assert sorted(map(tuple, have.select("id", "a", "b", "c").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("backward", [False, True])
def test_carry(rows, backward):
    order = F.desc("id") if backward else F.asc("id")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.last("v", ignorenulls=True).over(w).alias("x"))
    have = carry(rows, ["k"], "id", F.floor(F.col("id") / 13), {"x": "v"}, backward=backward).select("id", "x")
    assert sorted(map(tuple, have.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("min_run", [2, 3, 4])
def test_drop_stale_against_brute_force(rows, min_run):
    kept = {r["id"] for r in drop_stale(rows, ["k"], ["t", "id"], "s", F.floor(F.col("t") / 9), min_run).collect()}
    want = set()
    for key in ("0", "1"):
        series = sorted((r["t"], r["id"], r["s"]) for r in rows.where(F.col("k") == key).collect())
        runs, last = [], None
        for t, i, s in series:
            if s != last:
                runs.append([])
            runs[-1].append(i)
            last = s
        for run in runs:
            want.update(run if len(run) < min_run else run[:1])
    assert kept == want


def test_reposts_chain(spark):
    day = 86400
    at = [0, 2 * day, 4 * day, 7 * day, 7 * day + 1]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(at)], "k string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    # The third is two days after a repost, so it is one too; exactly three days is not.
    assert sorted(r["id"] for r in drop_reposts(df, ["k"], "ts", "id", 3).collect()) == [0, 3]


def test_first_event_bounds(spark):
    periods = spark.createDataFrame([("a", "2024-03-31"), ("a", "2024-06-30"), ("b", "2024-03-31")], "k string, e string").withColumn("e", F.to_date("e"))
    events = spark.createDataFrame([("a", "2024-03-31"), ("a", "2024-04-01"), ("a", "2024-10-08"), ("b", "2024-07-10")], "k string, d string").withColumn("d", F.to_date("d"))
    out = {(r["k"], str(r["e"])): r["first_event"] and str(r["first_event"]) for r in first_event_after(periods, events, "k", "e", "d").collect()}
    assert out == {("a", "2024-03-31"): "2024-04-01", ("a", "2024-06-30"): "2024-10-08", ("b", "2024-03-31"): None}


def test_a_key_within_one_day_is_spread(spark):
    """All rows of a hot key lie in few days: pieces follow its rows, not the calendar."""
    from pyspark.sql import functions as F

    from pricetide.operators.segments import equi_depth

    rows = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 0 THEN NULL ELSE 'hot' END AS k", "19000 + CAST(id % 5000 AS double) / 5000 AS at")
    cut = equi_depth(rows, ["k"], "at")
    sizes = {(r.k, r["__segment"]): r["count"] for r in cut.groupBy("k", "__segment").count().collect()}
    assert sum(sizes.values()) == 20_000 and max(sizes.values()) < 20_000 / 40 and len(sizes) > 100
    ordered = cut.where("k = 'hot'").groupBy("__segment").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("__segment").collect()
    assert all(a.hi < b.lo for a, b in zip(ordered, ordered[1:]))


def test_average_ranks_of_bunched_values(spark):
    import numpy as np

    from pricetide.operators.aggregate import average_ranks

    rng = np.random.default_rng(1)
    values = np.round(100 + rng.random(3000) * 1e-3, 6)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.v: r.rank for r in average_ranks(frame, [], "v", "rank").collect()}
    order = np.sort(values)
    assert got == {float(v): (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in set(values.tolist())}
