"""Turning points and cycles against a brute-force reading, and properties of the index."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.plans.cycles import cycle_table, turning_points, upswing_decay
from pricetide.plans.forecast import decay_path, scenario_paths, scenario_table
from pricetide.functions.columns import fallback_price, item_key
from pricetide.operators.aggregate import item_month
from pricetide.plans.index import chain_index, monthly_items


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def walk(seed, n=140):
    rng = np.random.default_rng(seed)
    return [float(x) for x in np.exp(np.cumsum(rng.normal(0, 0.12, n)))]


def frame(spark, named):
    rows = [(name, month(i), v) for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, month date, value double")


def brute_turns(values, threshold):
    """All confirmed extremes, by looking for the next point that reverses far enough."""
    logs, turns = [math.log(v) for v in values], []
    hi = lo = 0
    trend = 0
    for i in range(len(logs)):
        if trend >= 0 and logs[i] > logs[hi]:
            hi = i
        if trend <= 0 and logs[i] < logs[lo]:
            lo = i
        if trend <= 0 and logs[i] - logs[lo] >= threshold:
            turns.append((lo, "T"))
            trend, hi = 1, i
        elif trend >= 0 and logs[hi] - logs[i] >= threshold:
            turns.append((hi, "P"))
            trend, lo = -1, i
    return turns


@pytest.fixture(scope="module")
def walks():
    return {f"s{k}": walk(k) for k in range(6)}


def test_turning_points(spark, walks):
    found = {}
    for r in turning_points(frame(spark, walks), math.log(1.3)).orderBy("month").collect():
        found.setdefault(r["series"], []).append((r["month"], r["kind"]))
    for name, values in walks.items():
        assert found.get(name, []) == [(month(i), k) for i, k in brute_turns(values, math.log(1.3))]


def test_turns_alternate_and_mirror(spark, walks):
    up = frame(spark, walks)
    down = up.withColumn("value", 1 / F.col("value"))

    def turns(df):
        out = {}
        for r in turning_points(df, math.log(1.3)).orderBy("month").collect():
            out.setdefault(r["series"], []).append((r["month"], r["kind"]))
        return out

    a, b = turns(up), turns(down)
    for name, points in a.items():
        kinds = [k for _, k in points]
        assert all(x != y for x, y in zip(kinds, kinds[1:]))
        assert b[name] == [(m, "P" if k == "T" else "T") for m, k in points]


def test_cycle_table(spark, walks):
    have = {(r["series"], r["peak"]): r for r in cycle_table(frame(spark, walks), math.log(1.3)).collect()}
    want = 0
    for name, values in walks.items():
        turns = brute_turns(values, math.log(1.3))
        for at, (i, kind) in enumerate(turns):
            troughs = [j for j, k in turns[:at] if k == "T"]
            if kind != "P" or not troughs:
                continue
            want += 1
            r, p0 = have[(name, month(i))], values[troughs[-1]]
            after = [j for j in range(i + 1, len(values))]
            back = next((j - i for j in after if values[j] <= p0), None)
            back120 = next((j - i for j in after if values[j] <= 1.2 * p0), None)
            half = next((j - i for j in after if math.log(values[j] / p0) <= math.log(values[i] / p0) / 2), None)
            assert (r["trough0"], r["back_months"], r["back_months_120"], r["half_life"]) == (month(troughs[-1]), back, back120, half)
            later = [j for j, k in turns[at + 1:] if k == "T"]
            if later:
                assert r["fall_rate"] == pytest.approx(math.log(values[i] / values[later[0]]) / (later[0] - i))
            else:
                assert r["trough1"] is None and r["fall_rate"] is None
    assert len(have) == want


def test_decay_ratios_stop_at_first_fall(spark):
    # Quarter means 1, e^.1, e^.5, e^.7, e^.8, e^.75: increments .1, .4, .2, .1, -.05
    levels = [0, 0.1, 0.5, 0.7, 0.8, 0.75]
    values = {"a": [math.exp(x) for x in levels for _ in range(3)]}
    cycles = spark.createDataFrame([("a", month(0), month(12))], "series string, trough0 date, peak date")
    row = upswing_decay(frame(spark, values), cycles).collect()[0]
    assert (row["max_q"], row["lag_q"]) == (month(6), 2)
    assert row["decay_ratios"] == pytest.approx([0.5, 0.5])


def test_decay_path_and_cap(spark):
    df = spark.createDataFrame(
        [(0.4, 0.5, month(0), None), (0.4, 0.5, month(0), month(7)), (0.4, 0.0, month(0), None), (-0.1, 0.5, month(0), None)],
        "inc double, r double, q date, cap date",
    )
    rows = decay_path(df, "inc", "r", "q", "cap").collect()
    # .2 .1 .05 .025 stay at or above .02; the cap keeps the first two
    assert [(r["peak_q"], round(r["further_rise"], 6)) for r in rows] == [(month(12), 0.375), (month(6), 0.3), (month(0), 0.0), (month(0), 0.0)]


def test_decay_path_has_no_last_quarter(spark):
    cases = [(0.5, 0.999), (0.4, 0.5), (0.02, 0.5), (0.04, 0.5), (0.08, 0.5), (0.3, 0.97), (0.021, 0.9999)]
    df = spark.createDataFrame([(i, r, month(0)) for i, r in cases], "inc double, r double, q date")
    for row in decay_path(df, "inc", "r", "q").collect():
        n, step, total = 0, row["inc"] * row["r"], 0.0
        while step >= 0.02:
            n, total, step = n + 1, total + step, step * row["r"]
        have = (row["peak_q"].year - month(0).year) * 12 + row["peak_q"].month - month(0).month
        assert abs(have - 3 * n) <= (3 if row["inc"] in (0.04, 0.08) else 0), row  # these end exactly at the bound
        assert row["further_rise"] == pytest.approx(total, abs=0.0201 if row["inc"] in (0.04, 0.08) else 1e-9)


def test_upswing_ends_with_the_quarter_of_its_peak(spark):
    # The largest increase is that of the quarter after the peak's: it belongs to the next move.
    levels = [0, 0.1, 0.4, 1.4]
    values = {"a": [math.exp(x) for x in levels for _ in range(3)]}
    for at in (6, 7, 8):
        cycles = spark.createDataFrame([("a", month(0), month(at))], "series string, trough0 date, peak date")
        row = upswing_decay(frame(spark, values), cycles).collect()[0]
        assert (row["max_q"], row["lag_q"]) == (month(6), 0), at


def test_scenario_dates_round_half_even(spark):
    df = spark.createDataFrame([("a", math.exp(0.25), 0.1), ("b", math.exp(0.35), 0.1)], "series string, ratio_now double, rate double")
    out = scenario_table(df, {"base": {"fall_rate": F.col("rate")}}, {"1.0x": 1.0}, "2020-01-01", 2, {"base": "2020-03-01"})
    dates = {r["series"]: (str(r["date_1.0x"]), str(r["date_1.0x_adj"])) for r in out.collect()}
    assert dates["a"][0] in ("2020-05-01", "2020-06-01") and dates["b"][0] in ("2020-06-01", "2020-07-01")
    exact = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "m double").select(F.bround("m").alias("m"))
    assert [r["m"] for r in exact.collect()] == [2.0, 4.0, -2.0]


def test_paths_hold_the_peak(spark):
    df = spark.createDataFrame([("a", 2.0, 0.0, dt.date(2020, 2, 1), 2.0, 0.1)], "series string, ratio_now double, further_rise double, peak date, peak_ratio double, fall_rate double")
    rows = scenario_paths(df, "2020-01-01", "2020-06-01", "2020-01-01", 2, ["series"]).orderBy("month").collect()
    assert [None if r["ratio"] is None else round(r["ratio"], 6) for r in rows] == [None, 2.0, 2.0, 2.0, round(2 * math.exp(-0.1), 6), round(2 * math.exp(-0.2), 6)]


def items(spark, rows):
    return spark.createDataFrame([(k, dt.date.fromisoformat(m), float(p)) for k, m, p in rows], "key string, month date, price double")


def test_index_rules(spark):
    rows = [("a", "2020-01-01", 10), ("b", "2020-01-01", 10), ("a", "2020-02-01", 20), ("c", "2020-02-01", 5),
            ("d", "2020-05-01", 5), ("d", "2020-06-01", 10), ("d", "2020-06-01", 30)]
    out = {str(r["month"]): r for r in chain_index(items(spark, rows), "2020-02-01").collect()}
    assert out["2020-01-01"]["n_link_items"] is None and out["2020-02-01"]["n_link_items"] == 1
    assert out["2020-05-01"]["n_link_items"] == 0 and out["2020-05-01"]["index"] == pytest.approx(100)
    assert out["2020-06-01"]["index"] == pytest.approx(400)  # mean of 10 and 30 over 5
    assert out["2020-01-01"]["index"] == pytest.approx(50)


def test_index_ignores_an_items_scale(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{k}", f"2020-{m:02d}-01", rng.uniform(1, 9)) for k in range(7) for m in range(1, 13) if rng.random() > 0.3]
    scaled = [(k, m, p * (1000 if k == "k3" else 1)) for k, m, p in rows]
    a, b = [sorted((str(r["month"]), r["index"]) for r in chain_index(items(spark, x), "2020-06-01").collect()) for x in (rows, scaled)]
    assert [m for m, _ in a] == [m for m, _ in b]
    assert [v for _, v in a] == pytest.approx([v for _, v in b])


def test_missing_base_is_an_error(spark):
    with pytest.raises(Exception, match="not observed"):
        chain_index(items(spark, [("a", "2020-01-01", 1)]), "2019-01-01").collect()


def test_quotes_to_index(spark):
    """Raw quotes through the whole chain: fallback price, item key, item-month, frozen run, unit price."""
    rows = [("dram_spot", "DDR4 8Gb 1G*8", f"2020-{m:02d}-05", p, None, None) for m, p in zip(range(1, 8), [4, 4, 4, 4, 5, 5, 6])]
    rows += [("dram_spot", "DDR4 8Gb 1Gx8", "2020-07-25", None, 9.0, 7.0), ("dram_spot", "DDR4 8GB SO-DIMM", "2020-07-01", 30, None, None),
             ("dram_contract", "DDR4 8Gb 1Gx8", "2020-07-01", 3, None, None), ("dram_spot", "DDR5 16Gb", "2020-07-01", 0, None, None)]
    df = spark.createDataFrame([(s, i, d, float(p) if p is not None else None, h, lo) for s, i, d, p, h, lo in rows],
                               "section string, item string, d string, price double, high double, low double")
    quotes = df.select("section", "item", F.to_date("d").alias("date"), item_key("item").alias("key"),
                       fallback_price("price", "high", "low").alias("price")).where("price IS NOT NULL")
    months = item_month(quotes, ["section", "key"], "date", "price", "item")
    out = {(r["key"], str(r["month"])): r for r in monthly_items(months, ["dram_spot"], 3).collect()}
    chip = sorted(m for k, m in out if k == "ddr48gb1gx8")
    assert chip == ["2020-01-01", "2020-05-01", "2020-06-01", "2020-07-01"]  # of four equal rows the first stays; two equal rows both do
    july = out[("ddr48gb1gx8", "2020-07-01")]
    assert (july["price"], july["item"], july["n_obs"], july["usd_per_gb"]) == (7.0, "DDR4 8Gb 1Gx8", 2, 0.875)
    assert out[("ddr48gbso-dimm", "2020-07-01")]["density_gb"] is None and not any(k == "ddr516gb" for k, _ in out)
