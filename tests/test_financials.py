"""Quarters of filed facts: hand-read cases and a brute-force reading of random filings."""

import datetime as dt
import random

from pricetide.plans.financials import METRICS, latest_facts, quarter_candidates, quarterly_conflicts, quarterly_financials

SCHEMA = "company string, tag string, start date, end date, val double, form string, filed date, accn string"
D = dt.date.fromisoformat


def fact(tag, start, end, val, form="10-Q", filed=None, accn="a", company="X"):
    end = D(end)
    return (company, tag, D(start) if start else None, end, float(val), form, D(filed) if filed else end + dt.timedelta(days=30), accn)


def read(spark, facts, **more):
    latest = latest_facts(spark.createDataFrame(facts, SCHEMA), "company")
    return {(r.metric, str(r.period_end)): r for r in quarterly_financials(latest, "company", **more).collect()}, latest


YEAR = [
    fact("Revenues", "2020-01-01", "2020-03-31", 100), fact("Revenues", "2020-01-01", "2020-06-30", 230),
    fact("Revenues", "2020-01-01", "2020-12-31", 600, "10-K"), fact("Revenues", "2020-01-01", "2020-09-30", 400),
]


def test_sums_are_taken_apart_and_labelled(spark):
    rows, _ = read(spark, YEAR)
    assert [rows["revenue", f"2020-{e}"].value for e in ("03-31", "06-30", "09-30", "12-31")] == [100, 130, 170, 200]
    last = rows["revenue", "2020-12-31"]
    assert (last.fiscal_year, last.fiscal_quarter, last.calendar_quarter, last.derivation, str(last.period_start)) == (
        2020, "Q4", "2020Q4", "ytd_diff", "2020-10-01"
    )


def test_last_filed_wins_and_other_forms_go(spark):
    rows, _ = read(spark, [
        *YEAR, fact("Revenues", "2020-01-01", "2020-03-31", 110, filed="2021-05-01"), fact("Revenues", "2020-01-01", "2020-03-31", 1, "8-K", "2022-01-01"),
        fact("Unknown", "2020-01-01", "2020-03-31", 7),
    ])
    assert rows["revenue", "2020-03-31"].value == 110
    assert rows["revenue", "2020-06-30"].value == 120


def test_start_off_by_a_day_is_one_quarter(spark):
    rows, latest = read(spark, [*YEAR, fact("Revenues", "2020-01-02", "2020-03-31", 101, filed="2020-06-01")])
    assert rows["revenue", "2020-03-31"].value == 101
    assert quarter_candidates(latest, "company").where("end = '2020-03-31'").count() == 1


def test_groups_fall_back_and_conflicts_are_logged(spark):
    facts = [
        *YEAR, fact("SalesRevenueGoodsNet", "2020-01-01", "2020-03-31", 90, filed="2023-01-01"),
        fact("SalesRevenueGoodsNet", "2021-01-01", "2021-03-31", 95), fact("SalesRevenueNet", "2020-01-01", "2020-03-31", 120, filed="2020-07-01"),
    ]
    rows, latest = read(spark, facts)
    assert (rows["revenue", "2020-03-31"].tag, rows["revenue", "2020-03-31"].value) == ("SalesRevenueNet", 120)
    assert rows["revenue", "2021-03-31"].tag == "SalesRevenueGoodsNet"
    [log] = quarterly_conflicts(latest, "company").collect()
    assert (log.kept_tag, log.kept_value, log.other_tag, log.other_value, str(log.kept_filed), str(log.other_filed)) == (
        "SalesRevenueNet", 120, "Revenues", 100, "2020-07-01", "2020-04-30"
    )


def test_stock_and_ratios(spark):
    rows, _ = read(spark, [
        *YEAR, fact("InventoryNet", None, "2020-03-31", 80), fact("InventoryNet", "2019-01-01", "2020-02-28", 70),
        fact("CostOfRevenue", "2020-01-01", "2020-03-31", 60), fact("GrossProfit", "2020-04-01", "2020-06-30", 52),
        fact("InventoryNet", None, "2020-06-30", 39),
    ])
    stock = rows["inventory", "2020-03-31"]
    assert (str(stock.period_start), stock.value) == ("2020-01-01", 80)
    assert ("inventory", "2020-02-28") not in rows
    margin = rows["gross_margin_pct", "2020-03-31"]
    assert (margin.value, margin.unit, margin.derivation, margin.tag) == (40.0, "pct", "(revenue-cost_of_revenue)/revenue", None)
    assert rows["inventory_days", "2020-03-31"].value == round(80 / 60 * 91, 1)
    assert (rows["gross_margin_pct", "2020-06-30"].value, rows["gross_margin_pct", "2020-06-30"].derivation) == (40.0, "gross_profit/revenue")
    assert rows["inventory_days", "2020-06-30"].value == round(39 / 78 * 91, 1)


def test_no_annual_report_no_year_old_quarters_no_rows(spark):
    rows, _ = read(spark, YEAR[:2])
    assert rows["revenue", "2020-03-31"].fiscal_year is None and rows["revenue", "2020-03-31"].fiscal_quarter is None
    assert read(spark, YEAR, first_year=2021)[0] == {}
    assert read(spark, [])[0] == {}


def test_random_filings_against_a_plain_reading(spark):
    pick = random.Random(5)
    ends = [dt.date(y, m, d) for y in (2019, 2020) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    tags = METRICS["revenue"][1][0] + METRICS["revenue"][1][1]
    facts = []
    for k in range(400):
        end = pick.choice(ends)
        start = pick.choice([dt.date(end.year, 1, 1), dt.date(end.year, end.month - 2, 1)])
        form = "10-K" if end.month == 12 else "10-Q"
        facts.append((f"c{k % 5}", pick.choice(tags), start, end, float(pick.randrange(1, 1000)), form, end + dt.timedelta(days=pick.randrange(10, 900)), f"{k:04d}"))
    latest = {}
    for f in sorted(facts, key=lambda f: (f[6], f[7])):
        latest[f[:4]] = f
    want = {}
    for company in sorted({f[0] for f in facts}):
        for rank, group in enumerate(METRICS["revenue"][1]):
            best = {}
            for tag in group:
                own = {(k[2], k[3]): f for k, f in latest.items() if k[:2] == (company, tag)}
                options = [(True, f[6], f[7], f[4], s, e) for (s, e), f in own.items() if 75 <= (e - s).days <= 105]
                known = {(o[4], o[5]) for o in options}
                for (s, e), f in own.items():
                    for (s2, e2), g in own.items():
                        q = (e2 + dt.timedelta(days=1), e)
                        if s == s2 and 75 <= (e - e2).days <= 105 and q not in known:
                            options.append((False, f[6], f[7], f[4] - g[4], *q))
                for o in options:
                    if o[5] not in best or o[:3] > best[o[5]][:3]:
                        best[o[5]] = o
            for e, o in best.items():
                want.setdefault((company, e), (o[3], "reported" if o[0] else "ytd_diff", o[2], rank))
    have = {
        (r.company, r.period_end): (r.value, r.derivation, r.accn, int(r.tag in METRICS["revenue"][1][1]))
        for r in quarterly_financials(latest_facts(spark.createDataFrame(facts, SCHEMA), "company"), "company").collect() if r.metric == "revenue"
    }
    assert len(want) > 30 and have == want
