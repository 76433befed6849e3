"""Readers, page rows, refreshes and sinks on small files."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from pricetide.operators.filings import ytd_to_discrete
from pricetide.operators.joins import first_per, interval_label, pattern_join
from pricetide.operators.quality import assert_required, assert_schema, value_in_text
from pricetide.sources import readers as R
from pricetide.sources import schemas
from pricetide.sources.pages import carry_down, extract_rows, quote_section
from pricetide.sources.upsert import backfill_plan, upsert, write_tidy


def test_facts_csv_is_typed_and_strict(spark, tmp_path):
    path = tmp_path / "facts.csv"
    path.write_text("date,term,metric,value\n2025-01-01,ram,views,3.5\n2025-02-01,ram,views,\n")
    rows = R.read_facts(spark, str(path)).collect()
    assert rows[0]["date"] == dt.date(2025, 1, 1) and rows[1]["value"] is None
    path.write_text("date,term,value,metric\n2025-01-01,ram,3.5,views\n")
    with pytest.raises(Exception):
        R.read_facts(spark, str(path)).collect()


def test_posts_archive(spark, tmp_path):
    post = {"id": "a", "created_utc": 1735689600, "title": "t", "score": 1, "num_comments": 0, "link_flair_text": None, "domain": None}
    for name, posts in {"2025-01": [post, post], "2025-02": [{**post, "id": "b", "created_utc": 1738368000}]}.items():
        with gzip.open(tmp_path / f"{name}.jsonl.gz", "wt") as f:
            f.write("\n".join(json.dumps(p) for p in posts))
    rows = R.read_posts(spark, str(tmp_path / "*.jsonl.gz")).orderBy("id").collect()
    assert [(r["id"], str(r["month"]), r["domain"]) for r in rows] == [("a", "2025-01-01", ""), ("b", "2025-02-01", "")]


def test_coverage_sidecars(spark, tmp_path):
    (tmp_path / "build_it_2025-03.meta.json").write_text('{"scanned": 10, "kept": 2}')
    row = R.read_coverage(spark, str(tmp_path / "*.meta.json")).collect()[0]
    assert tuple(row) == ("build_it", dt.date(2025, 3, 1), 10, 2)


def test_fact_explode(spark):
    fact = {"start": "2024-01-01", "end": "2024-03-31", "val": 5.0, "form": "10-Q", "filed": "2024-05-01", "accn": "x"}
    body = {"Revenues": {"units": {"USD": [fact, {**fact, "form": "8-K"}], "EUR": [fact]}}}
    df = spark.createDataFrame([("c", json.dumps(body))], "company string, body string")
    rows = R.explode_facts(df, "body", ["company"]).collect()
    assert len(rows) == 1 and rows[0]["val"] == 5.0 and rows[0]["end"] == dt.date(2024, 3, 31)


XML = """<?xml version="1.0"?>
<xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi">
 <xbrli:context id="c1"><xbrli:entity><xbrli:segment>
   <xbrldi:explicitMember dimension="srt:ProductOrServiceAxis">x:DRAM</xbrldi:explicitMember>
   <xbrldi:explicitMember dimension="srt:ConsolidationItemsAxis">x:Op</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
   <xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
 <xbrli:context id="c2"><xbrli:entity><xbrli:segment>
   <xbrldi:explicitMember dimension="srt:ProductOrServiceAxis">x:DRAM</xbrldi:explicitMember>
   <xbrldi:explicitMember dimension="srt:GeoAxis">x:US</xbrldi:explicitMember></xbrli:segment></xbrli:entity>
   <xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
 <us-gaap:Revenues contextRef="c1" unitRef="usd">12.5</us-gaap:Revenues>
 <us-gaap:Revenues contextRef="c2" unitRef="usd">99</us-gaap:Revenues>
</xbrl>"""


def test_xml_facts(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    rows = R.read_xml_facts(spark, str(tmp_path), ["Revenues"], ["srt:ProductOrServiceAxis"]).collect()
    assert [(r["tag"], r["member"], r["val"], str(r["end"])) for r in rows] == [("Revenues", "x:DRAM", 12.5, "2024-03-31")]


def test_cube(spark, tmp_path):
    cube = {"id": ["time", "geo"], "dimension": {
        "time": {"category": {"index": {"2024-01": 0, "2024-02": 1}}}, "geo": {"category": {"index": {"b": 1, "a": 0, "c": 2}}}},
        "value": {"0": 1.0, "5": 6.0, "3": None}}
    (tmp_path / "cube.json").write_text(json.dumps(cube))
    df = spark.read.schema(schemas.CUBE).option("multiLine", True).json(str(tmp_path / "cube.json"))
    assert sorted(map(tuple, R.flatten_cube(df, ["time", "geo"]).collect())) == [("2024-01", "a", 1.0), ("2024-02", "c", 6.0)]


def test_year_blocks(spark):
    none = [None] * 12
    rows = [(0, "2023", *none), (1, "Europe ", 1.0, *none[1:]), (2, "2024.0", *none), (3, "Europe", None, 2.0, *none[2:]), (4, None, *none)]
    out = R.unpivot_year_blocks(spark.createDataFrame(rows, schemas.YEAR_SHEET)).collect()
    assert sorted((str(r["date"]), r["region"], r["value"]) for r in out) == [("2023-01-01", "Europe", 1.0), ("2024-02-01", "Europe", 2.0)]


def test_page_rows_and_headings(spark):
    html = "<tr><td>Spot</td></tr><tr><td>DDR5 <b>16Gb</b></td><td>3.10</td><td>2.90</td></tr><tr><th>x</th><td>n/a</td></tr>"
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    rows = extract_rows(pages, "html", ["page"], min_cells=1).orderBy("pos").collect()
    assert [list(r["cells"]) for r in rows] == [["Spot"], ["DDR5 16Gb", "3.10", "2.90"], ["x", "n/a"]]
    numeric = extract_rows(pages, "html", ["page"], min_numbers=2).collect()
    assert [r["pos"] for r in numeric] == [1]
    marked = spark.createDataFrame([(1, i, "S" if i == 2 else None) for i in range(5)], "page int, pos int, head string")
    assert [r["section"] for r in carry_down(marked, ["page"], "pos", {"section": "head"}, span=2).orderBy("pos").collect()] == [None, None, "S", "S", "S"]


def test_quote_sections(spark):
    rows = [("p", "dram_spot", "Micron USD"), ("p", "memory_card", "DDR 256Mb"), ("p", "dram_spot", "MicroSD 8GB"),
            ("p", "dram_contract", "64Gb MLC"), ("p", "dram_spot", "Kingston DDR3 2GB 1333"), ("p", "dram_spot", "DDR4 8Gb")]
    df = spark.createDataFrame(rows, "page string, section string, item string")
    out = [r["s"] for r in df.select(quote_section("page", "section", "item").alias("s")).collect()]
    assert out == [None, "dram_spot", "memory_card", "flash_contract", "module_spot", "dram_spot"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, p int, v double")
    new = spark.createDataFrame([("a", 1, 9.0)], "k string, p int, v double")
    once = upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, 9.0), ("b", 1, 3.0)]
    assert sorted(map(tuple, upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    gone = spark.createDataFrame([("b",)], "k string")
    assert sorted(map(tuple, upsert(old, new.limit(0), ["k"], gone).collect())) == [("a", 1, 1.0), ("a", 2, 2.0)]


def test_backfill_order(spark):
    available = spark.createDataFrame([("us", 0, p) for p in (202401, 202402, 202403)] + [("jp", 1, 202403)], "r string, priority int, p int")
    fetched = spark.createDataFrame([("us", 202401, "2020-01-01"), ("us", 202403, "2020-01-01")], "r string, p int, d string").select("r", "p", F.to_date("d").alias("fetched_on"))
    out = backfill_plan(available, fetched, ["r"], "p", 2, "2024-01-01").collect()
    assert [(r["r"], r["p"], r["reason"]) for r in out] == [("us", 202403, "stale"), ("us", 202402, "missing"), ("jp", 202403, "missing")]


def test_tidy_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "series string, v int")
    write_tidy(df, path, ["series"], ["v"])
    write_tidy(spark.createDataFrame([("a", 7)], "series string, v int"), path, ["series"])
    assert sorted((r["series"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]


def test_reported_quarter_beats_difference(spark):
    rows = [("c", "2024-01-01", "2024-03-31", 10.0), ("c", "2024-01-01", "2024-06-30", 25.0), ("c", "2024-04-01", "2024-06-30", 14.0),
            ("c", "2024-01-01", "2024-12-31", 60.0), ("c", "2024-01-01", "2024-09-30", 45.0)]
    df = spark.createDataFrame(rows, "c string, s string, e string, val double").select("c", F.to_date("s").alias("start"), F.to_date("e").alias("end"), "val")
    out = sorted((str(r["start"]), r["val"], r["derivation"]) for r in ytd_to_discrete(df, ["c"]).collect())
    assert out == [("2024-01-01", 10.0, "reported"), ("2024-04-01", 14.0, "reported"), ("2024-07-01", 20.0, "ytd_diff"), ("2024-10-01", 15.0, "ytd_diff")]


def test_fiscal_labels(spark):
    d = dt.date
    periods = spark.createDataFrame([("c", d(2023, 9, 1), d(2023, 11, 30)), ("c", d(2024, 6, 1), d(2024, 9, 5)), ("c", d(2030, 1, 1), d(2030, 3, 31))], "c string, start date, end date")
    years = spark.createDataFrame([("c", d(2023, 9, 1), d(2024, 8, 31)), ("c", d(2024, 9, 1), d(2025, 8, 30))], "c string, fy_start date, fy_end date")
    out = {str(r["start"]): (r["fiscal_year"], r["fiscal_quarter"]) for r in interval_label(periods, years, "c").collect()}
    assert out == {"2023-09-01": (2024, 1), "2024-06-01": (2024, 4), "2030-01-01": (None, None)}


def test_guards(spark):
    df = spark.createDataFrame([("a",), (" ",)], "url string")
    with pytest.raises(Exception, match="every row needs url"):
        assert_required(df, "url").collect()
    assert assert_schema(df, df.schema) is df
    with pytest.raises(ValueError, match="columns changed"):
        assert_schema(df.withColumn("x", F.lit(1)), df.schema)
    two = spark.createDataFrame([("RTX 3080",), ("RTX 3080 Ti",), ("RTX 3070",)], "device string")
    with pytest.raises(Exception, match="matches several names"):
        pattern_join(two, {"one": "RTX 3080"}, "device").collect()
    labels = {tuple(r) for r in pattern_join(two, {"one": "^RTX 3080$", "again": "3080$", "ti": "Ti$"}, "device").collect()}
    assert labels == {("RTX 3080", "one"), ("RTX 3080", "again"), ("RTX 3080 Ti", "ti")}
    rows = spark.createDataFrame([("k", 1, "x", None), ("k", 0, "y", 2)], "k string, o int, a string, b int")
    assert tuple(first_per(rows, ["k"], [F.col("o")]).collect()[0]) == ("k", 0, "y", 2)


def test_value_in_text(spark):
    rows = [("Revenue of $1,234 million", 1234, False, "exact"), ("Revenue of 1,2345", 1234, False, None), ("sales 1235", 1234, True, "within_1mn"),
            ("sales 1235", 1234, False, None), ("Revenue " + "x" * 250 + " 1234", 1234, False, None), ("1234 revenue", 1234, False, None),
            ("revenue 900 in the year", 300, True, "ytd_sum")]
    df = spark.createDataFrame([(i, t, v, d, 900) for i, (t, v, d, _) in enumerate(rows)], "i int, t string, v int, d boolean, y int")
    for r in value_in_text(df, "t", "v", "revenue|sales", "d", "y").collect():
        assert r["match_type"] == rows[r["i"]][3], rows[r["i"]][0]


def test_patterns_as_a_table(spark):
    from pyspark.sql import functions as F

    from pricetide.operators.joins import plain_part

    want = {r"^RTX 3080$": "RTX 3080", r"\bGTX 10[678]0( Ti)?\b": "GTX 10", r"RX ?9070 XT(?! 2)": "9070 XT", "a|b": "", "((a)b)+cd*ef": "ef", "x{2}yz[ab]+": "yz", r"\.": ""}
    rows = spark.createDataFrame(list(want.items()), "pattern string, want string").select(plain_part(F.col("pattern")).alias("have"), "want").collect()
    assert all(r.have == r.want for r in rows), rows
    names = spark.createDataFrame([("GTX 1080 Ti", 1), ("GTX 1080", 2), ("RX 9070 XT", 3), ("RX 9070 XT", 4), (None, 5), ("other", 6)], "device string, n int")
    rules = spark.createDataFrame([("p", r"^GTX 1080$"), ("ti", r"1080 Ti"), ("amd", r"^RX ?9070 XT(?! 2)")], "label string, pattern string")
    assert {tuple(r) for r in pattern_join(names, rules, "device").select("n", "label").collect()} == {(2, "p"), (1, "ti"), (3, "amd"), (4, "amd")}
    with pytest.raises(Exception, match="no plain part"):
        pattern_join(names, spark.createDataFrame([("x", "a|b")], "label string, pattern string"), "device").collect()
