"""Titles and statements read by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricetide.functions import statements as S
from pricetide.functions.columns import host, item_key, item_spec, norm_model, normalize_text
from pricetide.functions.deals import extract_price
from pricetide.functions.topics import attention, topic_flags
from pricetide.operators.joins import contained_passages, quote_check
from pricetide.operators.layout import read_once
from pricetide.plans.deals import parse_titles

TITLES = [  # title, year, expected values or reject reason
    ("[RAM] Corsair Vengeance 32GB (2x16GB) DDR5-6000 CL30 - $109.99", 2025,
     dict(category="RAM", price=109.99, capacity_gb=32, kit="2x16GB", ddr="DDR5", speed_mts=6000, cas=30, form="dimm")),
    ("[RAM] TeamGroup 32GB 3200MHz CL16 - $55", 2020,
     dict(category="RAM", price=55.0, capacity_gb=32, kit=None, ddr="DDR4", ddr_inferred=True, speed_mts=3200, cas=16)),
    ("[SSD] Samsung 990 Pro 2TB NVMe - $159.99", 2025,
     dict(category="SSD", price=159.99, capacity_gb=2000, interface="NVMe", usd_per_tb=79.995)),
    ("[SSD] Crucial MX500 1TB SATA - $60 - $10 coupon", 2025, dict(price=50.0, interface="SATA", enterprise=False)),
    ("[GPU] RTX 5070 Ti - $749.99 - $50 MIR = $699.99", 2025, dict(price=699.99, model="RTX 5070 Ti")),
    ("[GPU] ASUS RTX 4060 Ti - $399", 2025, "vram_unspecified"),
    ("[GPU] ASUS RTX 4060 Ti 16GB - $449", 2025, dict(model="RTX 4060 Ti 16GB", price=449.0)),
    ("[RAM] G.Skill 32GB DDR5 $120 or 64GB $220", 2025, "ambiguous_price"),
    ("[CPU/Mobo] Ryzen combo - $300", 2025, "bundle"),
    ("[CPU] AMD Ryzen 7 9800X3D - $479 CAD", 2025, "non_usd"),
    ("[RAM] Crucial 16GB DDR4 (Used) - $25", 2025, "used_refurb"),
    ("[CPU] Intel Core i7-14700K - $299", 2025, dict(model="Core 14700K", price=299.0)),
    ("[CPU] Intel Core Ultra 7 265K - $289 ($309 - $20 off)", 2025, dict(model="Core Ultra 265K", price=289.0)),
    ("[GPU] Sapphire Pulse RX 9070 XT - $599.99 (was $699.99)", 2025, dict(model="RX 9070 XT", price=599.99)),
    ("[GPU] Arc B580 - $249", 2025, dict(model="Arc B580", price=249.0)),
    ("[SSD] WD Black SN850X 2TB/4TB - $150", 2025, "multi_capacity"),
    ("[RAM]  Kingston  16GB DDR4 3200 - $35", 2025, dict(price=35.0, capacity_gb=16, ddr="DDR4", speed_mts=3200)),
    ("[CPU] Ryzen 5 5600X - open box - $90", 2025, "open_box"),
    ("[RAM] G.Skill 32GB DDR5", 2025, "no_price"),
    ("[CPU] Ryzen 5 5600 $20", 2025, "price_out_of_range"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(str(i), t, dt.datetime(y, 6, 1), "", "newegg.com") for i, (t, y, _) in enumerate(TITLES)]
    rows.append(("none", "[M.2 to PCIe Adapter] dual slot - $12", dt.datetime(2025, 6, 1), "SSD", "newegg.com"))
    rows.append(("flair", "Some 1TB NVMe drive - $70", dt.datetime(2025, 6, 1), "SSD - M.2", "newegg.com"))
    rows.append(("uk", "[SSD] 1TB NVMe - $70", dt.datetime(2025, 6, 1), "", "scan.co.uk"))
    posts = spark.createDataFrame(rows, "id string, title string, ts timestamp, link_flair_text string, domain string")
    return {r["id"]: r for r in parse_titles(posts).collect()}


@pytest.mark.parametrize("at", range(len(TITLES)), ids=[t[:40] for t, _, _ in TITLES])
def test_title(parsed, at):
    row, want = parsed[str(at)], TITLES[at][2]
    if isinstance(want, str):
        assert row["reject"] == want
        return
    assert row["reject"] is None
    for name, value in want.items():
        assert row[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_category_edges(parsed):
    assert "none" not in parsed
    assert parsed["flair"]["category"] == "SSD" and parsed["flair"]["price"] == 70
    assert parsed["uk"]["reject"] == "non_usd"


PRICES = [
    ("item $1,299.99", 1299.99, None), ("item 20$", 20.0, None), ("item 45 USD", 45.0, None),
    ("item - 639.99", 639.99, None), ("item 2.5GB 89.99", 89.99, None), ("item ($79.99)", 79.99, None),
    ("item $100 ($80 inside)", 100.0, None), ("item $50 off", None, "no_price"),
    ("($125) ($150 - $25)", 125.0, None), ("$100 - $90", None, "ambiguous_price"),
    ("$80 after -$10 promo", 80.0, None), ("$80 (50% off)", 80.0, None), ("was $90 now $70", 70.0, None),
    ("$70 + $5 shipping", 70.0, None), ("no amount", None, "no_price"), ("$60 $70", None, "ambiguous_price"),
    ("$100 - $20 - $5", 75.0, None), ("69,99 $", None, "no_price"), ("$69,99", 69.99, None),
]


def test_prices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PRICES)], "i int, t string")
    for r in extract_price(df, "t").collect():
        text, price, reason = PRICES[r["i"]]
        assert (r["price"], r["price_reason"]) == (price, reason), text


RANGES = [
    ("Prices increased high-teens percentage range", "increase", 17, 19, 18),
    ("ASPs declined over 30%", "decrease", None, -30, None),
    ("prices were roughly flat", "flat", 0, 0, 0),
    ("average selling prices increased low-60s percent", "increase", 60, 63, 61.5),
    ("prices grew approximately 30% sequentially and in the mid-teens percent range", "increase", 30, 30, 30),
    ("ASPs more than doubled and rose", "increase", 100, None, None),
]


def test_verbal_ranges(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RANGES)], "i int, c string")
    for r in S.verbal_range(df, "c", S.PRICE_SUBJECT).collect():
        assert (r["direction"], r["low"], r["high"], r["mid"]) == RANGES[r["i"]][1:], RANGES[r["i"]][0]
    bits = spark.createDataFrame([("bit shipments declined low-single-digit percentage",)], "c string")
    r = S.verbal_range(bits, "c", S.BITS_SUBJECT).collect()[0]
    assert (r["direction"], r["low"], r["high"], r["mid"]) == ("decrease", -3, -1, -2)


def test_first_clause(spark):
    text = "For the fiscal year prices rose 5%. DRAM revenue grew, with bit shipments up 10% and prices down 3%."
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(S.first_clause("t", S.BITS_SUBJECT).alias("b"), S.first_clause("t", S.PRICE_SUBJECT).alias("p")).collect()[0]
    assert row["b"] == "bit shipments up 10%" and row["p"].startswith("prices down 3%")


def test_amounts(spark):
    text = ("Revenues for 2023 were 32.77 trillion won. In the fourth quarter, revenue reached 11.306 trillion won. "
            "Operating loss in the quarter was 346 billion won. Net profit came later, 5 trillion won.")
    df = spark.createDataFrame([("x", 4, text)], "k string, q int, t string")
    out = {r["metric"]: r["value"] for r in S.amounts(df, "t", "q", ["k"]).collect()}
    assert out == {"revenue": 11.306, "operating_profit": -0.346}


def test_paired_changes(spark):
    text = ("DRAM and NAND Flash bit shipments increased 4% and 8% but the ASP slipped 8% and 6% respectively. "
            "DRAM bit shipments rose 3% and the average selling price by 6%. NAND bit shipments grew strongly.")
    df = spark.createDataFrame([("x", text)], "k string, t string")
    rows = sorted((r["metric"], r["value"]) for r in S.paired_changes(df, "t", ["k"]).collect())
    assert rows == sorted([
        ("dram_bit_shipments_qoq_pct", 4.0), ("nand_bit_shipments_qoq_pct", 8.0), ("dram_asp_qoq_pct", -8.0),
        ("nand_asp_qoq_pct", -6.0), ("dram_bit_shipments_qoq_pct", 3.0), ("dram_asp_qoq_pct", 6.0), ("nand_statement", None),
    ], key=lambda r: (r[0], r[1]) if r[1] is not None else (r[0], 0.0))


def test_guidance_and_figures(spark):
    text = ("Revenue $8.70 billion ± $200 million Gross margin 34.5% ± 1.0% 36.5% ± 1.0% "
            "Diluted earnings (loss) per share ($0.58) ± $0.08 $1.43 ± $0.08")
    df = spark.createDataFrame([("x", text)], "k string, t string")
    rows = {(r["metric"], r["basis"]): (r["mid"], r["plus_minus"], r["low"]) for r in S.guidance_range(df, "t", ["k"]).collect()}
    assert rows[("revenue", "GAAP")] == (8700.0, 200.0, 8500.0)
    assert rows[("gross_margin_pct", "non-GAAP")] == (36.5, 1.0, 35.5)
    assert rows[("diluted_eps", "GAAP")][:2] == (-0.58, 0.08)
    release = ("Quarterly Financial Results (in millions) Revenue $ 7,750 $ 6,811 Gross margin $ 2,737 1,832 percent of revenue "
               "35.3 % 26.9 % 36.5 % 28.1 % ")
    figures = S.filing_figures(spark.createDataFrame([("x", release)], "k string, t string"), "t", ["k"]).collect()
    assert [(r["metric"], r["basis"], r["value"]) for r in figures][:3] == [
        ("revenue", "GAAP", 7750.0), ("gross_profit", "GAAP", 2737.0), ("gross_margin_pct", "GAAP", 35.3)]
    sales = "Sales of DRAM products increased 30% primarily due to a low-60% range increase in average selling prices partially offset by a mid-teens decline in bit shipments."
    rows = {r["metric"]: (r["low"], r["high"]) for r in S.discussion_changes(spark.createDataFrame([("x", sales)], "k string, t string"), "t", ["k"]).collect()}
    assert rows == {"asp_qoq_pct": (60.0, 63.0), "bits_qoq_pct": (-16.0, -14.0)}


DATES = [
    ("October 12, 2022", "2022-10-12", "day"), ("Nov. 2019", "2019-11-01", "month"), ("2024-03-05 (EU)", "2024-03-05", "day"),
    ("Q3 2021", "2021-07-01", "quarter"), ("2H 2020", "2020-07-01", "half"), ("about 1999", "1999-01-01", "year"),
    ("soon", None, None), ("October / 12, 2022", "2022-10-12", "day"),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, t string")
    for r in df.withColumn("d", S.parse_date_precision("t")).collect():
        got = (str(r["d"]["date"]), r["d"]["precision"]) if r["d"] else (None, None)
        assert got == DATES[r["i"]][1:], DATES[r["i"]][0]


def test_topics(spark):
    titles = [("RAM prices are going up again", (True, True, True, False, False)),
              ("Should I wait for RAM prices to come back down?", (True, True, False, False, True)),
              ("DDR5 finally cheaper", (True, True, False, True, False)),
              ("New GPU build", (False, False, False, False, False))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(titles)], "i int, t string")
    for r in topic_flags(df, "t").collect():
        have = tuple(r[f"is_{n}"] for n in ("topic", "price", "neg", "pos", "wait"))
        assert have == titles[r["i"]][1], titles[r["i"]][0]


def test_attention_zero_fill(spark):
    posts = spark.createDataFrame([("a", "2025-01-01", "RAM is expensive"), ("b", "2025-01-01", "ddr5 cheap now"), ("a", "2025-02-01", "RAM shortage")], "term string, date string, title string")
    totals = spark.createDataFrame([("a", "2025-01-01", 1000), ("b", "2025-01-01", 500), ("a", "2025-02-01", 1000), ("b", "2025-03-01", 10)], "term string, date string, posts_total int")
    covered = spark.createDataFrame([("a", "2025-01-01"), ("b", "2025-01-01"), ("a", "2025-02-01"), ("b", "2025-03-01")], "term string, date string")
    out = {(r["term"], r["date"]): r for r in attention(posts, totals, covered, ["a", "b"]).collect()}
    assert ("b", "2025-02-01") not in out and out[("b", "2025-03-01")]["posts"] == 0
    assert ("ALL", "2025-02-01") not in out
    whole = out[("ALL", "2025-01-01")]
    assert (whole["posts"], whole["neg"], whole["pos"], whole["net_tone"]) == (2, 1, 1, 0.0)
    assert whole["posts_per_1k"] == pytest.approx(2000 / 1500)


def test_quotes(spark):
    pages = spark.createDataFrame([("u", "The “new” drive ships — at 14 000 MB/s™.")], "url string, text string")
    quotes = spark.createDataFrame([("u", 'the "new" drive ... ships - at'), ("u", "not there"), ("u", " ... "), ("v", "x")], "url string, quote string")
    assert [r["quote_found"] for r in quote_check(quotes, pages, "url").orderBy("quote").collect()].count(True) == 1
    found = {(r["url"], r["quote"].strip()): r["quote_found"] for r in quote_check(quotes, pages, "url").collect()}
    assert found[("u", "not there")] is False and found[("u", "...")] is None and found[("v", "x")] is None


def test_contained_passages_against_brute_force(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    passages = [(i, " ".join(words[i:i + 6])) for i in range(5)]
    texts = [(0, "x" + " ".join(words) + "y"), (1, " ".join(words[:6])), (2, "Alpha  beta\ngamma delta epsilon ZETAX"), (3, "none")]
    have = contained_passages(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame(passages, "p int, q string"), "p", "q").collect()
    want = {(d, p) for d, t in texts for p, q in passages if q in " ".join(t.lower().split())}
    assert {tuple(r) for r in have} == want


def test_small_columns(spark):
    df = spark.createDataFrame([("DDR4 8Gb 1G*8  3200 MHz", "https://www.Shop.example.com:8080/a", "http://[bad", "Ryzen 7 5800X3D")], "n string, u string, b string, m string")
    r = df.select(item_key("n").alias("k"), item_spec("n").alias("s"), host("u").alias("h"), host("b").alias("b"),
                  norm_model("m", ["ryzen 7 ", "ryzen "]).alias("m"), normalize_text(F.lit("ＡＢ  “x”")).alias("t")).collect()[0]
    assert r["k"] == "ddr48gb1gx83200" and r["s"]["generation"] == "DDR4" and r["s"]["density_gb"] == 8.0
    assert r["h"] == "shop.example.com:8080" and r["b"] == "" and r["m"] == "5800x3d" and r["t"] == 'ab "x"'


def test_entities_scripts_and_marks(spark):
    from pricetide.functions.columns import decode_entities, strip_tags

    rows = [
        ("Ryzen&trade; 9 costs &#36;5 &#x2014; it&rsquo;s &amp;lt; <b>&eacute;</b>", "Ryzen™ 9 costs $5 — it’s &lt; é"),
        ("a<script>var q='hidden';</script>b<style>p{}</style>c<noscript>no</noscript>d<!-- gone -->e", "a b c d e"),
        ("&#0;&#xD800;&#1114112;&unknown;&#9999999;", "\ufffd\ufffd\ufffd&unknown;\ufffd"), ("plain", "plain"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame(rows, "t string, want string").select(strip_tags("t").alias("have"), "want", decode_entities("t").alias("d"))
    for r in df.collect():
        assert r["have"] == r["want"]
    marks = spark.range(1).select(normalize_text(F.lit("Ryzen™ 9® X")).alias("t")).collect()[0]["t"]
    assert marks == "ryzentm 9 x"


def test_outlook_and_inventory_forms(spark):
    from pricetide.functions import statements as S

    head = "Outlook The table below presents the company's guidance for the second quarter of fiscal 2024 "
    rows = [(1, "Revenue $9 billion ± $1 million. " + head + "Revenue $3.0 billion - $3.5 billion"), (2, "Revenue $9 billion ± $1 million."), (3, None)]
    got = S.outlook_guidance(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).collect()
    assert [(r.k, r.guidance_for, r.metric, r.low, r.high) for r in got] == [(1, "FQ2-FY2024", "revenue", 3000.0, 3500.0)]
    long = "x" * 100 + " Average DIO. Our average DIO for the quarter was 133 days, ended with 99 days of inventory" + "y" * 60
    found = spark.createDataFrame([(long,), ("none",), (None,)], "t string").select(S.days_of_inventory("t").alias("d")).collect()
    assert found[0]["d"]["days"] == 133 and found[1]["d"] is None and found[2]["d"] is None
    at = long.index("average DIO for")
    assert found[0]["d"]["source_text"] == long[at - 80:at + len("average DIO for the quarter was 133 days") + 40]


def test_texts_that_come_again_are_read_once(spark):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate([("a", None), ("a", None), ("b", "x"), ("a", "x"), (None, None), ("drop", None)])], "i int, t string, f string")
    asked = []

    def read(texts):
        asked.extend(sorted(map(str, texts.collect())))
        return texts.where("t IS NULL OR t <> 'drop'").withColumn("n", F.coalesce(F.length("t"), F.lit(-1)))

    got = {r.i: r.n for r in read_once(rows, ["t", "f"], read).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: -1} and len(asked) == len(set(asked)) == 5


def test_reposts_share_one_reading(spark):
    """The same title before and after the launch of DDR5, with and without a flair, once per way it can be read."""
    title = "[RAM] TeamGroup 32GB 3200MHz  CL16 - $55"
    posts = [(str(i), dt.datetime(y, 3, 1), title, flair, "newegg.com") for i, (y, flair) in enumerate([(2020, ""), (2025, ""), (2025, None), (2020, "")])]
    posts += [("9", None, title, "", None)]
    frame = spark.createDataFrame(posts, "id string, ts timestamp, title string, link_flair_text string, domain string")
    parsed = parse_titles(frame)
    got = {r.id: (r.title, r.link_flair_text, r.ts, r.price, r.capacity_gb, r.ddr) for r in parsed.collect()}
    one = "[RAM] TeamGroup 32GB 3200MHz CL16 - $55"
    assert got == {p[0]: (one, p[3], p[1], 55.0, 32.0, "DDR4") for p in posts}
    assert "Aggregate [title" in parsed._jdf.queryExecution().optimizedPlan().toString()


def test_amount_words_stand_in_all_matches(spark):
    said = [
        "REVENUES were 5 trillion won.", "12 billion won in Sales.", "Operating income rose to 3 trillion won.", "2 billion won in  operating loss.",
        "NET LOSS was 7 billion won.", "1 trillion won in\tnet profit.", "Nothing is sold.",
    ]
    text = " ".join(said)
    df = spark.createDataFrame([(text, 1)], "t string, q int")
    own = {(r.metric, r.value, r.source_text) for r in S.amounts(df, "t", "q", []).collect()}
    plain = {(r.metric, r.value, r.source_text) for r in S.amounts(df, "t", "q", [], S.AMOUNT_RULES).collect()}
    assert own == plain and len(own) == 3
    plan = S.amounts(df, "t", "q", [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(") <= 5  # sentences once, one search of them per metric, and the compacting of the rows
