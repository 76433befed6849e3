"""Cases in which an operator once did less than the whole job."""

import random
import re

from pyspark.sql import functions as F

from pricetide.functions.columns import normalize_text
from pricetide.operators.joins import contained_passages, pattern_join
from pricetide.sources import readers as R

from .test_sources import XML

WORDS = "the cat sat on a mat and the dog sat on the log by the big red barn near old mill".split()


def test_short_passages_are_found_beside_long_ones(spark):
    texts = [(1, " ".join(WORDS)), (2, "Another cat, a catalogue and the  dog SAT on"), (3, ""), (4, None), (2, "on a mat"), (None, "xthe cat saty")]
    passages = [" ".join(WORDS[i:i + n]) for n in range(1, 9) for i in range(0, len(WORDS) - n, 2)] + ["", "e cat sa", "cat", "e d", "the dog sat on the log by the moon", "mat and the d"]
    passages = [*enumerate(passages), (900, None), (0, "the cat"), (0, "the cat")]
    have = contained_passages(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame(passages, "p int, q string"), "p", "q")
    want = [(d, p) for d, t in texts for p, q in passages if t is not None and q is not None and " ".join(q.lower().split()) in " ".join(t.lower().split())]
    assert sorted(map(tuple, have.collect()), key=str) == sorted(want, key=str)


def test_passages_inside_words(spark):
    """Pieces of one to eight characters, cut anywhere, with spaces inside or not."""
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abé d", k=rng.randint(0, 60)))) for i in range(120)]
    pieces = ["".join(rng.choices("abé d", k=rng.randint(1, 8))) for _ in range(150)] + ["z", "zz", "aéb😀", "😀"]
    texts += [(500, "x😀y aéb😀 end")]
    passages = list(enumerate(pieces))
    have = contained_passages(spark.createDataFrame(texts, "d int, t string"), "d", "t", spark.createDataFrame(passages, "p int, q string"), "p", "q")
    assert "NestedLoop" not in have._jdf.queryExecution().executedPlan().toString()
    want = {(d, p) for d, t in texts for p, q in passages if " ".join(q.split()) in " ".join(t.split())}
    assert {tuple(r) for r in have.collect()} == want and len(want) > 500


def test_xml_facts_with_a_default_namespace(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    (tmp_path / "two.xml").write_text(XML.replace("xbrli:", "").replace("12.5", "13.5"))
    rows = R.read_xml_facts(spark, str(tmp_path), ["Revenues"], ["srt:ProductOrServiceAxis"]).collect()
    assert sorted((r["member"], r["val"], str(r["end"])) for r in rows) == [("x:DRAM", 12.5, "2024-03-31"), ("x:DRAM", 13.5, "2024-03-31")]


def test_texts_are_made_plain_again_only_where_they_met_a_passage(spark):
    """All texts were made plain once more before they were joined to the pairs, and each run was made of slices of all words."""
    texts, passages = spark.range(9).selectExpr("id AS d", "concat('the cat sat on the mat ', id) AS t"), spark.range(5).selectExpr("id AS p", "concat('cat sat on the mat ', id) AS q")
    found = contained_passages(texts, "d", "t", passages, "p", "q")
    assert {tuple(r) for r in found.collect()} == {(i, i) for i in range(5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    compared = [line for line in plan.splitlines() if "Join" in line and "Contains(" in line]
    assert compared and all("translate(" in line for line in compared), compared
    assert "arrays_zip" not in plan


def test_patterns_are_made_plain_after_they_are_told_apart(spark):
    """A filter on the plain part went below the distinct patterns, to every row that they are made of."""
    names = spark.range(400).selectExpr("id AS n", "concat('part ', id % 4, 'x') AS device")
    pattern = F.concat(F.lit("^"), F.regexp_replace("device", ".$", "[a-z]"), F.lit("$")).alias("pattern")
    found = pattern_join(names, names.select(F.upper("device").alias("label"), pattern).distinct(), "device")
    assert sorted(map(tuple, found.select("n", "label").collect())) == [(i, f"PART {i % 4}X") for i in range(400)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [line for at, line in enumerate(lines) if "Filter" in line and "translate(" in line and "Range" in lines[at + 1]]
    assert not below, below[:1]


def test_plain_text_of_every_character(spark):
    """The short way for texts without a character that folds agrees with the long one."""
    def long_way(text):
        folds = {**{chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}, "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "™": "tm", "ﬀ": "ff", "ﬁ": "fi",
                 "ﬂ": "fl", "…": "...", **dict.fromkeys("®©\u200b\u200c\u00ad", "")}
        spaces = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
        return re.sub(spaces, " ", "".join(folds.get(c, c) for c in text)).strip(" ")

    texts = [(c, f"{chr(c)}a {chr(c)} \n{chr(c)}b  c{chr(c)}") for c in [*range(1, 0xD800), *range(0xE000, 0x10080)]]
    rows = spark.createDataFrame(texts, "c int, t string").select("c", "t", normalize_text("t").alias("have")).collect()
    have = {r["t"]: r["have"] for r in rows}
    want = spark.createDataFrame([(t, long_way(t)) for _, t in texts], "t string, w string").select("t", F.lower("w").alias("w")).collect()
    assert [(r["t"], have[r["t"]]) for r in want if r["w"] != have[r["t"]]] == []
