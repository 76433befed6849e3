"""Secret scans, DataFrame functions only: fixed patterns plus character Markov models.

Base kinds (``assign``, ``access``, ``hex``) are leftmost non-overlapping matches of fixed patterns. The method adds
``markov`` spans: tokens of 20 or more characters outside base spans whose mean log-likelihood ratio per transition,
between a model of random strings and a model of ordinary identifiers, is at least ``LEAST``. Both models are
first-order character chains, smoothed by the share of each character, counted over labelled samples: values inside
base spans (random) and word-like tokens of 8 or more characters outside them (ordinary). Base spans are looked for in all rows;
about ``SAMPLE_ROWS`` of the rows that hold one, and about ``PLAIN_ROWS`` of all rows, picked by the hash of doc_id, are learned from. At most 2 x 68 x 68 counts reach the driver and become one array literal.

Positions are running sums over the matches of a text. Arrays cannot be appended to in place, so sums (and running maxima) are
folded in two levels, blocks of about the square root of their number: work per text grows with the power 1.5 of its matches at
most, and tokens meet spans in one sorted pass.

Defined results: null and empty texts have no spans. Without a labelled random string no ``markov`` span is added.
Repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row

# Fixed patterns of the contract; the least length is that of the whole match, for assign of its second group.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 8
# Ordinary for the labels: words, joined words, a number behind them, or a number.
ORDINARY = r"^([A-Za-z]+([-_/][A-Za-z]+)*[-_]?[0-9]*|[0-9]+)$"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
SAMPLE_ROWS = 8000
PLAIN_ROWS = 800
LEAST = 0.6
# Code points of a text that are cut at once.
BLOCK = 4096
# Weight, in transitions, of a character's overall share where a transition was seldom seen.
BACKOFF = 10.0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, also where lambdas use it for each of their elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step, start: Column) -> Column:
    """Running results of ``step`` over an array of numbers, in two levels of blocks."""

    def walk(items: Column, before: Column) -> Column:
        return F.aggregate(items, F.array(before), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))

    def folded(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        count = F.ceil(F.size(v) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * width + 1, width))
        return let(blocks, lambda bs: F.flatten(F.zip_with(
            bs, F.slice(walk(F.transform(bs, lambda x: F.aggregate(x, start, step)), start), F.lit(1), F.size(bs)),
            lambda x, before: F.slice(walk(x, before), F.lit(2), F.size(x)),
        )))

    return let(values, lambda v: F.when(F.size(v) > 0, folded(v)).otherwise(v))


def added(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


LOWEST = -(1 << 30)


def highest(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(LOWEST))


def matches(text: Column, pattern: str) -> Column:
    """All matches with code-point positions: array of (start, end, value), end exclusive.

    The matches and the pieces between them come from the same left-to-right search; positions are running lengths.
    """
    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = added(F.zip_with(gaps, found, lambda g, v: F.length(g) + F.length(v)))
        spans = F.zip_with(found, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.when(F.size(found) > 0, spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> dict[str, Column]:
    long_enough = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_VALUE
    return {"assign": F.filter(matches(text, ASSIGN), long_enough), "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def outside(found: Column, spans: list[Column]) -> Column:
    """The found entries that touch none of the spans: one sorted pass over both."""
    def marked(entries: Column, span: bool) -> Column:
        value = F.lit("") if span else None
        return F.transform(entries, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(span).alias("span"), (m["value"] if value is None else value).alias("value"),
        ))

    def clear(line: Column) -> Column:
        # The last end of the spans that stand before an entry, and the first start of those behind it.
        before = highest(F.transform(line, lambda m: F.when(m["span"], m["end"]).otherwise(LOWEST)))
        behind = F.reverse(highest(F.reverse(F.transform(line, lambda m: F.when(m["span"], -m["start"]).otherwise(LOWEST)))))
        seen = F.zip_with(line, before, lambda m, b: F.struct(m.alias("m"), (~m["span"] & (b <= m["start"])).alias("free")))
        kept = F.zip_with(seen, behind, lambda x, b: F.when(
            x["free"] & (-b >= x["m"]["end"]), F.struct(x["m"]["start"].alias("start"), x["m"]["end"].alias("end"), x["m"]["value"].alias("value")),
        ))
        return F.filter(kept, lambda x: x.isNotNull())

    both = F.array_sort(F.concat(*[marked(s, True) for s in spans], marked(found, False)))
    held = F.size(F.concat(*spans)) > 0
    return F.when((F.size(found) > 0) & held, let(both, clear)).otherwise(found)


def transitions(token: Column) -> Column:
    """Index of each transition of a token in a WIDTH x WIDTH table; characters outside the alphabet are 0."""
    code = F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))
    return F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code) - 1), lambda a, b: a * WIDTH + b)


def train(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratios per transition, random against ordinary; None without labelled random strings."""
    place = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("secrets")), F.lit(1 << 30)) / float(1 << 30)).alias("place")
    held = docs.select(place, *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    values = F.concat(
        F.transform("assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2)),
        F.transform(F.concat("access", "hex"), lambda m: m["value"]),
    )
    held = held.select("place", F.filter(values, lambda v: F.length(v) >= 16).alias("values"))
    labelled = F.size("values") > 0
    rows, holding, first = held.agg(F.count("*"), F.count_if(labelled), F.min(F.when(labelled, F.col("place")))).first()
    if not holding:
        return None
    # At least the first row by hash, also where all rows that hold a span have one place.
    random = held.where(F.col("place") <= max(SAMPLE_ROWS / holding, first)).select(F.lit(1).alias("label"), F.explode("values").alias("token"))
    sample = docs.select("text", place).where(F.col("place") < PLAIN_ROWS / rows)
    bare = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, pattern, " ")
    tokens = F.split(bare, r"[^A-Za-z0-9+/_=-]+")
    plain = sample.select(F.lit(0).alias("label"), F.explode(tokens).alias("token")).where((F.length("token") >= LEAST_VALUE) & F.col("token").rlike(ORDINARY))
    counts = (
        random.unionByName(plain).select("label", F.explode(transitions(F.col("token"))).alias("at"))
        .groupBy("label", "at").agg(F.count("*").alias("n")).collect()
    )
    logs = []
    for label in (0, 1):
        table = [0.0] * (WIDTH * WIDTH)
        for r in counts:
            if r.label == label:
                table[r["at"]] = float(r.n)
        total = sum(table) + 0.5 * WIDTH
        single = [(sum(table[b::WIDTH]) + 0.5) / total for b in range(WIDTH)]
        rows_of = [sum(table[a * WIDTH:(a + 1) * WIDTH]) for a in range(WIDTH)]
        logs.append([
            math.log((table[a * WIDTH + b] + BACKOFF * single[b]) / (rows_of[a] + BACKOFF)) for a in range(WIDTH) for b in range(WIDTH)
        ])
    return [r - p for p, r in zip(*logs, strict=True)]


def scanned(docs: DataFrame, *keep: str, least: float = LEAST) -> DataFrame:
    """The kept columns, text, and one array of (start, end, value) per kind for each row."""
    ratios = train(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    rows = rows.select("*", *[c.alias(f"_{k}") for k, c in base_spans(F.col("text")).items()])
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)")
    if ratios is None:
        return rows.withColumn("_markov", empty)
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")

    def mean_ratio(token: Column) -> Column:
        at = transitions(token)
        return F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / F.size(at)

    tokens = rows.withColumn("_token", matches(F.col("text"), TOKEN))
    tokens = tokens.withColumn("_token", outside(F.col("_token"), [F.col(f"_{k}") for k in KINDS[:3]]))
    scored = F.when(F.size("_token") > 0, F.filter("_token", lambda m: mean_ratio(m["value"]) >= least)).otherwise(F.col("_token"))
    return tokens.withColumn("_markov", scored).drop("_token")


def ordered(kinds: list[str]) -> Column:
    """All spans of these kinds by start, then by kind."""
    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(f"_{kind}", lambda m: F.struct(m["start"].alias("start"), number, m["end"].alias("end")))

    return F.array_sort(F.concat(*map(tagged, kinds)))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op8_secret_scan(docs: DataFrame) -> DataFrame:
    """Contract columns for every document."""
    found = scanned(docs, "doc_id")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(as_text(ordered(KINDS[:3])), 256).alias("base_sha256")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, base, as_text(ordered(KINDS)).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by ``mark``; a null text stays null, and n_chars, where it is a column,
    follows the new text."""
    columns = docs.columns
    found = scanned(docs.select("doc_id", "text", whole_row(docs).alias("row")), "row").withColumn("spans", ordered(KINDS))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(text: Column, start: Column, end: Column) -> Column:
        """Code points of a text in blocks, without a walk from its beginning."""
        first = F.floor(start / BLOCK).cast("int")
        held = F.array_join(F.slice(text, first + 1, F.ceil(end / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * BLOCK + 1, end - start)).otherwise("")

    def walked(spans: Column) -> Column:
        ends = highest(F.transform(spans, lambda s: s["end"]))
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(spans))
        return F.zip_with(spans, before, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b.alias("before")))

    def pieces(text: Column) -> Column:
        # A span within what is already replaced adds nothing.
        cut = F.transform(let(F.col("spans"), walked), lambda s: F.when(s["end"] <= s["before"], "").otherwise(
            F.concat(between(text, s["before"], s["start"]), F.lit(mark))
        ))
        last = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(cut, ""), between(text, last, F.length("text")))

    changed = F.size("spans") > 0
    old = F.col("row.text")
    out = found.select("row", changed.alias("changed"), F.when(changed, let(blocks, pieces)).otherwise(old).alias("new"))
    made = {"text": F.col("new")}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in columns])
