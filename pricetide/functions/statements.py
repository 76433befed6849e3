"""Company statements to numbers: verbal ranges, clauses, amounts, guidance, paired changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import read_once
from .columns import found

# Words of direction and level, and the reading of a verbal range.
DOWN = r"declin|decreas|down|lower|fell|drop"
UP = r"increas|\bup\b|grew|grow|rose|higher|improv|\bgain"
FLAT = r"flat|flattish|unchanged"
LEVELS = {"low": 0, "lower": 0, "mid": 1, "middle": 1, "high": 2, "upper": 2}
_LEVEL = "(low|lower|mid|middle|high|upper)"
VERBAL = (
    _LEVEL + r"(?:-to-" + _LEVEL + r")?[- ]?"
    r"(single-digits?|double-digits?|teens?|(\d+)0s\b|(\d+)0(?:%|-percent| percent))"
)
SINGLE_DIGIT = ([1, 4, 7], [3, 6, 9])
TEENS = ([10, 14, 17], [13, 16, 19])
DECADE = ([0, 4, 7], [3, 6, 9])
NUMERIC = [  # pattern, whether it is only a lower bound
    (r"(?:approximately|about|roughly|nearly|almost|close to|approached|approximate)\s+(\d+)\s?(?:%| percent)", False),
    (r"(?:slightly over|over|more than|above)\s+(\d+)\s?(?:%| percent)", True),
    (r"in the (\d+)-percent(?:age)? range", False),
    (r"(\d+(?:\.\d+)?)\s?(?:%| percent)", False),
]
WORDED = [  # pattern, low, high
    (r"more than doubled", 100.0, None),
    (r"\b(?:roughly |approximately |relatively )?(?:flat|flattish|unchanged)\b", 0.0, 0.0),
    (r"\b(?:slight(?:ly)?|modest(?:ly)?)\b", None, None),
]
PRICE_SUBJECT = r"\bASPs?\b|average selling prices?|\bprices?\b"
BITS_SUBJECT = r"bit shipments?|shipment quantities|\bbits\b|gigabits sold|gigabytes sold|sales volumes?"
SENTENCE = r"(?<=[a-z%)\d])\.\s+(?=[A-Z])"
ANNUAL_SENTENCE = r"^\s*(For (the |full )?(fiscal year|FY)|Fiscal 20\d\d|Year-over-year|Year-on-year)"
CLAUSE = (
    r",\s*(?:and\s+|while\s+|with\s+)?|\s+while\s+|;\s*|"
    r"\s+and\s+(?!prices? both)(?=(?:ASPs?|average selling|prices?|bit|shipment))"
)
MAGNITUDE_MARK = f"{DOWN}|{UP}|flat|unchanged|%|percent|digit|teens"


def norm_statement(col: str | Column) -> Column:
    """Undo breaks that page extraction leaves in ranges."""
    text = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(text, r"\s*-\s*", "-")
    text = F.regexp_replace(text, r"\bf lat\b", "flat")
    text = F.replace(text, F.lit("single digit"), F.lit("single-digit"))
    return F.replace(text, F.lit("double digit"), F.lit("double-digit"))


def magnitude(text: Column) -> Column:
    """``struct<low, high, phrase>`` of the earliest, then longest, size phrase; null without one."""
    none = F.lit(None).cast("double")
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    kind = F.regexp_extract(text, VERBAL, 3)
    a = level[F.regexp_extract(text, VERBAL, 1)]
    b = level[F.coalesce(found(text, VERBAL, 2), F.regexp_extract(text, VERBAL, 1))]
    base = F.coalesce(found(text, VERBAL, 4), found(text, VERBAL, 5)).try_cast("double") * 10

    def bound(index: Column, side: int) -> Column:
        def of(table) -> Column:
            return F.get(F.array(*[F.lit(float(x)) for x in table[side]]), index)

        teens = kind.startswith("double") | kind.startswith("teen")
        return F.when(kind.startswith("single"), of(SINGLE_DIGIT)).when(teens, of(TEENS)).otherwise(base + of(DECADE))

    def candidate(pattern: str, order: int, low: Column, high: Column) -> Column:
        phrase = F.regexp_extract(text, pattern, 0)
        return F.when(text.rlike(pattern), F.struct(
            F.regexp_instr(text, F.lit(pattern)).alias("pos"), (-F.length(phrase)).alias("short"), F.lit(order).alias("order"),
            low.cast("double").alias("low"), high.cast("double").alias("high"), phrase.alias("phrase"),
        ))

    rows = [candidate(VERBAL, 0, bound(a, 0), bound(b, 1))]
    for pattern, over in NUMERIC:
        value = found(text, pattern, 1).try_cast("double")
        rows.append(candidate(pattern, len(rows), value, none if over else value))
    for pattern, low, high in WORDED:
        rows.append(candidate(pattern, len(rows), F.lit(low), F.lit(high)))
    best = F.array_min(F.array_compact(F.array(*rows)))
    return F.when(best.isNotNull(), F.struct(best["low"].alias("low"), best["high"].alias("high"), best["phrase"].alias("phrase")))


def verbal_range(df: DataFrame, clause: str, subject: str) -> DataFrame:
    """Add ``direction, low, high, mid, phrase``: the sign comes from the first direction word
    at or after the subject (else anywhere), and turns the range around when prices fall. Clauses that come again are read once."""
    return read_once(df, [clause], lambda clauses: _read_range(clauses, clause, subject))


def _read_range(df: DataFrame, clause: str, subject: str) -> DataFrame:
    text = norm_statement(clause)
    at = F.regexp_instr(F.col("__c"), F.lit(f"(?i)(?:{subject})"))
    out = df.withColumn("__c", text)
    out = out.withColumn("__tail", F.when(at > 0, F.substring(F.col("__c"), at, F.length("__c"))).otherwise(F.col("__c")))
    word = f"(?i)({DOWN})|({UP})|({FLAT})"

    def sign(col: str) -> Column:
        return (
            F.when(F.regexp_extract(col, word, 1) != "", -1).when(F.regexp_extract(col, word, 2) != "", 1)
            .when(F.regexp_extract(col, word, 3) != "", 0)
        )

    out = out.withColumn("__sign", F.coalesce(sign("__tail"), sign("__c")))
    whole = F.when(~F.col("__c").rlike("(?i)revenue"), magnitude(F.col("__c")))
    out = out.withColumn("__m", magnitude(F.col("__tail")))
    # The rest of the clause is read only where the tail says nothing and differs from it.
    out = out.withColumn("__m", F.when(F.col("__m").isNull() & (at > 1), whole).otherwise(F.col("__m")))
    low, high, falls = F.col("__m.low"), F.col("__m.high"), F.col("__sign") < 0
    out = out.withColumns({
        "low": F.when(falls, -high).otherwise(low), "high": F.when(falls, -low).otherwise(high),
        "phrase": F.coalesce("__m.phrase", F.lit("")),
    })
    named = F.when(F.col("__sign") == 1, "increase").when(F.col("__sign") == -1, "decrease").when(
        F.col("__sign") == 0, "flat"
    ).otherwise("unknown")
    # A zero range keeps its sign-free form.
    return out.withColumns({
        "direction": F.when(F.col("phrase").rlike("flat|unchanged"), "flat").otherwise(named),
        "mid": (F.col("low") + F.col("high")) / 2,
    }).drop("__c", "__tail", "__sign", "__m")


def clauses(text: Column) -> Column:
    """Clauses of all sentences that do not speak of a whole year."""
    sentences = F.filter(F.split(text, SENTENCE), lambda s: ~s.rlike(ANNUAL_SENTENCE))
    return F.filter(F.flatten(F.transform(sentences, lambda s: F.split(s, CLAUSE))), lambda c: F.trim(c) != "")


def first_clause(text: str | Column, subject: str, exclude: str | None = None, mark: str = MAGNITUDE_MARK) -> Column:
    """First clause that names the subject and a size or direction; null without one."""
    body = F.col(text) if isinstance(text, str) else text

    def fits(c: Column) -> Column:
        ok = c.rlike(f"(?i){subject}") & c.rlike(f"(?i){mark}")
        return ok & ~c.rlike(f"(?i){exclude}") if exclude else ok

    return F.trim(F.get(F.filter(clauses(body), fits), F.lit(0)))


# Amounts in won, the words around them, and sentences about a year or a quarter.
_AMOUNT = r"(-?[\d][\d,]*(?:\.\d+)?)\s*(trillion|billion)\s*(?:Korean )?won"
_GAP = r"(?:(?!profit|income|loss|revenue|sales)[^.;·▪])"
_VERB = r"(?:of|was|were|at|totaled|amounted to|reached|recorded|to)"
AMOUNT_RULES: dict[str, list[tuple[int, str]]] = {
    "revenue": [
        (1, rf"(?:revenues?|sales)\b{_GAP}{{0,70}}?\b{_VERB}\s+{_AMOUNT}"),
        (1, rf"{_AMOUNT}\s+in\s+(?:revenues?|sales)"),
    ],
    "operating_profit": [
        (1, rf"operating (?:profit|income)\b{_GAP}{{0,40}}?\s{_AMOUNT}"),
        (1, rf"{_AMOUNT}\s+in\s+operating (?:profit|income)"),
        (-1, rf"operating loss(?:es)?\b{_GAP}{{0,40}}?\s{_AMOUNT}"),
        (-1, rf"{_AMOUNT}\s+in\s+operating loss"),
    ],
    "net_profit": [
        (1, rf"net (?:profit|income)\b{_GAP}{{0,40}}?\s{_AMOUNT}"),
        (1, rf"{_AMOUNT}\s+in\s+net (?:profit|income)"),
        (-1, rf"net loss(?:es)?\b{_GAP}{{0,40}}?\s{_AMOUNT}"),
        (-1, rf"{_AMOUNT}\s+in\s+net loss"),
    ],
}
# One of these stands, in small letters, in whatever a pattern of the metric matches.
AMOUNT_WORDS = {"revenue": ["revenue", "sales"], "operating_profit": ["operating "], "net_profit": ["net "]}
ANNUAL_WORDS = (
    r"(?i)fiscal year|for the year|full year|annual|yearly|\bFY ?\d|for 20\d\d\b|"
    r"revenues? for 20\d\d|20\d\d revenues?|in 20\d\d\b"
)
QUARTER_WORDS = (
    r"(?i)\b(?:first|second|third|fourth) quarter|\b[1-4]Q|\bQ[1-4]\b|three months|"
    r"three-month|the quarter|quarterly"
)
FOURTH_WORDS = r"(?i)fourth quarter|\b4Q|\bQ4\b|three months|three-month|the quarter|quarterly"
RELEASE_SENTENCE = r"(?<=[.!?])[\"”’]?\s+(?=[A-Z“\"‘(])|\s[·▪–]\s|▲|\s•\s"
UNITS = {"trillion": 1.0, "billion": 0.001}


def _any_pattern(patterns: list[str], words: list[str] | None = None):
    """One-argument test for ``filter``: some pattern occurs. ``words``: the patterns are tried only where one of them stands."""
    def occurs(s: Column) -> Column:
        hit = reduce(lambda a, b: a | b, [s.rlike(p) for p in patterns])
        return reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(w)) for w in words]) & hit if words else hit

    return occurs


def amounts(df: DataFrame, text: str, quarter: str, keep: list[str], rules: dict | None = None) -> DataFrame:
    """``(keep..., metric, value, source_text)``: first sentence per metric, one unit, losses negative.

    Fourth-quarter releases lead with the year, so there only sentences that name the
    quarter count; elsewhere sentences framed as annual are passed over.
    """
    def counts(s: Column) -> Column:
        return F.when(F.col(quarter) == 4, s.rlike(FOURTH_WORDS)).otherwise(
            ~s.rlike(ANNUAL_WORDS) | s.rlike(QUARTER_WORDS)
        )

    sentences = F.filter(F.split(text, RELEASE_SENTENCE), lambda s: (s != "") & counts(s))
    staged = df.withColumn("__s", sentences)
    scale = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    found_rows, words = [], {} if rules else AMOUNT_WORDS
    for metric, patterns in (rules or AMOUNT_RULES).items():
        tests = [(sign, f"(?i){pattern}") for sign, pattern in patterns]

        # A column of its own, as every use of the expression would search the sentences again.
        staged = staged.withColumn(f"__s_{metric}", F.get(F.filter("__s", _any_pattern([p for _, p in tests], words.get(metric))), F.lit(0)))
        sentence = F.col(f"__s_{metric}")
        value = F.coalesce(*[
            F.when(sentence.rlike(p), sign * F.replace(F.regexp_extract(sentence, p, 1), F.lit(","), F.lit("")).try_cast("double")
                   * scale[F.lower(F.regexp_extract(sentence, p, 2))])
            for sign, p in tests
        ])
        found_rows.append(F.when(sentence.isNotNull(), F.struct(
            F.lit(metric).alias("metric"), F.round(value, 6).alias("value"), F.trim(sentence).alias("source_text")
        )))
    return staged.select(*keep, F.inline(F.array_compact(F.array(*found_rows))))


def money(text: Column) -> Column:
    """Amount in millions; brackets mean a loss."""
    size = F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit("")).try_cast("double")
    return F.when(F.trim(text).startswith("("), -size).otherwise(size)


# Guidance and results wording.
REVENUE_PLUS_MINUS = r"Revenue \$([\d.]+) billion ?(?:±|\+/-) ?\$([\d.]+) (million|billion)"
REVENUE_RANGE = r"Revenue \$([\d.]+) billion ?[-–] ?\$([\d.]+) billion"
MARGIN_GUIDANCE = (
    r"Gross margin (?:Approximately )?(\(?[\d.]+%\)?)(?: ?± ?([\d.]+)%)? "
    r"(?:Approximately )?(\(?[\d.]+%\)?)(?: ?± ?([\d.]+)%)?"
)
EPS_GUIDANCE = (
    r"Diluted earnings(?: \(loss\))? per share (\(?\$\(?[\d.]+\)?) ?± ?\$([\d.]+) "
    r"(\(?\$\(?[\d.]+\)?) ?± ?\$([\d.]+)"
)
RESULTS_TABLE = (
    r"Quarterly Financial Results.{0,200}?(?:Net sales|Revenue) \$ ([\d,]+) .{0,80}?Gross margin \$? ?(\(?[\d,]+\)?) "
    r".{0,120}?(?:percent|Percent) of (?:net sales|revenue) (\(?[\d.]+ ?%\)?).{0,40}?(\(?[\d.]+ ?%\)?) (\(?[\d.]+ ?%\)?) "
    r"(\(?[\d.]+ ?%\)?)"
)
SUMMARY_TABLE = (
    r"CONSOLIDATED FINANCIAL SUMMARY.{0,300}?Net sales \$ ([\d,]+) .{0,200}?Gross margin (\(?[\d,]+ ?\)?) "
)
SALES_SENTENCE = r"Sales of {product} products (?:increased|decreased|declined) \d+%[^•]*?\.(?= |$)"
SALES_SEGMENT = r",| and | partially offset by | primarily due to | driven by "
CHANGE_SUBJECTS = {"asp_qoq_pct": r"average selling prices", "bits_qoq_pct": r"bit shipments"}


def _range_row(metric: str, basis: str, mid: Column, spread: Column, unit: str, text: Column) -> Column:
    return F.when(mid.isNotNull(), F.struct(
        F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), mid.alias("mid"), spread.alias("plus_minus"),
        (mid - spread).alias("low"), (mid + spread).alias("high"), F.lit(unit).alias("unit"), text.alias("text"),
    ))


# Where an outlook table begins, what it is for, and how many characters of it are read.
OUTLOOK = (
    r"(?:Business )?Outlook The (?:following )?table (?:below )?presents .{1,40}?s guidance for the "
    r"(first|second|third|fourth) quarter (?:of )?(?:fiscal )?(\d{4})(.{0,900})"
)
# Days of inventory in remarks, the first form that occurs counts.
INVENTORY_DAYS = [
    r"days of inventory (?:\(DIO\) )?at (\d{2,3})",
    r"(?:[Aa]verage days(?: of inventory)?(?: for the quarter)?|average DIO for the quarter)[^.]{0,30}?(?:were|was)(?: down to)? (\d{2,3}) days",
    r"\$[\d.]+ billion(?: of inventory)?,? or (\d{2,3}) days",
    r"[Dd]ays of inventory (?:was|were) (\d{2,3})",
    r"ended with (\d{2,3}) days of inventory",
]


def outlook(text: str | Column) -> Column:
    """``(guidance_for, body)`` of the outlook section, such as ``FQ2-FY2024``; null without one."""
    body = F.col(text) if isinstance(text, str) else text
    quarter, year, rest = (F.regexp_extract(body, OUTLOOK, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(q) for q in ("first", "second", "third", "fourth")]), quarter)
    label = F.concat(F.lit("FQ"), number.cast("string"), F.lit("-FY"), year)
    return F.when(body.rlike(OUTLOOK), F.struct(label.alias("guidance_for"), rest.alias("body")))


def outlook_guidance(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``guidance_range`` within the outlook section only, with the quarter it is for; texts without a section have no rows."""
    section = df.select(*keep, outlook(text).alias("__o")).where(F.col("__o").isNotNull())
    return guidance_range(section.select(*keep, "__o.guidance_for", F.col("__o.body").alias("__body")), "__body", [*keep, "guidance_for"])


def days_of_inventory(text: str | Column) -> Column:
    """``(days, source_text)`` of the first form of words that occurs, with 80 characters before and 40 behind it; or null."""
    body = F.col(text) if isinstance(text, str) else text
    forms = []
    for pattern in INVENTORY_DAYS:
        around = f"(?s).{{0,80}}?{pattern}.{{0,40}}"
        seen = F.struct(F.regexp_extract(body, pattern, 1).cast("double").alias("days"), F.regexp_extract(body, around, 0).alias("source_text"))
        forms.append(F.when(body.rlike(pattern), seen))
    return F.coalesce(*forms)


def guidance_range(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Outlook table to rows ``metric, basis, mid, plus_minus, low, high, unit, text``."""
    body = F.col(text)

    def number(pattern: str, group: int) -> Column:
        return found(body, pattern, group).try_cast("double")

    spread = number(REVENUE_PLUS_MINUS, 2) * F.when(F.regexp_extract(body, REVENUE_PLUS_MINUS, 3) == "billion", 1000.0).otherwise(1.0)
    lo, hi = number(REVENUE_RANGE, 1) * 1000, number(REVENUE_RANGE, 2) * 1000
    rows = [F.coalesce(
        _range_row("revenue", "GAAP", number(REVENUE_PLUS_MINUS, 1) * 1000, spread, "USD mn", F.regexp_extract(body, REVENUE_PLUS_MINUS, 0)),
        _range_row("revenue", "GAAP", (lo + hi) / 2, (hi - lo) / 2, "USD mn", F.regexp_extract(body, REVENUE_RANGE, 0)),
    )]
    for metric, pattern, unit in (("gross_margin_pct", MARGIN_GUIDANCE, "pct"), ("diluted_eps", EPS_GUIDANCE, "USD")):
        for basis, group in (("GAAP", 1), ("non-GAAP", 3)):
            rows.append(_range_row(
                metric, basis, money(found(body, pattern, group)), number(pattern, group + 1), unit,
                F.regexp_extract(body, pattern, 0),
            ))
    return df.select(*keep, F.inline(F.array_compact(F.array(*rows))))


def filing_figures(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Results table of a release to ``metric, basis, value, unit``; the older summary is the fallback."""
    body = F.col(text)
    full = body.rlike(RESULTS_TABLE)

    def row(metric: str, basis: str, value: Column, unit: str) -> Column:
        return F.when(value.isNotNull(), F.struct(
            F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), value.alias("value"), F.lit(unit).alias("unit")
        ))

    def either(group: int) -> Column:
        return money(F.when(full, found(body, RESULTS_TABLE, group)).otherwise(found(body, SUMMARY_TABLE, group)))

    rows = [
        row("revenue", "GAAP", either(1), "USD mn"), row("gross_profit", "GAAP", either(2), "USD mn"),
        row("gross_margin_pct", "GAAP", money(found(body, RESULTS_TABLE, 3)), "pct"),
        row("gross_margin_pct", "non-GAAP", money(found(body, RESULTS_TABLE, 6)), "pct"),
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*rows))))


def discussion_changes(df: DataFrame, text: str, keep: list[str], products: tuple[str, ...] = ("DRAM", "NAND")) -> DataFrame:
    """"Sales of X products increased N% ... due to ..." to one verbal change per product and subject."""
    rows = []
    for product in products:
        sentence = found(F.col(text), SALES_SENTENCE.format(product=product), 0)
        for metric, subject in CHANGE_SUBJECTS.items():
            part = F.get(F.filter(F.split(sentence, SALES_SEGMENT), _any_pattern([subject])), F.lit(0))
            rows.append(F.when(sentence.isNotNull(), F.struct(
                F.lit(product).alias("technology"), F.lit(metric).alias("metric"), part.alias("statement")
            )))
    return verbal_range(df.select(*keep, F.inline(F.array_compact(F.array(*rows)))), "statement", ".")


# Verbs and subjects of paired changes.
RISES = ["increased", "rose", "grew", "climbed", "surged", "jumped"]
FALLS = ["declined", "decreased", "fell", "dropped", "slipped", "lowered"]
_V = "(" + "|".join(RISES + FALLS) + ")(?: only)?"
_N = r"(\d+(?:\.\d+)?)\s?%"
_BITS = r"bit shipments?"
_ASP = r"(?:average selling prices?|ASPs?)"
PAIR_SENTENCE = r"(?<=[.!?])[\"”’]?\s+"
FOUR_WAY = rf"(?i)DRAM and NAND(?: Flash)? {_BITS} {_V}(?: by)? {_N} and {_N}.*?{_ASP} {_V}(?: by)? {_N} and {_N}"
TWO_WAY = rf"(?i){_BITS} and (?:the )?(?:DRAM )?{_ASP} {_V}(?: by)? {_N} and {_N}"
BITS_ALONE = rf"(?i){_BITS}(?:(?!average selling|ASP)[^%])*?\b{_V}(?: by)? {_N}"
ASP_NEXT = rf"(?i){_ASP}\s+(?:{_V}\s+)?(?:by )?{_N}"
ASP_ALONE = rf"(?i){_ASP}(?:(?!bit shipment)[^%])*?\b{_V}(?: by)? {_N}"


def paired_changes(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``(keep..., metric, value, source_text)``: signed changes of bits and prices per product.

    A price without a verb of its own takes the one of the bits. Sentences that name a
    subject but read no clear way stay as a ``_statement`` row without a value.
    """
    none = F.lit(None).cast("double")
    rows = df.select(*keep, F.explode(F.filter(F.split(text, PAIR_SENTENCE), lambda s: s.rlike(f"(?i){_BITS}|{_ASP}"))).alias("__s"))
    s = F.col("__s")

    def signed(verb: Column, number: Column) -> Column:
        return F.when(F.lower(verb).isin(*FALLS), -1.0).otherwise(1.0) * number.try_cast("double")

    def part(pattern: str, verb: int, number: int) -> Column:
        return signed(F.regexp_extract(s, pattern, verb), found(s, pattern, number))

    def row(metric: Column, value: Column) -> Column:
        return F.struct(metric.alias("metric"), value.cast("double").alias("value"))

    dram, nand = s.contains("DRAM"), s.contains("NAND")
    product = F.when(dram & ~nand, "dram").when(nand & ~dram, "nand")
    four = F.array(
        row(F.lit("dram_bit_shipments_qoq_pct"), part(FOUR_WAY, 1, 2)), row(F.lit("nand_bit_shipments_qoq_pct"), part(FOUR_WAY, 1, 3)),
        row(F.lit("dram_asp_qoq_pct"), part(FOUR_WAY, 4, 5)), row(F.lit("nand_asp_qoq_pct"), part(FOUR_WAY, 4, 6)),
    )
    bits_name, asp_name = F.concat(product, F.lit("_bit_shipments_qoq_pct")), F.concat(product, F.lit("_asp_qoq_pct"))
    two = F.array(row(bits_name, part(TWO_WAY, 1, 2)), row(asp_name, part(TWO_WAY, 1, 3)))
    bits_verb = found(s, BITS_ALONE, 1)
    bits = F.when(bits_verb.isNotNull(), row(bits_name, part(BITS_ALONE, 1, 2)))
    beside = s.rlike(ASP_NEXT)
    verb = F.coalesce(F.when(beside, found(s, ASP_NEXT, 1)).otherwise(found(s, ASP_ALONE, 1)), bits_verb)
    number = F.when(beside, found(s, ASP_NEXT, 2)).otherwise(found(s, ASP_ALONE, 2))
    asp = F.when(number.isNotNull() & verb.isNotNull(), row(asp_name, signed(verb, number)))
    alone = F.array_compact(F.array(bits, asp))
    statement = F.concat(F.when(dram & nand, "dram_nand").otherwise(product), F.lit("_statement"))
    read = (
        F.when(s.rlike(FOUR_WAY), four).when(product.isNotNull() & s.rlike(TWO_WAY), two)
        .when(product.isNotNull() & (F.size(alone) > 0), alone)
        .when(dram | nand, F.array(row(statement, none)))
        .otherwise(F.slice(four, 1, 0))
    )
    return rows.select(*keep, F.inline(read), F.trim("__s").alias("source_text"))


# Month names and the forms of a date with its precision.
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAY_FORM = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})"
ISO_FORM = r"\b(\d{4})-(\d{2})-(\d{2})\b"
MONTH_FORM = r"\b([A-Za-z]{3,9})\.?,?\s+(\d{4})"
PART_FORM = r"\b(?:Q([1-4])|([12])H)\s*(\d{4})"
YEAR_FORM = r"\b(20\d{2}|19\d{2})\b"


def parse_date_precision(col: str | Column) -> Column:
    """``struct<date, precision>``: first date in the text and how exact it is."""
    text = F.replace(F.col(col) if isinstance(col, str) else col, F.lit(" / "), F.lit(" "))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])

    def part(pattern: str, group: int) -> Column:
        return found(text, pattern, group).try_cast("int")

    def month(pattern: str) -> Column:
        place = F.array_position(names, F.lower(F.substring(F.regexp_extract(text, pattern, 1), 1, 3))).cast("int")
        return F.when(place > 0, place)

    def form(year: Column, mon: Column, day: Column, precision: Column | str) -> Column:
        known = year.isNotNull() & mon.isNotNull() & day.isNotNull()
        text_date = F.format_string("%04d-%02d-%02d", year, mon, day)
        label = F.lit(precision) if isinstance(precision, str) else precision
        return F.when(known, F.struct(text_date.try_cast("date").alias("date"), label.alias("precision")))

    one = F.lit(1)
    quarter, half = part(PART_FORM, 1), part(PART_FORM, 2)
    return F.coalesce(
        form(part(DAY_FORM, 3), month(DAY_FORM), part(DAY_FORM, 2), "day"),
        form(part(ISO_FORM, 1), part(ISO_FORM, 2), part(ISO_FORM, 3), "day"),
        form(part(MONTH_FORM, 2), month(MONTH_FORM), one, "month"),
        form(
            part(PART_FORM, 3), F.coalesce((quarter - 1) * 3 + 1, F.when(half == 1, 1).otherwise(7)), one,
            F.when(quarter.isNotNull(), "quarter").otherwise("half"),
        ),
        form(part(YEAR_FORM, 1), one, one, "year"),
    )
