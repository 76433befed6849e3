"""Column builders: time buckets, keys, guarded arithmetic, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GRAINS = {"day": "DAY", "month": "MM", "quarter": "QUARTER", "year": "YEAR"}


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket(col: str | Column, grain: str = "month") -> Column:
    """First day of the period that holds the date."""
    day = _c(col).cast("date")
    return day if grain == "day" else F.trunc(day, _GRAINS[grain])


def month_of_text(col: str | Column) -> Column:
    """``YYYY-MM`` or ``YYYY-MM-DD`` text to the first day of its month."""
    return F.to_date(F.concat(F.substring(_c(col), 1, 7), F.lit("-01")))


def quarter_label(col: str | Column) -> Column:
    return F.concat(F.year(_c(col)).cast("string"), F.lit("Q"), F.quarter(_c(col)).cast("string"))


def month_number(col: str | Column) -> Column:
    return F.year(_c(col)) * 12 + F.month(_c(col))


def months_apart(earlier: str | Column, later: str | Column) -> Column:
    """Whole calendar months between two dates, days ignored."""
    return month_number(later) - month_number(earlier)


def quarters_apart(earlier: str | Column, later: str | Column) -> Column:
    return (F.year(_c(later)) * 4 + F.quarter(_c(later))) - (F.year(_c(earlier)) * 4 + F.quarter(_c(earlier)))


def shift_months(day: str | Column, months: str | Column) -> Column:
    return F.add_months(_c(day), _c(months).cast("int"))


def age_months(day: str | Column, release: str | Column) -> Column:
    """Age in months of 30.44 days, rounded half to even."""
    return F.bround(F.datediff(_c(day), _c(release)) / F.lit(30.44)).cast("int")


def item_key(col: str | Column) -> Column:
    """One key for cosmetic variants of an item name."""
    squeezed = F.lower(F.regexp_replace(_c(col), r"(?U)\s+", ""))
    return F.regexp_replace(F.translate(squeezed, "*", "x"), "mbps|mhz", "")


# Generation names, density and module forms of chip quotes.
_GENERATION = r"(?i)\b(SDRAM|RDRAM|DDR5|DDR4|DDR3|DDR2|DDR)\b"
_MODULE_FORMS = "SO-DIMM|U-DIMM|DIMM|RIMM"
_DENSITY = rf"(\d+)\s*(G|M)b?\b(?!\s*(?:{_MODULE_FORMS}))"


def item_spec(col: str | Column) -> Column:
    """``struct<generation, density_gb>``; modules have no chip density."""
    name = _c(col)
    module = name.rlike(rf"\d+\s*GB\s*(?:{_MODULE_FORMS})") | name.contains("RIMM")
    amount = F.regexp_extract(name, _DENSITY, 1).try_cast("double")
    scale = F.when(F.regexp_extract(name, _DENSITY, 2) == "G", F.lit(1.0)).otherwise(F.lit(1024.0))
    return F.struct(
        F.upper(found(name, _GENERATION, 1)).alias("generation"),
        F.when(~module, amount / scale).alias("density_gb"),
    )


def found(col: str | Column, pattern: str, group: int = 0) -> Column:
    """``regexp_extract`` with null, not an empty string, for no match."""
    return F.nullif(F.regexp_extract(_c(col), pattern, group), F.lit(""))


def fallback_price(price: str | Column, high: str | Column, low: str | Column) -> Column:
    """The price, else the middle of high and low; null unless positive."""
    value = F.coalesce(_c(price), (_c(high) + _c(low)) / 2)
    return F.when(value > 0, value)


def guarded_ratio(num: str | Column, den: str | Column, valid: Column | None = None) -> Column:
    usable = _c(den) > 0 if valid is None else (_c(den) > 0) & valid
    return F.when(usable, _c(num) / _c(den))


def norm_model(col: str | Column, words: list[str]) -> Column:
    """Strip the listed words in their order, then all white space."""
    name = F.lower(_c(col))
    for word in words:
        name = F.replace(name, F.lit(word), F.lit(""))
    return F.regexp_replace(name, r"(?U)\s+", "")


def clean_number(col: str | Column) -> Column:
    """Text to a number; placeholders and anything not numeric become null."""
    text = F.replace(F.trim(_c(col)), F.lit(","), F.lit(""))
    return F.when(~F.lower(text).isin("", ".", "null", "nan", "-"), text.try_cast("double"))


def in_range(value: str | Column, category: str | Column, bounds: dict[str, tuple[float, float]]) -> Column:
    """True when the value lies in its category's range; null without a range."""
    check = F.lit(None).cast("boolean")
    for name, (low, high) in bounds.items():
        check = F.when(_c(category) == name, _c(value).between(low, high)).otherwise(check)
    return check


def exclude_window(ts: str | Column, low: str, high: str) -> Column:
    return ~_c(ts).between(F.lit(low).cast("date"), F.lit(high).cast("date"))


def cutover(section: str | Column, ts: str | Column, after: str, day: str) -> Column:
    """Rows of ``after`` always, rows of every other section only before ``day``."""
    return (_c(section) == after) | (_c(ts) < F.lit(day).cast("date"))


def net_tone(pos: str | Column, neg: str | Column) -> Column:
    total = _c(pos) + _c(neg)
    return F.when(total > 0, (_c(pos) - _c(neg)) / total)


def months_to(level: str | Column, target: str | Column, rate: str | Column) -> Column:
    """Months of steady log decline from ``level`` to ``target``; 0 when already there."""
    return F.when(_c(level) <= _c(target), F.lit(0.0)).otherwise(F.ln(_c(level) / _c(target)) / _c(rate))


def host(url: str | Column) -> Column:
    """Lower-case host (and port) without ``www.``; empty when the address is malformed."""
    address = F.try_parse_url(_c(url), F.lit("AUTHORITY"))
    return F.coalesce(F.regexp_replace(F.lower(address), r"^www\.", ""), F.lit(""))


def version_key(col: str | Column) -> Column:
    """Dotted version as an array of integers, for sorting."""
    return F.transform(F.split(_c(col), r"\."), lambda part: part.try_cast("int"))


def mismatch_flag(a: str | Column, b: str | Column, low: float = 0.8, high: float = 1.25) -> Column:
    """True when a / b lies outside [low, high]."""
    ratio = F.try_divide(_c(a), _c(b))
    return F.coalesce((ratio < low) | (ratio > high), F.lit(False))


# Characters dropped and folded before quotes are compared.
_DROPPED = "®©​‌­"
_FOLDS = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}
_FORMS = {"™": "tm", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "…": "..."}
# White space outside of ASCII, and two ranges that hold it and every character that folds.
_WIDE_SPACE = r"[\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_MAY_FOLD = r"[\u0085-\u00AE\u1680-\uFFFF]"


def normalize_text(col: str | Column) -> Column:
    """Fold quotes, dashes, full-width and compatibility forms, collapse white space, lower case.

    Folding looks up every character by itself, so it is done only for texts that may hold one that folds.
    """
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + " \u3000"
    narrow = "".join(chr(0x21 + i) for i in range(94)) + "  "
    folded = F.translate(_c(col), wide, narrow)
    folded = F.translate(folded, "".join(_FOLDS) + _DROPPED, "".join(_FOLDS.values()))
    for form, letters in _FORMS.items():
        folded = F.replace(folded, F.lit(form), F.lit(letters))
    folded = F.regexp_replace(folded, _WIDE_SPACE, " ")
    text = F.when(F.rlike(_c(col), F.lit(_MAY_FOLD)), folded).otherwise(_c(col))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\t-\r]", " "), "  +", " ")))


# Named character references of running text; the ampersand comes last, so that nothing is decoded twice.
_ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "sbquo": "‚", "bdquo": "„", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "deg": "°", "plusmn": "±", "times": "×", "frac12": "½", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "amp": "&",
}
_NUMERIC = "&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def decode_entities(col: str | Column) -> Column:
    """Numeric and named character references as characters; unknown names stay as they are."""
    text = _c(col)

    def char(code: Column) -> Column:
        digits = F.when(F.lower(code).startswith("x"), F.substring(code, 2, 8)).otherwise(F.conv(code, 10, 16))
        digits = F.lpad(F.upper(digits), 8, "0")
        valid = (digits <= "0010FFFF") & ~digits.between("0000D800", "0000DFFF") & (digits > "00000000")
        return F.decode(F.unhex(F.when(valid, digits).otherwise(F.lit("0000FFFD"))), "UTF-32")

    found = F.regexp_extract_all(text, F.lit(_NUMERIC), 1)
    parts = F.zip_with(F.split(text, _NUMERIC, -1), F.transform(found, char), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    decoded = F.when(F.contains(text, F.lit("&#")), F.array_join(parts, "")).otherwise(text)
    for name, letters in _ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(letters))
    return decoded


def strip_tags(col: str | Column) -> Column:
    """Text without scripts, styles and tags, with character references decoded and white space collapsed."""
    text = F.regexp_replace(_c(col), r"(?is)<(script|style|noscript)\b[^>]*>.*?(</\1\s*>|\z)|<!--.*?-->", " ")
    text = decode_entities(F.regexp_replace(text, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
