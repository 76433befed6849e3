"""Rows out of stored pages: cells, headings carried down, recurring labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_number, strip_tags
from ..operators.segments import carry

ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def extract_rows(
    pages: DataFrame,
    html: str,
    keep: list[str],
    row: str = ROW,
    cell: str = CELL,
    min_cells: int = 1,
    min_numbers: int = 0,
    known: list[str] | None = None,
) -> DataFrame:
    """``(keep..., pos, cells)`` for each page row with enough cells, numbers or a known key."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(row), 1)).alias("pos", "__row"))
    cells = F.transform(F.regexp_extract_all("__row", F.lit(cell), 1), strip_tags)
    out = rows.select(*keep, "pos", cells.alias("cells")).where(F.size("cells") >= min_cells)
    if min_numbers:
        out = out.where(F.size(F.filter("cells", lambda c: clean_number(c).isNotNull())) >= min_numbers)
    return out.where(F.col("cells")[0].isin(known)) if known else out


def carry_down(rows: DataFrame, page: list[str], pos: str, columns: dict[str, str], span: int = 1000) -> DataFrame:
    """Each row takes the nearest value at or before it in its page (headings, dates, years)."""
    return carry(rows, page, pos, F.floor(F.col(pos) / span), columns)


# Share-price rows, cards, flash words and modules under a wrong heading.
_CURRENCY_TAIL = r"\b(USD|KRW|JPY|TWD|HKD|EUR)$"
_CARD = r"(?i)micro\s?sd"
_FLASH_WORDS = r"\b(MLC|SLC|TLC|QLC|NAND|Speedns)\b"
_FLASH_PAGE = "trendforce.com/price/flash"


def quote_section(page: str, section: str, item: str) -> Column:
    """Corrected section of a quote row; null drops the row."""
    p, s, i = F.col(page), F.col(section), F.col(item)
    rules = [
        ((s == "memory_card") & i.rlike(r"^(DDR|SDRAM)"), F.lit("dram_spot")),
        (i.rlike(_CARD), F.lit("memory_card")),
        (
            s.startswith("dram_") & (p.startswith(_FLASH_PAGE) | i.rlike(_FLASH_WORDS)),
            F.concat(F.lit("flash_"), F.regexp_replace(s, "^[^_]*_", "")),
        ),
        ((s == "dram_spot") & i.rlike(r"\d\s*GB\b"), F.lit("module_spot")),
    ]
    return reclassify([(i.rlike(_CURRENCY_TAIL), F.lit(None).cast("string")), *rules], default=s)


def reclassify(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """First rule that holds gives the value (null = drop), else the default."""
    head, *rest = rules
    chain = F.when(*head)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)
