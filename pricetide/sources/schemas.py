"""Declared schemas as DDL text. Every reader uses one, with FAILFAST, instead of inferring types."""

FACTS = "date DATE, term STRING, metric STRING, value DOUBLE"
QUOTES = (
    "date DATE, section STRING, item STRING, price DOUBLE, high DOUBLE, low DOUBLE, capture_ts STRING, page STRING"
)
POSTS = (
    "id STRING, created_utc BIGINT, title STRING, score INT, num_comments INT, link_flair_text STRING, domain STRING"
)
COVERAGE = "scanned BIGINT, kept BIGINT"
FACT_UNITS = (
    "MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<"
    "start: DATE, end: DATE, val: DOUBLE, form: STRING, filed: DATE, accn: STRING>>>>>"
)
XML_CONTEXT = (
    "_id STRING,"
    "`xbrli:entity` STRUCT<`xbrli:segment`: STRUCT<`xbrldi:explicitMember`: ARRAY<STRUCT<_VALUE: STRING, _dimension: STRING>>>>,"
    "`xbrli:period` STRUCT<`xbrli:startDate`: DATE, `xbrli:endDate`: DATE>"
)
XML_FACT = "_VALUE DOUBLE, _contextRef STRING"
CUBE = (
    "id ARRAY<STRING>,"
    "dimension MAP<STRING, STRUCT<category: STRUCT<index: MAP<STRING, INT>>>>,"
    "value MAP<STRING, DOUBLE>"
)
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
YEAR_SHEET = "row BIGINT, label STRING, " + ", ".join(f"{m} DOUBLE" for m in MONTHS)
