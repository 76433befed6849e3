"""Joins on time, intervals, patterns and keys.

No operator here pairs up all rows of a group: nearest and next matches come from ordered
carries or ``min_by``, intervals are matched through the calendar years they touch, and
patterns are tested once per distinct name; passages meet texts on runs of words or characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_text
from .segments import carry, equi_depth, neighbours


def first_per(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``, which must be total within a key.

    A ``min_by``/``max_by`` combines before the shuffle, unlike a ranking window.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "__row.*").select(*df.columns)


def join_earliest(df: DataFrame, reference: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Inner join to the earliest reference row of each key."""
    return df.join(first_per(reference, [key], order), key)


def join_curve(df: DataFrame, curve: DataFrame, on: list[str]) -> DataFrame:
    return df.join(curve, on, "left")


def interval_label(
    periods: DataFrame, years: DataFrame, entity: str, start: str = "start", end: str = "end",
    slack: int = 8,
) -> DataFrame:
    """Fiscal year and quarter of each period: the first fiscal year that contains it.

    ``years`` has ``(entity, fy_start, fy_end)``. A fiscal year lasts about a year, so it is
    filed under the calendar years it touches and each distinct period looks it up by
    (entity, calendar year of its start).
    """
    touched = F.explode(F.sequence(F.year("fy_start"), F.year(F.date_add("fy_end", slack))))
    calendar = years.select(F.col(entity).alias("__e"), "fy_start", "fy_end", touched.alias("__y"))
    asked = periods.select(entity, start, end).distinct()
    match = (
        (asked[entity] == calendar["__e"])
        & (F.year(asked[start]) == calendar["__y"])
        & (calendar["fy_start"] <= asked[start])
        & (asked[end] <= F.date_add(calendar["fy_end"], slack))
    )
    hit = F.min_by(F.struct("fy_start", "fy_end"), "fy_start").alias("__fy")
    first = asked.join(calendar, match).groupBy(entity, start, end).agg(hit)
    quarter = F.bround((F.datediff(end, F.col("__fy.fy_start")) + 1) / F.lit(91.3)).cast("int")
    labels = first.select(
        entity, start, end, F.year("__fy.fy_end").alias("fiscal_year"),
        F.greatest(F.lit(1), F.least(F.lit(4), quarter)).alias("fiscal_quarter"),
    )
    return periods.join(labels, [entity, start, end], "left").select(*periods.columns, "fiscal_year", "fiscal_quarter")


def nearest_sample(df: DataFrame, keys: list[str], ts: str, targets: list[int], tie: str | None = None) -> DataFrame:
    """Per key and target day of month, the row nearest the target (earliest of ties), once each."""
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    rest = [c for c in df.columns if c not in keys]
    day = F.dayofmonth(ts)
    picks = df.groupBy(*keys).agg(
        *[F.min_by(F.struct(*rest), F.struct(F.abs(day - t), *order)).alias(f"__t{t}") for t in targets]
    )
    chosen = F.explode(F.array_distinct(F.array(*[F.col(f"__t{t}") for t in targets])))
    return picks.select(*keys, chosen.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def month_targets(per_month: int) -> list[int]:
    """Evenly spaced target days: 1, 16 for two a month; 1, 9, 16, 23 for four."""
    return [1 + round(i * 30 / per_month) for i in range(per_month)]


def plain_part(pattern: Column) -> Column:
    """The longest run of characters that every match of a pattern holds; empty where the pattern names none.

    Groups, classes, escapes and what a quantifier makes optional count as unknown; so does all of a pattern with alternatives
    outside of groups.
    """
    cut = F.regexp_replace(pattern, r"\\.", "\u0001")
    cut = F.regexp_replace(cut, r"\[\^?\]?[^\]]*\](?:[*?+]|\{[^}]*\})?", "\u0001")
    for _ in range(4):  # groups from the inside out
        cut = F.regexp_replace(cut, r"\([^()]*\)(?:[*?+]|\{[^}]*\})*", "\u0001")
    nested, either = F.contains(cut, F.lit("(")), F.contains(cut, F.lit("|"))
    cut = F.regexp_replace(cut, r"(?s).(?:[*?]|\{[^}]*\})[?+]?", "\u0001")
    runs = F.split(F.regexp_replace(cut, r"[.^$+*?{}()|]", "\u0001"), "\u0001+")
    longest = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))), -1)["r"]
    return F.when(nested | either, F.lit("")).otherwise(longest)


def pattern_join(df: DataFrame, patterns: DataFrame | dict[str, str], name: str, label: str = "label") -> DataFrame:
    """Rows labelled by each pattern their name matches; a pattern that matches several names is an error.

    Names are reduced to distinct values before any pattern is tested. A name that several patterns match gives a row for
    each. ``patterns`` is a table of ``(label, pattern)``, which meets names on the plain part of each pattern, or a handful
    of rules as a dict, each of which is tested on every name. A pattern of the table without a plain part is an error.
    """
    distinct = df.select(name).where(F.col(name).isNotNull()).distinct()
    if isinstance(patterns, dict):
        hits = F.array_compact(F.array(*[F.when(F.col(name).rlike(rx), F.lit(key)) for key, rx in patterns.items()]))
        labelled = distinct.select(name, F.explode(hits).alias(label))
    else:
        # Inlined from an array, as a filter on the plain part would else be pushed to the rows that the patterns are made of.
        plain = F.inline(F.array(F.struct(normalize_text(plain_part(F.col("pattern"))).alias("__q"))))
        complaint = F.concat(F.lit("no plain part in pattern "), F.col("pattern"))
        checked = F.when(F.col("__q") != "", F.col("__q")).otherwise(F.raise_error(complaint).cast("string"))
        rules = patterns.select(label, "pattern", plain).select(label, "pattern", checked.alias("__plain"))
        met = contained_passages(distinct.withColumn("__name", F.col(name)), name, "__name", rules.select("__plain", F.col("__plain").alias("__q")).distinct(), "__plain", "__q")
        labelled = met.join(rules, "__plain").where(F.rlike(F.col(name), F.col("pattern"))).select(name, label)
    names = labelled.groupBy(label).agg(F.count("*").alias("__n"), F.min(name).alias("__one"), F.max(name).alias("__other"))
    complaint = F.concat(F.col(label), F.lit(" matches several names: "), F.col("__one"), F.lit(", "), F.col("__other"))
    single = F.when(F.col("__n") == 1, F.col("__one")).otherwise(F.raise_error(complaint).cast("string"))
    return df.join(names.select(single.alias(name), label), name)


def first_event_after(
    periods: DataFrame, events: DataFrame, key: str, period_end: str, event_day: str,
    lo_days: int = 1, hi_days: int = 100,
) -> DataFrame:
    """Date of the first event ``lo_days`` to ``hi_days`` after each period's end, or null.

    Events move back by ``lo_days`` and join the same time line as the periods; each period
    then takes the next event on it.
    """
    moved = events.select(key, F.date_sub(event_day, lo_days).alias("__t"), F.col(event_day).alias("__event"))
    line = periods.withColumns({"__t": F.col(period_end).cast("date"), "__event": F.lit(None).cast("date")})
    line = line.unionByName(moved.withColumn("__moved", F.lit(True)), allowMissingColumns=True)
    # Same day: the event must come at or after the period on the line, so order by (day, event last).
    place = F.unix_date("__t") * 2 + F.when(F.col("__moved"), 1).otherwise(0)
    line = equi_depth(line.withColumn("__at", place), [key], "__at")
    known = carry(line, [key], "__at", F.col("__segment"), {"first_event": "__event"}, backward=True)
    late = F.datediff("first_event", F.col(period_end).cast("date")) > hi_days
    return known.where(F.col("__moved").isNull()).select(
        *periods.columns, F.when(~late, F.col("first_event")).alias("first_event")
    )


def reconcile(
    a: DataFrame, b: DataFrame, keys: list[str], a_value: str, b_value: str, tolerance: Column | float,
    missing: str = "missing", bad: Column | str = "mismatch",
) -> DataFrame:
    """``ok``, ``mismatch`` or ``missing`` per row of ``a`` against the value of ``b``."""
    limit = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    other = bad if isinstance(bad, Column) else F.lit(bad)
    verdict = (
        F.when(F.col(b_value).isNull(), missing)
        .when(F.abs(F.col(b_value) - F.col(a_value)) <= limit, "ok")
        .otherwise(other)
    )
    return a.join(b, keys, "left").withColumn("match", verdict)


def label(df: DataFrame, lookup: DataFrame, code: str, name: str = "label", default: Column | None = None) -> DataFrame:
    """Left join to a code list; codes without a label keep themselves."""
    return df.join(lookup, code, "left").withColumn(
        name, F.coalesce(F.col(name), default if default is not None else F.col(code).cast("string"))
    )


def interpolate_at(
    series: DataFrame, dates: DataFrame, key: str, day: str, value: str, at: str
) -> DataFrame:
    """Linear value at each date between the observations before and after it.

    Outside the observed span the nearest observation holds, as ``numpy.interp`` does.
    """
    seen = F.struct(F.col(day).cast("date").alias("d"), F.col(value).cast("double").alias("v"))
    line = series.where(F.col(value).isNotNull()).select(key, F.col(day).cast("date").alias("__t"), seen.alias("__obs"))
    asked = dates.withColumn("__t", F.col(at).cast("date")).withColumn("__ask", F.lit(True))
    line = line.unionByName(asked, allowMissingColumns=True)
    span = F.col("__segment")
    # An observation on the very day lies before the question going forward and after it going back.
    line = line.withColumn("__at", F.unix_date("__t") * 2 + F.when(F.col("__ask"), 1).otherwise(0))
    line = equi_depth(line, [key], "__at")
    line = carry(line, [key], "__at", span, {"__prev": "__obs"})
    line = carry(line, [key], "__at", span, {"__next": "__obs"}, backward=True)
    prev, nxt = F.col("__prev"), F.col("__next")
    part = F.datediff("__t", prev["d"]) / F.datediff(nxt["d"], prev["d"])
    blended = F.when(nxt.isNull(), prev["v"]).when(prev.isNull(), nxt["v"]).when(
        prev["d"] == F.col("__t"), prev["v"]
    ).otherwise(prev["v"] + (nxt["v"] - prev["v"]) * part)
    return line.where("__ask").withColumn("interpolated", blended).select(*dates.columns, "interpolated")


def first_reported(obs: DataFrame, keys: list[str], period: str, reported_in: str, value: str) -> DataFrame:
    """Value as first reported, number of reports and the largest later difference.

    Reports older than the period do not count. Differences to the first value follow from
    the smallest and largest report, so no report is joined to another.
    """
    used = obs.where(F.col(reported_in) >= F.col(period))
    rolled = used.groupBy(*keys, period).agg(
        F.min_by(F.struct(F.col(reported_in).alias("r"), F.col(value).alias("v")), reported_in).alias("__first"),
        F.count(F.lit(1)).alias("n_reports"), F.min(value).alias("__min"), F.max(value).alias("__max"),
    )
    first = F.col("__first.v")
    return rolled.select(
        *keys, period, first.alias("value"), F.col("__first.r").alias("reported_in"),
        (F.col("__first.r") == F.col(period)).alias("as_first_reported"), "n_reports",
        F.greatest(F.col("__max") - first, first - F.col("__min")).alias("max_abs_diff"),
    )


def align_cycles(series: DataFrame, cycles: DataFrame, tail_months: int = 30) -> DataFrame:
    """Series rows from each cycle's trough to the next one, as months since and times the trough.

    ``series`` is one row per series and month, so a series is as long as the calendar.
    """
    until = F.coalesce("trough1", F.add_months("peak", tail_months))
    spans = cycles.select("series", "trough0", "peak", "p_trough0", until.alias("__end"))
    months = (F.year("month") - F.year("trough0")) * 12 + F.month("month") - F.month("trough0")
    return (
        series.join(spans, "series").where(F.col("month").between(F.col("trough0"), F.col("__end")))
        .select("series", "trough0", "peak", "month", months.alias("months_since"), (F.col("value") / F.col("p_trough0")).alias("ratio"))
    )


def quote_check(quotes: DataFrame, pages: DataFrame, key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """Whether every fragment of a quote (cut at dots of omission) occurs in its page's text.

    Null when the quote is empty or the page is missing.
    """
    fragments = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), normalize_text), lambda f: f != "")
    joined = quotes.join(pages.select(key, normalize_text(text).alias("__text")), key, "left")
    inside = F.forall("__fragments", lambda f: F.contains(F.col("__text"), f))
    return joined.withColumn("__fragments", fragments).withColumn(
        "quote_found", F.when((F.size("__fragments") > 0) & F.col("__text").isNotNull(), inside)
    ).drop("__fragments", "__text")


def contained_passages(
    texts: DataFrame, text_id: str, text: str, passages: DataFrame, passage_id: str, passage: str, words: int = 4, grams: int = 3
) -> DataFrame:
    """``(text_id, passage_id)`` for every passage found whole inside a text, without a shared key.

    A text that holds a passage holds the passage's inner words as whole words, so the two meet on a run of ``words``
    inner words, or of all inner words if there are fewer. A passage of one or two words has no inner word and may stand within
    words: it meets texts on its runs of ``grams`` characters (of all its characters if it is shorter; an empty one is in every text
    that is not null). Texts post the kinds of runs that some passage asks for; a passage's anchor is its run that the fewest texts
    hold, and only texts that hold the anchor are compared in full. One lazy plan: both uses of the posts share one shuffle, and a
    text is cut into runs once.
    """
    t = texts.select(text_id, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    p = passages.select(passage_id, F.inline(F.array(F.struct(normalize_text(passage).alias("__p"))))).where(F.col("__p").isNotNull())
    n_words = F.size(F.split("__p", " "))
    kind = F.when(n_words >= 3, F.least(n_words - 2, F.lit(words))).otherwise(-F.least(F.length("__p"), F.lit(grams)))
    inner = F.when(n_words >= 3, F.array_join(F.slice(F.split("__p", " "), F.lit(2), n_words - 2), " ")).otherwise(F.col("__p"))
    distinct = p.select("__p").distinct().select("__p", kind.alias("__kind"), inner.alias("__x"))
    # Kinds that no passage asks for are not posted; the sets are one value each, read as a subquery.
    kinds = distinct.agg(F.collect_set(F.when(F.col("__kind") > 0, F.col("__kind"))).alias("w"), F.collect_set(F.when(F.col("__kind") <= 0, F.col("__kind"))).alias("c"))
    own = distinct.withColumns({"__w": F.array_compact(F.array(F.when(F.col("__kind") > 0, F.col("__kind")))), "__c": F.array_compact(F.array(F.when(F.col("__kind") <= 0, F.col("__kind"))))})
    own = _runs(own, "__x", F.col("__w"), F.col("__c"), ["__p"], words, grams).distinct()
    posts = t.select(F.col(text_id).alias("__id"), normalize_text("__text").alias("__t"))
    posts = _runs(posts, "__t", kinds.select("w").scalar(), kinds.select("c").scalar(), ["__id"], words, grams)
    # The shuffle of distinct posts is the one that both the counts and the pairs read.
    met = posts.join(own.select("__a").distinct(), "__a", "left_semi").select("__a", "__id").distinct()
    counts = met.groupBy("__a").agg(F.count(F.lit(1)).alias("__n"))
    rarest = F.min_by("__a", F.struct(F.coalesce("__n", F.lit(0)), "__a")).alias("__a")
    anchor = own.join(counts, "__a", "left").groupBy("__p").agg(rarest)
    # The text itself comes back by id, and is made plain again only where it met an anchor.
    found = met.join(anchor, "__a").select("__id", "__p").distinct()
    pairs = found.join(t, F.col("__id").eqNullSafe(F.col(text_id))).where(F.contains(normalize_text("__text"), F.col("__p")))
    return pairs.select(text_id, "__p").join(p, "__p").select(text_id, passage_id)


def _runs(df: DataFrame, text: str, word_kinds: Column, char_kinds: Column, keep: list[str], words: int, grams: int) -> DataFrame:
    """``keep`` and the hash ``__a`` of each run of n words (n in ``word_kinds``) and of each distinct run of n characters (-n in ``char_kinds``).

    Words are hashed once. Runs are then numbered and hashed one by one, in one small compiled loop with the join that follows.
    """
    def characters(n: int) -> Column:
        """Distinct runs of n characters, from one pass of a pattern that looks ahead."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))

    def hashed(pieces: str) -> Column:
        return F.transform(pieces, lambda x: F.xxhash64(x)).alias(pieces)

    none = F.expr("CAST(array() AS array<string>)")
    runs = [F.when(F.array_contains(char_kinds, F.lit(-n)), characters(n) if n else F.array(F.lit(""))).otherwise(none) for n in range(grams + 1)]
    split = F.when(F.size(word_kinds) > 0, F.split(text, " ")).otherwise(none)
    cut = df.select(*keep, word_kinds.alias("__kinds"), split.alias("__words"), F.concat(*runs).alias("__chars"))
    cut = cut.select(*keep, "__kinds", hashed("__words"), hashed("__chars"))
    n_kinds, n_words = F.size("__kinds"), F.size("__words")
    last = n_words * n_kinds + F.size("__chars") - 1
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("CAST(array() AS array<int>)"))
    number = F.col("__i")
    place, n = F.floor(number / n_kinds).cast("int"), F.get("__kinds", number % n_kinds)
    of_words = number < n_words * n_kinds
    hashes = F.when(of_words, F.xxhash64(F.slice("__words", place + 1, n))).otherwise(F.get("__chars", number - n_words * n_kinds))
    return cut.select("*", F.explode(numbers).alias("__i")).where(~of_words | (place + n <= n_words)).select(*keep, hashes.alias("__a"))


def repost_gap(df: DataFrame, keys: list[str], ts: str, tie: str, days: float, segment: str = "DAY") -> DataFrame:
    """``is_repost``: less than ``days`` after the previous row of the same keys, repost or not."""
    seen = neighbours(
        df, keys, [ts, tie], F.date_trunc(segment, F.col(ts)), lags={"prev_ts": (ts, 1)}
    )
    gap = F.col(ts).cast("timestamp").cast("double") - F.col("prev_ts").cast("timestamp").cast("double")
    return seen.withColumn("is_repost", F.coalesce(gap < days * 86400.0, F.lit(False)))


def drop_reposts(df: DataFrame, keys: list[str], ts: str, tie: str, days: float, segment: str = "DAY") -> DataFrame:
    return repost_gap(df, keys, ts, tie, days, segment).where(~F.col("is_repost")).drop("is_repost", "prev_ts")


def drop_stale(
    df: DataFrame, key: list[str], order: list[str], value: str, segment: Column, min_run: int = 3
) -> DataFrame:
    """Drop the repeats of a value in runs of at least ``min_run`` rows; the first row stays.

    A row lies in such a run if some window of ``min_run`` rows around it is all equal, so a
    bounded look around decides and no run is ever gathered.
    """
    reach = min_run - 1
    lags = {f"__b{k}": (value, k) for k in range(1, reach + 1)}
    leads = {f"__f{k}": (value, k) for k in range(1, reach + 1)}
    seen = neighbours(df, key, order, segment, lags, leads)
    here = F.col(value)

    def same(name: str) -> Column:
        return F.coalesce(F.col(name) == here, F.lit(False))

    in_run = F.lit(False)
    for back in range(1, reach + 1):
        window = [same(f"__b{k}") for k in range(1, back + 1)] + [same(f"__f{k}") for k in range(1, min_run - back)]
        all_same = window[0]
        for w in window[1:]:
            all_same = all_same & w
        in_run = in_run | all_same
    return seen.where(~in_run).select(*df.columns)
