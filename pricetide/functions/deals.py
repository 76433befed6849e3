"""Deal titles to columns: category, reject reason, price and specification.

All rules are native column expressions. A title goes through as one row; matches with
their positions come from ``matches`` and later rules work on arrays of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import deal_rules as R

_OPEN, _CLOSE = "\u0001", "\u0002"


def rx(pattern: str) -> str:
    """Case-insensitive with Unicode letters, digits and spaces, as the rules assume."""
    return "(?iuU)" + pattern


def tidy(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"(?U)\s+", " "))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<s, e, txt>>``: every match with 0-based start and end.

    Matches are marked in a copy of the text and the copy is cut at the marks; the pieces'
    lengths give the positions.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    pieces = F.transform(
        F.split(marked, _OPEN),
        lambda p: F.struct(
            F.when(F.instr(p, _CLOSE) > 0, F.substring_index(p, _CLOSE, 1)).otherwise(F.lit("")).alias("txt"),
            F.length(F.replace(p, F.lit(_CLOSE), F.lit(""))).alias("len"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,txt:string>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        hit = F.struct(
            state["at"].alias("s"), (state["at"] + F.length(piece["txt"])).alias("e"), piece["txt"].alias("txt")
        )
        return F.struct(
            (state["at"] + piece["len"]).alias("at"), F.array_append(state["out"], hit).alias("out")
        )

    walked = F.aggregate(pieces, start, step, lambda s: s["out"])
    return F.filter(walked, lambda m: m["txt"] != "")


def amount(text: Column) -> Column:
    """Number in a money match, with decimal point or decimal comma."""
    whole = F.regexp_replace(F.regexp_extract(text, R.NUMBER, 1), ",", "")
    cents = F.coalesce(
        F.nullif(F.regexp_extract(text, R.NUMBER, 2), F.lit("")), F.nullif(F.regexp_extract(text, R.NUMBER, 3), F.lit(""))
    )
    return F.when(cents.isNull(), whole).otherwise(F.concat(whole, F.lit("."), cents)).try_cast("double")


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern)), index)


def _rows(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """All matches as structs of the named groups (unmatched group: empty string)."""
    return F.arrays_zip(*[_group(text, pattern, g).alias(n) for n, g in groups.items()])


# --- category -----------------------------------------------------------------

def categorize(df: DataFrame, title: str, flair: str) -> DataFrame:
    """Add ``category`` (null = not a part), ``body`` (title without its tag) and ``multi_tag``."""
    text = F.col(title)
    tag = F.regexp_extract(text, R.TAG, 1)
    tagged = text.rlike(R.TAG)
    rest = F.regexp_replace(text, R.TAG, "")
    hits = [F.when(tag.rlike(rx(words)), F.lit(name)) for name, words in R.CATEGORY_WORDS.items()]
    named = F.array_compact(F.array(*hits))
    off_topic = tag.rlike(rx(R.ACCESSORY_TAG)) | tag.rlike(rx(R.META_TAG))
    other = tag.rlike(rx(R.OTHER_TAG))
    by_flair = F.create_map(*[F.lit(x) for pair in R.FLAIRS.items() for x in pair])[
        F.lower(F.trim(F.coalesce(F.col(flair), F.lit(""))))
    ]
    kind = (
        F.when(tagged & off_topic, F.lit("none")).when(tagged & (F.size(named) > 0), F.lit("tag"))
        .when(tagged & other, F.lit("none")).otherwise(F.lit("flair"))
    )
    several = (F.size(named) > 1) | tag.rlike(R.JOINED_TAG) | other
    return (
        df.withColumn("__kind", kind)
        .withColumn("category", F.when(F.col("__kind") == "tag", F.get(named, F.lit(0))).when(F.col("__kind") == "flair", by_flair))
        .withColumn("body", F.when(F.col("__kind") == "flair", text).otherwise(rest))
        .withColumn("multi_tag", (F.col("__kind") == "tag") & several)
        .drop("__kind")
    )


def domain_non_us(domain: Column) -> Column:
    d = F.lower(F.coalesce(domain, F.lit("")))
    bad = d.isin(*R.NON_US_SITES)
    for ending in R.NON_US_ENDINGS:
        bad = bad | d.endswith(ending)
    return bad


def non_usd(title: Column, domain: Column, flair: Column) -> Column:
    return title.rlike(rx(R.NON_USD)) | domain_non_us(domain) | F.coalesce(flair, F.lit("")).rlike(rx(R.NON_US_FLAIR))


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """First rule that holds names the reason; null when none does."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for reason, condition in rules])


def title_rejects(title: Column, body: Column, category: Column, multi: Column, domain: Column, flair: Column) -> Column:
    bundled = F.lit(False)
    for name, words in R.BUNDLE_WORDS.items():
        bundled = F.when(category == name, body.rlike(rx(words))).otherwise(bundled)
    return reject_reason([
        ("bundle", multi),
        ("not_a_deal", body.rlike(rx(R.NOT_DEAL))),
        ("non_usd", non_usd(title, domain, flair)),
        ("marketplace_or_suspect", body.rlike(rx(R.SUSPECT)) | F.coalesce(domain, F.lit("")).contains("ebay.")),
        ("not_dram", (category == "RAM") & body.rlike(rx(R.NOT_DRAM))),
        ("open_box", body.rlike(rx(R.OPEN_BOX))),
        ("used_refurb", body.rlike(rx(R.USED))),
        ("range_or_multi", body.rlike(rx(R.RANGE))),
        ("multi_pack", body.rlike(rx(R.PACK))),
        ("bundle", body.rlike(rx(R.COMBO)) | bundled),
        ("conditional_price", body.rlike(rx(R.CONDITIONAL))),
        ("prebuilt_or_laptop", category.isin("CPU", "GPU") & body.rlike(rx(R.PREBUILT))),
    ])


# --- price --------------------------------------------------------------------

def extract_price(df: DataFrame, body: str) -> DataFrame:
    """Add ``price`` and ``price_reason`` (``no_price``, ``ambiguous_price`` or null).

    The last ``= $X`` wins. Otherwise every amount is described by what stands around it:
    *cut* amounts are subtracted from the one before ("$A - $B"), *dashed* ones are a
    promotion after an offer ("after -$10"), *flagged* ones are discounts or old prices. An
    offer is an amount that is none of these; offers outside brackets go before those inside.
    """
    text = F.col(body)
    equals = matches(text, "(?U)" + R.EQUALS)
    prefixed = matches(text, rx(R.MONEY))
    suffixed = F.filter(
        matches(text, rx(R.MONEY_AFTER)),
        lambda m: ~F.exists(F.col("__prefixed"), lambda p: (p["s"] <= m["s"]) & (m["s"] < p["e"])),
    )
    bare = matches(text, rx(R.BARE_AMOUNT))
    staged = df.withColumn("__prefixed", prefixed).withColumn("__signed", F.concat("__prefixed", suffixed))
    staged = staged.withColumn(
        "__tokens", F.array_sort(F.when(F.size("__signed") > 0, F.col("__signed")).otherwise(bare))
    )
    staged = staged.withColumn("__facts", F.transform("__tokens", lambda m, i: _describe(text, m, i)))
    # An amount is dashed only after an earlier offer.
    staged = staged.withColumn("__facts", F.transform("__facts", lambda f, i: F.struct(
        f["v"].alias("v"), f["inside"].alias("inside"), f["cut"].alias("cut"), f["flag"].alias("flag"),
        f["opens"].alias("opens"),
        (~f["cut"] & f["dash"] & F.exists(F.slice("__facts", 1, i), _plain)).alias("dashed"),
        (_plain(f) & ~(f["dash"] & F.exists(F.slice("__facts", 1, i), _plain))).alias("offer"),
    )))
    outside = F.array_distinct(F.transform(F.filter("__facts", lambda f: f["offer"] & ~f["inside"]), lambda f: f["v"]))
    bracketed = F.array_distinct(F.transform(F.filter("__facts", lambda f: f["offer"] & f["inside"]), lambda f: f["v"]))
    staged = staged.withColumn("__offers", F.when(F.size(outside) > 0, outside).otherwise(bracketed))
    staged = staged.withColumn("__chains", _chains(F.col("__facts")))
    only = F.get("__offers", F.lit(0))
    result = F.get(F.filter("__chains", lambda c: c["head"] == only), F.lit(0))["total"]
    agreed = F.filter("__offers", lambda v: F.exists("__chains", lambda c: F.abs(v - c["total"]) < 0.02))
    price = (
        F.when(F.size(equals) > 0, amount(F.try_element_at(equals, F.lit(-1))["txt"]))
        .when((F.size("__offers") == 1) & result.isNull(), only)
        .when(F.size("__offers") == 1, F.when(result > 0.3 * only, result))
        .when(F.size(agreed) == 1, F.get(agreed, F.lit(0)))
    )
    reason = F.when(F.col("price").isNotNull(), F.lit(None).cast("string")).when(
        F.size("__offers") > 0, "ambiguous_price"
    ).otherwise("no_price")
    return staged.withColumn("price", price).withColumn("price_reason", reason).drop(
        "__prefixed", "__signed", "__tokens", "__facts", "__offers", "__chains"
    )


def _plain(f: Column) -> Column:
    return ~f["cut"] & ~f["flag"]


def _describe(text: Column, m: Column, i: Column) -> Column:
    before = F.substring(text, F.greatest(m["s"] - 24, F.lit(1)), F.least(m["s"], F.lit(25)))
    after = F.substring(text, m["e"] + 1, F.lit(25))
    previous_end = F.when(i > 0, F.get("__tokens", i - 1)["e"])
    gap = F.substring(text, previous_end + 1, m["s"] - previous_end)
    depth = F.aggregate(
        F.split(F.substring(text, F.lit(1), m["s"]), ""), F.lit(0),
        lambda d, ch: F.when(ch.isin("(", "[", "{"), d + 1).when(ch.isin(")", "]", "}"), F.greatest(d - 1, F.lit(0))).otherwise(d),
    )
    flagged = after.rlike(rx(R.DISCOUNT_AFTER)) | before.rlike(rx(R.DISCOUNT_BEFORE))
    return F.struct(
        amount(m["txt"]).alias("v"),
        (depth > 0).alias("inside"),
        F.coalesce(gap.rlike(r"(?U)^\s*[-–]\s*$"), F.lit(False)).alias("cut"),
        before.rlike("[-–]$").alias("dash"),
        (flagged | after.rlike(r"(?U)^\s*%")).alias("flag"),
        (~flagged).alias("opens"),
    )


def _chains(facts: Column) -> Column:
    """``array<struct<head, total>>``: an amount and what is left after the amounts cut from it.

    A chain opens at an amount that is neither cut nor dashed and runs up to the next one.
    """
    opener = F.transform(facts, lambda f, i: F.when(~f["cut"] & ~f["dashed"], i))
    owner = F.transform(facts, lambda f, i: F.array_max(F.slice(opener, 1, i + 1)))
    rows = F.arrays_zip(facts.alias("f"), owner.alias("o"))

    def total(f: Column, i: Column) -> Column:
        cuts = F.filter(rows, lambda r: (r["o"] == i) & r["f"]["cut"])
        left = F.aggregate(cuts, f["v"], lambda acc, r: acc - r["f"]["v"])
        usable = ~f["cut"] & ~f["dashed"] & f["opens"] & (F.size(cuts) > 0)
        return F.when(usable, F.struct(f["v"].alias("head"), F.bround(left, 2).alias("total")))

    return F.array_compact(F.transform(facts, total))


# --- specifications -----------------------------------------------------------

def _one(values: Column) -> Column:
    """The only distinct element, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def memory_spec(df: DataFrame, title: str, ts: str) -> DataFrame:
    """Add ``spec_reject, capacity_gb, kit, ddr, ddr_inferred, speed_mts, cas, form`` for memory."""
    t = F.col(title)

    def kits(pattern: str, count: int, size: int) -> Column:
        pairs = F.transform(
            _rows(t, pattern, {"n": count, "s": size}),
            lambda m: F.struct(m["n"].try_cast("int").alias("n"), m["s"].try_cast("int").alias("s")),
        )
        good = F.filter(pairs, lambda p: p["s"].isin(*R.MODULE_SIZES) & p["n"].isin(*R.KIT_COUNTS))
        return F.array_distinct(good)

    count_first, size_first = kits(R.KIT_COUNT_FIRST, 1, 2), kits(R.KIT_SIZE_FIRST, 2, 1)
    stated = F.array_distinct(F.transform(
        _rows(t, R.STATED_SIZE, {"n": 1, "u": 2}),
        lambda m: F.floor(m["n"].try_cast("double") * F.when(F.lower(m["u"]) == "tb", 1024).otherwise(1)).cast("int"),
    ))
    out = (
        df.withColumn("__kits", F.when(F.size(count_first) > 0, count_first).otherwise(size_first))
        .withColumn("__stated", stated)
        .withColumn("__lone", F.filter("__stated", lambda v: v.isin(*R.LONE_SIZES)))
    )
    kit = F.get("__kits", F.lit(0))
    total = kit["n"] * kit["s"]
    has_kit = F.size("__kits") > 0
    extra = F.size(F.filter("__stated", lambda v: ~((v == total) | (v == kit["s"])))) > 0
    gens = F.array_distinct(F.transform(
        _rows(t, R.DDR, {"a": 1, "b": 2}), lambda m: F.coalesce(F.nullif(m["a"], F.lit("")), m["b"])
    ))
    speed = F.lit(None).cast("int")
    bare = F.array_distinct(F.filter(
        F.transform(_group(t, r"\b(\d{4})\b"), lambda v: v.try_cast("int")), lambda v: v.isin(*R.KNOWN_SPEEDS)
    ))
    stages = [
        F.array_max(F.filter(F.transform(_group(t, p), lambda v: v.try_cast("int")), lambda v: v.between(*R.SPEED_RANGE)))
        for p in R.SPEEDS
    ]
    speed = F.coalesce(*stages, _one(bare))
    cas = F.array_distinct(F.filter(
        F.transform(_group(t, R.CAS), lambda v: v.try_cast("int")), lambda v: v.between(*R.CAS_RANGE)
    ))
    out = out.withColumn("__gens", gens).withColumn("speed_mts", speed)
    early = F.col(ts).cast("date") < F.lit(R.DDR5_LAUNCH).cast("date")
    guessed = (
        F.when(early | (F.col("speed_mts") <= R.DDR4_TOP_SPEED), "DDR4")
        .when(F.col("speed_mts") >= R.DDR5_LOW_SPEED, "DDR5")
    )
    explicit = F.when(F.size("__gens") > 0, F.concat(F.lit("DDR"), F.get("__gens", F.lit(0))))
    timed = t.rlike(rx(R.TIMING))
    reject = reject_reason([
        ("lpddr_camm", t.rlike(rx(R.LOW_POWER))),
        ("multi_capacity", F.size("__kits") > 1),
        ("multi_capacity", has_kit & extra),
        ("multi_capacity", ~has_kit & (F.size("__lone") > 1)),
        ("no_capacity", ~has_kit & (F.size("__lone") == 0)),
        ("multi_ddr", F.size("__gens") > 1),
    ])
    return out.withColumns({
        "spec_reject": reject,
        "capacity_gb": F.when(has_kit, total).otherwise(F.get("__lone", F.lit(0))).cast("double"),
        "kit": F.when(has_kit, F.concat(kit["n"].cast("string"), F.lit("x"), kit["s"].cast("string"), F.lit("GB"))),
        "ddr": F.coalesce(explicit, guessed),
        "ddr_inferred": explicit.isNull() & guessed.isNotNull(),
        "cas": F.when(timed, F.regexp_extract(t, rx(R.TIMING), 1).try_cast("int")).otherwise(_one(cas)),
        "form": F.when(t.rlike(rx(R.SERVER)), "server").when(t.rlike(rx(R.SODIMM)), "sodimm").otherwise("dimm"),
    }).drop("__kits", "__stated", "__lone", "__gens")


def storage_spec(df: DataFrame, title: str, flair: str) -> DataFrame:
    """Add ``spec_reject, capacity_gb, interface, pcie_gen, enterprise`` for drives."""
    t = F.col(title)
    sizes = F.filter(
        F.transform(
            _rows(t, R.CAPACITY, {"n": 1, "u": 2}),
            lambda m: m["n"].try_cast("double") * F.when(F.lower(m["u"]) == "gb", 1.0).otherwise(1000.0),
        ),
        lambda gb: gb.between(*R.CAPACITY_RANGE),
    )
    # 1TB, 1000GB and 1024GB name one drive: a size within 10 % of a kept smaller one is dropped.
    kept = F.aggregate(
        F.array_sort(F.array_distinct(sizes)), F.array().cast("array<double>"),
        lambda acc, c: F.when(F.exists(acc, lambda x: F.abs(c - x) / x < 0.1), acc).otherwise(F.array_append(acc, c)),
    )
    gens = F.array_distinct(F.transform(_group(t, R.PCIE_GENERATION), lambda v: v.try_cast("int")))
    nvme = t.rlike(rx(R.NVME_WORDS)) | t.rlike(rx(R.NVME_MODELS))
    sata = (
        t.rlike(rx(R.SATA_WORDS)) | t.rlike(rx(R.SATA_MODELS))
        | F.lower(F.coalesce(F.col(flair), F.lit(""))).contains("sata")
    )
    out = df.withColumn("__sizes", kept)
    reject = reject_reason([
        ("external_or_not_ssd", t.rlike(rx(R.EXTERNAL))),
        ("multi_capacity", t.rlike(rx(R.CAPACITY_PAIR))),
        ("multi_capacity", F.size("__sizes") > 1),
        ("no_capacity", F.size("__sizes") == 0),
    ])
    return out.withColumns({
        "spec_reject": reject,
        "capacity_gb": _one(F.col("__sizes")),
        "interface": F.when(nvme & ~sata, "NVMe").when(sata & ~nvme, "SATA"),
        "pcie_gen": _one(gens),
        "enterprise": t.rlike(rx(R.ENTERPRISE)),
    }).drop("__sizes")


def _cpu_models(t: Column) -> Column:
    threadripper = t.rlike(rx("threadripper"))
    amd = F.transform(
        F.filter(
            F.transform(
                _rows(t, R.AMD_CPU, {"a": 1, "b": 2, "c": 3, "d": 4}),
                lambda m: F.struct(
                    F.concat(m["a"], m["c"]).alias("num"), F.upper(F.concat(m["b"], m["d"])).alias("suf")
                ),
            ),
            lambda m: m["num"].try_cast("int").between(1000, 9999),
        ),
        lambda m: F.concat(
            F.when(threadripper | (m["suf"] == "WX"), "Threadripper").otherwise("Ryzen"), F.lit(" "), m["num"], m["suf"]
        ),
    )
    core = F.transform(
        _rows(t, R.INTEL_CORE, {"n": 2, "s": 3}), lambda m: F.concat(F.lit("Core "), m["n"], F.upper(m["s"]))
    )
    bare = F.transform(
        _rows(t, R.INTEL_BARE, {"n": 1, "s": 2}), lambda m: F.concat(F.lit("Core "), m["n"], F.upper(m["s"]))
    )

    def ultra(pattern: str) -> Column:
        return F.transform(
            _rows(t, pattern, {"n": 1, "s": 2, "p": 3}),
            lambda m: F.concat(
                F.lit("Core Ultra "), m["n"], F.upper(m["s"]), F.when(m["p"] != "", " Plus").otherwise("")
            ),
        )

    marked = F.concat(amd, core, ultra(R.ULTRA))
    full = F.when((F.size(amd) == 0) | t.rlike(rx(R.INTEL_MARKS)), marked).otherwise(amd)
    return F.array_distinct(F.when(F.size(full) > 0, full).otherwise(F.concat(bare, ultra(R.ULTRA_BARE))))


def _gpu_models(t: Column) -> Column:
    nvidia = F.transform(
        F.filter(_rows(t, R.NVIDIA, {"n": 2, "ti": 3, "su": 4}), lambda m: m["n"].isin(*R.NVIDIA_NUMBERS)),
        lambda m: F.concat(
            F.when(m["n"] == "1030", "GT").when(F.substring(m["n"], 1, 2).isin("10", "16"), "GTX").otherwise("RTX"),
            F.lit(" "), m["n"], F.when(m["ti"] != "", " Ti").otherwise(""), F.when(m["su"] != "", " Super").otherwise(""),
        ),
    )
    radeon_word = t.rlike(rx("radeon"))
    radeon = F.transform(
        F.filter(
            _rows(t, R.RADEON, {"p": 1, "n": 2, "s": 3}),
            lambda m: m["n"].isin(*R.RADEON_NUMBERS)
            | (m["n"].isin(*R.OLD_RADEON_NUMBERS) & ((m["p"] != "") | radeon_word)),
        ),
        lambda m: F.concat(F.lit("RX "), m["n"], F.when(m["s"] != "", F.concat(F.lit(" "), F.upper(m["s"]))).otherwise("")),
    )
    arc = F.when(
        t.rlike(rx(R.ARC_MARKS)), F.transform(_group(t, R.ARC), lambda n: F.concat(F.lit("Arc "), F.upper(n)))
    ).otherwise(F.array().cast("array<string>"))
    vega = F.transform(
        _group(t, R.VEGA), lambda n: F.when(n != "", F.concat(F.lit("RX Vega "), n)).otherwise("Radeon VII")
    )
    return F.array_distinct(F.concat(nvidia, radeon, arc, vega))


def chip_model(df: DataFrame, title: str, kind: str) -> DataFrame:
    """Add ``spec_reject`` and ``model`` for ``kind`` CPU or GPU."""
    t = F.col(title)
    out = df.withColumn("__models", _cpu_models(t) if kind == "CPU" else _gpu_models(t))
    model = _one(F.col("__models"))
    rules = [("multi_model", F.size("__models") > 1), ("no_model", F.size("__models") == 0)]
    if kind == "GPU":
        out = out.withColumn("__vram", F.array_distinct(F.filter(
            F.transform(_group(t, R.VRAM), lambda v: v.try_cast("int")), lambda v: v.isin(*R.VRAM_SIZES)
        )))
        split = model.isin(*R.VRAM_DECIDES)
        rules += [
            ("vram_unspecified", split & (F.size("__vram") == 0)), ("multi_model", split & (F.size("__vram") > 1)),
        ]
        model = F.when(split, F.concat(model, F.lit(" "), _one(F.col("__vram")).cast("string"), F.lit("GB"))).otherwise(model)
    return out.withColumn("spec_reject", reject_reason(rules)).withColumn("model", model).drop("__models", "__vram")
