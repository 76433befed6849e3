"""Filter interaction audit: what each filter removes, alone and behind the others, in every order of the filters.

The files of a table are read as a stream, in available-now micro-batches. Four filters are functions of the text alone and are
computed while it is scanned; the fifth (a smaller doc_id has the same text) needs memory. The state of a stateful operator keeps
for each text (by its SHA-256; texts themselves are not kept) the smallest doc_id seen so far and the counts of its rows. Texts share
a state key by their digest, about ``KEY_TEXTS`` of them whatever the size of the table, so that Python is called once for many.
A row with a larger id adds one to the counter of its mask with the duplicate bit. A smaller id takes the place of the
least one: the rows counted for the old one are taken back (a negative count) and added again with the duplicate bit.
Changes are summed per micro-batch into a table of part counters; a batch that is run again writes the same folder again.

Before the shuffle by text every task folds its rows: those with an id above the task's smallest for their text are certain
duplicates and skip the state, so a text that a third of all rows share sends one row per task. Labels are joined on salted ids.

Defined results: a null text is empty; a null source is the part ''; a null doc_id is no smaller and no larger id, so such rows
are never duplicates; rows that repeat an id are documents of their own, duplicates only of smaller ids; of repeated labels of one id
the largest counts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import fresh_path
from .common import prepared, written

FILTERS = "ABCDE"
TWIN = 1 << 4
LEAST_WORDS = 50
FOLDED_TEXTS = 50_000
SALTS = 8
ROUNDS = 4
KEY_TEXTS = 256

CHANGE = "part string, mask int, good int, toxic int, n long"
ENTRY = "bucket long, digest string, id long, " + CHANGE


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < LEAST_WORDS, distinct * 100 < n * 65, capitals * 100 > F.length(text) * 5, text.rlike("[#$%&*|]")]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << i).otherwise(0)
    return bits.cast("int")


def folded(buckets: int):
    """Rows of one task: one entry per text for its smallest id; all other rows as certain counts."""

    def fold(batches):
        sure: dict[tuple, int] = {}
        least: dict[str, list] = {}

        def count(held: dict, key: tuple, n: int) -> None:
            held[key] = held.get(key, 0) + n

        def flush() -> pa.RecordBatch:
            rows = [(int(d[:15], 16) % buckets, d, ident, *key, n) for d, (ident, held) in least.items() for key, n in held.items()]
            # Certain counts belong to no text (and have an id only as a null would turn ids into floats); their bucket spreads them.
            rows += [(zlib.crc32(repr(key).encode()) % buckets, None, 0, *key, n) for key, n in sure.items()]
            least.clear()
            sure.clear()
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            names = ["bucket", "digest", "id", "part", "mask", "good", "toxic", "n"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for digest, ident, part, mask, good, toxic in zip(*(batch.column(c).to_pylist() for c in ("digest", "id", "part", "mask", "good", "toxic")), strict=True):
                key = (part, mask, good, toxic)
                if ident is None:
                    count(sure, key, 1)
                    continue
                held = least.get(digest)
                if held is None:
                    least[digest] = [ident, {key: 1}]
                elif ident == held[0]:
                    count(held[1], key, 1)
                else:
                    if ident < held[0]:
                        older, least[digest] = held[1], [ident, {key: 1}]
                    else:
                        older = {key: 1}
                    for (p, m, g, t), n in older.items():
                        count(sure, (p, m | TWIN, g, t), n)
            if len(least) >= FOLDED_TEXTS or len(sure) >= FOLDED_TEXTS:
                yield flush()
        yield flush()

    return fold


def changes(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Counter changes that new rows make; the state holds the smallest id of each text and that id's counts."""
    out: dict[tuple, int] = {}

    def add(part, mask, good, toxic, n):
        out[part, mask, good, toxic] = out.get((part, mask, good, toxic), 0) + n

    texts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    before = bool(texts)
    for frame in frames:
        for digest, new, part, mask, good, toxic, n in zip(*(frame[c].tolist() for c in ("digest", "id", "part", "mask", "good", "toxic", "n")), strict=True):
            if not isinstance(digest, str):
                add(part, mask, good, toxic, n)
                continue
            ident, held = int(new), texts.get(digest)
            if held is None or ident < held[0]:
                for p, m, g, t, count in held[1] if held else []:
                    add(p, m, g, t, -count)
                    add(p, m | TWIN, g, t, count)
                held = texts[digest] = [ident, []]
            if ident == held[0]:
                same = next((x for x in held[1] if x[:4] == [part, mask, good, toxic]), None)
                if same:
                    same[4] += n
                else:
                    held[1].append([part, mask, good, toxic, n])
                add(part, mask, good, toxic, n)
            else:
                add(part, mask | TWIN, good, toxic, n)
    if texts or before:
        state.update((json.dumps(texts),))
    rows = [(*k, n) for k, n in out.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


def counters(spark: SparkSession, path: str, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """part, mask, good, toxic, n: documents per part, set of failed filters and labels, over all files of the table.

    The files are dealt into about ``rounds`` micro-batches. ``FOLDED_TEXTS`` bounds what a task holds.
    """
    prepared(spark)
    table = spark.read.parquet(path)
    files = table.inputFiles()
    # A stream takes a single file only as a pattern.
    folder, _, name = path.rstrip("/").rpartition("/")
    source = f"{folder}/{{{name}}}" if len(files) == 1 and files[0].endswith(f"/{name}") else path
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    known = written(known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("label_salt")), "audit-labels")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // rounds))).parquet(source)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stream.select(
        F.sha2(text.cast("binary"), 256).alias("digest"), F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"),
    )
    # Null ids have no label; a hash keeps them from meeting in one task.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)).cast("int")).withColumn("near", F.coalesce("id", F.xxhash64("digest")))
    joined = rows.join(known, (F.col("near") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")) & F.col("id").isNotNull(), "left").select(
        "digest", "id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    buckets = max(1, table.count() // KEY_TEXTS)
    changed = joined.mapInArrow(folded(buckets), ENTRY).groupBy("bucket").applyInPandasWithState(
        changes, CHANGE, "texts string", "append", GroupStateTimeout.NoTimeout,
    )
    sink, progress = fresh_path(spark, "audit-counters"), fresh_path(spark, "audit-progress")
    # The folder is there even if no batch runs.
    spark.createDataFrame([], CHANGE).write.parquet(f"{sink}/batch=-1")

    def summed(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream_writer(changed, progress, summed).start()
    query.awaitTermination()
    total = spark.read.schema(CHANGE).parquet(sink).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return total.where("n != 0")


def stream_writer(changed: DataFrame, progress: str, write):
    return changed.writeStream.option("checkpointLocation", progress).outputMode("append").foreachBatch(write).trigger(availableNow=True)


def orders() -> Column:
    """All (filter_order, step, bits before, own bit) as one array."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [
        F.struct(F.lit("".join(o)), F.lit(k + 1), F.lit(sum(bit[f] for f in o[:k])), F.lit(bit[o[k]])) for o in itertools.permutations(FILTERS) for k in range(len(FILTERS))
    ]
    return F.array(*rows).cast("array<struct<filter_order:string,step:int,before:int,own:int>>")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters per part and mask."""
    per_mask = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    )
    # At most 32 masks per part.
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = parts.select("part", "masks", F.explode(orders()).alias("at")).select("part", "masks", "at.*")
    before, own = F.col("before"), F.col("own")

    def total(value, when) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + F.when(when(m["mask"]), value(m)).otherwise(0).cast("long"))

    n = lambda m: m["n"]
    clear = lambda m: m.bitwiseAND(before) == 0
    fails = lambda m: m.bitwiseAND(own) != 0
    orders_of = len(list(itertools.permutations(FILTERS)))
    return each.select(
        "part", "filter_order", "step",
        total(n, lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total(n, lambda m: clear(m) & fails(m)).alias("removed"),
        total(n, lambda m: ~clear(m) & fails(m)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda m: m["good"], lambda m: clear(m) & fails(m)).alias("good_lost"),
        total(lambda m: m["toxic"], lambda m: clear(m) & fails(m)).alias("toxic_lost"),
        # A filter removes a document in the share of the orders in which it comes first of all that the document fails.
        total(lambda m: m["n"] * F.lit(orders_of) / F.bit_count(m["mask"]), fails).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Contract columns for every part, order and step."""
    return report(counters(spark, path, labels))


SQL = r"""
WITH docs AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS text, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM docs LEFT JOIN known USING (doc_id)
), filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(name, bit)
), perms AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM perms, range(1, 6) r(step)
), counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), rows AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
         CAST(coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""
