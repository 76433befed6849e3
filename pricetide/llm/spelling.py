"""Spelling variants: words that differ by a single edit, found by dense prefix-suffix tiles.

Two different words a and b are one inserted, deleted or replaced code point apart exactly if the lengths of their common
prefix p and common suffix s reach the longer length L less one. Words lie in padded code-point matrices, once aligned left and
once aligned right, and blocks of words are compared with each other column by column.

Blocks are formed so that no near pair is missed and most other pairs never meet: with cuts c1 < c2 at a third and two thirds of
L, p + s >= L - 1 leaves three kinds of near pairs: (0) p >= c2, (1) p >= c1 and s >= L - c2, (2) s >= L - c1. A word is
posted under each kind, for L its own length and one more, and posts meet by the hash of the code points that the kind fixes. A
pair counts only under the first kind that holds of it, so it is found once. Buckets of about ``BUCKET_ROWS`` posts are one
tile; one that holds more than ``BLOCK_ROWS`` (very many words that share two thirds of their letters) is cut into blocks by the
hash of the word and the block pairs are dealt over tasks; nothing is capped.

A word's form is its most frequent near word (ties: the smallest in code-point order), if that is at least ``RATIO`` times as
frequent. Along forms the count grows by ``RATIO``, so chains are short: log(largest count) steps, halved each round.

Defined results: null and empty texts have no words; a null doc_id counts as empty text in the hash; repeated rows count again;
without frequent words the result is empty; extra columns are ignored. A very long run is a word like any other: blocks are
bounded by code points too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, written

RUN = "[a-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DROP_EVERY = 199
BUCKET_ROWS, BLOCK_ROWS, BLOCK_POINTS = 192, 256, 4_000_000
PAIRS = "a string, b string, n_a long, n_b long"


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters after the planted deletions, by number of occurrences."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # A deletion only shortens a run, so shorter runs cannot become words.
    runs = F.regexp_extract_all(lowered, F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = docs.select(ident.alias("ident"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "ident", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % DROP_EVERY == 0, cut).otherwise(F.col("run"))
    return (
        each.select(word.alias("word")).where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    )


def cuts(longer):
    """The two cuts of pairs whose longer word has this length; works for numbers and for columns."""
    return (longer / 3), (2 * longer / 3)


def posts(words: DataFrame) -> DataFrame:
    """One row per word, longer length and kind, with the hash of the code points that the kind fixes."""
    longer, own = F.col("longer"), F.length("word")
    c1, c2 = (c.cast("int") for c in cuts(longer))
    prefix = lambda k: F.substring(F.col("word"), F.lit(1), k)
    suffix = lambda k: F.substring(F.col("word"), own - k + 1, k)
    keys = [F.xxhash64(prefix(c2)), F.xxhash64(prefix(c1), suffix(longer - c2)), F.xxhash64(suffix(longer - c1))]
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate(keys)])
    each = words.select("word", "n", F.explode(F.array(own, own + 1)).alias("longer"))
    return each.select("word", "n", "longer", F.explode(kinds).alias("post")).select("word", "n", "longer", "post.kind", "post.key")


def tiles(words: DataFrame) -> DataFrame:
    """longer, kind, bucket, block, blocks, words: blocks of bounded size."""
    spread = posts(words)
    sizes = spread.groupBy("longer", "kind").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets"))
    dealt = spread.join(sizes, ["longer", "kind"]).withColumn("bucket", F.pmod("key", "buckets")).drop("key", "buckets")
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_POINTS) / F.col("longer"))))
    blocks = dealt.groupBy("longer", "kind", "bucket").agg(F.count("*").alias("held")).where("held > 1")
    blocks = blocks.select("longer", "kind", "bucket", F.ceil(F.col("held") / rows).alias("blocks"))
    placed = dealt.join(blocks, ["longer", "kind", "bucket"])
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks"))).otherwise(0)
    return (
        placed.withColumn("block", block).groupBy("longer", "kind", "bucket", "block", "blocks")
        .agg(F.collect_list(F.struct("word", "n")).alias("words"))
    )


class Block:
    """Words as padded code-point matrices, aligned left and aligned right."""

    def __init__(self, words: list[str], pad: int):
        self.size = np.array([len(w) for w in words], np.int64)
        width = int(self.size.max(initial=0))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        column = np.arange(width)
        self.left = np.full((len(words), width), pad, np.uint32)
        self.left[column < self.size[:, None]] = points
        self.right = np.full((len(words), width), pad, np.uint32)
        self.right[column >= width - self.size[:, None]] = points


def shared(a: np.ndarray, b: np.ndarray, from_right: bool) -> np.ndarray:
    """Length of the common beginning (or end) of every row of a with every row of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones(out.shape, bool)
    for i in range(min(a.shape[1], b.shape[1])):
        at = -1 - i if from_right else i
        alive &= a[:, at][:, None] == b[:, at][None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(a: list[str], b: list[str], longer: int, kind: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of near words whose longer length and kind are these; of one block with itself only i < j."""
    left, right = Block(a, 0xFFFFFFFF), Block(b, 0xFFFFFFFE)
    most, least = np.maximum.outer(left.size, right.size), np.minimum.outer(left.size, right.size)
    p, s = shared(left.left, right.left, False), shared(left.right, right.right, True)
    # Equal words (only in one block with itself) share everything and are not near.
    near = (most == longer) & (most - least <= 1) & (p + s >= most - 1) & ~((p == most) & (most == least))
    c1, c2 = (int(c) for c in cuts(longer))
    holds = [p >= c2, (p >= c1) & (s >= longer - c2), s >= longer - c1]
    near &= holds[kind]
    for earlier in holds[:kind]:
        near &= ~earlier
    if same:
        near &= np.tri(len(a), k=-1, dtype=bool).T
    return np.nonzero(near)


def compared(batches):
    """Rows (longer, kind, words, others) -> near pairs; without others a block is compared with itself."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            same = row["others"] is None
            a, b = row["words"], row["words"] if same else row["others"]
            left, right = [w["word"] for w in a], [w["word"] for w in b]
            for i, j in zip(*near_pairs(left, right, row["longer"], row["kind"], same), strict=True):
                for column, value in zip(out, (left[i], right[j], a[i]["n"], b[j]["n"]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["a", "b", "n_a", "n_b"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: every pair of near words once."""
    prepared(words.sparkSession)
    held = written(tiles(words), "tiles")
    nothing = F.lit(None).cast("array<struct<word:string,n:bigint>>")
    inside = held.select("longer", "kind", "words", nothing.alias("others")).mapInArrow(compared, PAIRS)
    # Block pairs of large buckets: each earlier block travels to the later ones, which are the join keys.
    hot = held.where("blocks > 1")
    first = hot.where(F.col("block") < F.col("blocks") - 1).select(
        "longer", "kind", "bucket", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "words",
    )
    second = hot.select("longer", "kind", "bucket", "block", F.col("words").alias("others"))
    across = first.join(second, ["longer", "kind", "bucket", "block"]).select("longer", "kind", "words", "others").mapInArrow(compared, PAIRS)
    return inside.unionByName(across)


def rooted(forms: DataFrame, largest: int, ratio: int) -> DataFrame:
    """word, root of words that have a form: the end of each chain, found by doubling steps."""
    steps = max(1, int(math.log(max(largest, 1)) / math.log(ratio)) + 1)
    chain = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("end"))
        chain = written(chain.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root")), "roots")
    return chain


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word."""
    prepared(docs.sparkSession)
    words = written(counted_words(docs, least_length, least_count), "words")
    pairs = near_words(words)
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )).alias("x")
    best = pairs.select(ends).select("x.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    strong = -F.col("best.less") >= F.col("n") * ratio
    linked = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    ), "forms")
    largest = linked.agg(F.max("n")).first()[0] or 0
    roots = rooted(linked.where(F.col("form").isNotNull()), largest, ratio)
    return linked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(docs: DataFrame) -> DataFrame:
    """Contract columns for every frequent word."""
    return variants(docs)


SQL = r"""
WITH codes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS code
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS ident,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[a-z\x{C0}-\x{FF}]{6,}')) AS run
  FROM documents
), each_run AS (
  SELECT ident, run, count(*) AS n, hex(encode(ident || ':' || run)) AS bytes FROM runs GROUP BY ident, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(bytes), 2),
           lambda i: CAST('0x' || substring(bytes, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM each_run, codes
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), frequent AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, gap, substring(word, 1, gap - 1) || substring(word, gap + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS gap FROM frequent)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN frequent b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN frequent b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), linked AS (
  SELECT f.word, f.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * f.n THEN other END AS form,
         CASE WHEN other_n >= 5 * f.n THEN other_n END AS form_n
  FROM frequent f LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE steps AS (
    SELECT word AS start, word AS here, 0 AS depth FROM linked
    UNION ALL SELECT s.start, l.form, depth + 1 FROM steps s JOIN linked l ON l.word = s.here WHERE l.form IS NOT NULL
  )
  SELECT start, max_by(here, depth) AS root FROM steps GROUP BY start
)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN chain ON start = word
"""
