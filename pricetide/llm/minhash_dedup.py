"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes), a 128-bit fingerprint of the set, and
   a MinHash signature of ``COORDS`` coordinates. Equal sets are folded to the row with the smallest doc_id.
2. Each folded document is posted under its (coordinate, value) pairs. Posts are ordered by how many documents they
   hold, rarest first. Two documents with at least ``MATCHES`` equal coordinates share one of their first
   ``COORDS - MATCHES + 1`` posts, so only this prefix is merged, and the longest lists are skipped where they lie
   behind it.
3. In each list every member is held against the smallest member only. Pairs with ``MATCHES`` collisions or more over
   the whole signature are confirmed on full sets, and links give components.
4. Members of lists that span several components after that may still have links across components. For these
   documents alone the shingles are posted, rarest first, and only as many as a similarity of 0.75 allows to be
   missing. Where such a list spans several components, the members outside its largest one are held against members
   of other components, if what stands behind the shared shingle can reach the overlap that both sizes ask for.
   Pairs inside one component are never made, so a group of near copies costs about its size, and documents whose
   own words rule every link out make no pair.

A pair with a similarity of exactly 0.75 collides in 48 coordinates less than 22 times with a chance near 3e-6;
that is the only way a link can be missed. Everything after that is exact but for 64-bit hash collisions.

Defined results: null texts and texts without words have 0 shingles and are linked with nothing; fewer than five words
are one shingle; rows with a null doc_id are never linked and not kept. Each row is judged by its own text, repeated
rows alike. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, whole_row, written

SHINGLE = 5
COORDS = 48
MATCHES = 22
PREFIX = COORDS - MATCHES + 1
WORDS_KEPT = 200_000

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Codes(dict):
    """Word -> 64-bit hash, filled as words come; emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the rule's white space
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    h = codes[: n - width + 1].copy()
    for i in range(1, width):
        h *= _P
        h += codes[i : n - width + 1 + i]
    h += np.uint64(width)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS values for each non-empty set: the high half of the smallest product per coordinate."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    joined = np.concatenate(sets)
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(joined * _FACTORS[k], starts) >> np.uint64(32)
    return out


def _sign(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(ids):
            sets, size, first = [], 0, at
            while at < len(ids) and size < 100_000:  # keeps the products in cache
                sets.append(shingle_set(texts[at].as_py()))
                size += len(sets[-1])
                at += 1
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first:at], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([next(signed).view(np.int32) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                ["doc_id", "n_shingles", "print", "sig"],
            )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint and signature of every row, kept as a table: the texts are read once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_sign, "doc_id long, n_shingles long, print binary, sig array<int>")
    return written(out, "signed")


def prefix_posts(reps: DataFrame) -> DataFrame:
    """(post, node): the rarest PREFIX posts of each node, but those held by no other node."""
    posts = reps.select("node", F.posexplode("sig").alias("k", "v")).select(
        "node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("post")
    )
    shared = posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    own = posts.join(shared, "post").groupBy("node").agg(F.collect_list(F.struct("n", "post")).alias("own"))
    own = own.where(F.size("own") >= MATCHES)  # fewer cannot reach the threshold with anyone
    rest = F.lit(PREFIX - COORDS) + F.size("own")
    return own.where(rest > 0).select("node", F.explode(F.slice(F.array_sort("own"), 1, rest)).alias("p")).select("p.post", "node")


def _verify(batches):
    """Rows (a, b, text_a, text_b) -> (a, b) of those with 100 * common >= 75 * union."""
    kept: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right, good = batch.column("text_a"), batch.column("text_b"), []
        for i in range(len(a)):
            hub = left[i].as_py()
            if hub != kept[0]:
                kept = (hub, shingle_set(hub))
            other = shingle_set(right[i].as_py())
            common = len(np.intersect1d(kept[1], other, assume_unique=True))
            good.append(100 * common >= 75 * (len(kept[1]) + len(other) - common))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(b, pa.int64()).filter(mask)], ["a", "b"])


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that collide often enough and whose full sets are similar enough, as a table."""
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda m: m))
    near = (
        pairs.distinct()
        .join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
        .join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
        .where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").where(same >= MATCHES).select("a", "b")
    )
    near = written(near, "pairs")
    both = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long").distinct(), "links")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of some nodes as a table; the one place where texts are joined to ids, at every size by a shuffle."""
    found = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.distinct().hint("merge"), "node")
    return written(found, "texts")


def main_component(posts: DataFrame) -> DataFrame:
    """(post, main) of every post that spans several components; main is the one with most members."""
    per = posts.groupBy("post", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("post").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k"))
    return main.where("k > 1").select("post", "main")


def _shingles(batches):
    for batch in batches:
        for node, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingle_set(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(s), node), pa.int64()), pa.array(np.full(len(s), component), pa.int64()),
                    pa.array(np.full(len(s), len(s)), pa.int64()), pa.array(s.view(np.int64), pa.int64()),
                ],
                ["node", "component", "size", "post"],
            )


def crossing_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (node, component) of different components that full sets do not rule out."""
    own = texts.join(members, "node").select("node", "component", "text")
    posts = written(own.mapInArrow(_shingles, "node long, component long, size long, post long").distinct(), "shingles")
    shared = posts.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    own = posts.join(shared, "post").groupBy("node", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "post"))).alias("own"))
    # Shingles that no other member has come first; they cannot be shared. A link shares 75 % of either set.
    alone = F.col("size") - F.size("own")
    first = F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * 0.75) + 1 - alone).cast("int")
    own = own.where(F.size("own") * 100 >= F.col("size") * 75).select(
        "node", "component", "size", alone.alias("alone"), F.posexplode(F.slice("own", 1, first)).alias("i", "p")
    )
    prefix = written(own.select("p.post", "node", "component", "size", (F.col("size") - F.col("alone") - F.col("i")).alias("left")), "prefix")
    mixed = prefix.join(main_component(prefix), "post")
    rest = mixed.where("component <> main").select(
        "post", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("left").alias("lx")
    )
    every = mixed.alias("m").join(
        rest.alias("r"),
        F.expr("m.post = r.post AND component <> cx AND (component = main OR node > x) "
               "AND 7 * least(left, lx) >= 3 * (size + sx) AND 100 * least(size, sx) >= 75 * greatest(size, sx)"),
    )
    return every.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: alternating large and small stars until the edges stay the same."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        edges = written(small, "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    prepared(docs.sparkSession)
    rows = signed(docs)
    folded = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "print").agg(
        F.min("doc_id").alias("node"), F.first("sig").alias("sig")
    )
    folded = written(folded, "folded")
    reps = folded.select("node", "sig", "n_shingles")
    posts = written(prefix_posts(reps), "posts")
    hubs = posts.groupBy("post").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    held = written(posts.join(hubs, "post"), "held")
    texts = texts_of(docs, held.select("node"))
    stars = held.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = confirmed(stars, reps, texts)
    found = written(components(links), "components")
    # In lists of two the only pair is done.
    placed = held.where("n > 2 AND hub <> node").join(found, "node", "left")
    placed = written(placed.select("post", "node", F.coalesce("component", "node").alias("component")), "placed")
    members = placed.join(main_component(placed), "post").select("node", "component").distinct()
    more = confirmed(crossing_pairs(written(members, "members"), texts), reps, texts)
    if more.limit(1).count():
        found = written(components(links.unionByName(more)), "components")
    grouped = folded.join(found, "node", "left").select("n_shingles", "print", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "print").join(grouped, ["n_shingles", "print"], "left")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest doc_id.

    Rows that share this doc_id and its text are reduced to one, the first by all other columns as text. Rows with unlike texts are no
    duplicates of each other, whatever their doc_id: each text of a component that the kept id names stays. Rows with a
    null doc_id stay. A component whose smallest id names several unlike texts keeps them all.
    """
    marks = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("print"), whole_row(docs).alias("row"))
    # As text, for columns (maps, for one) that have no order; null texts and empty ones are alike.
    order = F.to_json(F.struct(F.col("row"), F.lit(0).alias("_")))
    one = rows.join(marks, rows["id"] == marks["kept_id"]).groupBy("id", "print").agg(F.min_by("row", order).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), one AS (
  SELECT doc_id, unnest(sh) AS x FROM s
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), comp AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM n JOIN comp ON a = doc_id
"""
