"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Equal vectors are one entry of the index, named by their smallest vec_id and holding their k + 1 smallest ones, which is all
that any answer can need of them. Queries with equal vectors are searched once, for k + 1 ids; each then leaves out its own.

The tree is fitted on at most ``SAMPLE_ROWS`` entries (and at most ``SAMPLE_VALUES`` values) at a time, picked by hash: leaves
that hold more than twice the wanted number of entries (``LEAF_ROWS``, or the square root of all if that is more) get a sample of
their own and are split again until none is left or none can be split. Every entry is then put into its leaf. So the tree
has about as many leaves as the square root of the entries, and its size (leaves x dimension) is the bound of the broadcast. A
leaf is read in packs of about ``PACK_ROWS`` entries.

A query takes nodes from a priority queue by inner product with their centres; the leaves it meets are visited in that
order. How many it visits is calibrated, at every size of table alike: the true neighbours of ``CALIBRATION`` queries are found by
brute force over all entries, and the number of visits grows by a quarter at a time until at least ``RECALL`` of these neighbours
lie in the visited leaves. A query goes on beyond them until its leaves hold k + 1 entries, so it gets fewer than k neighbours
only if there are fewer. The first leaves, up to k + 1 entries, give a query a k-th score; from its other leaves only what reaches
this score leaves the task. Scores of what is found are exact, summed in the order of the components.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part. Rows
with one vec_id are one vector, the smallest. Only vectors of equal length are compared; each length has its own tree.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, written
from .vectors import packed, unpacked, usable

SAMPLE_ROWS = 20_000
SAMPLE_VALUES = 4_000_000
SAMPLE_PER_LEAF = 20
LEAF_ROWS = 256
BRANCHES = 8
PACK_ROWS = 2048
PACK_QUERIES = 512
CALIBRATION = 64
RECALL = 0.95
KEPT_QUERIES = 20_000
SALTS = 16

HITS = "query_id long, vec_id long, score double"
QUERY_PACK = "dim int, shard int, part int, query_ids binary, queries binary, least binary"


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class KMeansTree:
    """Centres of a hierarchy of clusters; only centres are kept, so its size is leaves x dimension."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        self.random = np.random.default_rng(seed)
        self.leaves = 0
        self.root = self._grow(sample, max(1, len(sample) // max(1, leaves)))

    def _grow(self, rows: np.ndarray, least: int) -> Node:
        node = Node(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        parts = self._cluster(rows, min(BRANCHES, len(rows) // least)) if len(rows) >= 2 * least else []
        if len(parts) < 2:
            node.leaf, self.leaves = self.leaves, self.leaves + 1
        else:
            node.children = [self._grow(p, least) for p in parts]
        return node

    def _cluster(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        centres = rows[self.random.choice(len(rows), k, replace=False)]
        for _ in range(12):
            near = _nearest(rows, centres)
            centres = np.stack([rows[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        near = _nearest(rows, centres)
        return [rows[near == j] for j in range(k) if (near == j).any()]

    def split(self, node: Node, rows: np.ndarray, leaves: int) -> bool:
        """Grow a leaf into several, fitted on its own sample; False if the sample cannot be parted."""
        grown = self._grow(rows, max(1, len(rows) // max(2, leaves))) if len(rows) > 1 else Node(node.centre)
        if not grown.children:
            return False
        node.children, node.leaf = grown.children, -1
        return True

    def leaf_nodes(self) -> dict[int, Node]:
        out, stack = {}, [self.root]
        while stack:
            node = stack.pop()
            stack += node.children
            if not node.children:
                out[node.leaf] = node
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        out = np.zeros(len(rows), np.int32)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if not node.children:
                out[at] = node.leaf
                continue
            near = _nearest(rows[at], np.stack([c.centre for c in node.children]))
            stack += [(child, at[near == j]) for j, child in enumerate(node.children) if (near == j).any()]
        return out

    def visit(self, query: np.ndarray, count: int, rows: dict[int, int], least: int) -> tuple[list[int], int]:
        """The first ``count`` leaves with rows in the order of a best-bin-first search, and more until they hold ``least`` rows.

        The second number tells with how many of them these rows are reached.
        """
        queue, out, turn, held, enough = [(0.0, 0, self.root)], [], 1, 0, 0
        while queue and (len(out) < count or held < least):
            _, _, node = heapq.heappop(queue)
            if not node.children:
                if rows.get(node.leaf):
                    out.append(node.leaf)
                    enough += held < least
                    held += rows[node.leaf]
                continue
            for child in node.children:
                heapq.heappush(queue, (-float(query @ child.centre), turn, child))
                turn += 1
        return out, enough


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query row, vec_id, score): the k best rows of each query, equal scores by vec_id, none below ``least``."""
    rough = queries @ vectors.T
    kth = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(queries), -np.inf)
    if least is not None:
        kth = np.maximum(kth, least)
    # A matrix product may round equal vectors apart: all within its error of the k-th are scored again, in order.
    scale = np.sqrt((queries**2).sum(axis=1)) * np.sqrt((vectors**2).sum(axis=1).max(initial=0.0))
    q, v = np.nonzero(rough >= (kth - 1e-12 * scale)[:, None])
    score = np.zeros(len(q))
    for d in range(queries.shape[1]):
        score += queries[q, d] * vectors[v, d]
    if least is not None:
        high = score >= least[q]
        q, v, score = q[high], v[high], score[high]
    return _first(q, ids[v], score, k)


def _first(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    turn = np.lexsort((ids, -score, q))
    q, ids, score = q[turn], ids[turn], score[turn]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def _search(k: int):
    """Rows (dim, ids, vectors, query_ids, queries, least) -> hits; a task keeps the k best so far of its queries."""

    def hits(batches):
        held: list[tuple] = []

        def flush():
            q, v, s = _first(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
            held[:] = [(q, v, s)]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = unpacked(row["ids"], row["vectors"], row["dim"])
                query_ids, queries = unpacked(row["query_ids"], row["queries"], row["dim"])
                q, v, s = best(queries, ids, vectors, k, np.frombuffer(row["least"], "<f8"))
                held.append((query_ids[q], v, s))
                if sum(len(h[0]) for h in held) > KEPT_QUERIES * k:
                    flush()
                    if len(held[0][0]) > KEPT_QUERIES * k // 2:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return hits


def _top(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, dim, vector, ids: one row per distinct vector with its k + 1 smallest ids."""
    kept = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit("fold")), F.lit(SALTS)))
    # Salted first: what a hot vector sends to its last task does not grow with the number of tasks.
    for by in (["dim", "vector", "salt"], ["dim", "vector"]):
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = kept.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.get("ids", F.lit(0)).alias("vec_id"), "dim", "vector", "ids")


@dataclass
class Index:
    tree: KMeansTree
    rows: DataFrame  # vec_id, dim, vector, ids, leaf
    held: dict[int, int]  # entries per leaf
    visits: int


def _placed(rows: DataFrame, tree: KMeansTree) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def leaf(batches):
        for batch in batches:
            vectors = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            yield batch.append_column("leaf", pa.array(shared.value.place(vectors) if batch.num_rows else [], pa.int32()))

    return rows.mapInArrow(leaf, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, leaf int")


def _sampled(rows: DataFrame, n: int, want: int) -> DataFrame:
    """About ``want`` of ``n`` rows, never more, by the hash of their id."""
    place = F.pmod(F.xxhash64("vec_id", F.lit("tree")), F.lit(1 << 30))
    return rows.where(place < (1 << 30) * min(1.0, 1.2 * want / n)).orderBy(place, "vec_id").limit(want)


def grown(rows: DataFrame, n: int, dim: int) -> tuple[KMeansTree, dict[int, int]]:
    """The tree and the number of entries of each leaf."""
    want, wide = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // dim)), max(LEAF_ROWS, math.isqrt(n))
    sample = np.array([r.vector for r in _sampled(rows, n, want).select("vector").collect()], float).reshape(-1, dim)
    tree = KMeansTree(sample, min(-(-n // wide), max(1, len(sample) // SAMPLE_PER_LEAF)))
    final: set[int] = set()
    while True:
        at = _placed(rows.select("vec_id", "vector"), tree)
        held = {r.leaf: r["count"] for r in at.groupBy("leaf").count().collect()}
        large = {leaf: c for leaf, c in held.items() if c > 2 * wide and leaf not in final}
        if not large:
            return tree, held
        inside = at.where(F.col("leaf").isin(list(large)))
        parts: dict[int, list] = {}
        for r in _sampled(inside, sum(large.values()), want).select("leaf", "vector").collect():
            parts.setdefault(r.leaf, []).append(r.vector)
        nodes = tree.leaf_nodes()
        for leaf, c in large.items():
            own = np.array(parts.get(leaf, []), float).reshape(-1, dim)
            if not tree.split(nodes[leaf], own, min(-(-c // wide), max(2, len(own) // SAMPLE_PER_LEAF))):
                final.add(leaf)


def build(rows: DataFrame, asked: DataFrame, n: int, dim: int, k: int) -> Index:
    """Tree, entries with their leaves, and the calibrated number of visits for vectors of one length."""
    spark = rows.sparkSession
    tree, held = grown(rows, n, dim)
    placed = written(_placed(rows, tree), "leaves")
    # True neighbours of a few queries over all entries, and how late a search would come to their leaves.
    some = asked.orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATION).select("vec_id", "vector").collect()
    own_ids, queries = np.array([r.vec_id for r in some], np.int64), np.array([r.vector for r in some], float).reshape(-1, dim)
    known = spark.sparkContext.broadcast(queries)

    def brute(batches):
        qs, found = known.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            hits = best(qs, own, np.array(batch.column("vector").to_pylist(), float), k + 1)
            found = hits if found is None else _first(*(np.concatenate(c) for c in zip(found, hits, strict=True)), k + 1)
        if found is not None:
            q, v, s = found
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    near = _top(placed.select("vec_id", "vector").mapInArrow(brute, HITS), k + 1)
    truth: dict[int, list] = {}
    for r in near.join(placed.select("vec_id", "ids", "leaf"), "vec_id").select("query_id", "score", "ids", "leaf").collect():
        truth.setdefault(r.query_id, []).extend((-r.score, i, r.leaf) for i in r.ids)
    late = []
    for q, found in truth.items():
        turns = {leaf: t for t, leaf in enumerate(tree.visit(queries[q], len(held), held, 0)[0])}
        late += [turns[leaf] for _, i, leaf in sorted(found)[:k + 1] if i != own_ids[q]][:k]
    visits, late = 1, np.array(late)
    while visits < len(held) and len(late) and (late < visits).mean() < RECALL:
        visits = -(-visits * 5 // 4) + 1
    return Index(tree, placed, held, min(visits, len(held)))


def _met(packs: DataFrame, each: DataFrame, k: int) -> DataFrame:
    """Hits of queries (vec_id, dim, vector, least, shard) in the packs of their shards."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({
            "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "part": [pdf["part"].iloc[0]],
            "query_ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "queries": [np.stack(pdf["vector"].to_list()).astype("<f8").tobytes()],
            "least": [pdf["least"].to_numpy("<f8").tobytes()],
        })

    sizes = each.groupBy("shard").agg(F.ceil(F.count("*") / PACK_QUERIES).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", F.lit("queries")), F.col("parts")).cast("int")
    keyed = each.join(sizes, "shard").select("vec_id", "dim", "vector", "least", "shard", part.alias("part"))
    asked = written(keyed.groupBy("dim", "shard", "part").applyInPandas(pack, QUERY_PACK), "asked")
    met = packs.join(asked, ["dim", "shard"]).select("dim", "ids", "vectors", "query_ids", "queries", "least")
    return met.mapInArrow(_search(k), HITS)


def search(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best entries for each asked entry (vec_id, dim, vector) among the leaves it visits."""
    shared = asked.sparkSession.sparkContext.broadcast(index.tree)
    visits, held = index.visits, index.held

    def visit(batches):
        for batch in batches:
            seen = [shared.value.visit(np.array(v), visits, held, k) for v in batch.column("vector").to_pylist()]
            yield batch.append_column("leaves", pa.array([leaves for leaves, _ in seen], pa.list_(pa.int32()))).append_column("enough", pa.array([e for _, e in seen], pa.int32()))

    # Packs of entries and of queries, both of bounded size, meet by leaf.
    sizes = index.rows.groupBy("leaf").agg(F.ceil(F.count("*") / PACK_ROWS).alias("packs"))
    part = F.pmod(F.xxhash64("vec_id", F.lit("pack")), F.col("packs"))
    packs = written(packed(index.rows.join(sizes, "leaf").select("vec_id", "dim", "vector", F.col("leaf").alias("shard"), part.alias("part"))), "packs")
    queries = written(asked.select("vec_id", "dim", "vector").mapInArrow(visit, "vec_id long, dim int, vector array<double>, leaves array<int>, enough int"), "visits")
    lowest = F.lit(float("-inf")).alias("least")
    first = queries.select("vec_id", "dim", "vector", lowest, F.explode(F.slice("leaves", F.lit(1), F.col("enough"))).alias("shard"))
    near = written(_top(_met(packs, first, k), k), "near")
    # A query that has k entries already takes from its other leaves only what reaches the k-th score.
    bounds = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = queries.where(F.size("leaves") > F.col("enough")).join(bounds, "vec_id", "left")
    rest = rest.select("vec_id", "dim", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.explode(F.slice("leaves", F.col("enough") + 1, F.size("leaves"))).alias("shard"))
    return _top(near.select("query_id", "vec_id", "score").unionByName(_met(packs, rest, k)), k)


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products for each row that ``is_query`` holds of."""
    spark = prepared(rows.sparkSession)
    vectors = written(usable(rows, zero=False), "vectors")
    distinct = written(entries(vectors, k), "entries")
    # Each query and the entry that stands for its vector.
    stands = distinct.select(F.col("vec_id").alias("entry"), "dim", "vector")
    asking = written(vectors.where(is_query).join(stands, ["dim", "vector"]).select(F.col("vec_id").alias("query_id"), "entry"), "queries")
    asked = written(distinct.join(asking.select(F.col("entry").alias("vec_id")).distinct(), "vec_id", "left_semi"), "asked-entries")
    dims = asked.groupBy("dim").count().orderBy("dim").collect()  # one row per length of vector
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    hits = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim, _ in dims:
        own = asked.where(F.col("dim") == dim)
        index = build(distinct.where(F.col("dim") == dim), own, sizes[dim], dim, k)
        hits = hits.unionByName(search(index, own, k + 1).select("query_id", "vec_id", "score"))
    # From entries to ids: of k + 1 ids one may be the query's own.
    each = hits.join(distinct.select("vec_id", "ids"), "vec_id").select("query_id", F.explode("ids").alias("vec_id"), "score")
    answers = _top(each, k + 1).groupBy(F.col("query_id").alias("entry")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found")
    )
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(answers, "entry").select("query_id", F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score")


def op3_ann_search(rows: DataFrame) -> DataFrame:
    """Contract columns: the 20 nearest for every row whose vec_id is divisible by 20."""
    return nearest(rows, F.col("vec_id") % 20 == 0, 20)
