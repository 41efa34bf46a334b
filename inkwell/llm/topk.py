"""Exact top-k by inner product: ball trees, branch and bound.

Candidates are dealt into shards; each shard builds a ball tree over its rows.  A block of queries visits a tree's nodes in
the order of their upper bounds ``q.center + |q| * radius`` of the inner product, highest first, and a query takes no part
in a node whose bound is below its current k-th score.  That score is shared: each query first searches one shard, its home,
and takes the k-th score it finds there along to all others, so most of their nodes are never opened and they return only
rows that reach it.  Scores are integers and exact: vectors are small integers held as float64 in matrix products.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

LEAF = 256
#: Queries that go down a tree together.
BLOCK = 512
#: Rows of a shard and queries of a group: what a task holds.
SHARD, GROUP = 20_000, 50_000


class BallTree:
    """Nodes in arrays; node i holds rows ``begin[i]:end[i]`` of the reordered vectors; children are ``left[i]``, ``right[i]``."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        nodes: list[tuple[int, int]] = []
        self.vectors = vectors
        stack = [(0, len(vectors), -1)]
        children: dict[int, list[int]] = {}
        while stack:
            begin, end, parent = stack.pop()
            at = len(nodes)
            nodes.append((begin, end))
            children.setdefault(parent, []).append(at)
            if end - begin > leaf:
                own = self.order[begin:end]
                spread = vectors[own]
                # Split at the median along the line between two far points.
                a = spread[np.argmax(((spread - spread[0]) ** 2).sum(1))]
                b = spread[np.argmax(((spread - a) ** 2).sum(1))]
                along = spread @ (b - a)
                middle = (end - begin) // 2
                self.order[begin:end] = own[np.argpartition(along, middle)]
                stack.append((begin, begin + middle, at))
                stack.append((begin + middle, end, at))
        self.begin, self.end = (np.array([n[i] for n in nodes], np.int64) for i in (0, 1))
        self.children = [children.get(i, []) for i in range(len(nodes))]
        self.vectors, self.keys = vectors[self.order], keys[self.order]
        self.center = np.stack([self.vectors[b:e].mean(0) for b, e in zip(self.begin, self.end, strict=True)])
        self.radius = np.array([np.sqrt(((self.vectors[b:e] - c) ** 2).sum(1).max()) for b, e, c in zip(self.begin, self.end, self.center, strict=True)])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, key) of each query, best first, ties to smaller keys; a query's own key doesn't count.
        Rows that score below a query's ``floor`` may be missing; missing ones have score -inf."""
        n = len(queries)
        score, key = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        least = floor.copy()  # the k-th score of each query by now
        # Bounds are rounded up a little, so that rounding in them can't hide a row that ties.
        bound = queries @ self.center.T + np.sqrt((queries**2).sum(1))[:, None] * self.radius
        bound += 1e-6 * (1 + np.abs(bound))
        heap = [(-np.inf, 0, np.arange(n))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[bound[who, node] >= least[who]]
            if not len(who):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    open_ = who[bound[who, child] >= least[who]]
                    if len(open_):
                        heapq.heappush(heap, (-float(bound[open_, child].max()), child, open_))
                continue
            begin, end = self.begin[node], self.end[node]
            found = queries[who] @ self.vectors[begin:end].T
            keys = np.broadcast_to(self.keys[begin:end], found.shape)
            found = np.where(keys == own[who][:, None], -np.inf, found)
            # Only rows that reach the current k-th score can enter.
            some = (found >= least[who][:, None]).any(1)
            who, found, keys = who[some], found[some], keys[some]
            if len(who):
                both, names = np.concatenate([score[who], found], 1), np.concatenate([key[who], keys], 1)
                best = np.lexsort((names, -both), axis=1)[:, :k]
                score[who], key[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                least[who] = np.maximum(floor[who], score[who, -1])
        return score, key

    def alike(self, queries: np.ndarray) -> np.ndarray:
        """An order of the queries in which those that head for the same leaves stand together."""
        node = np.zeros(len(queries), np.int64)
        moving = np.arange(len(queries)) if self.children[0] else np.zeros(0, np.int64)
        pairs = np.array([c if c else [i, i] for i, c in enumerate(self.children)])
        while len(moving):
            first, second = pairs[node[moving]].T
            closer = ((queries[moving] * (self.center[first] - self.center[second])).sum(1)) > 0
            node[moving] = np.where(closer, first, second)
            moving = moving[pairs[node[moving], 0] != node[moving]]
        return np.argsort(self.begin[node], kind="stable")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """key and ``floor(scale * x)`` of every component; rows with a null key or vector, or null or non-finite components
    are left out."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole).select(key, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias(vector))


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, shards: int | None = None) -> DataFrame:
    """The k highest integer inner products of each query among all other rows: query_id, rank, vec_id, score.

    Queries are the rows whose key is divisible by ``every``; candidates are all rows but the query's own.  Ties go to the
    smaller key.  A repeated row is one candidate for each time it stands there, but rows with a query's key are its
    own; of several vectors with a query's key the smallest asks.  Rows with a null key, null or empty vectors and those that
    hold null or non-finite components take no part.  Vectors only meet vectors of their own length.  An empty table
    gives no rows.  Other columns are not looked at.
    """
    rows = integer_vectors(vectors, key, vector, scale).where(F.size(vector) > 0).withColumn("width", F.size(vector))
    rows = written(rows, "vectors")
    # The query set meets all rows in blocks: each shard of about SHARD rows meets each group of about GROUP queries.
    queries = rows.where(F.col(key) % every == 0).groupBy(key).agg(F.min(F.struct("width", vector)).alias("v"))
    number, asked = rows.count(), rows.where(F.col(key) % every == 0).count()
    shards, groups = shards or max(1, number // SHARD), max(1, asked // GROUP)
    queries = queries.select(F.col(key).alias("query_id"), F.col(f"v.{vector}").alias("query"), "v.width", F.pmod(F.xxhash64(F.lit(2), key), F.lit(groups)).alias("group"), F.pmod(F.xxhash64(F.lit(7), key), F.lit(shards)).cast("int").alias("home"))
    # A row is dealt by all it holds, so repeated keys spread as well.
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), key, vector), F.lit(shards)).cast("int"))
    candidates = candidates.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and held.num_rows:
            held, asked = held.combine_chunks(), asked.combine_chunks()
            width = held["width"][0].as_py()
            tree = BallTree(_matrix(held[vector].chunk(0), width), held[key].to_numpy())
            points = _matrix(asked["query"].chunk(0), width)
            order = tree.alike(points)
            points, names = points[order], asked["query_id"].to_numpy()[order]
            floor = asked["floor"].fill_null(-np.inf).to_numpy()[order]
            for i in range(0, len(names), BLOCK):
                part = slice(i, i + BLOCK)
                score, found = tree.search(points[part], names[part], k, floor[part])
                real = (score > -np.inf) & (score >= floor[part][:, None])
                out["query_id"].append(np.broadcast_to(names[part][:, None], real.shape)[real])
                out["vec_id"].append(found[real])
                out["score"].append(score[real].astype(np.int64))
        return pa.table({n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()})

    by = ("shard", "group", "width")

    def search(asked: DataFrame) -> DataFrame:
        return asked.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")

    found = written(search(queries.withColumn("shard", F.col("home")).withColumn("floor", F.lit(None).cast("double"))), "home")
    if shards > 1:
        # A query that found k rows at home needs no row that scores below the last of these.
        floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
        others = queries.join(floors, "query_id", "left").withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))))
        found = found.unionByName(search(others))
    # Each shard gives k rows a query at most.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
