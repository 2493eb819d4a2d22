"""Exact largest inner products of integer vectors: ball trees, branch and bound.

Components are floor(SCALE * x), x as double. Rows are dealt to shards; each shard's
rows make one tree of balls, and a block of queries goes down it together: the node
with the greatest upper bound (the centre's inner product, and the query's length
times the radius) over the block comes first, a query leaves a subtree whose bound is
under its current k-th score, and a subtree that all have left is never opened.

The current k-th score is shared between shards: a query is first answered in the
shard of its own row, and takes that k-th score along to all others as the bound to
reach. A shard then returns only rows that reach it.

Cases: rows without an id, and vectors that are null or hold a null or non-finite
component (also once scaled), take no part; zero vectors do. Vectors of another
length than the query's aren't candidates. A query doesn't find rows that have its
own id. Repeated query rows are answered once; repeated candidates each count. Ties
go to the smaller id. Components of any size are exact; a score beyond a long counts
as the nearest long. Ids must be integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import common, shards

SCALE, LEAF, K = 256, 128, 5
#: Queries that go down a tree together, and the least rows of a shard in small tables.
BLOCK, LEAST_ROWS = 512, 4_096
#: Part by which bounds are widened, for the rounding of their sums.
SLACK = 1e-9
#: Largest sums that doubles hold exactly, and what a long holds.
EXACT, LONG = 2.0**53, 2**63 - 1


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


class Tree:
    """A ball tree over scaled vectors; node i holds the rows lo[i] to hi[i] of its order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> None:
        x = scaled(vectors)
        self.k, order = k, np.arange(len(x))
        centres, self.radius, self.lo, self.hi, self.children = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node, rows = len(self.lo), order[lo:hi]
            own = x[rows]
            centre = own.mean(axis=0)
            apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            self.radius.append(float(apart.max()))
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo > LEAF and self.radius[-1] > 0:
                far = own[int(apart.argmax())]
                other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
                along = own @ ((other - far) / max(1.0, float(np.abs(other - far).max())))
                half = (hi - lo) // 2
                order[lo:hi] = rows[np.argsort(along, kind="stable")]
                todo += [(lo + half, hi, node), (lo, lo + half, node)]
        self.centres, self.radius = np.array(centres), np.array(self.radius)
        self.lengths = np.sqrt((self.centres**2).sum(axis=1))
        self.ids, self.x = ids[order], x[order]
        self.top = float(np.abs(x).max(initial=0))

    def exact(self, asked: np.ndarray) -> bool:
        """Whether doubles hold all sums of the products."""
        return self.top * float(np.abs(asked).max(initial=0)) * asked.shape[1] < EXACT

    def products(self, asked: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Inner products with the rows from lo to hi: in doubles where these are exact, else in whole numbers of any size."""
        if self.exact(asked):
            return asked @ self.x[lo:hi].T
        whole = np.vectorize(int, otypes=[object])
        return np.maximum(np.minimum(whole(asked) @ whole(self.x[lo:hi]).T, LONG), -LONG - 1)

    def best(self, asked: np.ndarray, own_ids: np.ndarray, least: np.ndarray) -> tuple[list, np.ndarray]:
        """Of each query the (query, score, id) of its k best rows that reach least."""
        wide = np.sqrt((asked**2).sum(axis=1))[:, None]
        bound = asked @ self.centres.T + wide * self.radius
        bound += SLACK * wide * (self.lengths + self.radius) + 1
        bound[np.isnan(bound)] = np.inf  # squares that no double holds
        exact = self.exact(asked)
        kth = least if exact else np.nextafter(least, -np.inf)
        kth = kth.copy()
        met = (np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object), np.zeros(0, np.int64))
        queue = [(-float(bound[:, 0].max()), 0)]
        while queue:
            _, node = heapq.heappop(queue)
            on = np.flatnonzero(bound[:, node] >= kth)
            if not len(on):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-float(bound[on, child].max()), child))
                continue
            lo, hi = self.lo[node], self.hi[node]
            score = self.products(asked[on], lo, hi)
            q, row = np.nonzero((score >= kth[on, None]) & (self.ids[lo:hi] != own_ids[on, None]))
            if not len(q):
                continue
            query, value, found = np.concatenate([met[0], on[q]]), np.concatenate([met[1], score[q, row]]), np.concatenate([met[2], self.ids[lo:hi][row]])
            by = np.lexsort((found, -value if exact else np.unique(-value, return_inverse=True)[1], query))
            query = query[by]
            place = np.arange(len(query)) - np.searchsorted(query, query, "left")
            keep = by[place < self.k]
            met = (np.sort(query[place < self.k]), value[keep], found[keep])
            last = by[place == self.k - 1]
            reached = value[last].astype(np.float64)
            kth[query[place == self.k - 1]] = reached if exact else np.nextafter(reached, -np.inf)
        return met

    def search(self, ids, keys, vectors, bounds) -> Iterator[pa.RecordBatch]:
        asked = scaled(vectors)
        least = np.where(np.isnan(bounds), -np.inf, bounds)
        for start in range(0, len(ids), BLOCK):
            part = slice(start, start + BLOCK)
            query, score, found = self.best(asked[part], ids[part], least[part])
            columns = [pa.array(ids[part][query]), pa.array(keys[part][query]), pa.array(found), pa.array(score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "key", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: components that are all there and finite, also once scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def largest(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k largest inner products of each row that is_query (a condition) picks."""
    rows = shards.vectors(df, id_col, vector_col, is_query, usable)
    n = shards.shard_count(rows.count(), LEAST_ROWS)
    queries = rows.where("asked").dropDuplicates(["id", "key"])
    schema = "query_id long, key long, vec_id long, score long"

    def index(ids, vectors):
        return Tree(ids, vectors, k)

    at_home = queries.withColumns({"shard": shards.home(n), "bound": F.lit(None)})
    first = common.cut(shards.stream_past(rows, at_home, n, index, schema), "largest-first")
    found = first
    if n > 1:
        kth = first.groupBy(F.col("query_id").alias("id"), "key").agg(F.min("score").alias("bound"), F.count("*").alias("met"))
        kth = kth.select("id", "key", F.when(F.col("met") >= k, F.col("bound")).alias("bound"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s != shards.home(n)))
        away = queries.join(kth, ["id", "key"], "left").select("id", "v", "key", "dim", "bound", others.alias("shard"))
        found = first.unionByName(shards.stream_past(rows, away, n, index, schema))
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql() -> str:
    """The query in DuckDB, for a stated query set against all rows."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
