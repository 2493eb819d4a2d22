"""Approximate nearest neighbours: forests of random-projection trees.

Rows are dealt by hash to shards. Each shard gets one forest, whatever order its rows
arrive in: a node splits its vectors at the hyperplane between two of them. A query
walks all trees of a shard through one priority queue, least margin first, until it
has met LEAST rows and SHARE of the shard's; those candidates are ranked by their
exact cosine in double precision. Every row is indexed, all queries stream past every
shard's forest, and the best of all shards are ranked once more.

Recall is set by SHARE and TREES for vectors without any structure, the worst case:
of 64 equal dimensions it is over 0.9 (tests measure it against brute force). With
such vectors no order of visits finds nine in ten neighbours in a small part of the
rows or shards; with clustered ones a far smaller share does.

Cases: rows whose vector is null, zero, empty or holds a null or non-finite
component, and rows without an id, take no part; components that aren't floating are
taken as double; ids must be integers. Vectors of another length than the query's
aren't candidates. A query doesn't find rows that have its own id.
Repeated query rows are answered once; repeated candidates each count. Ties go to
the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import shards

TREES, LEAF = 32, 64
#: Part of a shard's rows that a query meets, and how many more.
SHARE, LEAST = 0.3, 500


class Forest:
    """Trees over unit vectors; inner nodes have a normal and an offset, leaves a slice of row numbers."""

    def __init__(self, unit: np.ndarray, seed: int) -> None:
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        #: Of inner node i: its children; a child below 0 is the leaf -1 - child.
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        random = np.random.Generator(np.random.Philox(seed))
        self.roots = [self._grow(unit, np.arange(len(unit)), random) for _ in range(TREES)]
        self.planes = np.array(self.normals, dtype=unit.dtype).reshape(-1, unit.shape[1])
        self.cuts = np.array(self.offsets, dtype=unit.dtype)

    def _grow(self, unit: np.ndarray, rows: np.ndarray, random) -> int:
        top: list[int] = []
        todo = [(rows, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            split = self._split(unit, own, random) if len(own) > LEAF else None
            if split is None:
                self.leaves.append(own)
                node = -len(self.leaves)
            else:
                normal, offset, right = split
                node = len(self.children)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append((0, 0))
                todo += [(own[~right], node, 0), (own[right], node, 1)]
            if parent < 0:
                top.append(node)
            else:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
        return top[0]

    @staticmethod
    def _split(unit: np.ndarray, rows: np.ndarray, random):
        """A hyperplane between two random vectors; by halves along it where they fall on one side. None if all are alike."""
        for _ in range(3):
            a, b = random.choice(len(rows), 2, replace=False)
            normal = unit[rows[a]] - unit[rows[b]]
            length = float(np.linalg.norm(normal))
            if length > 1e-6:
                normal = normal / length
                at = unit[rows] @ normal
                offset = float((unit[rows[a]] + unit[rows[b]]) @ normal) / 2
                right = at > offset
                if not 0.05 < right.mean() < 0.95:
                    offset = float(np.median(at))
                    right = at > offset
                if 0 < right.sum() < len(rows):
                    return normal, offset, right
        return None

    def candidates(self, margins: np.ndarray, enough: int) -> np.ndarray:
        """Distinct rows of the leaves that come first in the shared queue. margins: the query's, of all inner nodes."""
        heap = [(-np.inf, r) for r in self.roots]
        heapq.heapify(heap)
        met, found = 0, []
        margins = margins.tolist()
        seen = np.zeros(sum(len(x) for x in self._first_tree()), dtype=bool)
        while heap and met < enough:
            bound, node = heapq.heappop(heap)
            while node >= 0:
                m = margins[node]
                left, right = self.children[node]
                near, far = (right, left) if m > 0 else (left, right)
                heapq.heappush(heap, (max(bound, abs(m)), far))
                node = near
            leaf = self.leaves[-1 - node]
            new = leaf[~seen[leaf]]
            seen[new] = True
            met += len(new)
            found.append(new)
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def _first_tree(self) -> list[np.ndarray]:
        if not hasattr(self, "_sizes"):
            out, todo = [], [self.roots[0]]
            while todo:
                node = todo.pop()
                if node < 0:
                    out.append(self.leaves[-1 - node])
                else:
                    todo += self.children[node]
            self._sizes = out
        return self._sizes


class Index:
    """A shard's rows under one forest, which all queries of the shard walk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 7) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.forest = Forest((vectors / self.norms[:, None]).astype(np.float32), seed)
        self.enough = LEAST + int(SHARE * len(ids))

    def best(self, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query (by its place): ids and cosines of the k nearest found, best first."""
        asked = queries.astype(np.float64)
        norms = np.linalg.norm(asked, axis=1)
        for start in range(0, len(asked), 256):
            part = (asked[start : start + 256] / norms[start : start + 256, None]).astype(np.float32)
            margins = part @ self.forest.planes.T - self.forest.cuts
            for i in range(len(part)):
                q = start + i
                rows = self.forest.candidates(margins[i], self.enough)
                rows = rows[self.ids[rows] != query_ids[q]]
                score = np.einsum("ij,j->i", self.vectors[rows].astype(np.float64), asked[q]) / (self.norms[rows] * norms[q])
                if len(rows) > self.k:
                    keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
                    rows, score = rows[keep], score[keep]
                by = np.lexsort((self.ids[rows], -score))[: self.k]
                yield q, self.ids[rows[by]], score[by]

    def search(self, ids, keys, vectors, bounds) -> Iterator[pa.RecordBatch]:
        found = list(self.best(ids, vectors))
        query = np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64)
        columns = [ids[query], keys[query], np.concatenate([x for _, x, _ in found]), np.concatenate([s for _, _, s in found])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "key", "vec_id", "score"])


def usable(vector) -> F.Column:
    """Whether a vector takes part: components that are all there and finite, one of them not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row that is_query (a condition) picks."""
    rows = shards.vectors(df, id_col, vector_col, is_query, usable)
    n = shards.shard_count(rows.count())
    asked = rows.where("asked").dropDuplicates(["id", "key"]).withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "bound": F.lit(None)})

    def index(ids, vectors):
        return Index(ids, vectors, k)

    found = shards.stream_past(rows, asked, n, index, "query_id long, key long, vec_id long, score double")
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
