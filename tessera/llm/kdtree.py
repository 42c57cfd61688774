"""Exact top-k by inner product with KD-trees, one for each shard (operator 6).

Vectors become whole numbers (floor(scale * x)) and are dealt to shards by hash.
In a shard a tree is built by median splits on the widest side of the tight box
around a node's vectors. A query walks the tree best first: the box bounds the
score of all that is inside by the sum over dimensions of the larger of q*low
and q*high, and a node whose bound is less than the kth score so far cannot
hold a result; an equal bound may, as ties go to the smaller vec_id. Each tree is
built once and all queries stream past it. One shard is searched first, then seven,
then 56 and so on, and each round hands the kth score so far to the next, so trees
are pruned from the start.

Scores are integers and exact: products are summed in doubles only while they
stay below 2^53, else in Python's integers. Components beyond 64 bits count as the
nearest 64-bit number. Scores beyond 64 bits are ranked by their exact values and
shown as the nearest 64-bit number. Vectors null or with null or
non-finite components take no part; vectors of other lengths never meet. A
repeated vec_id is searched for once, and rows with the query's own vec_id are
no candidates. Empty tables give empty results.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import by_rounds, matrix, queries_of, sharded, usable


class Tree:
    """leaf: vectors of a leaf at most."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 256):
        self.x, self.ids = x, ids
        self.exact: Tree | None = None
        self.visited = 0
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        low, high = [], []
        order = np.arange(len(x))
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            part = x[order[a:b]]
            box = part.min(0), part.max(0)
            low.append(box[0])
            high.append(box[1])
            self.span.append((a, b))
            self.child.append(None)
            if parent >= 0:
                two = list(self.child[parent] or (0, 0))
                two[side] = node
                self.child[parent] = tuple(two)
            widths = box[1] - box[0]
            if b - a > leaf and widths.max() > 0:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, int(widths.argmax())], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.order, self.low, self.high = order, np.array(low), np.array(high)
        self.sorted_x, self.sorted_ids = x[order], ids[order]

    def of_integers(self) -> Tree:
        """The same tree with Python's integers in place of doubles."""
        if self.x.dtype == object:
            return self
        if self.exact is None:
            self.exact = copy.copy(self)
            self.exact.x, self.exact.sorted_x, self.exact.low, self.exact.high = (m.astype(np.int64).astype(object) for m in (self.x, self.sorted_x, self.low, self.high))
        return self.exact

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of each query and node, the score that nothing in the node's box exceeds."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, q: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best; fewer where others cannot reach the kth score handed in."""
        ids, scores = np.zeros(0, self.ids.dtype), np.zeros(0, self.x.dtype)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if two := self.child[node]:
                for c in two:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.span[node]
            self.visited += b - a
            s = self.sorted_x[a:b] @ q
            take = s >= kth
            if not take.any():
                continue
            i, s = self.sorted_ids[a:b][take], s[take]
            other = i != own
            ids, scores = np.concatenate((ids, i[other])), np.concatenate((scores, s[other]))
            if len(ids) >= k:
                first = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[first], scores[first]
                kth = max(kth, scores[-1])
        return ids, scores


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _wide(score: int) -> bytes | None:
    """A score beyond 64 bits as bytes that sort like it; null for others."""
    return None if LEAST <= score <= MOST else (score + (1 << 200)).to_bytes(26, "big")


def _build(ids: np.ndarray, vectors: pa.ChunkedArray) -> tuple[Tree, float]:
    x = matrix(vectors, np.int64)
    largest = float(np.abs(x.astype(np.float64)).max())
    return Tree(x.astype(np.float64 if largest < 1 << 52 else object), ids), largest


def _search(k: int):
    def search(index: tuple[Tree, float], queries: pa.Table) -> pa.Table:
        tree, largest = index
        kind = queries.column("id").type
        q = matrix(queries.column("v"), np.int64)
        exact = float(np.abs(q.astype(np.float64)).max()) * largest * q.shape[1] < 1 << 52
        if not exact:
            tree, q = tree.of_integers(), q.astype(object)
        else:
            q = q.astype(np.float64)
        bounds = tree.bounds(q)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, (own, kth) in enumerate(zip(queries.column("id").to_pylist(), queries.column("kth").to_pylist(), strict=True)):
            # a kth at the lower end of 64 bits may stand for less
            ids, scores = tree.search(q[i], bounds[i], own, k, -np.inf if kth is None or kth == LEAST else kth)
            out[0].append(np.full(len(ids), own))
            out[1].append(ids)
            if exact:
                out[2].append(scores.astype(np.int64))
                out[3].extend([None] * len(ids))
            else:
                whole = [int(s) for s in scores]
                out[2].append(np.array([min(MOST, max(LEAST, s)) for s in whole], np.int64))
                out[3].extend(map(_wide, whole))
        columns = [pa.array(np.concatenate(c)) for c in out[:3]]
        return pa.table([columns[0].cast(kind), columns[1].cast(kind), columns[2].cast(pa.int64()), pa.array(out[3], pa.binary())], names=["query_id", "vec_id", "score", "wide"])

    return search


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_bytes: int = 4 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other rows."""
    rows = usable(vectors, lambda x: F.floor(x * scale))
    queries = queries_of(rows, every)
    rows, shards = sharded(rows, vectors, shard_bytes)
    found = by_rounds(queries, rows, shards, k, _build, _search(k), "score long, wide binary", [F.desc("score"), F.desc_nulls_last("wide")], F.col("score"), "long")
    return found.select("query_id", "rank", "vec_id", "score")
