"""Nearest neighbours by a block matrix join with int8 tiles (operator 8).

Vectors are dealt to shards by hash; a shard is quantised once and the queries
stream past it block by block. Both sides of a tile are quantised to int8, each row
by its own scale, and multiplied as a matrix, in float32 while sums of products of
int8 values are exact there (up to 1,040 dimensions), else in float64. With
q = q' + e and v = v' + f, the error of q'·v' is at most |q'||f| + |e||v|; so
each pair's squared distance lies in a known interval. A pair survives unless
the interval begins beyond the query's kth smallest interval end, its heap's
kth distance or the kth distance of earlier rounds of shards; survivors are recomputed from the original vectors in double
precision and merged by a heap for each query. The bounds hold, so nothing
near is lost: recall is 1.

Vectors null, zero, or with null or non-finite components take no part; vectors
of other lengths never meet. A repeated vec_id is searched for once, and rows
with the query's own vec_id are no candidates. Ties go to the smaller vec_id.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import by_rounds, matrix, queries_of, sharded, usable


#: So many products of int8 values sum to less than 2^24.
EXACT_IN_FLOAT32 = (1 << 24) // 127**2


class Quantised:
    """int8 rows and what bounds need: scale, norm of the rounded row, of the error and of the row."""

    def __init__(self, x: np.ndarray):
        largest = np.abs(x).max(1)
        self.scale = np.where(largest > 0, largest, 1.0) / 127
        self.q = np.rint(x / self.scale[:, None]).astype(np.int8)
        rounded = self.q * self.scale[:, None]
        self.rounded = np.sqrt((rounded**2).sum(1))
        self.error = np.sqrt(((x - rounded) ** 2).sum(1))
        self.square = (x**2).sum(1)
        self.norm = np.sqrt(self.square)

    def intervals(self, other: Quantised, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Between which values the squared distances of rows a to other's rows b lie."""
        kind = np.float32 if self.q.shape[1] <= EXACT_IN_FLOAT32 else np.float64
        tile = self.q[a].astype(kind) @ other.q[b].astype(kind).T
        dot = tile * self.scale[a, None] * other.scale[None, b]
        error = self.rounded[a, None] * other.error[None, b] + self.error[a, None] * other.norm[None, b]
        total = self.square[a, None] + other.square[None, b]
        slack = 2 * error + 1e-6 * total
        return total - 2 * dot - slack, total - 2 * dot + slack


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed one dimension after another."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - q[d]) ** 2
    return np.sqrt(total)


def _build(ids: np.ndarray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, Quantised]:
    x = matrix(vectors)
    return ids, x, Quantised(x)


def _search(k: int, tile: tuple[int, int]):
    def search(index: tuple[np.ndarray, np.ndarray, Quantised], queries: pa.Table) -> pa.Table:
        ids, x, right = index
        kind = queries.column("id").type
        q, own = matrix(queries.column("v")), queries.column("id").to_numpy()
        known = queries.column("kth").to_numpy(zero_copy_only=False)  # nan: none
        huge = max(np.abs(q).max(), np.abs(x).max()) > 1e100 or min(np.abs(q).max(1).min(), np.abs(x).max(1).min()) < 1e-100
        left = Quantised(q)
        heaps: list[list[tuple[float, int]]] = [[] for _ in own]
        for a in range(0, len(q), tile[0]):
            for b in range(0, len(x), tile[1]):
                low, high = left.intervals(right, slice(a, a + tile[0]), slice(b, b + tile[1]))
                part = ids[b : b + tile[1]]
                for i in range(len(low)):
                    other = part != own[a + i]
                    heap = heaps[a + i]
                    ends = high[i][other]
                    reach = np.inf if len(ends) < k or huge else np.partition(ends, k - 1)[k - 1]
                    if not huge:
                        kth = min(heap[0][0] ** 2 if len(heap) == k else np.inf, known[a + i] ** 2 if known[a + i] == known[a + i] else np.inf)
                        reach = min(reach, kth * (1 + 1e-9))
                    alive = np.flatnonzero(other & ~(low[i] > reach))
                    for d, v in zip(distances(q[a + i], x[b + alive]).tolist(), part[alive].tolist(), strict=True):
                        entry = (-d, -v)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        flat = [(int(own[i]), -v, -d) for i, heap in enumerate(heaps) for d, v in heap]
        cols = list(zip(*flat, strict=True)) or [(), (), ()]
        return pa.table([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, shard_bytes: int = 4 << 20, tile: tuple[int, int] = (256, 4096)) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k smallest Euclidean distances among all other rows."""
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    queries = queries_of(rows, every)
    rows, shards = sharded(rows, vectors, shard_bytes)
    found = by_rounds(queries, rows, shards, k, _build, _search(k, tile), "score double", [F.asc("score")], F.col("score"), "double")
    return found.select("query_id", "rank", "vec_id", "score")
