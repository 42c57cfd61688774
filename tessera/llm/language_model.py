"""Stupid-backoff scores of documents under n-gram counts of the whole corpus (operator 2).

S(w | context) is the relative frequency of w after the longest context with
which it occurs, times ``backoff`` for each word by which the context had to be
shortened; a word that occurs nowhere else counts as seen once. With
``leave_one_out`` a document's own n-grams are taken from the counts, so every
document is scored by the rest of the corpus.

The relations are these, with an n-gram as the 64-bit hash of its words:

* n-grams exploded from documents, summed in a block of documents, and dealt by
  hash range (rows: range, block, sorted hashes, counts);
* the count table, each hash range in one group, which adds up all blocks;
* the join of both, from which each block gets its n-grams' counts back;
* the sum of log S over each document's words.

Sets of rows travel packed (differences of sorted hashes, deflated), about a
third of what plain rows take, and texts as zstd. A packed row holds what one block
has in one hash range and is sent only if that is anything, so there are never
more rows than n-grams. Documents are dealt to blocks at random, so neither a source
with a third of all rows nor a row that is often repeated makes a large block; a
frequent n-gram is one entry for each block. The group of a hash range and a block
are both bounded; a block grows only with its longest document.

Null and empty texts have no words and a null mean score. Repeated rows are
documents each (with leave_one_out each is scored by the others). An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import pieces_for


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences, byte by byte of all of them, deflated."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _large(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class Block:
    """The n-grams of some documents. grams[k]: hash (to score: place) of the k+1 words up to each word; valid[k]: whether the document has so many."""

    def __init__(self, texts: list[str | None], order: int, to_score: bool = False):
        known: dict[bytes, int] = {}
        digest = xxhash.xxh64_intdigest
        hashes, lengths = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            lengths.append(len(words))
            for w in words:
                if w not in known:
                    known[w] = digest(w, 1)
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(h)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.grams, self.valid = [_mixed(np.full(len(h), 1, np.uint64), h)], [np.ones(len(h), bool)]
        for k in range(1, order):
            before = np.concatenate((np.zeros(1, np.uint64), self.grams[-1][:-1])) if len(h) else h
            self.grams.append(_mixed(before, h))
            self.valid.append(place >= k)
        every = np.concatenate([g[v] for g, v in zip(self.grams, self.valid, strict=True)])
        self.grams = []
        if not to_score:
            self.distinct, self.counts = np.unique(every, return_counts=True)
            return
        self.distinct, back, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        begin = 0  # from here on, grams are places among distinct
        for v in self.valid:
            at = np.zeros(len(v), np.int64)
            at[v] = back[begin : (begin := begin + int(v.sum()))]
            self.grams.append(at)

    def scores(self, counts: np.ndarray, total: int, backoff: float, leave_one_out: bool) -> np.ndarray:
        """Of each document the sum of log10 S. counts: of self.distinct."""
        left = []
        for at, v in zip(self.grams, self.valid, strict=True):
            n = counts[at]
            if leave_one_out:
                n -= 1
                more = np.flatnonzero(v & (self.counts[at] > 1))  # others occur once in the block, so once in their document
                _, back, own = np.unique(self.doc[more] * len(self.distinct) + at[more], return_inverse=True, return_counts=True)
                n[more] -= own[back] - 1
            left.append(np.where(v, n, 0))
        rest = total - (self.lengths[self.doc] if leave_one_out else 0)
        s = np.maximum(left[0], 1) / np.maximum(rest, 1)
        for k in range(1, len(left)):
            context = np.concatenate((np.ones(1, np.int64), left[k - 1][:-1]))
            s = np.where(self.valid[k], np.where(left[k] > 0, left[k] / np.maximum(context, 1), backoff * s), s)
        return np.bincount(self.doc, np.log10(s), len(self.lengths))


def stupid_backoff(docs: DataFrame, order: int = 3, backoff: float = 0.4, leave_one_out: bool = True, block_bytes: int = 5 << 20) -> DataFrame:
    """doc_id, words, log10_score (summed over words), mean_log10."""
    blocks = pieces_for(docs, block_bytes)
    ranges = blocks
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(3)
        for b in batches:
            texts = [small.compress(t.as_buffer()) if t.is_valid else None for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], names=["block", "doc_id", "text"])

    def texts_of(table: pa.Table) -> list[str | None]:
        large = zstandard.ZstdDecompressor()
        return [None if t is None else large.decompress(t).decode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]

    # dealt by place in the input, so that rows that are alike are spread as well
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    rows = docs.select(number.alias("block"), "doc_id", "text").mapInArrow(packed, f"block long, doc_id {kind}, text binary")

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        b = Block(texts_of(table), order)
        edges = np.searchsorted(b.distinct, np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)) if ranges > 1 else np.zeros(0, int)
        spans = [(r, x, y) for r, (x, y) in enumerate(zip([0, *edges], [*edges, len(b.distinct)], strict=True)) if y > x]
        block = key[0].as_py()
        return pa.table([pa.array([s[0] for s in spans], pa.int64()), pa.array([block] * len(spans), pa.int64()), pa.array([_pack(b.distinct[x:y]) for _, x, y in spans], pa.binary()), pa.array([_small(b.counts[x:y]) for _, x, y in spans], pa.binary())], names=["range", "from_block", "grams", "counts"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        grams = [_unpack(g) for g in table.column("grams").to_pylist()]
        counts = np.concatenate([_large(c) for c in table.column("counts").to_pylist()])
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(back, counts).astype(np.int64)[back]
        ends = np.cumsum([len(g) for g in grams])
        parts = [_small(x) for x in np.split(sums, ends[:-1])]
        return pa.table([table.column("range"), table.column("from_block"), pa.array(parts, pa.binary())], names=["range", "to_block", "sums"])

    def scored(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(texts_of(table), order, to_score=True)
        ordered = answers.sort_by("range").column("sums").to_pylist()
        if len(b.distinct):
            sums = b.scores(np.concatenate([_large(x) for x in ordered]), total, backoff, leave_one_out)
        else:
            sums = np.zeros(len(b.lengths))
        return pa.table([table.column("doc_id"), pa.array(b.lengths), pa.array(sums)], names=["doc_id", "words", "log10_score"])

    sent = rows.groupBy("block").applyInArrow(counted, "range long, from_block long, grams binary, counts binary")
    answers = sent.groupBy("range").applyInArrow(added, "range long, to_block long, sums binary")
    out = rows.groupBy("block").cogroup(answers.groupBy("to_block")).applyInArrow(scored, f"doc_id {kind}, words long, log10_score double")
    return out.withColumn("mean_log10", F.when(F.col("words") > 0, F.col("log10_score") / F.col("words")))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (SELECT r, unnest(ws) AS w3, unnest(range(len(ws))) AS i FROM words
), g AS (SELECT r, i, w3, lag(w3) OVER w AS w2, lag(w3, 2) OVER w AS w1 FROM t WINDOW w AS (PARTITION BY r ORDER BY i)
), a AS (
  SELECT r, i,
    count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY r, w3) AS c1,
    CASE WHEN i >= 1 THEN count(*) OVER (PARTITION BY i >= 1, w2, w3) - count(*) OVER (PARTITION BY i >= 1, r, w2, w3) END AS c2,
    CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY i >= 2, w1, w2, w3) - count(*) OVER (PARTITION BY i >= 2, r, w1, w2, w3) END AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY r) AS n
  FROM g
), b AS (SELECT *, lag(c1) OVER w AS d2, lag(c2) OVER w AS d3 FROM a WINDOW w AS (PARTITION BY r ORDER BY i)
), s1 AS (SELECT *, greatest(c1, 1) / greatest(n, 1)::DOUBLE AS p1 FROM b
), s2 AS (SELECT *, CASE WHEN i < 1 THEN p1 WHEN c2 > 0 THEN c2 / d2::DOUBLE ELSE {backoff} * p1 END AS p2 FROM s1
), s3 AS (SELECT r, log10(CASE WHEN i < 2 THEN p2 WHEN c3 > 0 THEN c3 / d3::DOUBLE ELSE {backoff} * p2 END) AS s FROM s2
), sums AS (SELECT r, count(*) AS n, sum(s) AS total FROM s3 GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS words, round(coalesce(total, 0.0), 6) AS log10_score, round(total / n, 6) AS mean_log10
FROM words LEFT JOIN sums USING (r)
"""
