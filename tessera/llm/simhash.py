"""Near-duplicates by SimHash and covering locality-sensitive hashing (operator 5).

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of four
words joined by single spaces with repeats, XXH64 with seed 42 of each; a bit is
set if more than half of the hashes have it. Fewer words make one shingle of
all; none make the fingerprint zero, which links like any other.

Linking: ``radius`` = 4. Each bit gets a vector of radius + 1 binary digits, and
each of the 31 nonzero vectors v makes a mask of the bits whose vector has odd
overlap with v. Up to four differing bits have vectors that span at most four
dimensions, so some v is orthogonal to them all: its mask leaves all of them
out, and the pair agrees in that table. So every pair within the radius meets,
whatever the data; each mask keeps 32 to 34 bits.

Distinct fingerprints are hashed into 31 tables, dealt by key and sorted; a
stream over sorted rows compares within a bucket and gives a spanning forest of
its links, never all pairs. A bucket with more than ``most`` fingerprints is
not compared but hashed once more, by 31 masks over other bits, until buckets
are small: the guarantee holds at each level. Components come from
``tessera.operators.components``.

For the near-duplicate stage see ``tessera.llm.similar``, which adds exact
similarity over runs of words.

Nulls: null text counts as empty; null doc_ids belong to components and are
never their names (a component of nulls alone has a null name). Ties and
repeated rows share a fingerprint and so a component. Empty tables give empty
results; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, pieces_for
from tessera.operators.components import components

BITS, RADIUS = 64, 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(first), 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each row."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(mapped, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def masks(level: int = 0, radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks as signed longs. Each level gives the bits other vectors."""
    count = (1 << (radius + 1)) - 1
    vector = [((i * (2 * level + 1) + 5 * level) % BITS) % count + 1 for i in range(BITS)]
    made = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, count + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def forest(values: np.ndarray, radius: int) -> tuple[list, list]:
    """A spanning forest of the links among distinct fingerprints."""
    a, b, left = [], [], values
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hits = left[near].tolist()
                left = left[~near]
                a += [int(x)] * len(hits)
                b += hits
                queue += map(np.uint64, hits)
    return a, b


def _linked(rows: DataFrame, level: int, radius: int, most: int, parts: int) -> DataFrame:
    """Of rows bucket, fp: forests of links (a, b), and with over = the bucket, a = the fingerprint, what is too large to compare."""
    keyed = rows.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(level, radius)))).alias("v", "part"), "bucket")
    keyed = keyed.select(F.xxhash64("bucket", "v", "part").alias("key"), "fp")  # a clash of keys only costs a comparison

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, over=None):
            over = pa.nulls(len(a), pa.int64()) if over is None else pa.array(over)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), over], names=["a", "b", "over"])

        keys, fps, over_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        stream = iter(batches)
        while True:
            batch = next(stream, None)
            if batch is not None:
                keys = np.concatenate((keys, batch.column(0).to_numpy()))
                fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
                done = int(np.searchsorted(keys, keys[-1])) if keys.size and keys[0] != keys[-1] else 0
                if over_key is None and keys.size - done > most:
                    over_key = keys[-1]
                elif not done and over_key is None:
                    continue
            else:
                done = keys.size
            if over_key is not None:  # rows of a bucket known to be too large go on at once
                n = int(np.searchsorted(keys, over_key, "right")) if done == keys.size or keys[-1] != over_key else keys.size
                first = int(np.searchsorted(keys, over_key))
                if n > first:
                    yield out(fps[first:n], np.zeros(n - first), keys[first:n])
                rest_keys, rest_fps = keys[n:], fps[n:]
                keys, fps = keys[:first], fps[:first]
                if rest_keys.size or batch is None:
                    over_key = None
                done = first
            else:
                rest_keys, rest_fps = keys[done:], fps[done:]
            k, f = keys[:done], fps[:done]
            if done:
                begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                size = np.diff(np.append(begin, done))
                two = begin[size == 2]
                near = np.bitwise_count(f[two] ^ f[two + 1]) <= radius
                a, b = f[two[near]].tolist(), f[two[near] + 1].tolist()
                for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                    x, y = forest(f[at : at + n], radius)
                    a += x
                    b += y
                if a:
                    yield out(a, b)
            keys, fps = rest_keys, rest_fps
            if batch is None:
                if not keys.size:
                    return
                stream = iter(())

    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(compared, "a long, b long, over long")


def links(fps: DataFrame, parts: int, radius: int = RADIUS, most: int = 50_000, levels: int = 6) -> DataFrame:
    """Edges a, b that connect what is within radius, of distinct fingerprints in column fp."""
    rows, found = fps.select("fp", F.lit(0).cast("long").alias("bucket")), []
    for level in range(levels):
        got = cut(_linked(rows, level, radius, most if level + 1 < levels else 1 << 62, parts))
        found.append(got.where(F.col("over").isNull()).select("a", "b"))
        over = got.where(F.col("over").isNotNull()).select(F.col("over").alias("bucket"), F.col("a").alias("fp"))
        if over.isEmpty():
            break
        rows = over
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def grouped(docs: DataFrame, radius: int = RADIUS, most: int = 50_000) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    parts = pieces_for(docs, 8 << 20)
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), parts, radius, most))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return prints.join(by_print, prints.fp == by_print.of_fp).drop("of_fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs, radius=radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
