"""One document of each group of near-duplicates (the pipeline's stage of operator 5).

Two documents are linked if their fingerprints (``tessera.llm.simhash``) differ in
at most four bits, or if their sets of runs of five words have a Jaccard similarity
of 0.8 or more. Of each connected component the document with the smallest doc_id
stays (nulls last, then the smaller hash of the text).

Similar sets are found by a prefix filter. In any common order of runs, two sets
as similar as that share one of the first n - ceil(0.8 n) + 1 runs of each; runs
that a sample of texts shares come last, which only saves comparisons. The
prefixes are shuffled once, as hashes; a stream over the sorted rows keeps the runs
that more than one set has. Two sets are compared only where the run may be the first
that they share: what comes after it in each must suffice for the similarity. In each of
the first rounds the rows of a run meet one of them, the one with the least before that
run, as it is most like the others; what it links takes its name. Rounds go on while they
spare comparisons, and what is left among rows that are not connected yet meets in the last
one; so large groups of copies make few pairs, and no link between two components
is lost. Rows of one run that are alike in nothing else are still held against each
other there, by numbers alone, and make no pairs. Candidates pass a filter of 64 one-bit minhashes, of which a pair at 0.8
has 57.6 alike on average: fewer than 40 stops it, which has a chance below
10^-9. The rest are compared as whole sets. Equal sets are one node from the start.

Only narrow rows (hashes, counts) are shuffled for candidates. The list of documents
to compare and that of rows to keep are broadcast if they were counted to be few;
else texts are dealt by row to meet them. A row that occurs many times is dealt by a
salt.

Null and empty texts are one group, as their fingerprints are all zero. Of
repeated rows (doc_id and text alike) any one stays. Empty tables give empty
results. All columns pass through, whatever their names: a row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, forget, give_back, in_reach, pieces_for, stored
from tessera.llm.simhash import RADIUS, fingerprint, links
from tessera.operators.components import components

SIGNS, LEAST_SIGNS = 64, 40
_FACTORS = (np.random.default_rng(5).integers(0, 1 << 63, SIGNS, np.uint64) << np.uint64(1)) | np.uint64(1)
_BITS = np.uint64(1) << np.arange(SIGNS, dtype=np.uint64)


def run_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; a shorter text is one run of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def signature(runs: np.ndarray) -> int:
    """One bit of the least of the runs under each of 64 orders."""
    if not runs.size:
        return 0

    def least(part: np.ndarray) -> np.ndarray:
        x = part[:, None] * _FACTORS
        x ^= x >> np.uint64(31)
        return (x * np.uint64(0xD6E8FEB86659FD93)).min(0)

    mins = np.min([least(runs[k : k + 2048]) for k in range(0, len(runs), 2048)], 0)
    return int(_BITS[(mins >> np.uint64(20)) & np.uint64(1) == 1].sum())


def _signed(values: tuple[int, ...]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _row_hash() -> Column:
    """The hash skips nulls, so that of (a, null) and (null, a) would be one without the flags."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """rid, doc_id, fp, and of the set of runs: its hash, its size, its signature. docs: rid, doc_id, text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(2):  # one text at a time
                text = t.as_py()
                runs = run_hashes(text, size)
                found.append((fingerprint(text), xxhash.xxh64_intdigest(runs.tobytes()) if runs.size else 0, len(runs), signature(runs)))
            fp, node, n, signs = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(fp), _signed(node), pa.array(n, pa.int32()), _signed(signs)], names=["rid", "doc_id", "fp", "node", "n", "signs"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(mapped, f"rid long, doc_id {kind}, fp long, node long, n int, signs long")


def _prefixes(docs: DataFrame, size: int, threshold: float, common: np.ndarray) -> DataFrame:
    """x (a run), node, n and at (how many runs of the set come before x). common: runs that come last, the rarest first."""
    held, rank = np.sort(common), np.argsort(common, kind="stable")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at_row in ((b, k) for b in batches for k in range(0, b.num_rows, 2000)):
            runs, nodes, sizes, places = [], [], [], []
            for t in whole.slice(at_row, 2000).column(0):
                h = run_hashes(t.as_py(), size)
                if not (n := len(h)):
                    continue
                late = np.zeros(n, np.int64)
                if held.size:
                    at = np.minimum(np.searchsorted(held, h), held.size - 1)
                    late = np.where(held[at] == h, rank[at] + 1, 0)
                first = min(n, n - int(np.ceil(threshold * n - 1e-9)) + 1)
                runs.append(h[np.lexsort((h, late))][:first])
                nodes.append(np.full(first, xxhash.xxh64_intdigest(h.tobytes()), np.uint64))
                sizes.append(np.full(first, n, np.int32))
                places.append(np.arange(first, dtype=np.int32))
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(t)) for c, t in ((runs, np.int64), (nodes, np.int64), (sizes, np.int32), (places, np.int32))], names=["x", "node", "n", "at"])
        give_back()

    return docs.select("text").mapInArrow(mapped, "x long, node long, n int, at int")


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """The distinct rows x, node, n, at whose x has more than one node."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, had = ["x", "node", "n", "at"], False
        x, node, n, at = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
        for b in batches:
            if not b.num_rows:
                continue
            x, node, n, at = (np.concatenate((c, b.column(i).to_numpy())) for i, c in enumerate((x, node, n, at)))
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (node[1:] != node[:-1])))
            x, node, n, at = x[new], node[new], n[new], at[new]
            before = np.concatenate(([had], x[1:] == x[:-1]))
            keep = before[:-1] | (x[1:] == x[:-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in (x, node, n, at)], names=names)
            x, node, n, at, had = x[-1:], node[-1:], n[-1:], at[-1:], bool(before[-1])
        if had:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x, node, n, at)], names=names)

    return rows.repartition(parts, "x").sortWithinPartitions("x", "node").mapInArrow(streamed, "x long, node long, n int, at int")


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b and their roots) of nodes whose sets are similar. first: node, rid of a row that has it."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                c = b.slice(k, 200)
                sets = [run_hashes(t.as_py(), size).view(np.int64) for t in c.column(1)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])
        give_back()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = in_reach(first.join(nodes, "node", "left_semi"))
    sets = docs.join(asked, "rid").select("node", "text").mapInArrow(mapped, "node long, s array<long>").dropDuplicates(["node"])
    of = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}"))
    same = F.size(F.array_intersect("s_a", "s_b"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(same >= (F.size("s_a") + F.size("s_b") - same) * threshold - 1e-9).select(*pairs.columns)


def _reach(threshold: float) -> Column:
    """The largest set that can be as similar, if x is the first run that a set of n shares with it: they share n - at runs at most."""
    return F.floor((F.col("n") - F.col("at")) * ((1 + threshold) / threshold) + 1e-6) - F.col("n")


def _plausible(a: str, b: str, threshold: float) -> Column:
    """By sizes, by what x leaves to share if it is the first run that they share, and by signatures."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    alike = SIGNS - F.bit_count(F.col(f"{a}_signs").bitwiseXOR(F.col(f"{b}_signs")))
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9) & (m <= F.col(f"{a}_reach")) & (n <= F.col(f"{b}_reach")) & (alike >= LEAST_SIGNS)


def _mixed(left: DataFrame) -> DataFrame:
    """Rows that can still meet one of another root. Of two similar sets the smaller one reaches its own size where their first shared run is."""
    small = F.col("reach") >= F.col("n")
    runs = left.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(small, F.col("n"))).alias("least"))
    return left.join(runs.where("low <> high and least is not null").select("x", "least"), "x").where(small | (F.col("least") <= F.col("reach"))).drop("least")


def _merged(good: DataFrame) -> DataFrame:
    """root, to: what each root of linked pairs is called from now on, the least root of the centres that it has met, and the least that this one has met."""
    met = good.select(F.col("other").alias("root"), F.col("centre").alias("to")).unionByName(good.select(F.col("centre").alias("root"), F.col("centre").alias("to")))
    once = cut(met.groupBy("root").agg(F.min("to").alias("to")))
    return once.join(once.select(F.col("root").alias("to"), F.col("to").alias("further")), "to", "left").select("root", F.coalesce("further", "to").alias("to"))


def similar(docs: DataFrame, profiles: DataFrame, roots: DataFrame, parts: int, size: int = 5, threshold: float = 0.8, stars: int = 2, sample: int = 64, most_common: int = 100_000, most_stars: int = 12, a_row: int = 8, few: int = 50_000) -> DataFrame:
    """Links a, b between roots that connect what is similar. docs: rid, doc_id, text; profiles: as _profiles gives them; roots: node, root of nodes that are connected already.

    There are `stars` rounds with centres, and up to most_stars as long as the last round would compare more than
    a_row pairs for each row, and more than `few` (fewer take less time than a round), and a round with centres
    spares a tenth of them.
    """
    some = docs.where(F.pmod(F.col("rid"), F.lit(sample)) == 0).select("text")
    often = _prefixes(some, size, 0.0, np.zeros(0, np.uint64)).groupBy("x").agg(F.count_distinct("node").alias("n")).where("n > 1").orderBy(F.desc("n"), "x").select("x").limit(most_common).toArrow()
    common = often.column("x").to_numpy()[::-1].copy().view(np.uint64)
    first = cut(profiles.where("n > 0").groupBy("node").agg(F.min("rid").alias("rid"), F.first("signs").alias("signs")))
    left = _shared(_prefixes(docs, size, threshold, common), parts).join(first.select("node", "signs"), "node").join(roots, "node", "left")
    left = cut(left.select("x", "node", "n", "at", "signs", F.coalesce("root", "node").alias("root"), _reach(threshold).alias("reach")))
    left = stored(_mixed(left))  # in files, and so is what is good: else sizes that the optimizer expects multiply over rounds
    first, found, k, before = first.select("node", "rid"), None, 0, None
    side = lambda name: left.select("x", *(F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "at", "signs", "root", "reach")))
    while True:
        held = left.groupBy("x").agg(F.count("*").alias("all"), F.count_if(F.col("reach") >= F.col("n")).alias("small"))
        rows, compared = held.agg(F.sum("all"), F.sum(F.col("all") * F.col("small"))).first()
        if not rows:
            break
        last = k >= stars and (k >= most_stars or compared <= max(few, a_row * rows) or (k > 0 and compared > 0.9 * before))
        before = compared
        a = side("a")
        if last:
            met = a.where("a_reach >= a_n").join(side("b"), "x").where(F.struct("a_n", "a_node") < F.struct("b_n", "b_node"))
        else:  # the set with the least before x is most like the others
            kept = ("a_node", "a_n", "a_at", "a_signs", "a_root", "a_reach")
            a = a.groupBy("x").agg(F.min(F.struct((F.col("a_at") / F.col("a_n")).alias("before"), F.xxhash64("a_node", F.lit(k)).alias("turn"), *kept)).alias("m")).select("x", *(f"m.{c}" for c in kept))
            met = a.join(side("b"), "x")
        met = met.where((F.col("a_root") != F.col("b_root")) & _plausible("a", "b", threshold))
        pairs = met.groupBy(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).agg(F.min(F.struct(F.col("a_root").alias("centre"), F.col("b_root").alias("other"))).alias("m"))
        good = stored(_verified(cut(pairs.select("a", "b", "m.centre", "m.other")), docs, first, size, threshold))
        found = good if found is None else found.unionByName(good)
        if last:
            break
        # rows that met all others of their run are done, and so are runs whose rows are connected
        rest = left.join(a.select("x", F.col("a_node").alias("node")), ["x", "node"], "left_anti").join(_merged(good), "root", "left")
        rest = cut(rest.select("x", "node", "n", "at", "signs", F.coalesce("to", "root").alias("root"), "reach"))
        old, left = left, stored(_mixed(rest))
        forget(old)
        k += 1
    if found is None:
        return left.select(F.col("root").alias("a"), F.col("root").alias("b"))
    return found.select(F.col("centre").alias("a"), F.col("other").alias("b"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, size: int = 5, threshold: float = 0.8, **how: int) -> DataFrame:
    """docs, columns as before, with one row of each group."""
    parts = pieces_for(docs, 8 << 20)
    rows = docs.select(_row_hash().alias("rid"), "doc_id", "text")
    profiles = cut(_profiles(rows, size))
    printed = cut(profiles.select("fp", "node").distinct())
    hub = cut(printed.groupBy("fp").agg(F.min("node").alias("hub")))  # a fingerprint stands for its smallest set
    of = lambda c: hub.select(F.col("fp").alias(f"fp_{c}"), F.col("hub").alias(c))
    near = cut(links(hub.select("fp"), parts, radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")))
    edges = near.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    edges = edges.unionByName(printed.join(hub, "fp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    roots = components(edges)
    whole = components(similar(rows, profiles, roots, parts, size, threshold, **how)).select(F.col("node").alias("of"), F.col("root").alias("whole"))
    label = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))
    of_node = profiles.groupBy("node").agg(F.min(label).alias("m"))
    of_node = of_node.join(roots, "node", "left").withColumn("of", F.coalesce("root", "node")).join(whole, "of", "left")
    stays = of_node.groupBy(F.coalesce("whole", "of").alias("whole")).agg(F.min("m").alias("m")).select(F.col("m.rid").alias("rid"))
    times = profiles.groupBy("rid").agg(F.count("*").alias("times"))
    stays = cut(stays.join(times, "rid"))
    whole = docs.select(_row_hash().alias("rid"), F.struct("*").alias("row"))
    once = whole.join(in_reach(stays.where("times = 1").select("rid")), "rid", "left_semi")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int")
    salted = in_reach(stays.where("times > 1").select("rid", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt")))
    repeated = whole.withColumn("salt", salt).join(salted, ["rid", "salt"], "left_semi").drop("salt").dropDuplicates(["rid"])
    return once.unionByName(repeated).select("row.*")
