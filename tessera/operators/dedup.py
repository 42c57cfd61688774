"""Exact, normalised, dual-key and near-duplicate removal; leakage and decontamination."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import _kept, _written, components
from tessera.operators.order import first_of_key


def exact(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key stays."""
    return first_of_key(df, key, order)


def dual_key(df: DataFrame, first: str, second: str, seq: str, plain_rounds: int = 2) -> DataFrame:
    """Rows in order of seq (unique); a row is accepted if neither of its keys was registered, and only then registers both.

    In rounds over the rows that are undecided: rows that are the first for both of
    their keys are accepted, and those that share a key with an accepted one are out. Where a
    row has a single earlier rival left, its fate is the opposite of that one's; such
    rows form trees, which pointer jumping settles in logarithmically many
    joins, so a long chain of rows that decide each other takes few rounds. Only
    minima by key are taken, so a key of very many rows is combined before it moves.
    A null key is no key: it neither registers nor meets another. Nothing is collected.
    """
    rows = df.select(F.col(seq).alias("s"), F.col(first).alias("a"), F.col(second).alias("b"))
    # a null key is a key of the row's own
    own = lambda c: F.struct(F.col(c).alias("k"), F.when(F.col(c).isNull(), F.col("s")).alias("s"))
    digest = lambda c: F.sha2(F.to_json(own(c)), 256)
    left, accepted, done = _written(rows.select("s", digest("a").alias("a"), digest("b").alias("b"))), None, 0
    while not left.isEmpty():
        yes, no = _settled(left, jump=done >= plain_rounds)
        accepted = yes.select("s") if accepted is None else accepted.unionByName(yes.select("s"))
        for c in "ab":
            left = left.join(yes.select(c), c, "left_anti")
        left, done = _written(left if no is None else left.join(no, "s", "left_anti")), done + 1
    return df.limit(0) if accepted is None else df.join(accepted.withColumnRenamed("s", seq), seq, "left_semi")


def _settled(left: DataFrame, jump: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of undecided rows s, a, b: those that are accepted now, and with jump those known to be out."""
    told = left
    for c in "ab":
        told = told.join(left.groupBy(c).agg(F.min("s").alias(f"{c}1")), c)
    heads = (F.col("s") == F.col("a1")) & (F.col("s") == F.col("b1"))
    if not jump:
        return _written(told.where(heads).select("s", "a", "b")), None
    told = _written(told)
    for c in "ab":
        told = told.join(told.where(F.col("s") != F.col(f"{c}1")).groupBy(c).agg(F.min("s").alias(f"{c}2")), c, "left")
    first, second = ({c: F.col("s") == F.col(f"{c}{k}") for c in "ab"} for k in (1, 2))
    rival = F.when(first["a"] & second["b"], F.col("b1")).when(second["a"] & first["b"], F.col("a1")).when(second["a"] & second["b"] & (F.col("a1") == F.col("b1")), F.col("a1"))
    told = _written(told.select("s", "a", "b", heads.alias("head"), rival.alias("to")))
    links = told.where("to IS NOT NULL").select("s", "to", F.lit(True).alias("odd"))
    while True:  # each round doubles how far a link reaches
        links = _written(links)
        nexts = links.select(F.col("s").alias("to"), F.col("to").alias("then"), F.col("odd").alias("more"))
        far = links.join(nexts, "to", "left")
        if far.where("then IS NOT NULL").isEmpty():
            break
        links = far.select("s", F.coalesce("then", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"))
    known = links.join(told.where("head").select(F.col("s").alias("to")), "to", "left_semi")
    good = told.where("head").select("s", "a", "b").unionByName(told.join(known.where("NOT odd"), "s", "left_semi").select("s", "a", "b"))
    return _written(good), known.where("odd").select("s")


def shingles(text: Column, size: int) -> Column:
    """Distinct runs of size words; a shorter text is one run of all its words, an empty one has none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return F.get(F.transform(F.array(words), runs), 0)  # bound once: an expression within a lambda is evaluated for each element


def run_hashes(text: Column, size: int) -> Column:
    """Sorted distinct hashes of the runs of size words, from one hash a word; a shorter text is one run, an empty one has none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, size)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(each)))

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 0)  # bound once


def _over_cores(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores is dealt over them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _sets(df: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """k and s, the run hashes of each row's text, written once."""
    return _written(_over_cores(df).select(F.col(key).alias("k"), run_hashes(text, size).alias("s")))


def _representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the sets that are not empty, each once, with its smallest key; and k, rep for every key. Sets are compared by 128 bits of hashes and stay where they are."""
    some = sets.where(F.size("s") > 0)
    narrow = some.select("k", F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.xxhash64(F.reverse("s")).alias("g"))
    same = narrow.groupBy("n", "h", "g").agg(F.min("k").alias("rep"))
    of = _written(narrow.join(same, ["n", "h", "g"]).select("k", "rep"))
    return _of_keys(some, of.where("k = rep").select("k")), of


def _of_keys(sets: DataFrame, keys: DataFrame, most: int = 400_000) -> DataFrame:
    """The sets of some keys. These are counted: up to `most` they are broadcast and sets stay where they are, beyond that Spark deals both by key."""
    held = _written(keys)
    return sets.join(F.broadcast(held) if held.count() <= most else held, "k", "left_semi")


def _prefixes(reps: DataFrame, threshold: float, common: np.ndarray, whole: bool = False) -> DataFrame:
    """x, k, n, at: the runs in the prefix of each set (k, s) and their places; with whole k and hs, the prefix and one run more.

    The order of runs: those that are not common by their hash, then the common ones, the rarest first.
    """
    held, rank = np.sort(common), np.argsort(common, kind="stable")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            lists, ends = b.column(1), b.column(1).offsets.to_numpy()
            every = lists.values.to_numpy()
            late = np.zeros(len(every), np.int64)
            if held.size:
                at = np.minimum(np.searchsorted(held, every), held.size - 1)
                late = np.where(held[at] == every, rank[at] + 1, 0)
            runs, lengths = [], []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = j - i
                p = n - math.ceil(n * threshold - 1e-9) + 1 + whole
                runs.append(every[i:j][np.lexsort((every[i:j], late[i:j]))][:p])
                lengths.append(len(runs[-1]))
            flat = np.concatenate(runs) if runs else np.zeros(0, np.int64)
            if whole:
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["k", "hs"])
            else:
                row = np.repeat(np.arange(b.num_rows), lengths)
                places = np.concatenate([np.arange(m) for m in lengths]) if lengths else row
                yield pa.RecordBatch.from_arrays([pa.array(flat), b.column(0).take(pa.array(row)), pa.array(np.diff(ends)[row], pa.int32()), pa.array(places, pa.int32())], names=["x", "k", "n", "at"])

    kind = reps.schema["k"].dataType.simpleString()
    return reps.select("k", "s").mapInArrow(mapped, f"k {kind}, hs array<bigint>" if whole else f"x bigint, k {kind}, n int, at int")


def _similar(reps: DataFrame, threshold: float, links_only: bool = False, crowd: int = 50, sample: int = 64, most_common: int = 100_000) -> DataFrame:
    """a, b, jaccard of distinct sets (k, s): of all pairs at or above threshold, or with links_only of enough to connect them.

    In any order of runs, a set of n has the first run that it shares with a similar one
    among its first n - ceil(threshold * n) + 1; the order puts runs last that a sample of
    sets has often, which only saves comparisons. A pair is met at each
    run that both prefixes hold, with the places of it in both; it goes on if the sizes fit
    and if what is left behind those places can still make up the overlap (the
    positional filter), and is compared once. A run in more than ``crowd`` prefixes is
    split: two sets that agree on it agree on one more of their prefixes, each a
    place longer, so they meet by both runs. With links_only such a crowd first meets one
    of its own, and crowds that this connects are done.
    """
    if threshold <= 0.5:
        raise ValueError("with a threshold of a half or less a pair may share a single run")
    some = reps.where(F.pmod(F.xxhash64("k"), F.lit(sample)) == 0).select(F.explode("s").alias("h"))
    often = some.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "h").limit(most_common).select("h").toArrow()
    common = often.column("h").to_numpy()[::-1].copy()
    placed = _written(_prefixes(reps, threshold, common))
    crowds = _written(placed.groupBy("x").agg(F.count("*").alias("m"), F.min("k").alias("one")).where("m > 1"))
    rows = _written(placed.join(crowds, "x"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9))
    side = lambda df, name, *on: df.select(*on, F.col("k").alias(name), F.col("n").alias(f"n{name}"), F.col("at").alias(f"i{name}"))
    small, large = rows.where(F.col("m") <= crowd), rows.where(F.col("m") > crowd)
    met = side(small, "a", "x").join(side(small, "b", "x"), "x").where(fits & (F.col("a") < F.col("b"))).select("a", "b")
    found = None
    if not large.isEmpty():
        if links_only:
            centre = large.where(F.col("k") == F.col("one"))
            star = side(centre, "a", "x").join(side(large, "b", "x"), "x").where("a <> b").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            found = _written(_compared(star, reps, threshold))
            hop = found.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("to"))
            named = large.join(hop, "k", "left").withColumn("to", F.coalesce("to", "k"))
            open_ = named.groupBy("x").agg(F.min("to").alias("low"), F.max("to").alias("high")).where("low <> high").select("x")
            large = _written(large.where(F.col("k") != F.col("one")).join(open_, "x", "left_semi"))  # the centre has met all of its crowd
        lists = _prefixes(_of_keys(reps, large.select("k").distinct()), threshold, common, whole=True)
        pairs = large.join(lists, "k").withColumn("y", F.explode(F.filter("hs", lambda h: h != F.col("x")))).drop("hs")
        met = met.unionByName(side(pairs, "a", "x", "y").join(side(pairs, "b", "x", "y"), ["x", "y"]).where(fits & (F.col("a") < F.col("b"))).select("a", "b"))
    out = _compared(met.distinct(), reps, threshold)
    return out if found is None else out.unionByName(found)


def _compared(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of the pairs at or above threshold: only sets that are in a pair move."""
    pairs = _written(pairs)
    asked = _of_keys(reps, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    of = lambda c: asked.select(F.col("k").alias(c), F.col("s").alias(f"s{c}"))
    same = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", (same / (F.size("sa") + F.size("sb") - same)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def jaccard_pairs(df: DataFrame, key: str, text: Column, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """A, b and jaccard of the distinct texts' pairs at or above threshold, exactly.

    Equal run sets are joined once, by their smallest key, so groups of copies make no
    pairs here (see clusters). Null and empty texts have no runs and no pairs.
    """
    reps, _ = _representatives(_sets(df, key, text, size))
    return _similar(reps, threshold)


def clusters(df: DataFrame, key: str, text: Column, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Key, cluster_id (the smallest key of its cluster) and kept. Equal run sets belong together; so do similar ones, over any number of steps. A text without runs is a cluster of its own."""
    sets = _sets(df, key, text, size)
    own = sets.where(F.coalesce(F.size("s"), F.lit(0)) <= 0).select("k", F.col("k").alias("rep"))
    reps, of = _representatives(sets)
    members = of.unionByName(own)
    roots = components(_similar(reps, threshold, links_only=True).select("a", "b"))
    least = roots.groupBy("root").agg(F.min("node").alias("cluster_id"))
    named = roots.join(least, "root").select(F.col("node").alias("rep"), "cluster_id")
    out = members.join(named, "rep", "left").select(F.col("k").alias(key), F.coalesce("cluster_id", "rep").alias("cluster_id"))
    return out.withColumn("kept", F.col(key) == F.col("cluster_id"))


def _in_pieces(patterns: DataFrame, column: str, most_chars: int) -> Iterator[list]:
    """The rows of a small table in lists of about most_chars characters, dealt by hash, so that one list at a time is in memory; their size is counted first."""
    chars = patterns.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    pieces = max(1, -(-chars // most_chars))
    for k in range(pieces):
        yield patterns.where(F.pmod(F.xxhash64(*patterns.columns), F.lit(pieces)) == k).collect()


def contained(df: DataFrame, key: str, text: Column, passages: DataFrame, pid: str, passage: Column, most_chars: int = 1 << 24) -> DataFrame:
    """J08, decontamination: the distinct key and pid where the text holds the passage, inside words too; empty and null passages are nowhere.

    All passages are looked for at once, by an Aho-Corasick automaton that each worker
    builds from a broadcast list, so a text is read once and never moves. Passages are
    counted first; beyond most_chars of them, lists of that size take turns.
    """
    p = _written(passages.select(F.col(pid).alias("pid"), passage.alias("p")).where(F.length("p") > 0).distinct())
    rows = _over_cores(df).select(F.col(key).alias("k"), text.alias("t"))
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((rows, "k"), (p, "pid"))}
    pid_type = p.select("pid").limit(0).toArrow().schema.field("pid").type
    spark, out = df.sparkSession, None
    for found in _in_pieces(p, "p", most_chars):
        by_text: dict[str, list] = {}
        for r in found:
            by_text.setdefault(r.p, []).append(r.pid)
        held = spark.sparkContext.broadcast(by_text)

        def looked_up(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for words, pids in held.value.items():
                automaton.add_word(words, pids)
            automaton.make_automaton()
            for b in batches:
                at, pids = [], []
                for i, t in enumerate(b.column(1)):
                    for one in {x for _, xs in automaton.iter(t.as_py() or "") for x in xs} if len(automaton) else ():
                        at.append(i)
                        pids.append(one)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(pids, pid_type)], names=["k", "pid"])

        each = rows.mapInArrow(looked_up, f"k {kinds['k']}, pid {kinds['pid']}")
        out = each if out is None else out.unionByName(each)
    return out.distinct().select(F.col("k").alias(key), F.col("pid").alias(pid))


def names_within(names: DataFrame, name: str, texts: DataFrame, text: Column, least: int = 7, most_chars: int = 1 << 22, noise: tuple[str, ...] = ()) -> DataFrame:
    """J08, names in a suite: distinct names of at least `least` characters that some text holds, and genuine: at least 12 characters with an underscore, and not among the noise.

    Names are many and texts few, so texts are broadcast with the places of their runs
    of `least` characters, and a name looks only where its first ones are. Texts are
    counted first; beyond most_chars of them, lists of that size take turns.
    """
    rows = names.select(F.col(name).cast("string").alias("name")).where(F.length(name) >= least).distinct()
    spark, out = names.sparkSession, None
    for found in _in_pieces(texts.select(text.alias("t")).where("t IS NOT NULL").distinct(), "t", most_chars):
        held = spark.sparkContext.broadcast([r.t for r in found])

        def looked_up(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            places: dict[str, list] = {}
            for t in held.value:
                for i in range(len(t) - least + 1):
                    places.setdefault(t[i : i + least], []).append((t, i))
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([n for n in b.column(0).to_pylist() if any(t.startswith(n, i) for t, i in places.get(n[:least], ()))], pa.string())], names=["name"])

        each = rows.mapInArrow(looked_up, "name string")
        out = each if out is None else out.unionByName(each)
    return out.distinct().withColumn("genuine", (F.length("name") >= 12) & F.contains("name", F.lit("_")) & ~F.col("name").isin(*noise))


def leakage(df: DataFrame, key: Column, order: list[str], held_out: DataFrame, held_key: Column) -> DataFrame:
    """Df with reason: "leak" if its key is held out, else "duplicate" after the first of its key, else null. Leaks are told first, so counts add up."""
    held = held_out.select(held_key.alias("_k")).distinct().withColumn("_leak", F.lit(True))
    keyed = df.withColumn("_k", key).withColumn("_label", F.struct(*order))
    first = keyed.groupBy("_k").agg(F.min("_label").alias("_first"))
    flagged = keyed.join(held, "_k", "left").join(first, "_k", "left")
    reason = F.when(F.col("_leak"), "leak").when(F.col("_label") != F.col("_first"), "duplicate")
    return flagged.withColumn("reason", reason).drop("_k", "_leak", "_label", "_first")


def without(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key is in none of the others (each with a column of that name)."""
    for other in others:
        df = df.join(other.select(key).distinct(), key, "left_anti")
    return df


def only(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """J03."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def call_sites(df: DataFrame, text: Column, at_risk: Column) -> DataFrame:
    """The distinct names called in the texts at risk."""
    return df.where(at_risk).select(F.explode(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("name")).distinct()


