"""Bootstraps of means and rank correlations by seeded Poisson weights.

A replicate gives each item a weight, drawn from a hash of item and replicate: how often it
was taken, if each were taken about once. Statistics are then weighted sums, which any
engine can repeat, and an item has the same weight wherever it occurs, so all columns
and all groups (checkpoints, say) are resampled jointly. Replicate -1 has weight 1
throughout: the sample itself.

The hash is a polynomial of degree two in 32 bits of the item's md5, modulo a prime, with
three coefficients from the md5 of seed and replicate, so weights of any three
items are independent. Thresholds of a Poisson distribution turn it into a weight.

Groups of at most ``most`` rows, which is counted first, are computed from value ranks in
arrays, many replicates at once; those with over ``ALONE`` weights are dealt by group and block
of replicates. Larger ones are never in one task: their weighted values are summed up over range
partitions (``order.running``). All give the same numbers.

Rows with a null or NaN in a column that is asked for are left out. A correlation where
one side does not vary, or of under two items, is ``degenerate``. Repeated rows of an item
have its weight each. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import _kept
from tessera.operators.order import running

PRIME = (1 << 31) - 1
#: A hash of at least the k-th of these means a weight of more than k.
THRESHOLDS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def coefficients(seed: int, replicate: int) -> tuple[int, int, int]:
    digest = hashlib.md5(f"{seed}:{replicate}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) % PRIME for k in range(3))


def item_hash(item: Column) -> Column:
    return F.conv(F.substring(F.md5(item.cast("string")), 1, 8), 16, 10).cast("long") % PRIME


def array_weights(h: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    if replicate < 0:
        return np.ones(len(h), np.int64)
    a, b, c = coefficients(seed, replicate)
    return np.searchsorted(THRESHOLDS, ((a * h + b) % PRIME * h + c) % PRIME, "right")


def column_weights(h: Column, a: Column, b: Column, c: Column) -> Column:
    u = ((a * h + b) % PRIME * h + c) % PRIME
    return reduce(lambda x, t: x + (u >= t).cast("long"), THRESHOLDS, F.lit(0).cast("long"))


#: Weights of a group that one task draws, and of all groups of a task.
ALONE = 200_000_000
#: Weights held at once.
TILE = 1 << 17
#: A worker's arrays, used again for each tile, as new memory costs more than the sums.
_ROOM: dict[tuple, np.ndarray] = {}


def _room(name: str, shape: tuple[int, int], kind: type) -> np.ndarray:
    n = shape[0] * shape[1]
    if len(_ROOM.get((name, kind), ())) < n:
        _ROOM[name, kind] = np.empty(max(n, TILE), kind)
    return _ROOM[name, kind][:n].reshape(shape)


@lru_cache(4)
def _factors(seed: int, replicates: tuple[int, ...]) -> np.ndarray:
    drawn = [coefficients(seed, r) if r >= 0 else (0, 0, 0) for r in replicates]
    return np.array([((a << 16) % PRIME, a, (b << 16) % PRIME, b, c + 0.25) for a, b, c in drawn], np.float64).reshape(-1, 5)


class Weights:
    """Weights of items (rows) for many replicates at once, the same as array_weights: a row for each replicate.

    With halves of the hashes the polynomial's sums stay below 2^50, so they are exact as
    doubles in whatever order they are added up; a quarter keeps the remainder modulo PRIME, taken as
    a fraction, off the multiples of 1 / PRIME by more than it can be wrong.
    """

    def __init__(self, h: np.ndarray, seed: int, replicates: list[int]) -> None:
        square = h * h % PRIME
        self.powers = np.array([square >> 16, square & 0xFFFF, h >> 16, h & 0xFFFF, np.ones_like(h)], np.float64)
        self.replicates = np.array(replicates, np.int64)
        self.factors = _factors(seed, tuple(replicates))

    def of(self, some: slice) -> np.ndarray:
        """Good until it is called again."""
        factors = self.factors[some]
        shape = (len(factors), self.powers.shape[1])
        u, whole, w, more = _room("u", shape, np.float64), _room("whole", shape, np.float64), _room("w", shape, np.uint8), _room("more", shape, np.bool_)
        np.matmul(factors, self.powers, out=u)
        u *= 1 / PRIME
        u -= np.floor(u, out=whole)
        limits = np.array(THRESHOLDS) / PRIME
        np.greater_equal(u, limits[0], out=w.view(np.bool_))
        for t in limits[1:4]:
            w += np.greater_equal(u, t, out=more).view(np.uint8)
        np.greater_equal(u, limits[4], out=more)
        flat, drawn = more.reshape(-1), u.reshape(-1)
        whole8 = len(flat) // 8 * 8
        near = np.flatnonzero(flat[:whole8].view(np.uint64))  # eight at a time, as few are high
        high = (8 * near[:, None] + np.arange(8)).reshape(-1)
        high = np.concatenate([high[flat[high]], whole8 + np.flatnonzero(flat[whole8:])])
        w.reshape(-1)[high] = np.searchsorted(limits, drawn[high], "right")
        w[self.replicates[some] < 0] = 1
        return w


class Ranks:
    """Spearman correlations of columns over items with weights, a row of weights at a time or many.

    Items are put in order of the columns, and those that are equal in all of them count as one. Twice a
    value's mean rank, less that of all, is a whole number: what lies below it less what lies above.
    So sums are exact, in single precision as long as the square of the weights' sum is.
    """

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        names = list(columns)
        places = {c: np.unique(v, return_inverse=True)[1] for c, v in columns.items()}
        names.sort(key=lambda c: -places[c].max(initial=0))  # the first has the most values
        self.order = np.lexsort([places[c] for c in reversed(names)])
        found = np.array([places[c][self.order] for c in names])
        new = np.ones(len(self.order), bool)
        new[1:] = (found[:, 1:] != found[:, :-1]).any(axis=0)
        self.ends = None if new.all() else np.append(np.flatnonzero(new)[1:], len(new)) - 1
        self.first, self.at = names[0], dict(zip(names, found[:, new], strict=True))
        self.size = {c: int(v.max(initial=-1)) + 1 for c, v in self.at.items()}
        #: a one for each item and its value, side by side for all columns that have few
        few = [c for c in names[1:] if self.size[c] <= 128 and len(self.at[c]) * self.size[c] <= 1 << 20]
        ends = np.cumsum([0, *(self.size[c] for c in few)])
        self.among = {c: slice(i, j) for c, i, j in zip(few, ends, ends[1:], strict=False)}
        ones = np.zeros((len(self.order) if self.ends is None else len(self.ends), ends[-1]), np.float32)
        for c in few:
            ones[np.arange(len(ones)), ends[few.index(c)] + self.at[c]] = 1
        self.ones = {np.float32: ones, np.float64: ones.astype(np.float64)}
        self.signs = {c: np.sign(np.arange(self.size[c]) - np.arange(self.size[c])[:, None]).astype(np.float64) for c in few}

    def _sums(self, v: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
        """Of each row of v, by value of the columns."""
        out = {c: np.array([np.bincount(self.at[c], x, self.size[c]) for x in v]) for c in wanted - set(self.among)}
        if wanted & set(self.among):
            sums = (v @ self.ones[v.dtype.type]).astype(np.float64, copy=False)
            out |= {c: sums[:, self.among[c]] for c in wanted & set(self.among)}
        return out

    def _weights(self, w: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
        """_sums of weights. In single precision their sums have 12 of the 24 bits, so two replicates are added up as one."""
        if w.dtype != np.float32 or len(w) < 2 or not wanted <= set(self.among):
            return self._sums(w, wanted)
        half = len(w) // 2
        two = _room("two", (half, w.shape[1]), np.float32)
        np.multiply(w[half : 2 * half], 4096, out=two)
        two += w[:half]
        both, odd = self._sums(two, wanted), self._sums(w[2 * half :], wanted)
        upper = {c: np.floor(v / 4096) for c, v in both.items()}
        return {c: np.concatenate([v - 4096 * upper[c], upper[c], odd[c]]) for c, v in both.items()}

    def correlations(self, w: np.ndarray, pairs: dict[str, tuple[str, str]]) -> dict[str, np.ndarray]:
        """w: a row of weights of items in self.order for each replicate. NaN where a side does not vary or there are under two items."""
        long = np.int32 if w.shape[1] < 1 << 27 else np.int64
        upto = np.cumsum(w, axis=1, dtype=long, out=_room("upto", w.shape, long))
        total = upto[:, -1:].astype(np.float64)
        n = total[:, 0]
        if self.ends is not None:
            upto = upto[:, self.ends]
            w = np.diff(upto, axis=1, prepend=0)
        kind = np.float32 if n.max(initial=0) < 4096 else np.float64
        given, w = w, _room("weights", w.shape, kind)
        w[:] = given
        over: dict[str, np.ndarray] = {}  # by value: what is below less what is above
        spread: dict[str, np.ndarray] = {}  # 12 times the ranks' squares
        by_value = self._weights(w, {c for pair in pairs.values() for c in pair} - {self.first})
        for c in {c for pair in pairs.values() for c in pair}:
            if c == self.first and self.ends is None and self.size[c] == w.shape[1]:
                over[c] = each = _room("over", w.shape, kind)
                np.multiply(w, w, out=each)
                spread[c] = n * n * n - np.einsum("ij,ij->i", each, w)
                each[:] = upto
                each *= 2
                each -= w
                each -= total.astype(kind)
                continue
            if c == self.first:
                last = np.append(np.flatnonzero(np.diff(self.at[c])), w.shape[1] - 1)
                t = np.diff(upto[:, last], axis=1, prepend=0).astype(np.float64)
            else:
                t = by_value[c]
            over[c] = t @ self.signs[c] if c in self.signs else 2 * np.cumsum(t, axis=1) - t - total
            spread[c] = np.einsum("ij,ij,ij->i", t, total - t, total + t)
        ordered = {name: sorted(pair, key=lambda c: -self.size[c]) for name, pair in pairs.items()}
        moved = {}
        for x in {x for x, _ in ordered.values()}:
            each = over[x] if x == self.first and self.size[x] == w.shape[1] else over[x][:, self.at[x]]
            moved[x] = self._sums(np.multiply(w, each, out=_room("moved", w.shape, kind), casting="same_kind"), {b for a, b in ordered.values() if a == x})
        out = {}
        for name, (x, y) in ordered.items():
            both = np.einsum("ij,ij->i", moved[x][y], over[y].astype(np.float64, copy=False))
            varies = (n >= 2) & (spread[x] > 0.5) & (spread[y] > 0.5)
            out[name] = np.where(varies, 3 * both / np.sqrt(np.where(varies, spread[x], 1)) / np.sqrt(np.where(varies, spread[y], 1)), np.nan)
        return out


def resampled(df: DataFrame, by: list[str], item: str, pairs: dict[str, tuple[str, str]], means: dict[str, str], resamples: int = 2000, seed: int = 42, degenerate: float | None = 0.0, most: int = 1_000_000, block: int = 250) -> DataFrame:
    """by, replicate (from -1), and for each name of pairs a Spearman correlation, of means a mean."""
    parts = _parts(df, by, item, pairs, means, resamples, most)
    draws = (pairs, means, resamples, seed, degenerate)
    out = [_in_tasks(parts["whole"], by, *draws, resamples)]
    if "blocks" in parts:
        out.append(_in_tasks(parts["blocks"], by, *draws, block))
    if "spread" in parts:
        out.append(_spread(parts["spread"], by, *draws))
    return reduce(DataFrame.unionByName, out)


def intervals(df: DataFrame, by: list[str], item: str, pairs: dict[str, tuple[str, str]], means: dict[str, str], of: dict[str, float], resamples: int = 2000, seed: int = 42, degenerate: float | None = 0.0, most: int = 1_000_000, block: int = 250) -> DataFrame:
    """bounds() of a sum of what resampled() gives, each times its number in ``of``. Replicates of groups that are whole in a task do not leave it."""
    parts = _parts(df, by, item, pairs, means, resamples, most)
    draws = (pairs, means, resamples, seed, degenerate)
    out = [_in_tasks(parts["whole"], by, *draws, resamples, of)]
    value = reduce(lambda x, y: x + y, (F.col(n) * k for n, k in of.items()))
    if "blocks" in parts:
        out.append(bounds(_in_tasks(parts["blocks"], by, *draws, block), by, value))
    if "spread" in parts:
        out.append(bounds(_spread(parts["spread"], by, *draws), by, value))
    return reduce(DataFrame.unionByName, out)


def rank_correlation(df: DataFrame, by: list[str], item: str, x: str, y: str, degenerate: float | None = None) -> DataFrame:
    """by, rho: Spearman's of the rows themselves, without a window over a group: large groups are ranked over range partitions."""
    return resampled(df, by, item, {"rho": (x, y)}, {}, resamples=0, degenerate=degenerate).drop("replicate")


def _parts(df: DataFrame, by: list[str], item: str, pairs: dict, means: dict, resamples: int, most: int) -> dict[str, DataFrame]:
    """Rows with hashes and values, by how their groups are computed: whole in a task, dealt by blocks of replicates, or spread."""
    columns = _columns(pairs, means)
    value = lambda c: F.col(c).cast("double").alias(c)
    rows = df.select(*by, item_hash(F.col(item)).alias("_h"), *map(value, columns)).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    sizes = _kept(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    total, largest = (x or 0 for x in sizes.agg(F.sum("_n"), F.max("_n")).first())  # one row
    alone = min(most, ALONE // max(resamples, 1))
    parts = {"whole": rows if largest <= alone else _of(rows, sizes.where(F.col("_n") <= alone), by)}
    if largest > alone and not (middle := sizes.where((F.col("_n") > alone) & (F.col("_n") <= most))).isEmpty():
        parts["blocks"] = _of(rows, middle, by)
    if largest > most:
        parts["spread"] = _of(rows, sizes.where(F.col("_n") > most), by)
    tasks = -(-total * resamples // ALONE)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        parts["whole"] = parts["whole"].repartition(tasks, *by)
    return parts


def _columns(pairs: dict, means: dict) -> list[str]:
    return sorted({c for pair in pairs.values() for c in pair} | set(means.values()))


def _of(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    theirs = groups.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)))
    return rows.join(theirs, reduce(lambda x, i: x & F.col(by[i]).eqNullSafe(F.col(f"_g{i}")), range(len(by)), F.lit(True)), "left_semi")


def _in_tasks(rows: DataFrame, by: list[str], pairs: dict, means: dict, resamples: int, seed: int, degenerate: float | None, block: int, of: dict[str, float] | None = None) -> DataFrame:
    """A task has a block of the replicates of a group. of: instead of replicates, bounds of their sum; block is then all."""
    blocks = max(-(-resamples // max(block, 1)), 1)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else rows
    fields = [*((c, kinds[c]) for c in by), *([(c, "double") for c in ("estimate", "low", "high")] if of else [("replicate", "int"), *((n, "double") for n in [*pairs, *means])])]

    def computed(key: tuple, table: pa.Table) -> pa.Table:
        first = key[len(by)].as_py() * block if blocks > 1 else 0
        chosen = [*([-1] if first == 0 else []), *range(first, min(first + block, resamples))]
        found = _found({c: table.column(c).to_numpy() for c in ["_h", *_columns(pairs, means)]}, pairs, means, seed, chosen)
        for name in pairs:
            if degenerate is not None:
                found[name][np.isnan(found[name])] = degenerate
        if of:
            rows, last = 1, {c: pa.array([v], pa.float64()) for c, v in _bounds(sum(found[n] * k for n, k in of.items())).items()}
        else:
            rows, last = len(chosen), {"replicate": pa.array(chosen, pa.int32())} | {n: pa.array(v, pa.float64(), mask=np.isnan(v)) for n, v in found.items()}
        held = [pa.array([k.as_py()] * rows, table.column(c).type) for k, c in zip(key, by, strict=False)]
        return pa.table([*held, *last.values()], names=[n for n, _ in fields])

    return dealt.groupBy(*by, *(["_block"] if blocks > 1 else [])).applyInArrow(computed, ", ".join(f"`{n}` {t}" for n, t in fields))


def _found(values: dict[str, np.ndarray], pairs: dict, means: dict, seed: int, chosen: list[int]) -> dict[str, np.ndarray]:
    """Of each name a number for each chosen replicate, or NaN."""
    ranks = Ranks({c: values[c] for pair in pairs.values() for c in pair}) if pairs else None
    order = ranks.order if ranks else slice(None)
    weights = Weights(values["_h"][order], seed, chosen)
    averaged = {n: values[c][order] for n, c in means.items()}
    found = {n: np.empty(len(chosen)) for n in [*pairs, *means]}
    step = max(TILE // len(values["_h"]), 1)
    for at in range(0, len(chosen), step):
        some = slice(at, at + step)
        w = weights.of(some)
        for name, rho in (ranks.correlations(w, pairs) if ranks else {}).items():
            found[name][some] = rho
        if means:
            w = w.astype(np.float64)
            total = w.sum(axis=1)
            for name, v in averaged.items():
                found[name][some] = np.where(total > 0, w @ v / np.where(total > 0, total, 1), np.nan)
    return found


def _bounds(values: np.ndarray) -> dict[str, float | None]:
    """bounds() of a group's values, the sample's first, with the quantiles of Spark's percentile."""
    drawn = np.sort(values[1:][~np.isnan(values[1:])])

    def quantile(q: float) -> float | None:
        if not len(drawn):
            return None
        place = (len(drawn) - 1) * q
        low, high = math.floor(place), math.ceil(place)
        return float(drawn[low] if low == high or drawn[low] == drawn[high] else (high - place) * drawn[low] + (place - low) * drawn[high])

    return {"estimate": None if np.isnan(values[0]) else float(values[0]), "low": quantile(0.025), "high": quantile(0.975)}


def _spread(rows: DataFrame, by: list[str], pairs: dict, means: dict, resamples: int, seed: int, degenerate: float | None) -> DataFrame:
    draws = F.array(*(F.struct(F.lit(r).alias("replicate"), *(F.lit(v).cast("long").alias(n) for n, v in zip("abc", coefficients(seed, r), strict=True))) for r in range(-1, resamples)))
    each = rows.withColumn("_d", F.explode(draws))
    weight = F.when(F.col("_d.replicate") < 0, F.lit(1).cast("long")).otherwise(column_weights(F.col("_h"), F.col("_d.a"), F.col("_d.b"), F.col("_d.c")))
    drawn = each.withColumn("replicate", F.col("_d.replicate")).withColumn("_w", weight).where("_w > 0").drop("_d", "_h")
    group = [*by, "replicate"]
    for c in sorted({c for pair in pairs.values() for c in pair}):
        cells = running(drawn.groupBy(*group, c).agg(F.sum("_w").alias("_c")), group, [F.col(c)], F.col("_c"), "_below")
        theirs = cells.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*group, c])), (F.col("_below") + (F.col("_c") + 1) / 2).alias(f"_r_{c}"))
        same = reduce(lambda x, i: x & F.col([*group, c][i]).eqNullSafe(F.col(f"_k{i}")), range(len(group) + 1), F.lit(True))  # noqa: B023
        drawn = drawn.join(theirs, same).drop(*(f"_k{i}" for i in range(len(group) + 1)))
    w, n = F.col("_w"), F.sum("_w")
    out = []
    for name, (x, y) in pairs.items():
        a, b = F.col(f"_r_{x}"), F.col(f"_r_{y}")
        middle = (n + 1) / 2  # of ranks that share ties
        va, vb, both = F.sum(w * a * a) - n * middle * middle, F.sum(w * b * b) - n * middle * middle, F.sum(w * a * b) - n * middle * middle
        out.append(F.when((n < 2) | (va < 1e-9) | (vb < 1e-9), degenerate).otherwise(both / F.sqrt(va * vb)).cast("double").alias(name))
    out += [(F.sum(w * F.col(c)) / n).alias(name) for name, c in means.items()]
    return drawn.groupBy(*group).agg(*out).withColumn("replicate", F.col("replicate").cast("int"))


def bounds(found: DataFrame, by: list[str], value: Column, linear: bool = True) -> DataFrame:
    """by, estimate, low, high: 95 % bounds of value over the replicates, interpolated (linear) or at sorted places; null and NaN replicates are left out."""
    rows = found.select(*by, "replicate", F.when(~F.isnan(value), value).alias("_v"))
    drawn = F.when((F.col("replicate") >= 0) & F.col("_v").isNotNull(), F.col("_v"))
    if linear:
        low, high = (F.percentile(drawn, F.lit(q)) for q in (0.025, 0.975))
    else:
        held = F.sort_array(F.collect_list(drawn))  # one number for each replicate
        place = lambda q: F.get(held, F.least(F.size(held) - 1, F.floor(F.size(held) * q).cast("int")))
        low, high = place(0.025), place(0.975)
    return rows.groupBy(*by).agg(F.max(F.when(F.col("replicate") < 0, F.col("_v"))).alias("estimate"), low.alias("low"), high.alias("high"))


def weights_sql(item: str, resamples: int, seed: int = 42) -> str:
    """DuckDB tables d (replicate, a, b, c; replicate -1 has none) and h, for texts that stand for the weights of ``item``."""
    part = lambda k: f"('0x' || substr(md5('{seed}:' || r), {8 * k + 1}, 8))::BIGINT % {PRIME}"
    return f"d AS (SELECT r::INT AS replicate, {part(0)} AS a, {part(1)} AS b, {part(2)} AS c FROM range(-1, {resamples}) t(r))", f"('0x' || substr(md5(({item})::VARCHAR), 1, 8))::BIGINT % {PRIME}", "CASE WHEN replicate < 0 THEN 1 ELSE " + " + ".join(f"(((a * h + b) % {PRIME} * h + c) % {PRIME} >= {t})::INT" for t in THRESHOLDS) + " END"
