"""Toxicity by a factorization machine over hashed terms (operator 7).

A text's terms are its lower-cased words and the first four and five letters of
longer words, each hashed to 64 bits and present or not. The machine adds a
bias, a weight for each term and the inner product of the factors of each two
terms, so a pair (an insult with the mention of a group) can weigh what neither
term does alone.

Learning takes at most ``sample`` labelled rows, those with the smallest hash of
doc_id, from rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``.
Every term has a place, its hash modulo ``width``, so none is left out and the
model's size is fixed whatever the input. Texts are turned into places on the
executors; one task learns from those of the bounded sample, and only the model
reaches the driver. Scoring is a map
over all documents and reads nothing but the text.

Null text counts as empty and is scored by the bias. Rows with null doc_id are
scored and never learned from; a doc_id that is labelled several times counts
as toxic if any label says so; null labels are ignored. Without labels of both
kinds each score is the labelled rows' rate of toxic ones (0 without any).
Columns other than doc_id and text of documents are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import give_back

WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """64-bit hashes of a word and of its beginnings."""
    parts = [word]
    if len(word) > 4:
        parts.append(f"{word[:4]}-")
    if len(word) > 5:
        parts.append(f"{word[:5]}-")
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in parts]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """bias + w·x + the factors' pairwise inner products, through a logistic function. A term's place is its hash modulo the width."""

    bias: float
    w: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))

    def score(self, active: np.ndarray | list[int]) -> float:
        z = self.bias
        if len(active):
            f = self.v[active].astype(np.float64)
            z += float(self.w[active].sum(dtype=np.float64)) + 0.5 * float((f.sum(0) ** 2 - (f**2).sum(0)).sum())
        return 1 / (1 + float(np.exp(-min(40.0, max(-40.0, z)))))


def values(rows: list[np.ndarray], labels: np.ndarray, width: int, soft: float) -> np.ndarray:
    """Of each place the value of a term there, from 0 to 1: q / (q + soft), where q is its chi-squared with the labels. No place is cut off."""
    places = np.concatenate(rows)
    n, p = np.bincount(places, minlength=width), np.bincount(places, np.repeat(labels, [len(r) for r in rows]), width)
    rate = labels.mean()
    q = (p - n * rate) ** 2 / np.maximum(n, 1) / (rate * (1 - rate))
    return q / (q + soft)


def learn(rows: list[np.ndarray], labels: np.ndarray, width: int, soft: float = 20.0, rank: int = 8, epochs: int = 12, least_steps: int = 200, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on the logistic loss. rows: the places of each text's terms."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(width, np.float32), rng.normal(0, 0.02, (width, rank)).astype(np.float32), 0.0
    gw, gv, gb = np.full(width, 1e-4, np.float32), np.full((width, rank), 1e-4, np.float32), 1e-4
    y = labels.astype(np.float64)
    x = values(rows, y, width, soft)
    sums_of = lambda x, ends: np.diff(np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)))[ends], axis=0)
    for _ in range(max(epochs, -(-least_steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            sizes = np.array([len(rows[i]) for i in part])
            ends = np.concatenate(([0], np.cumsum(sizes)))
            terms, back = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            own = x[terms]
            f = v[terms] * own[:, None]
            sums = sums_of(f[back], ends)
            z = bias + sums_of((w[terms] * own)[back], ends) + 0.5 * ((sums**2).sum(1) - sums_of((f**2).sum(1)[back], ends))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            of_row = np.repeat(np.arange(len(part)), sizes)
            each = err[of_row]
            db, dw = float(err.sum()), np.bincount(back, each, len(terms)) * own
            dv = np.stack([np.bincount(back, each * sums[of_row, j], len(terms)) for j in range(rank)], 1) * own[:, None] - dw[:, None] * f + decay * v[terms]
            dw = dw + decay * w[terms]
            gb += db * db
            gw[terms] += dw * dw
            gv[terms] += dv * dv
            bias -= rate * db / gb**0.5
            w[terms] -= rate * dw / np.sqrt(gw[terms])
            v[terms] -= rate * dv / np.sqrt(gv[terms])
    return bias, (w * x).astype(np.float32), (v * x[:, None]).astype(np.float32)


def places(text: str | None, width: int, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """The places of a text's terms; known remembers those of words."""
    active: set[int] = set()
    for w in words(text):
        if (got := known.get(w)) is None:
            if len(known) > 100_000:
                known.clear()
            got = known[w] = tuple(h % width for h in word_terms(w))
        active.update(got)
    return np.fromiter(active, np.int64, len(active))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, width: int = 1 << 18, folds: int = 4, held_out: int = 2, label: str = "toxic") -> Machine:
    """The machine from the labelled rows that may be learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held_out))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            found = [np.sort(places(t.as_py(), width, known)).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "terms"])
        known.clear()
        give_back()

    # chosen has at most `sample` narrow rows; of rows that share a doc_id one is learned from, so no more than that are collected
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    seen = texts.mapInArrow(hashed, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, terms binary")
    rows = seen.groupBy("doc_id", "y").agg(F.min("terms").alias("terms")).select("y", "terms")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        table = pa.Table.from_batches(parts).sort_by([("terms", "ascending"), ("y", "ascending")]) if parts else None
        y = table.column("y").to_numpy() if table else np.zeros(0)
        if not len(y) or y.sum() in (0, len(y)):
            rate = float(y.mean()) if len(y) else 0.0
            bias, w, v = float(np.log(max(rate, 1e-12) / max(1 - rate, 1e-12))), np.zeros(1, np.float32), np.zeros((1, 1), np.float32)
        else:
            bias, w, v = learn([np.frombuffer(t, "<u4") for t in table.column("terms").to_pylist()], y, width)
        yield pa.RecordBatch.from_arrays([pa.array([bias], pa.float64()), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["bias", "w", "v"])
        give_back()

    # one task learns from the bounded sample; the driver gets the model, whose size is fixed
    bias, w, v = rows.repartition(1).mapInArrow(learned, "bias double, w binary, v binary").first()
    w = np.frombuffer(w, np.float32)
    return Machine(bias, w, np.frombuffer(v, np.float32).reshape(len(w), -1))


def _score(machine: Machine) -> Column:
    """The score of the column text; only texts go to Python, and only numbers come back."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[int, ...]] = {}
        for part in texts:
            yield pa.array([machine.score(places(t.as_py(), len(machine.w), known)) for t in part], pa.float64())
        known.clear()
        give_back()

    return scored(F.col("text"))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = docs.select("doc_id", _score(machine).alias("score"))
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    return out.select("doc_id", is_held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    return score(docs, fit(docs, labels, **how))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents, with their columns in order and whatever their names, that score below threshold."""
    return docs.where(_score(fit(docs, labels)) < threshold)
