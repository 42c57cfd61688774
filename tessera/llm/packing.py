"""Mixture-controlled packing of documents into token sequences (operator 9).

Three steps:

1. *Tokenise* (map only). Each document gets its ids and the separator id, as
   packed unsigned integers, and a lane by a hash of its place in the input, so rows
   that are alike are spread. The result is kept as Parquet in the shared folder,
   so each text is tokenised once. Texts reach the workers in small batches.
2. *Deficits across partitions.* Tokens are summed by lane and source; the sums
   of the lanes before give each lane, for each source, by how much that source
   has so far fallen short of its target share. A lane starts with this.
3. *Pack* (one group for each lane). Deficit round-robin over the lane's source
   queues: each window gives every source its share of the window's tokens on
   top of what it carries; a source gives whole documents while its deficit is
   positive, and what it gives too much it carries as debt to the next window. A
   window is a sequence long, so at each sequence's end a source is off its target
   by about one of its documents at most while no queue has run dry.
   The row of documents is then cut at every ``sequence`` tokens. The rest of
   a lane is cut into sequences whose lengths are powers of two, so nothing is
   padded at all.

A lane is bounded by ``lane_bytes`` of input (a longer single document makes a
longer lane), whatever the size of its sources, so a source with a third of
all rows is spread over all lanes.

Null text counts as empty: only the separator. Null sources are a source of
their own. Repeated rows are packed each. An empty table gives an empty result. Other
columns are not read, whatever their names; doc_ids may be of any type that sorts.
Target shares need not be given for every source; without any, sources keep
their shares of all tokens. When a queue runs dry the others go on, so every
id is packed whatever the targets.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import give_back, pieces_for, small_batches, stored

#: A space before white space or the end: only there can a pre-token reach over a space between two words.
RISKY = re.compile(r" (?=\s|\Z)")
#: Letters whose classes are the same in every Unicode version that a library may hold.
USUAL = "ɏ"
#: Stands between words while a text is cut.
CUT = "\x1f"


class Words(dict):
    """Ids by word; words that are not there are encoded. Two generations are remembered."""

    def __init__(self, encode: Callable[[str], bytes], memory: int):
        super().__init__()
        self.encode, self.memory, self.older = encode, memory, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.memory:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids as tokenizers gives them.

    ``ranks_path`` may name the same vocabulary in tiktoken's form, which is
    faster: texts of usual letters go through it, about ``piece`` characters at a time, cut before
    a space between words, where a byte-level BPE splits anyway. In texts with other
    letters, words repeat and are remembered. Texts with runs of white space and texts
    that hold a special token's string go through tokenizers itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, memory: int = 100_000, piece: int = 1 << 18):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.piece = Tokenizer.from_file(path), piece
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Words(self._word, memory)
        self.quick = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        give_back()  # what reading the files took

    def _slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _fast(self, text: str) -> bytes:
        return array(self.code, self.quick.encode_ordinary(text)).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        return self._fast(word) if self.quick and max(word) <= USUAL else self._slow(word)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + self.piece)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if CUT in text or RISKY.search(text) or (self.special and self.special.search(text)):
            return self._slow(text)
        if self.quick and max(text) <= USUAL:
            return b"".join(map(self._fast, self._pieces(text)))
        return b"".join(map(self.words.__getitem__, text.replace(" ", f"{CUT} ").split(CUT)))


_MADE: dict[tuple, Encoder] = {}


def encoder(*key: str | None) -> Encoder:
    """One for each worker process."""
    if key not in _MADE:
        _MADE[key] = Encoder(*key)
    return _MADE[key]


def forget() -> None:
    """A worker that packs needs no encoder."""
    _MADE.clear()
    give_back()


def tokenised(docs: DataFrame, lanes: int, path: str, ranks_path: str | None, pattern: str | None, separator: int) -> DataFrame:
    """lane, doc_id, source, n (with the separator), ids (packed)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks_path, pattern)
        end = np.array([separator], enc.dtype).tobytes()
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                c = b.slice(k, 2000)
                ids = [enc(t.as_py() or "") + end for t in c.column(3)]
                n = [len(x) // len(end) for x in ids]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["lane", "doc_id", "source", "n", "ids"])
        give_back()

    lane = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes))  # the result is stored, so a row has one lane
    rows = docs.select(lane.alias("lane"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(encode, f"lane long, doc_id {dict(docs.dtypes)['doc_id']}, source string, n long, ids binary")


def carried(tokens: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """to_lane, source, share, deficit: by how much each source fell short of its share before each lane.

    Sources without a given share divide what the given ones leave, by their tokens.
    """
    by = tokens.groupBy("lane", "source").agg(F.sum("n").alias("n"))
    by_source = by.groupBy("source").agg(F.sum("n").alias("of_source"))
    asked = F.lit(None).cast("double")
    for name, share in (shares or {}).items():
        asked = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(asked)
    by_source = by_source.withColumn("asked", asked)
    unasked, given = by_source.agg(F.coalesce(F.sum(F.when(F.col("asked").isNull(), F.col("of_source"))), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0.0))).first()
    share = F.coalesce(F.col("asked") / max(1.0, given), F.col("of_source") * (max(0.0, 1 - given) / max(1, unasked)))
    targets = by_source.select("source", share.alias("share"))
    lanes = by.groupBy("lane").agg(F.sum("n").alias("of_lane")).withColumn("block", F.floor(F.col("lane") / 4096))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = lanes.groupBy("block").agg(F.sum("of_lane").alias("of_block")).select("block", F.coalesce(F.sum("of_block").over(earlier.orderBy("block")), F.lit(0)).alias("blocks_before"))
    in_block = F.coalesce(F.sum("of_lane").over(earlier.partitionBy("block").orderBy("lane")), F.lit(0))
    before = lanes.withColumn("in_block", in_block).join(blocks, "block").select("lane", (F.col("blocks_before") + F.col("in_block")).alias("upto"))
    have = by.join(before, "lane").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    given = F.coalesce(F.sum("n").over(earlier.partitionBy("source").orderBy("lane")), F.lit(0))
    return have.select(F.col("lane").alias("to_lane"), F.col("source").alias("source"), F.col("share").alias("share"), (F.col("share") * F.col("upto") - given).alias("deficit"))


def round_robin(queues: dict, shares: dict, deficits: dict, window: int) -> Iterator[int]:
    """Items of queues {source: [(item, tokens), ...]} in the order in which deficit round-robin serves them."""
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    at = dict.fromkeys(order, 0)
    owed = {s: deficits.get(s, 0.0) for s in order}
    while order:
        # if nobody may give a document with this window's tokens, as many windows pass as it takes
        wait = min((-owed[s] / (shares[s] * window) for s in order if shares[s] > 0), default=0.0)
        rounds = max(1, int(wait) + (wait >= 1))
        flow = any(shares[s] > 0 for s in order)
        for s in order:
            owed[s] += rounds * shares[s] * window if flow else window
            queue = queues[s]
            while owed[s] > 0 and at[s] < len(queue):
                item, n = queue[at[s]]
                at[s] += 1
                owed[s] -= n
                yield item
        order = [s for s in order if at[s] < len(queues[s])]


def sequence_lengths(total: int, sequence: int) -> list[int]:
    """Full sequences, then what is left as powers of two, the largest first."""
    rest = total % sequence
    return [sequence] * (total // sequence) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, pattern: str | None = None, shares: dict[str, float] | None = None, sequence: int = 1024, window: int = 1024, separator: int = 0, lane_bytes: int = 4 << 20) -> DataFrame:
    """One row for each piece of a document in a sequence.

    doc_id, start (the document's ids before it), length, ids_crc32 (of its ids
    as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset,
    source.
    """
    lanes = pieces_for(docs, lane_bytes)
    with small_batches(docs.sparkSession):
        tokens = stored(tokenised(docs, lanes, path, ranks_path, pattern, separator))
    kind = dict(docs.dtypes)["doc_id"]
    id_type = tokens.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    types = [id_type, *[pa.int64()] * 6, pa.string()]

    def packed(key: tuple, rows: pa.Table, carry: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        ids = rows.column("ids").to_pylist()
        n, sources, doc_ids = (rows.column(c).to_pylist() for c in ("n", "source", "doc_id"))
        if not ids:
            return pa.table([pa.array([], t) for t in types], names=names)
        wide = np.dtype("<u4" if len(ids[0]) // n[0] == 4 else "<u2")
        queues: dict = {}
        for i in sorted(range(len(n)), key=lambda i: ((1,) if doc_ids[i] is None else (0, doc_ids[i]), n[i], zlib.crc32(ids[i]))):
            queues.setdefault(sources[i], []).append((i, n[i]))
        told = {s: (share, owed) for s, share, owed in zip(*(carry.column(c).to_pylist() for c in ("source", "share", "deficit")), strict=True)}
        lengths = iter(sequence_lengths(sum(n), sequence))
        number, room, size = key[0].as_py() << 32, next(lengths), 0
        size = room
        for i in round_robin(queues, {s: told[s][0] for s in queues}, {s: told[s][1] for s in queues}, window):
            words = np.frombuffer(ids[i], wide).astype("<u4")
            start = 0
            while start < n[i]:
                if not room:
                    number += 1
                    size = room = next(lengths)
                take = min(room, n[i] - start)
                for column, value in zip(out, (doc_ids[i], start, take, zlib.crc32(words[start : start + take].tobytes()), n[i], number, size - room, sources[i]), strict=True):
                    column.append(value)
                start += take
                room -= take
        forget()
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return tokens.groupBy("lane").cogroup(carried(tokens, shares).groupBy("to_lane")).applyInArrow(packed, schema)
