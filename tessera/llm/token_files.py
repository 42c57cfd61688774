"""Token ids in binary files with Elias-Fano coded document boundaries (operator 13).

A folder holds shards and one list of them. Of a shard of documents there are

* ``*.ids``: the ids of all its documents, one after the other, as little-endian unsigned
  numbers of two bytes (four, if the vocabulary needs them), nothing between;
* ``*.ends``: where each document ends, Elias-Fano coded (``tessera.llm.elias_fano``): about
  two bits a document more than the logarithm of a document's mean length. A
  document's place is two selections, so nothing holds 64-bit offsets, neither on
  disk nor in memory;
* ``*.docs``: the documents' ids, as an Arrow stream;

and ``shards.json`` has for each shard its files, documents, tokens and how many tokens come before it.

``tessera_tokens`` is a data source of Spark, for writing and reading. Rows come in range
partitions by doc_id, sorted; a task writes one shard, streaming, under a name of
its own, so attempts that are lost or run twice leave no trace in the list, which the
commit writes last. Reading deals shards in stretches of documents, each of which
selects its first and last place and reads those bytes alone. Files are reached
through ``pyarrow.fs``, so local, HDFS and object-store paths do.

Null text counts as empty: only the end id. Null doc_ids come first; doc_ids may be of any
type that sorts. Repeated doc_ids are ordered by the hash of the text and then by
their place in the input, so a doc_id of very many rows is spread over shards.
A text of any length is encoded a stretch at a time. An empty table gives files with
no shard, and no rows. Columns other than ``doc_id`` and ``text`` are not read,
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.llm._common import pieces_for, shared_dir
from tessera.llm.elias_fano import EliasFano, encoded

SOURCE = "tessera_tokens"
#: White space to str.split, but not to the patterns of a vocabulary.
ODD = re.compile("[\x1c-\x1f]")
#: A single mark between a letter and white space or the end.
APART = re.compile(r"[.,;:!?](?!\S)(?<=[^\W\d_].)")
#: Not letters whose classes are the same in every Unicode version that a library may hold; one of those has two letters for its lower case.
UNUSUAL = re.compile("[^\0-įı-ɏ]")


class WordEncoder:
    """Ids as tokenizers gives them, for vocabularies in lower case that drop white space and mark word ends.

    No token reaches over white space, so words are encoded apart and remembered:
    the last ``memory`` to twice as many. Texts of usual letters are put in lower case first,
    and single marks behind letters are set apart, as the vocabulary's pattern does, so that
    fewer words are different. New words of letters alone are encoded as one text and
    told apart by the mark of word ends in their last tokens; if there are not as
    many of those as words, and for all other words, each is encoded alone. New words are
    gathered over ``together`` characters of texts first. Texts with
    characters that only Python takes for white space go through the library whole.
    """

    END = "</w>"

    def __init__(self, path: str, memory: int = 350_000, stretch: int = 1 << 20, together: int = 1 << 17):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.memory, self.stretch, self.together = Tokenizer.from_file(path), memory, stretch, together
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and (w.isascii() or not UNUSUAL.search(w))]
        if plain:
            ids = self._ids([" ".join(plain)])[0]
            cuts = ((np.flatnonzero(self.closes[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) == len(plain):
                data = ids.tobytes()
                self.words.update(zip(plain, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        others = [w for w in words if w not in self.words]
        if others:
            self.words.update((w, found.tobytes()) for w, found in zip(others, self._ids(others), strict=True))

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + self.stretch)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        return next(self.each([text]))

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        held, size = [], 0
        for text in texts:
            if len(text) > self.stretch:
                yield from self._of(held)
                held, size = [], 0
                yield b"".join(next(self._of([part])) for part in self._stretches(text))
                continue
            held.append(text)
            size += len(text)
            if size >= self.together:
                yield from self._of(held)
                held, size = [], 0
        yield from self._of(held)

    def _words(self, text: str) -> list[str]:
        if not UNUSUAL.search(text) and "<|" not in text:
            text = APART.sub(r" \g<0>", text.lower())
        return text.split()

    def _of(self, texts: list[str]) -> Iterator[bytes]:
        words = [None if not t or ODD.search(t) else self._words(t) for t in texts]
        found = [[] if w is None else list(map(self.words.get, w)) for w in words]
        missing = [[k for k, ids in enumerate(f) if ids is None] if None in f else [] for f in found]
        if new := {w[k] for w, at in zip(words, missing, strict=True) for k in at}:
            older = self.older
            if len(self.words) >= self.memory:
                self.older, self.words = self.words, {}
            self.words.update((w, older[w]) for w in new if w in older)
            if unknown := [w for w in new if w not in self.words]:
                self._learn(unknown)
        for text, w, f, at in zip(texts, words, found, missing, strict=True):
            for k in at:
                f[k] = self.words[w[k]]
            yield self._ids([text])[0].tobytes() if w is None else b"".join(f)


class Encoder:
    """Ids of any vocabulary, by the library alone."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if max(self.whole.get_vocab(with_added_tokens=True).values()) < 1 << 16 else "<u4")

    def __call__(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        return map(self, texts)


def drops_white_space(path: str) -> bool:
    """Whether white space only separates: the pre-tokenizer keeps nothing but what a pattern without white space finds, and words have an end mark."""
    with open(path, encoding="utf-8") as f:
        plan = json.load(f)
    steps = (plan.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return plan["model"].get("end_of_word_suffix") == WordEncoder.END and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and "\\s" in steps[0]["pattern"].get("Regex", "")


_MADE: dict[str, WordEncoder | Encoder] = {}


def encoder(path: str) -> WordEncoder | Encoder:
    """One for each worker process."""
    if path not in _MADE:
        _MADE[path] = WordEncoder(path) if drops_white_space(path) else Encoder(path)
    return _MADE[path]


def files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Shard(WriterCommitMessage):
    order: int
    name: str
    documents: int
    tokens: int
    width: int


@dataclass
class Stretch(InputPartition):
    name: str
    before: int
    width: int
    first: int
    last: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options["end_id"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        from pyspark import TaskContext

        store, root = files(self.path)
        encode, name = encoder(self.tokenizer), uuid.uuid4().hex
        end, width = np.array([self.end], encode.dtype).tobytes(), encode.dtype.itemsize
        ends, at, docs = [], 0, None
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}.ids") as ids, store.open_output_stream(f"{root}/{name}.docs") as held:
            for batch in iterator:
                lengths = []
                for found in encode.each(t.as_py() or "" for t in batch.column("text")):
                    ids.write(found)
                    ids.write(end)
                    lengths.append(len(found) // width + 1)
                if lengths:
                    ends.append(at + np.cumsum(np.array(lengths, np.int64)))
                    at = int(ends[-1][-1])
                kept = batch.select(["doc_id"])
                docs = docs or pa.ipc.new_stream(held, kept.schema)
                docs.write_batch(kept)
            if docs:
                docs.close()
        places = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        if len(places):
            with store.open_output_stream(f"{root}/{name}.ends") as f:
                f.write(encoded(places))
        else:
            for suffix in ("ids", "docs"):
                store.delete_file(f"{root}/{name}.{suffix}")
        return Shard(TaskContext.get().partitionId(), name, len(places), at, width)

    def commit(self, messages: list[Shard | None]) -> None:
        store, root = files(self.path)
        shards, before = [], 0
        for m in sorted((m for m in messages if m and m.documents), key=lambda m: m.order):
            shards.append({"name": m.name, "documents": m.documents, "tokens": m.tokens, "width": m.width, "before": before})
            before += m.tokens
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/shards.json.new") as f:
            f.write(json.dumps({"shards": shards}).encode())
        store.move(f"{root}/shards.json.new", f"{root}/shards.json")

    def abort(self, messages: list[Shard | None]) -> None:
        store, root = files(self.path)
        for m in messages:
            for suffix in ("ids", "docs", "ends") if m and m.documents else ():
                store.delete_file(f"{root}/{m.name}.{suffix}")


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.documents = options["path"], int(options.get("documents", 20_000))

    def partitions(self) -> list[InputPartition]:
        store, root = files(self.path)
        with store.open_input_stream(f"{root}/shards.json") as f:
            shards = json.loads(f.read())["shards"]
        return [Stretch(s["name"], s["before"], s["width"], k, min(k + self.documents, s["documents"])) for s in shards for k in range(0, s["documents"], self.documents)] or [Stretch("", 0, 2, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, root = files(self.path)
        with store.open_input_stream(f"{root}/{partition.name}.ends") as f:
            ends = EliasFano(f.read())
        at = ends.select(partition.first - 1) if partition.first else 0
        with store.open_input_file(f"{root}/{partition.name}.ids") as ids, store.open_input_stream(f"{root}/{partition.name}.docs") as f:
            row = 0
            for batch in pa.ipc.open_stream(f):
                for k in range(max(partition.first - row, 0), min(partition.last - row, batch.num_rows), 512):
                    part = batch.slice(k, min(512, partition.last - row - k))
                    places = ends.slice(row + k, row + k + part.num_rows)
                    starts = np.concatenate(([at], places[:-1]))
                    ids.seek(at * partition.width)
                    data = np.frombuffer(ids.read(int(places[-1] - at) * partition.width), f"<u{partition.width}").astype("<u4").tobytes()
                    cells = [data[4 * (a - at) : 4 * (b - at)] for a, b in zip(starts.tolist(), places.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + partition.before, pa.int64()), pa.array(places - starts, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at = int(places[-1])
                row += batch.num_rows
                if row >= partition.last:
                    return


class TokenFiles(DataSource):
    """Options: path; for writing tokenizer and end_id; for reading doc_id (its type) and documents (at most so many a task)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return f"doc_id {self.options.get('doc_id', 'bigint')}, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema: object, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)

    def reader(self, schema: object) -> TokenReader:
        return TokenReader(self.options)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = 16 << 20) -> None:
    """The documents' ids at path, in ascending order of doc_id; shard_bytes of input make about one shard."""
    docs.sparkSession.dataSource.register(TokenFiles)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_place"))
    order = ["doc_id", "_h", "_place"]
    dealt = rows.repartitionByRange(pieces_for(docs, shard_bytes), *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.write.format(SOURCE).mode("append").option("path", path).option("tokenizer", tokenizer).option("end_id", str(end_id)).save()


def read(spark: SparkSession, path: str, doc_id: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids (little-endian unsigned numbers of four bytes)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(SOURCE).option("path", path).option("doc_id", doc_id).load()


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Written, then read from the files, which stay; without a path they are in the session's shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(spark, path, docs.schema["doc_id"].dataType.simpleString())
