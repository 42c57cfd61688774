"""Token counts by a compiled finite-state transducer (operator 10).

A BPE vocabulary (merge the adjacent symbols whose joint piece ranks best) has
a useful property: a token sequence is the encoding of its text if and only if
each of its tokens encodes to itself and each adjacent pair encodes to itself.
So the last token of every prefix of a text follows from the last tokens of
shorter prefixes, and of those only the ones inside the longest suffix that
begins some piece matter. That bounded knowledge is the state of a
deterministic transducer; each of its transitions carries the change in the
number of emitted tokens.

States and transitions are compiled when first met and kept, within
``max_states``. Text is read in chunks; each gets a *chunk map* (what its head
must be fed to whichever state comes in, the tokens emitted from its first
synchronising point on, and its tail), and chunk maps compose associatively,
so a long text is counted by a tree of compositions. A word mark after another
character synchronises: no piece holds one behind its first letters, so the
state there is the same whatever came before, and the map of one such unit is a
plain number which is remembered.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each;
an empty table gives an empty result. Of other columns only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class State(dict):
    """Transitions by character: (next state, tokens emitted more than before)."""

    __slots__ = ("open",)


class Transducer:
    """ranks: piece to rank, the best first. A character without piece counts as its UTF-8 bytes.

    A state's ``open`` lists the places at which a token that is still to end
    may have begun, the earliest first: the text since then (the beginning of a
    piece, or nothing), the token that ended there ("" if anything may follow
    it) and the tokens emitted up to there less those emitted up to now.
    """

    def __init__(self, ranks: dict[str, int], max_states: int = 200_000, max_units: int = 400_000):
        self.ranks = ranks
        self.begins = {p[:k] for p in ranks for k in range(1, len(p) + 1)}
        self.letters = {c for p in ranks for c in p}
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in ranks)
        self.max_states, self.max_units = max_states, max_units
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.units: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state((("", "", 0),))

    def _state(self, places: tuple) -> State:
        if (s := self.states.get(places)) is None:
            s = self.states[places] = State()
            s.open = places
        return s

    def encode(self, text: str) -> list[str]:
        """Merges by rank, leftmost first: the definition that pairs are tested by."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_token(self, t: str) -> bool:
        if (ok := self.whole.get(t)) is None:
            ok = self.whole[t] = len(t) == 1 or (t in self.ranks and self.encode(t) == [t])
        return ok

    def _pair(self, a: str, b: str) -> bool:
        if not a:
            return True
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            ok = self.fits[a, b] = self.encode(a + b) == [a, b]
        return ok

    def _compile(self, s: State, c: str) -> tuple[State, int]:
        """The transition from s by c."""
        for since, before, ahead in s.open:
            token = since + c
            if self._is_token(token) and self._pair(before, token):
                break
        else:  # nothing fits only if the property above fails for this vocabulary
            raise ValueError(f"no token of {s.open!r} ends with {c!r}")
        delta = ahead + (1 if token in self.ranks else len(c.encode("utf-8", "surrogatepass")))
        places = []
        for since, before, ahead in s.open:
            if (grown := since + c) in self.begins:
                free = not since and before and not self.inner_mark and c == MARK and before[-1] != MARK
                places.append((grown, "" if free else before, ahead - delta))
        places.append(("", token if c in self.letters else "", 0))
        if len(self.states) >= self.max_states:
            self._forget()
        entry = s[c] = (self._state(tuple(places)), delta)
        return entry

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            if (e := state.get(c)) is None:
                e = self._compile(state, c)
            state = e[0]
            total += e[1]
        return state, total

    def unit(self, text: str) -> int:
        """Tokens of a unit: marks, then no mark. Two generations of results are remembered."""
        if (n := self.units.get(text)) is None:
            if len(self.units) >= self.max_units:
                self.units, self.older = {}, self.units
            if (n := self.older.get(text)) is None:
                n = self.run(self.start, text)[1]
            self.units[text] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail): head comes before the first synchronising point, tail is the last, open unit.

        Without such a point all is head and tokens is None.
        """
        cuts = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", chunk)]
        if not cuts or self.inner_mark:
            return chunk, None, ""
        body = chunk[cuts[0] : cuts[-1]]
        return chunk[: cuts[0]], self._units(body), chunk[cuts[-1] :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in a row. Associative."""
        if b[1] is None:
            return (a[0] + b[0], None, "") if a[1] is None else (a[0], a[1], a[2] + b[0])
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        middle = a[2] + b[0]
        return a[0], a[1] + b[1] + self._units(middle), b[2]

    def _units(self, marked: str) -> int:
        return sum(map(self.unit, UNITS.findall(marked)))

    def count(self, text: str, chunk_chars: int = 1 << 16) -> int:
        """Tokens of a text, with the mark before it that the library adds."""
        if not text:
            return 0
        if len(text) <= chunk_chars and not self.inner_mark and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.unit, (MARK + text.replace(" ", f" {MARK}")).split(" ")))
        marked = MARK + text.replace(" ", MARK)
        maps = [self.chunk_map(marked[k : k + chunk_chars]) for k in range(0, len(marked), chunk_chars)]
        while len(maps) > 1:  # a tree of compositions, as the order of chunks is all that matters
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        head, tokens, tail = maps[0]
        if self.inner_mark:
            return self.run(self.start, head)[1]
        return self._units(head) + (tokens or 0) + self._units(tail)


def piece_ranks(model_path: str) -> dict[str, int]:
    """Pieces of a sentencepiece BPE model in the order in which they merge."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model_path).serialized_model_proto())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    if trainer.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and trainer.byte_fallback) or trainer.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback, a mark before the text and no normalisation are compiled")
    normal = [(p.score, i, p.piece) for i, p in enumerate(model.pieces) if p.type == 1]
    if any(p.type == 4 for p in model.pieces):
        raise ValueError("user-defined pieces are not compiled")
    return {piece: k for k, (_, _, piece) in enumerate(sorted(normal, key=lambda x: (-x[0], x[1])))}


_MADE: dict[str, Transducer] = {}


def transducer(model_path: str) -> Transducer:
    """One for each worker process, which serves many tasks."""
    if model_path not in _MADE:
        _MADE[model_path] = Transducer(piece_ranks(model_path))
    return _MADE[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit. Map only: nothing is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for b in batches:
            n = [machine.count(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
