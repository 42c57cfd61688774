"""Repair of conversation structure by rank-compressed dynamic programming (operator 11).

The rows of a conversation, by turn, are edited as cheaply as possible until the
initials of their roles read ``(s?(ua)+)?``: each row is kept (0), given the role
user or assistant (3) or deleted (4, and the only choice for blank and duplicate
rows); empty rows of either role may be inserted anywhere (3 each); a
truncated row that stays adds 3. Of equally cheap edits, the ones whose initials
(D, I, K, R) are least as a string.

*Macro edits.* A run of insertions and the edit of the row behind it are one
macro edit: D, ID, IID, IIK, ... None begins another, so a string of macro edits is less than
another exactly if it is at the first macro edit that differs, and nine numbers in
that order stand for them. Where the result stands (nothing yet, after s, u or a) and a
macro edit fix where it stands next.

*Ranks.* After each row a state needs its cost, and how its string compares with those
of the other states; that is a rank among four. A step keeps for each state the
least of (cost, rank before, macro edit), and of that choice a parent pointer. Costs less
the smallest, and ranks, take few values, so steps are looked up in a table that
grows as it is used. Strings are not carried: they are read off the pointers
afterward.

*Chunks.* Rows are numbered over range partitions, and the rows of a conversation in
one of them are a chunk, so a conversation of any length is spread. A chunk is run from each
of the four states and leaves costs and ranks, 4 x 4; these compose along the
conversation, as strings that reach different states differ, and ranks before
decide unless they are equal. Then each chunk knows where it is entered and left
and its pointers are followed.

Only the last pass moves texts, once: rows and their edits meet in order of place,
streaming. What must be one after the other for one conversation (a hash of
its whole text) is a stream with bounded memory.

A null role or text is one space, a null turn comes first; conv_id and turn may be
of any type that sorts. Rows of one turn are ordered by role and text. Rows alike in
all columns are counted, then treated as one with copies, of which all but the first are
duplicates. A row is a duplicate if its role and text stood in an earlier row, whatever
becomes of that one. Very long texts are compared by their first 32 characters and their
SHA-256. A role whose initial is none of s, u and a can only be changed or deleted.
An empty table gives empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut

#: Where a result stands: nothing yet, after system, user, assistant.
EMPTY, S, U, A = range(4)
NEXT = {EMPTY: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
#: What it takes to end well.
TAIL = {EMPTY: 0, S: 2, U: 1, A: 0}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MACROS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
CODE = {m: k for k, m in enumerate(MACROS)}
FAR = 1 << 60
#: Kinds of rows: initial (3: none of s, u, a), 4 more if it must go, 8 more if it is truncated.
INITIAL = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
STARTS = [(tuple(0 if x == e else FAR for x in range(4)), tuple(0 if x == e else -1 for x in range(4))) for e in range(4)]


def _moves(kind: int) -> list[tuple[int, int, int, int]]:
    """from, to, macro edit, cost."""
    initial, out = kind & 3, []
    for p in range(4):
        for k in range(3):
            at = p
            for _ in range(k):
                at = NEXT[at]
            out.append((p, at, CODE["I" * k + "D"], INSERT * k + DELETE))
            if kind & 4:
                continue
            more = INSERT * k + (TRUNCATED if kind & 8 else 0)
            kept = {(0, EMPTY): S, (1, EMPTY): U, (1, S): U, (1, A): U, (2, U): A}.get((initial, at))
            if kept is not None:
                out.append((p, kept, CODE["I" * k + "K"], more + KEEP))
            out.append((p, NEXT[at], CODE["I" * k + "R"], more + REROLE))
    return out


class Steps:
    """The table of steps: (costs, ranks) and kind of row to (costs less the smallest, ranks), that smallest and parents (state, macro edit)."""

    def __init__(self) -> None:
        self.moves = [_moves(k) for k in range(16)]
        self.known: dict = {}

    def __call__(self, at: tuple, kind: int) -> tuple:
        found = self.known.get((at, kind))
        if found is None:
            costs, ranks = at
            best = [(FAR, -1, -1, -1)] * 4
            for p, x, code, cost in self.moves[kind]:
                if costs[p] < FAR:
                    best[x] = min(best[x], (costs[p] + cost, ranks[p], code, p))
            least = min(b[0] for b in best)
            order = sorted((b[1], b[2]) for b in best if b[0] < FAR)
            after = tuple(b[0] - least if b[0] < FAR else FAR for b in best), tuple(order.index((b[1], b[2])) if b[0] < FAR else -1 for b in best)
            found = self.known[at, kind] = (after, least, tuple((b[3], b[2]) for b in best))
        return found

    def forward(self, entry: int, kinds: list[int]) -> tuple[tuple, int, list]:
        """What a chunk makes of a state: (costs, ranks), cost of all, parents by row."""
        at, total, parents = STARTS[entry], 0, []
        for kind in kinds:
            at, cost, pointers = self(at, kind)
            total += cost
            parents.append(pointers)
        return at, total, parents

    def back(self, entry: int, leave: int, kinds: list[int]) -> list[tuple[str, int]]:
        """Each row's macro edit, and the state before it."""
        _, _, parents = self.forward(entry, kinds)
        out, at = [], leave
        for pointers in reversed(parents):
            at, code = pointers[at]
            out.append((MACROS[code], at))
        return out[::-1]


def _head(text: Column) -> Column:
    return F.substring(text, 1, 32)


PLACE = ["turn", "role", "head", "digest"]


def _clean(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """conv_id, the columns of PLACE, copies, blank, duplicate (of the first copy), truncated, kind, chunk, at: narrow rows, kept."""
    body = F.regexp_replace("text", r"(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++\z", "")  # one try for each run of white space
    keyed = rows.select("conv_id", "turn", "role", _head(F.col("text")).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"), (F.length(body) == 0).alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))
    counted = keyed.groupBy("conv_id", *PLACE, "blank", "truncated").agg(F.count("*").alias("copies"))
    # of equal role and text the one with the first turn; nulls come first, and one place has one row
    first = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("m"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("m.turn").alias("t"), F.lit(False).alias("duplicate"))
    told = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t")), "left").drop("c", "r", "d", "t")
    told = told.withColumn("duplicate", ~F.col("blank") & F.coalesce("duplicate", F.lit(True))).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("truncated"))
    initial, number = F.substring("role", 1, 1), F.lit(3)
    for name, k in INITIAL.items():
        number = F.when(initial == name, k).otherwise(number)
    told = told.withColumn("kind", number + F.when(F.col("blank") | F.col("duplicate"), 4).otherwise(0) + F.when(F.col("truncated"), 8).otherwise(0))
    order = ["conv_id", *PLACE]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("at", 33)))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (row for b in batches for k in range(0, b.num_rows, 4096) for row in zip(*(c.to_pylist() for c in b.slice(k, 4096).columns), strict=True))
    for key, group in groupby(rows, key=lambda row: row[:keys]):
        yield key, group


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _mapped(df: DataFrame, each: object, keys: int, extra: str) -> DataFrame:
    """each(key, rows) for every run of equal first columns gives tuples, which follow conv_id."""
    kind = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {extra}"
    schema = df.sparkSession.createDataFrame([], kind).toArrow().schema

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        yield from _batches(((key[0], *row) for key, rows in _runs(batches, keys) for row in each(steps, key, rows)), schema)

    return df.mapInArrow(stream, kind)


def _kinds(copies: int, kind: int) -> list[int]:
    return [kind] + [kind & 3 | 4] * (copies - 1)


def _chunk_maps(steps: Steps, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    kinds = [k for *_, copies, kind in rows for k in _kinds(copies, kind)]
    illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))
    costs, ranks = [], []
    for entry in range(4):
        (cost, rank), total, _ = steps.forward(entry, kinds)
        costs += [c + total if c < FAR else FAR for c in cost]
        ranks += rank
    yield key[1], illegal, kinds[0] & 3, kinds[-1] & 3, costs, ranks


def _composed(steps: Steps, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of each chunk where it is entered and left; on the last one also illegal neighbours, cost and insertions at the end."""
    costs, ranks, trail, illegal, last = *STARTS[EMPTY], [], 0, None
    for _, chunk, inner, head, foot, each, order in rows:
        best = [min((costs[e] + each[4 * e + x], ranks[e], e) for e in range(4) if costs[e] < FAR) for x in range(4)]
        place = [(b[1], order[4 * b[2] + x]) if b[0] < FAR else (9, 9) for x, b in enumerate(best)]
        costs, ranks = tuple(min(b[0], FAR) for b in best), tuple(sorted(place).index(p) for p in place)
        trail.append((chunk, [b[2] for b in best]))
        illegal += inner + (last is not None and (last, head) not in LEGAL)
        last = foot
    cost, _, leave = min((costs[x] + INSERT * TAIL[x], ranks[x], x) for x in range(4) if costs[x] < FAR)
    out, at = [], leave
    for chunk, entries in reversed(trail):
        out.append((chunk, entries[at], at))
        at = entries[at]
    yield (*out[0], illegal, cost, TAIL[leave])
    yield from ((*row, None, None, None) for row in out[1:])


def _edited(steps: Steps, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Each place's macro edits: of its first copy, of one further, how many further, and the state before the first."""
    held = list(rows)
    found = iter(steps.back(held[0][2], held[0][3], [k for row in held for k in _kinds(*row[-2:])]))
    for row in held:
        macro, state = next(found)
        rest = "".join(next(found)[0] for _ in range(row[-2] - 1))
        yield (*row[5:9], macro + rest, state)


def _merged(steps: Steps, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """step, edit, turn, role and text (null where nothing is left)."""
    step = 0
    for place, group in groupby(rows, key=lambda row: row[1:6]):
        first = next(group)
        edits, state = first[7], first[8]
        text = next(group)[9] if not place[0] else None
        for edit in edits:
            role = None
            if edit in "IR":
                state = NEXT[state]
                role = ROLE[state]
            elif edit == "K":
                state = {"s": S, "u": U, "a": A}[place[2][0]]
                role = place[2]
            yield step, edit, place[1] if edit != "I" else None, role, None if role is None else "" if edit == "I" else text
            step += 1


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of conversations and what is said of them.

    edits: conv_id, step, edit (K, R, D, I), turn, role, text (role and text null for
    D), sorted within partitions by conv_id and step, a conversation in one of them.
    facts: conv_id, gaps, blank, duplicate, truncated, illegal, cost of the rows as they come.
    """
    rows = _clean(rows)
    placed = _placed(rows)
    chunked = placed.select("conv_id", "chunk", "at", "copies", "kind").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at")
    maps = _mapped(chunked, _chunk_maps, 2, "chunk long, illegal long, head int, foot int, costs array<long>, ranks array<int>")
    maps = maps.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    ends = cut(_mapped(maps, _composed, 1, "chunk long, entry int, leave int, illegal long, cost long, tail int"))
    where = ends.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "entry", "leave")
    told = placed.join(where, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    told = told.select("conv_id", "chunk", "entry", "leave", "at", *PLACE, "copies", "kind").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at")
    types = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in PLACE)
    edits = _mapped(told, _edited, 2, f"{types}, edits string, state int")
    null = F.lit(None)
    parts = [
        edits.select("conv_id", F.lit(False).alias("end"), *PLACE, F.lit(0).alias("tag"), "edits", "state", null.cast("string").alias("text")),
        rows.select("conv_id", F.lit(False), "turn", "role", _head(F.col("text")), F.unhex(F.sha2("text", 256)), F.lit(1), null, null, "text"),
        ends.where("tail > 0").select("conv_id", F.lit(True), null, null, null, null, F.lit(0), F.repeat(F.lit("I"), F.col("tail")), "leave", null),
    ]
    together = parts[0].union(parts[1]).union(parts[2]).repartition("conv_id").sortWithinPartitions("conv_id", "end", *PLACE, "tag")
    out = _mapped(together, _merged, 1, f"step long, edit string, turn {placed.schema['turn'].dataType.simpleString()}, role string, text string")
    counted = placed.groupBy("conv_id", "turn").agg(*(F.sum(F.when(F.col(c), n).otherwise(m)).alias(c) for c, n, m in (("blank", F.col("copies"), 0), ("duplicate", F.col("copies"), F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1)), ("truncated", F.lit(1), 0))))
    counted = counted.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    last = ends.where("cost IS NOT NULL").select(F.col("conv_id").alias("c"), "illegal", "cost")
    facts = counted.join(last, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    return out, facts


def _digested(steps: Steps, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    audit, digest, between = [], hashlib.sha256(), ""
    for _, _, edit, _, role, text in rows:
        audit.append(edit)
        if role is not None:
            digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
            between = "\n"
    yield "".join(audit), digest.hexdigest()


def report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of original: what ``repair`` tells of rows, audit (the edits in order) and repaired_sha256 (of role:text, a line each)."""
    edits, facts = repair(rows)
    digests = _mapped(edits, _digested, 1, "audit string, repaired_sha256 string").select(F.col("conv_id").alias("d"), "audit", "repaired_sha256")
    every = original.select("conv_id").distinct()
    facts = facts.withColumnRenamed("conv_id", "c")
    out = every.join(facts, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC-32 of ``conv_id:turn``, for trying repairs: of twenty values 0 drops a row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    label = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(label) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(F.coalesce("text", space), "[.!?]", "")).otherwise(F.coalesce("text", space))
    role = F.when(hit == 4, "user").otherwise(F.coalesce("role", space))
    times = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1)))
    return rows.where(hit != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _sql() -> str:
    """The report of damaged ``conversations``, with audit strings and texts carried along as they are."""
    far = "{'c': 1000000000, 'a': '', 'b': ''}"
    put = lambda x, edit, cost, line="''": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'b': {x}.b || {line}}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    user, assistant, own = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')", "(chr(10) || role || ':' || text)"
    may = lambda test, x: f"CASE WHEN NOT must AND {test} THEN {x} ELSE {far} END"
    stay, changed = "3 * trunc", "3 + 3 * trunc"
    rerole = lambda x, role: may("true", put(x, "R", changed, f"(chr(10) || '{role}:' || text)"))
    keep = lambda x, initial: may(f"initial = '{initial}'", put(x, "K", stay, own))
    ends = least("e", "a", put("u", "I", 3, assistant), put("s", "II", 6, f"{user} || {assistant}"))
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS label FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(label, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS hit FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0
), f AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w AS before, substr(role, 1, 1) AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), o AS (
  SELECT *, body = '' OR nth > 1 AS must, (body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS trunc FROM f
), r AS (
  SELECT DISTINCT g, 0::BIGINT AS i, {{'c': 0, 'a': '', 'b': ''}} AS e, {far} AS s, {far} AS u, {far} AS a FROM o
  UNION ALL
  SELECT g, i, {put("e", "D", 4)}, {least(put("s", "D", 4), keep("e", "s"))},
    {least(put("u1", "D", 4), *(keep(x, "u") for x in ("e", "s", "a1")), *(rerole(x, "user") for x in ("e", "s", "a1")))},
    {least(put("a1", "D", 4), keep("u1", "a"), rerole("u1", "assistant"))}
  FROM (SELECT *, {least("a", put("u1", "I", 3, assistant))} AS a1 FROM (
    SELECT r.g, r.i + 1 AS i, r.e, r.s, r.a, {least("r.u", *(put(x, "I", 3, user) for x in ("r.e", "r.s", "r.a")))} AS u1, o.role, o.text, o.initial, o.must, o.trunc
    FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1))
), z AS (
  SELECT g, {ends} AS best FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1
), n AS (
  SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (body = '') AS blank, count(*) FILTER (body <> '' AND nth > 1) AS duplicate, sum(trunc) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY ALL
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.b, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.g = n.g
"""


SQL = _sql()
