"""Personal data replaced by surrogates (operator 4).

Found are e-mail addresses, telephone numbers, IPv4 addresses, payment cards,
social security numbers, IBANs, keys and passwords, and names of people after a
title or by a known first name. Each *entity* (kind and normal form) gets one
keyed surrogate wherever it occurs, so coreference holds across documents.

A surrogate comes from a keyed permutation of all texts of the same shape:
lower-case letters stay lower-case, digits digits, vowels vowels in names, and
punctuation stays; Russian surnames keep their endings, and a woman's and a man's
form are one entity; so it has the format and script of what it replaces, and two
entities can never get the same one. First names are permuted among the known
names of the same gender and script. Cards keep their first digit and a right
check digit; addresses and numbers stay valid (the permutation is applied until
they are).

*Collision checks*: over the table of all distinct entities, a surrogate that
equals another entity's or an entity that occurs in the corpus (itself included), however short,
is drawn again with the next tweak, until none is left. As a large corpus may use
up a short shape, every ``WIDEN`` tweaks the surrogate of a surname, e-mail address,
secret or IPv4 address gets a letter or digit more; the other kinds have one format
and very many values. If any still collide after ``rounds``, that is an error. First
names are drawn from the known ones, so they may be real. Entities with a tweak are exceptions;
they are few and are handed to the map over documents as a broadcast if they were
counted to be at most ``broadcast_entities``, else joined by document. Documents are
read twice and, without such a join, never shuffled.

Null text stays null. Repeated rows get the same surrogates. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut, pieces_for

# Titles and first names by gender and script.
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "госпожа"), "": ("Dr", "Prof")}
FIRST_NAMES = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Peter", "Hans", "Klaus", "Jürgen", "Carlos", "José", "Miguel", "Javier", "Jean", "Pierre", "Luc", "Antoine"),
    ("f", "latin"): ("Mary", "Patricia", "Linda", "Barbara", "Elizabeth", "Jennifer", "Susan", "Sarah", "Anna", "Ursula", "Monika", "Sabine", "María", "Carmen", "Lucía", "Pilar", "Marie", "Claire", "Sophie", "Camille"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина"),
}
_FIRST = {name: pool for pool, names in FIRST_NAMES.items() for name in names}
_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_CAP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЁ][\w'’-]*[^\W\d_]"
LOCAL, DOMAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PATTERNS: list[tuple[str, re.Pattern]] = [
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)")),
]
#: What any of PATTERNS has.
NUMERIC = re.compile(r"\d[\d .()A-Z-]{6}")
SECRET = re.compile(r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/.-]{6,})", re.IGNORECASE)
SECRET_SIGN = re.compile(r"(?:d|n|t|y)[\"']?\s*[=:]", re.IGNORECASE)
KEY = re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b")
KEY_SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁг]\w+")
NAMES = frozenset(_FIRST) | frozenset(t for ts in TITLES.values() for t in ts)
NAME = re.compile(rf"\b(?:(?P<title>{_ALL_TITLES})\.?\s+(?P<named>{_CAP}(?:\s+{_CAP}){{0,2}})|(?P<first>{'|'.join(_FIRST)})(?P<rest>(?:\s+{_CAP}){{1,2}}))\b")
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
HEX = [("0123456789abcdef",)]
PLAIN = [("0123456789",), ("abcdefghijklmnopqrstuvwxyz",), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ",)]


def _letters(first: int, last: int, case: str, known: str) -> str:
    """Letters of a stretch of Unicode that have both cases, in one case, less those known."""
    found = (chr(c) for c in range(first, last + 1))
    return "".join(c for c in found if getattr(c, f"is{case}")() and len(c.swapcase()) == 1 and c.swapcase().swapcase() == c and c not in known)


ACCENTED = "àáâäèéêëìíîïòóôöùúûü"
VOWELS_CYRILLIC, CONSONANTS_CYRILLIC = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"
SPOKEN = [("0123456789",), (VOWELS,), (CONSONANTS,), (VOWELS.upper(),), (CONSONANTS.upper(),), (ACCENTED,), (ACCENTED.upper(),), (VOWELS_CYRILLIC,), (CONSONANTS_CYRILLIC,), (VOWELS_CYRILLIC.upper(),), (CONSONANTS_CYRILLIC.upper(),)]
#: The other letters of Latin, Greek and Cyrillic, by case.
SPOKEN += [(_letters(a, b, case, "".join(x for (x,) in SPOKEN)),) for a, b in ((0xC0, 0x17F), (0x370, 0x3FF), (0x400, 0x52F)) for case in ("lower", "upper")]
_CLASS = {name: {c: a for (a,) in classes for c in a} for name, classes in (("plain", PLAIN), ("spoken", SPOKEN), ("hex", HEX))}


def permuted(key: bytes, tweak: str, text: str, classes: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    """text under a keyed permutation of all texts of its shape; applied again until the result is valid and another one.

    A Feistel network over the bits of the text's number among those of its shape;
    numbers beyond the last are walked through, so it stays a permutation.
    """
    alphabets = [_CLASS[classes].get(c) for c in text]
    count, number = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            number, count = number * len(a) + a.index(c), count * len(a)
    if count < 2:
        return text
    half = max(1, ((count - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    shape = "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True))

    def step(x: int) -> int:
        left, right = x >> half, x & mask
        for k in range(6):
            f = hashlib.blake2b(f"{k}|{tweak}|{shape}|{right}".encode(), key=key, digest_size=16 + half // 8).digest()
            left, right = right, left ^ int.from_bytes(f, "big") & mask
        return left << half | right

    start, x = number, number
    for _ in range(100_000):
        x = step(x)
        if x >= count:
            continue
        out, rest = [], x
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                rest, d = divmod(rest, len(a))
                c = a[d]
            out.append(c)
        made = "".join(reversed(out))
        if x == start or valid(made):
            return made
    raise RuntimeError(f"no valid surrogate of the shape {shape!r} was found")


def _luhn(digits: str) -> int:
    """The check digit after digits."""
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _regrouped(digits: str, like: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


def _card(key: bytes, tweak: str, norm: str) -> str:
    body, check = norm[1:-1], (int(norm[-1]) - _luhn(norm[:-1])) % 10
    made = norm[0] + permuted(key, tweak + norm[0], body, "plain")
    return made + str((_luhn(made) + check) % 10)


def _ip(made: str) -> bool:
    parts = made.split(".")
    return all(p == str(int(p)) and int(p) < 255 for p in parts) and 0 < int(parts[0]) < 224 and parts[0] not in ("10", "127") and int(parts[3]) > 0


#: So many tweaks until a shape is taken to be used up.
WIDEN = 8


def widened(kind: str, norm: str, more: int) -> str:
    """norm with room for more surrogates: letters added, or digits to the short numbers of an address."""
    if kind == "surname":
        stem, ending, _ = inflected(norm)
        return stem + "".join("na"[i % 2] for i in range(more)) + ending
    if kind == "email":
        local, _, domain = norm.partition("@")
        return f"{local}{'a' * more}@{domain}"
    if kind == "secret":
        return norm + "a" * more
    if kind == "ip":
        parts = norm.split(".")
        for _ in range(more):
            k = min(range(4), key=lambda i: len(parts[i]))
            parts[k] = "1" + parts[k] if len(parts[k]) < 3 else parts[k]
        return ".".join(p if p == str(int(p)) and int(p) < 255 else "1" * len(p) for p in parts)
    return norm


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, norm: str, tweak: int = 0) -> str:
    """The surrogate of an entity's normal form."""
    t = f"{kind}{tweak}"
    if tweak >= WIDEN:
        norm = widened(kind, norm, tweak // WIDEN)
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{permuted(key, t + domain, local, 'plain')}@{permuted(key, t, host, 'plain')}.{top}"
    if kind == "card":
        return _card(key, t, norm)
    if kind == "ip":
        return permuted(key, t, norm, "plain", _ip)
    if kind == "phone":
        code = re.match(r"\+\d+|", norm)[0] if norm.startswith("+") else ""
        code = code[:-10] if len(code) > 11 else code
        return code + permuted(key, t + code, norm[len(code) :], "plain", lambda m: len(m) < 10 or m[-10] not in "01" and m[-7] not in "01")
    if kind == "ssn":
        return permuted(key, t, norm, "plain", lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[-4:] != "0000")
    if kind == "iban":
        return norm[:2] + permuted(key, t + norm[:2], norm[2:], "plain")
    if kind == "key":
        return norm[:4] + permuted(key, t + norm[:4], norm[4:], "plain")
    if kind == "first":
        pool = FIRST_NAMES[_FIRST[norm]]
        order = sorted(pool, key=lambda n: hashlib.blake2b(f"{t}{n}".encode(), key=key).digest())
        return order[(order.index(norm) + 1) % len(order)]
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", norm):
        return permuted(key, t, norm, "hex")
    if kind == "surname":
        stem, ending, _ = inflected(norm)
        return permuted(key, t + ending, stem, "spoken") + ending
    return permuted(key, t, norm, "plain")


#: Endings of Russian surnames, feminine and masculine.
ENDINGS = (("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын"))


def inflected(name: str) -> tuple[str, str, str]:
    """(stem, masculine ending, own ending) of a surname, endings empty where it has none of ENDINGS."""
    for feminine, masculine in ENDINGS:
        for own in (feminine, masculine):
            if name.endswith(own) and len(name) > len(own) + 1:
                return name[: -len(own)], masculine, own
    return name, "", ""


def normal(kind: str, found: str) -> str:
    if kind == "surname":
        return "".join(inflected(found)[:2])
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", found)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", found)
    return found.lower() if kind == "email" else found


def dressed(kind: str, made: str, found: str) -> str:
    """A surrogate in the form in which the entity was written."""
    if kind == "surname":
        _, masculine, own = inflected(found)
        return made[: len(made) - len(masculine)] + own
    if kind in ("card", "phone"):
        return _regrouped(made.replace("+", ""), found)
    if kind == "iban":
        it = iter(made)
        return "".join(c if c == " " else next(it) for c in found)
    if kind == "email" and found != found.lower() and len(made) == len(found):
        return "".join(m.upper() if f.isupper() else m for m, f in zip(made, found, strict=True))
    return made


def entities(text: str) -> list[tuple[int, int, str]]:
    """begin, end and kind of what is found, in order and without overlap; earlier patterns prevail."""
    found: list[tuple[int, int, str]] = []  # sorted, without overlap

    def add(a: int, b: int, kind: str) -> None:
        k = bisect(found, (a, b, kind))
        if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or b <= found[k][0]):
            found.insert(k, (a, b, kind))

    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and text[at - 1] != "." and (domain := DOMAIN.match(text, at + 1)):
            add(begin, domain.end(), "email")
        at = text.find("@", at + 1)
    if ("=" in text or ":" in text) and SECRET_SIGN.search(text):
        for m in SECRET.finditer(text):
            add(*m.span(1), "secret")
    if any(k in text for k in KEY_SIGNS):
        for m in KEY.finditer(text):
            add(*m.span(), "key")
    if NUMERIC.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                digits = sum(map(str.isdigit, m[0]))
                if kind == "card" and not 13 <= digits <= 19 or kind == "iban" and digits < 8:
                    continue
                add(*m.span(), kind)
    if NAMES.isdisjoint(CAPITAL.findall(text)):
        return found
    for m in NAME.finditer(text):
        if m["title"]:
            spans = [(m.start("named") + w.start(), m.start("named") + w.end()) for w in re.finditer(r"\S+", m["named"])]
        else:
            spans = [m.span("first"), *((m.start("rest") + w.start(), m.start("rest") + w.end()) for w in re.finditer(r"\S+", m["rest"]))]
        for k, (a, b) in enumerate(spans):
            known = k == 0 and len(spans) > 1 or not m["title"] and k == 0
            add(a, b, "first" if known and text[a:b] in _FIRST else "surname")
    alone = sorted({text[a:b] for a, b, kind in found if kind == "surname"}, key=lambda n: (-len(n), n))
    if alone:  # the same people without title or first name
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, alone))})\b", text):
            add(*m.span(), "surname")
    return found


def replaced(text: str, key: bytes, tweaks: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at = [], 0
    found = entities(text)
    for a, b, kind in found:
        norm = normal(kind, text[a:b])
        out += [text[at:a], dressed(kind, surrogate(key, kind, norm, tweaks.get((kind, norm), 0)), text[a:b])]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, kind and norm of each document's distinct entities."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, str, str]] = []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                text = t.as_py() or ""
                rows += [(i, *e) for e in sorted({(kind, normal(kind, text[x:y])) for x, y, kind in entities(text)})]
            at = pa.array([r[0] for r in rows], pa.int64())
            kept = [c.take(at) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[*b.schema.names[:-1], "kind", "norm"])

    rows = docs.select(*keep, "text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{schema}kind string, norm string")


def exceptions(known: DataFrame, key: bytes, rounds: int = 60) -> DataFrame:
    """kind, norm and tweak (1 and more) of the entities whose first surrogate collides; an error if some still do after rounds. known: distinct kind, norm."""

    def drawn(df: DataFrame) -> DataFrame:
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [surrogate(key, k, n, t) for k, n, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "norm", "tweak", "made"])

        return df.select("kind", "norm", "tweak").mapInArrow(draw, "kind string, norm string, tweak int, made string")

    current = cut(drawn(known.withColumn("tweak", F.lit(0))))
    real = known.where("kind <> 'first'").select("kind", F.col("norm").alias("made")).withColumn("real", F.lit(True))
    for _ in range(rounds):
        winner = current.groupBy("kind", "made").agg(F.min(F.struct("tweak", "norm"))["norm"].alias("first"), F.count("*").alias("n"))
        judged = current.join(winner, ["kind", "made"]).join(real, ["kind", "made"], "left")
        bad = cut(judged.where((F.col("norm") != F.col("first")) | F.col("real")).select("kind", "norm", (F.col("tweak") + 1).alias("tweak")))
        if bad.isEmpty():
            break
        current = cut(current.join(bad.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(drawn(bad)))
    else:
        raise RuntimeError(f"surrogates of {bad.count()} entities still collide after {rounds} draws")
    return current.where("tweak > 0").select("kind", "norm", "tweak")


def pseudonymised(docs: DataFrame, key: bytes, broadcast_entities: int = 20_000) -> DataFrame:
    """doc_id, text with surrogates, entities (how many were replaced)."""
    known = cut(_found(docs, []).distinct().repartition(pieces_for(docs, 16 << 20), "kind", "norm"))
    odd = cut(exceptions(known, key))
    kind = dict(docs.dtypes)["doc_id"]
    small = odd.count() <= broadcast_entities
    tweaks = {(r.kind, r.norm): r.tweak for r in odd.collect()} if small else {}  # counted first
    if small:
        rows = docs.select("doc_id", F.array().cast("array<struct<kind:string,norm:string,tweak:int>>").alias("odd"), "text")
    else:
        row = F.xxhash64("doc_id", "text")
        mine = _found(docs.select(row.alias("row"), "text"), ["row"]).distinct().join(odd, ["kind", "norm"])
        mine = mine.groupBy("row").agg(F.collect_list(F.struct("kind", "norm", "tweak")).alias("odd"))
        rows = docs.withColumn("row", row).join(mine, "row", "left").select("doc_id", "odd", "text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for odd_here, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py()
                own = tweaks | {(o["kind"], o["norm"]): o["tweak"] for o in odd_here} if odd_here else tweaks
                new, n = (None, 0) if text is None else replaced(text, key, own)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "entities"])

    return rows.mapInArrow(rewrite, f"doc_id {kind}, text string, entities long")
