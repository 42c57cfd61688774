"""Functions out of source files: a small tokenizer as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"""(?P<doc>/\*\*.*?\*/)|(?P<skip>/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|<<<(['"]?)(?P<tag>\w+)\3\n.*?\n\s*(?P=tag)\b)|(?P<word>::class|\$?[A-Za-z_]\w*)|(?P<mark>[{};()&])""", re.DOTALL)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract"}


def functions_in(text: str) -> Iterator[tuple[str, str | None, str | None, str, int, int]]:
    """function_name, class_context, docblock, body, start_line and line_count of each named function.

    Braces are counted outside strings and comments; a doc comment belongs to the
    function if only modifiers stand between; ::class opens no class.
    """
    depth, classes, doc, head, begin = 0, [], None, False, None
    open_functions: list[tuple[int, str, str | None, str | None, int]] = []
    wait: tuple[str, int, str | None] | None = None
    name_next = None
    for m in TOKEN.finditer(text):
        kind, tok = m.lastgroup, m.group()
        if kind == "doc":
            doc, begin = tok, None
        elif m["skip"] is not None:
            continue
        elif kind == "word":
            if tok == "::class":
                continue
            if name_next:
                if name_next == "function":
                    wait = ("function:" + tok, begin if begin is not None else m.start(), doc)
                else:
                    wait = ("class:" + tok, m.start(), None)
                name_next, doc, begin = None, None, None
            elif tok == "function":
                name_next, begin = "function", m.start() if begin is None else begin
            elif tok in ("class", "interface", "trait") and not head:
                name_next = "class"
            elif tok in MODIFIERS:
                begin = m.start() if begin is None else begin
            else:
                doc, begin = None, None
            head = tok == "new"
        elif tok == "{":
            depth += 1
            if wait and wait[0].startswith("class:"):
                classes.append((wait[0][6:], depth))
            elif wait:
                open_functions.append((depth, wait[0][9:], classes[-1][0] if classes else None, wait[2], wait[1]))
            wait, doc, begin, name_next = None, None, None, None
        elif tok == "}":
            if open_functions and open_functions[-1][0] == depth:
                _, name, owner, comment, start = open_functions.pop()
                body = text[start : m.end()]
                yield name, owner, comment, body, text.count("\n", 0, start) + 1, body.count("\n") + 1
            if classes and classes[-1][1] == depth:
                classes.pop()
            depth -= 1
            doc, begin = None, None
        elif tok == ";":
            wait, doc, begin, name_next = None, None, None, None
        elif tok == "(" and name_next:
            name_next, doc, begin = None, None, None  # a closure


def extract_functions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and a row for each function of each text. A map: texts are not shuffled."""
    names = ["function_name", "class_context", "docblock", "body", "start_line", "line_count"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *f) for i, t in enumerate(b.column(1)) for f in functions_in(t.as_py() or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))], names=[key, *names])

    schema = f"`{key}` {dict(df.dtypes)[key]}, function_name string, class_context string, docblock string, body string, start_line int, line_count int"
    return df.select(key, text).mapInArrow(scan, schema)
