"""Fill-in-the-middle transformation (operator 12).

A text is a row of units (code points, unless another pattern is given). Two draws cut it
into prefix, middle and suffix at unit ends; a third decides whether it stays
plain, a fourth between two orders:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

Draws are groups of eight hex digits of the SHA-256 of ``seed:doc_id``, so any run
and any engine makes the same cuts.

The work is a pandas UDF over Arrow batches and shuffles nothing. For each text the
matches of the unit pattern leave their end offsets in one array of four bytes a
unit, and the two cuts are two lookups in it. ``restored`` undoes the transformation
from output and form alone; the UDF hashes what it gives, so that a round trip can
be checked without moving texts.

Null text counts as empty and stays plain with n = 0, as does empty text. Text that
holds one of the three marks stays plain, so marks in an output are always real
ones. A null doc_id has an empty string for its number; text doc_ids stand as they
are. Repeated rows get the same result each; there are no ties, as rows do not
meet. A text of any length is one value, with four bytes a unit beside it. What
lies between two units belongs to the later one, and what follows the last one to
the suffix. An empty table gives an empty result. Columns other than ``doc_id`` and
``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = regex.compile("|".join(map(regex.escape, (PREFIX, SUFFIX, MIDDLE))))
_END = methodcaller("end")


def draws(seed: str, doc_id: str) -> list[int]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def arranged(text: str, ends: array, numbers: list[int], transformed: int = 90, spm: int = 20) -> tuple[str, int | None, int | None, str]:
    """form, characters of prefix and middle (None if plain) and output of a text whose units end at ``ends``."""
    first, second, whether, order = numbers
    if not text or whether % 100 >= transformed or MARK.search(text):
        return "plain", None, None, text
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, middle = output[len(PREFIX) :].split(MIDDLE)
    a, b = first.split(SUFFIX if form == "psm" else PREFIX)
    return f"{a}{middle}{b}" if form == "psm" else f"{b}{middle}{a}"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def transformation(doc_id: Column, text: Column, seed: str = "1", unit: str = CODE_POINT, transformed: int = 90, spm: int = 20, with_output: bool = True) -> Column:
    """A struct of n, form, prefix_chars, middle_chars, output (unless left out), output_sha256 and restored_sha256.

    transformed: how many of a hundred texts are not left plain; spm: how many of a hundred of those have the suffix first.
    """
    kind = f"n long, form string, prefix_chars long, middle_chars long, {'output string, ' if with_output else ''}output_sha256 string, restored_sha256 string"
    columns = [field.split()[0] for field in kind.split(", ")]

    @F.pandas_udf(kind)
    def of_batch(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units, rows = regex.compile(unit), []
        for number, whole in zip(ids, texts, strict=True):
            ends = array("I", map(_END, units.finditer(whole)))
            form, before, between, output = arranged(whole, ends, draws(seed, number), transformed, spm)
            rows.append((len(ends), form, before, between, *([output] if with_output else []), _hash(output), _hash(restored(output, form))))
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return of_batch(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def transform(docs: DataFrame, with_output: bool = True, **how: object) -> DataFrame:
    """doc_id and the fields of ``transformation``, one row for each row of docs."""
    return docs.select("doc_id", transformation(F.col("doc_id"), F.col("text"), with_output=with_output, **how).alias("fim")).select("doc_id", "fim.*")


#: The contract's parameters: seed 1, 90 of 100 transformed, 20 of 100 of those with the suffix first.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
h AS (SELECT *, ('0x' || substr(g, 1, 8))::BIGINT AS h1, ('0x' || substr(g, 9, 8))::BIGINT AS h2, ('0x' || substr(g, 17, 8))::BIGINT AS h3, ('0x' || substr(g, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""
