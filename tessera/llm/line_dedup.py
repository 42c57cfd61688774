"""Boilerplate lines by site-relative frequency (operator 3).

Pages are grouped by host. A line's ratio is the number of the host's pages
that contain it, each counted once, over the number of the host's pages; lines
whose ratio exceeds ``ratio`` are dropped from all pages of that host. Lines are
compared without white space around them; blank lines have no ratio and stay.
Hosts with fewer than ``least_pages`` pages are left alone, as one page of two
says nothing; lines in fewer than ``least_copies`` of a host's pages stay, which does
without such a floor on hosts. A page that would lose every line keeps them all: it is a copy of
other pages rather than furniture around a text, which near-duplicate removal
decides on.

Counting moves 128-bit hashes of lines, never lines, and adds up before the
shuffle. A host's pages contain each dropped line in more than ``ratio`` of them,
so a host has at most (its mean lines a page) / ratio such lines: the hashes of
a host fit a row. That table is broadcast only when it was counted to hold at most
``broadcast_lines`` hashes; else it is joined by host, where Spark splits hosts that
are hot.

A page with null host is nobody's: it keeps its lines and counts nowhere. Null
text stays null, with no lines. Repeated rows count as pages. An empty table
gives an empty result; other columns pass through in one struct, so their names may
be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import cut

ADDED = ("line_count", "dropped_lines", "kept_text")


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("g"))


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = 0.06, least_pages: int = 1, least_copies: int = 3) -> DataFrame:
    """boiler_host and boiler, the hashes of the host's lines whose ratio is too high."""
    lines = F.array_distinct(F.transform(F.split(text, "\n"), _trimmed))
    rows = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("boiler_host"), lines.alias("lines"))
    each = rows.select("boiler_host", F.explode("lines").alias("line")).where(F.col("line") != "").select("boiler_host", _hash(F.col("line")).alias("line"))
    held = each.groupBy("boiler_host", "line").agg(F.count("*").alias("n"))
    total = pages.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("boiler_host")).agg(F.count("*").alias("of_host")).where(F.col("of_host") >= least_pages)
    often = held.where((F.col("n") > max(1.0, ratio * least_pages)) & (F.col("n") >= least_copies)).join(total, "boiler_host").where(F.col("n") > F.col("of_host") * ratio)
    return often.groupBy("boiler_host").agg(F.collect_list(F.col("line.h")).alias("boiler"), F.collect_list(F.col("line.g")).alias("boiler_g"))


def _split(pages: DataFrame, host: str, text: str, broadcast_lines: int, **how: float) -> DataFrame:
    """row (all of a page's columns), line_count, dropped_lines and kept_text."""
    found = cut(boilerplate(pages, host, text, **how))
    hashes = found.agg(F.sum(F.size("boiler"))).first()[0] or 0
    if hashes <= broadcast_lines:
        found = F.broadcast(found)
    lines = F.split("t", "\n")
    is_boiler = lambda x: (_trimmed(x) != "") & F.arrays_overlap(F.array(F.xxhash64(_trimmed(x))), F.col("boiler")) & F.array_contains("boiler_g", F.xxhash64(_trimmed(x), F.lit(1)))
    rows = pages.select(F.struct("*").alias("row"), F.col(host).alias("h"), F.col(text).alias("t"))
    joined = rows.join(found, F.col("h") == F.col("boiler_host"), "left")
    joined = joined.withColumn("kept_lines", F.when(F.col("boiler").isNotNull(), F.filter(lines, lambda x: ~is_boiler(x))))
    whole = F.col("boiler").isNull() | (F.coalesce(F.aggregate("kept_lines", F.lit(0), lambda n, x: n + (_trimmed(x) != "").cast("int")), F.lit(0)) == 0)
    counted = joined.withColumn("line_count", F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    dropped = F.when(whole | F.col("t").isNull(), 0).otherwise(F.col("line_count") - F.size("kept_lines")).cast("long")
    new_text = F.when(whole | F.col("t").isNull(), F.col("t")).otherwise(F.array_join("kept_lines", "\n"))
    return counted.select("row", "line_count", dropped.alias("dropped_lines"), new_text.alias("kept_text"))


def marked(pages: DataFrame, host: str, text: str = "text", broadcast_lines: int = 20_000, **how: float) -> DataFrame:
    """pages with line_count, dropped_lines and kept_text, which replace columns of these names."""
    mine = [c for c in pages.columns if c not in ADDED]
    return _split(pages, host, text, broadcast_lines, **how).select(*(F.col("row").getField(c).alias(c) for c in mine), *ADDED)


def without_boilerplate(docs: DataFrame, host: str, text: str = "text", length: str | None = None, broadcast_lines: int = 20_000, **how: float) -> DataFrame:
    """docs with their lines dropped, columns as before; length names a column of characters to set anew."""
    out = _split(docs, host, text, broadcast_lines, **how)

    def column(name: str) -> Column:
        was = F.col("row").getField(name)
        if name == text:
            return F.col("kept_text").alias(name)
        if name == length:
            return F.when(F.col("dropped_lines") > 0, F.length("kept_text").cast(dict(docs.dtypes)[name])).otherwise(was).alias(name)
        return was.alias(name)

    return out.select(*map(column, docs.columns))


SQL = """
WITH lines AS (
  SELECT d.rowid AS page, source, trim(l, chr(32) || chr(9) || chr(13)) AS line, l AS raw, i
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d,
       LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i)
), hosts AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1
), boiler AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source = h.source
  WHERE l.line <> '' AND h.n >= {least_pages}
  GROUP BY l.source, l.line, h.n HAVING count(DISTINCT page) > h.n * {ratio} AND count(DISTINCT page) > greatest(1.0, {ratio} * {least_pages}) AND count(DISTINCT page) >= {least_copies}
), flagged AS (
  SELECT l.page, l.i, l.raw, l.line, b.line IS NOT NULL AS bad FROM lines l LEFT JOIN boiler b ON l.source = b.source AND l.line = b.line
), pages AS (
  SELECT page, count(*) AS line_count, count(*) FILTER (bad) AS dropped, count(*) FILTER (NOT bad AND line <> '') AS left_over,
         string_agg(raw, chr(10) ORDER BY i) FILTER (NOT bad) AS kept, string_agg(raw, chr(10) ORDER BY i) AS whole
  FROM flagged GROUP BY page
)
SELECT d.doc_id, d.source, coalesce(p.line_count, 0)::BIGINT AS line_count,
       (CASE WHEN coalesce(p.left_over, 0) = 0 THEN 0 ELSE p.dropped END)::BIGINT AS dropped_lines,
       md5(CASE WHEN coalesce(p.left_over, 0) = 0 THEN d.text ELSE p.kept END) AS kept_md5
FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d LEFT JOIN pages p ON d.rowid = p.page
"""
