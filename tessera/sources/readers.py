"""Sources: JSON lines and arrays, CSV catalogues, configuration, trees of files, metrics logs.

Every reader takes an explicit schema, so nothing is scanned to infer one; bad
records are kept apart in ``_corrupt_record`` instead of ending the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _tolerant(schema: T.StructType | str) -> T.StructType:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, good_only: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped, malformed ones kept apart or left out."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    df = rows.select(F.from_json("value", _tolerant(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if good_only else df


def json_arrays(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Files that hold an array of objects, or one object; unreadable files give no rows. Adds source_file."""
    df = spark.read.schema(_tolerant(schema)).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.withColumn("source_file", F.col("_metadata.file_path")).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def wrapped_examples(text: Column, schema: str) -> Column:
    """A JSON text as an array of rows, whether it is a list, {"examples": [...]}, {"data": [...]} or one object."""
    as_list = F.from_json(text, f"array<{schema}>")
    inner = F.from_json(text, f"struct<examples:array<{schema}>,data:array<{schema}>>")
    first = F.substring(F.ltrim(text), 1, 1)
    return F.when(first == "[", as_list).otherwise(F.coalesce(inner["examples"], inner["data"], F.array(F.from_json(text, schema))))


def csv_catalog(spark: SparkSession, path: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """A CSV with a header, all values as strings."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def config_table(spark: SparkSession, entries: dict[str, object], key: str = "key", value: str = "value") -> DataFrame:
    """A configuration mapping as a small table; nested values as JSON text."""
    rows = [(str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in entries.items()]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


#: Parts of a path that are always left out.
ALWAYS_SKIPPED = ("vendor/", "node_modules/", "/tests/", "/test/", ".phpcs")


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression; * also crosses directories."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (f"\\{c}" if c in r".^$+{}()|\[]" else c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def path_allowed(rel: Column, paths: Iterable[str] = (), skip_paths: Iterable[str] = ()) -> Column:
    """Whether a relative path is to be read: skipped parts, skipped prefixes or globs, then allowed prefixes or globs."""
    bad = F.lit(False)
    for part in ALWAYS_SKIPPED:
        bad = bad | rel.contains(part)
    for s in skip_paths:
        bad = bad | rel.startswith(s) | rel.rlike(_glob(s))
    good = F.lit(not list(paths))
    for p in paths:
        if "*" in p:
            plain = p.replace("**/", "")
            good = good | rel.rlike(_glob(plain)) | rel.rlike(_glob(f"*/{plain}"))
        else:
            good = good | rel.startswith(p)
    return ~bad & good


def file_tree(spark: SparkSession, root: str, glob: str = "*", paths: Iterable[str] = (), skip_paths: Iterable[str] = ()) -> DataFrame:
    """Path relative to root, content and sha256 of the files below root that path_allowed lets through."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in root.rstrip("/")) + "/", "")
    df = df.withColumn("rel_path", rel).where(path_allowed(F.col("rel_path"), paths, skip_paths))
    return df.select("rel_path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def captured(df: DataFrame) -> DataFrame:
    """Rows of a capture that carry an index; provenance rows have none."""
    return df.where(F.col("index").isNotNull())


def stem_parts(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """Columns from a file name by the groups of pattern."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return [F.nullif(F.regexp_extract(stem, pattern, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)]
