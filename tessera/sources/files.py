"""Files that hold a whole document: arrays of JSON records and configuration.

Files are read as texts through Spark's own readers, so any store that Spark
reads will do, and a task takes some files, never all. A file or an element that
cannot be read is a row with an error, not the end of the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _texts(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("_text"))


def json_array_rows(spark: SparkSession, path: str | list[str], schema: T.StructType | str, glob: str | None = "*.json") -> DataFrame:
    """source_file, position, record and error of every element of JSON files below path, whatever folder they are in.

    A file holds an array of objects, or one object, which is then its only
    element. An unreadable file is one row, with error `unreadable` and neither
    position nor record; an element that is no object has the error `not an
    object`; fields that the schema lacks are left out, and those that a record
    lacks or that have another type are null. Empty arrays and files of no bytes
    give no rows.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = F.schema_of_variant(F.try_parse_json("_text"))
    files = _texts(spark, path, glob).withColumn("_kind", kind)
    elements = F.when(F.col("_kind").startswith("ARRAY"), F.from_json("_text", "array<string>")).when(F.col("_kind").startswith("OBJECT"), F.array("_text"))
    unread = F.col("_kind").isNull() | ~F.col("_kind").rlike("^(ARRAY|OBJECT)")
    rows = files.select("source_file", F.when(unread, F.array(F.lit(None).cast("string"))).otherwise(elements).alias("_elements"), unread.alias("_unread"))
    rows = rows.select("source_file", "_unread", F.posexplode("_elements").alias("_at", "_element"))
    whole = ~F.col("_unread") & F.coalesce(F.ltrim("_element").startswith("{"), F.lit(False))
    error = F.when(F.col("_unread"), "unreadable").when(~whole, "not an object")
    return rows.select("source_file", F.when(~F.col("_unread"), F.col("_at")).alias("position"), F.when(whole, F.from_json("_element", schema)).alias("record"), error.alias("error"))


def good_records(rows: DataFrame, excluded: Column | None = None) -> DataFrame:
    """source_file, position and the fields of readable records, without those that `excluded`, a condition over the fields, holds for."""
    fields = [F.col(f"record.{f}").alias(f) for f in rows.schema["record"].dataType.names]
    out = rows.where("error IS NULL").select("source_file", "position", *fields)
    return out if excluded is None else out.where(~F.coalesce(excluded, F.lit(False)))


def _flat(value: object, at: tuple[str, ...] = ()) -> Iterator[tuple[str, str | None]]:
    """Dotted paths and values; elements of lists go by their number, texts stay as they are, other values are JSON."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if inner and value:
        for k, v in inner:
            yield from _flat(v, (*at, str(k)))
    else:
        yield ".".join(at), None if value is None else value if isinstance(value, str) else json.dumps(value, default=str)


def config_rows(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """source_file, key (dotted path), value and error of YAML or JSON configuration files; of an unreadable file, one row with the error `unreadable`.

    Texts are themselves, other values JSON, null stays null; an empty file has no rows.
    """

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            out = []
            for file, text in zip(part["source_file"], part["_text"], strict=True):
                try:
                    found = yaml.safe_load(text)
                    out += [(file, k, v, None) for k, v in _flat(found)] if found is not None else []
                except (yaml.YAMLError, ValueError):
                    out.append((file, None, None, "unreadable"))
            yield pd.DataFrame(out, columns=["source_file", "key", "value", "error"], dtype=object)

    return _texts(spark, path, glob).mapInPandas(entries, "source_file string, key string, value string, error string")


def config_values(rows: DataFrame, defaults: dict[str, object], section: str = "") -> DataFrame:
    """Key and value for each key of defaults, below section: what the files say (of several, the last by name), else the default.

    A default that is a mapping or list stands for all keys below it if the files have none of them.
    """
    spark, prefix = rows.sparkSession, f"{section}." if section else ""
    fallback = spark.createDataFrame([(top, *entry) for top, v in defaults.items() for entry in _flat(v, (top,))], "top string, key string, value string")
    tops = [prefix + k for k in defaults]
    key = F.col("key")
    own = rows.where(F.col("error").isNull()).where(F.coalesce(F.array_contains(F.array(*map(F.lit, tops)), key), F.lit(False)) | F.coalesce(F.exists(F.array(*map(F.lit, tops)), lambda t: key.startswith(F.concat(t, F.lit(".")))), F.lit(False)))
    own = own.select(F.substring(key, len(prefix) + 1, 10_000).alias("key"), "value", "source_file").groupBy("key").agg(F.max_by(F.struct("value"), "source_file")["value"].alias("value"))
    own = own.withColumn("top", F.split_part("key", F.lit("."), F.lit(1)))
    missing = fallback.join(own.select("top").distinct(), "top", "left_anti")
    return own.select("key", "value").unionByName(missing.select("key", "value"))
