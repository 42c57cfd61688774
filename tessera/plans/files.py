"""Round trips of whole tables through files of records and of configuration, some of them broken."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.components import _shared_dir
from tessera.plans._registry import query, tables
from tessera.sources import files


@query("""
WITH d AS (SELECT doc_id // 100 AS file, doc_id, source, sha256(text) AS text_sha256, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS position FROM documents)
SELECT file, position, doc_id, source, text_sha256, NULL AS error FROM d WHERE file % 7 <> 3 UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, NULL, 'unreadable' FROM d WHERE file % 7 = 3
""")
def json_array_files(spark, sf_dir):
    """Documents as files of a hundred each, every seventh cut off before its end, read back with what could not be read."""
    (docs,) = tables(spark, sf_dir, "documents")
    path = f"{_shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    records = docs.groupBy(F.expr("doc_id div 100").alias("file")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("doc_id", "source", "text")))).alias("text"))  # a hundred a group, as doc_id is a key
    cut = F.when(F.col("file") % 7 == 3, F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    records.select("file", cut.alias("text")).write.partitionBy("file").text(path)
    rows = files.json_array_rows(spark, path, "doc_id long, source string, text string", glob=None)
    file = F.regexp_extract("source_file", "/file=([0-9]+)/", 1).cast("long")
    return rows.select(file.alias("file"), F.col("position").cast("long").alias("position"), "record.doc_id", "record.source", F.sha2("record.text", 256).alias("text_sha256"), "error")


@query("""
WITH m AS (SELECT user_id, event_type, max(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type || '.most' AS key, value::VARCHAR AS value FROM m UNION ALL SELECT user_id, event_type || '.n', n::VARCHAR FROM m
""")
def config_files(spark, sf_dir):
    """A configuration file for each user, written from events and read as rows."""
    (events,) = tables(spark, sf_dir, "events")
    path = f"{_shared_dir(spark)}/config-{uuid.uuid4().hex}"
    by_kind = events.groupBy("user_id", "event_type").agg(F.max("value").alias("most"), F.count("*").alias("n"))
    by_user = by_kind.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("most", "n"))))).alias("text"))
    by_user.write.partitionBy("user_id").text(path)
    rows = files.config_rows(spark, path)
    return rows.where("error IS NULL").select(F.regexp_extract("source_file", "/user_id=([0-9]+)/", 1).cast("long").alias("user_id"), "key", "value")
