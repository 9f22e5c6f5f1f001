"""Direct-message threads in JSON, several files a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import utf8_read_as_latin1
from quillon.operators.ordered import with_rank
from quillon.sources.common import file_name, normalized, parent_name

_SCHEMA = "messages array<struct<sender_name: string, timestamp_ms: long, content: string, photos: array<struct<uri: string>>>>"


def read_dm_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of one thread folder or of many. Messages keep the order of their time, then of file and position;
    texts that were UTF-8 read as Latin-1 are put right."""
    files = spark.read.schema(_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "message_*.json").json(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), "messages")
    rows = files.select("file", F.posexplode("messages").alias("pos", "m")).withColumn("thread", parent_name(F.col("file")))
    rows = rows.withColumns({"no_ts": F.col("m.timestamp_ms").isNull(), "ms": F.col("m.timestamp_ms"), "name": file_name(F.col("file"))})
    rows = with_rank(rows, ["thread"], ["no_ts", "ms", "name", "pos"], "seq")
    return normalized(
        rows.select(
            F.lit("instagram").alias("source"), "thread", F.timestamp_millis("m.timestamp_ms").alias("ts"), utf8_read_as_latin1(F.col("m.sender_name")).alias("sender"),
            utf8_read_as_latin1(F.col("m.content")).alias("text"), F.get("m.photos", F.lit(0))["uri"].alias("media_path"), F.lit(False).alias("is_system"),
            F.to_json(F.struct("thread")).alias("meta"), F.concat(F.lit("instagram:"), F.col("thread")).alias("source_group"), "seq",
        )
    )
