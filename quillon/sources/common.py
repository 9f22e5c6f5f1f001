"""What all readers share: the normalized item, safe media paths, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import unsafe_media_path, unsafe_path_note
from quillon.identity import item_id, py_or


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.url_decode(path), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(F.url_decode(path), "/"), -2)


def local_to_utc(wall: Column, zone: str | Column) -> Column:
    """A wall-clock text or timestamp of ``zone`` as a UTC timestamp. The zone is always named; the machine's own
    plays no part."""
    return F.to_utc_timestamp(wall, zone if isinstance(zone, Column) else F.lit(zone))


def normalized(rows: DataFrame, native_id: str | None = None) -> DataFrame:
    """Rows with source, thread, ts, sender, text, media_path, is_system, meta, source_group and seq as items. An
    unsafe media path is dropped and noted in the text; the id is the native one where there is one, else derived."""
    unsafe = F.coalesce(unsafe_media_path(F.col("media_path")), F.lit(False))
    note = F.when(unsafe, unsafe_path_note(F.col("media_path")))
    rows = rows.withColumn("text", F.when(unsafe, F.concat_ws(" ", F.nullif("text", F.lit("")), note)).otherwise(F.col("text")))
    rows = rows.withColumn("media_path", F.when(~unsafe, F.col("media_path")))
    derived = item_id(F.col("source"), F.col("thread"), F.col("ts"), F.col("sender"), F.col("text"), F.col("media_path"))
    key = py_or(F.col(native_id), derived) if native_id else derived
    return rows.select(key.alias("id"), "source", F.col("ts").cast("timestamp").alias("ts"), "sender", "text", "media_path", F.coalesce("is_system", F.lit(False)).alias("is_system"), "meta", "source_group", "seq")
