"""Photo folders with sidecars and image headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import exif
from quillon.operators.windows import first_by_min
from quillon.sources.common import file_name, local_to_utc, normalized

# Endings of photos, in any case.
ENDINGS = ("jpg", "jpeg", "png", "heic", "heif")
_SIDECAR = "photoTakenTime struct<timestamp: string>, geoData struct<latitude: double, longitude: double>"


def read_photos(spark: SparkSession, root: str, source_tz: str) -> DataFrame:
    """Items of all photos below ``root``; of equal contents the least deep, then first path wins. A sidecar comes
    before the image header: its place stays even if its time is missing, and once it has a time the header is not
    asked. An image that has to be asked and cannot be read is left out (``unreadable`` lists it)."""
    made = _dated(spark, root, source_tz).where("not lost")
    meta = F.to_json(F.struct("lat", "lon", "taken_source"))
    numbered = made.orderBy("depth", "rel").withColumn("seq", F.monotonically_increasing_id())  # rising, not consecutive
    return normalized(
        numbered.select(
            F.lit("photo").alias("source"), F.lit(None).cast("string").alias("thread"), "ts", F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("text"),
            F.col("rel").alias("media_path"), F.lit(False).alias("is_system"), meta.alias("meta"), F.lit("photos").alias("source_group"), "seq",
        )
    )


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    return _dated(spark, root, "UTC").where("lost").select("rel")


def _dated(spark: SparkSession, root: str, source_tz: str) -> DataFrame:
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    files = files.withColumn("path", F.url_decode("path"))
    rel = F.element_at(F.split("path", F.lit("\\Q" + base + "/\\E")), -1)
    files = files.withColumn("rel", rel).withColumn("name", file_name(F.col("path"))).withColumn("folder", F.regexp_replace("rel", r"[^/]*$", ""))
    images = files.where(F.lower("name").rlike(r"\.(" + "|".join(ENDINGS) + ")$"))
    images = images.select("rel", "name", "folder", "content", F.size(F.split("rel", "/")).alias("depth"), F.sha2("content", 256).alias("digest"))
    images = first_by_min(images, ["digest"], ["depth", "rel"])
    notes = files.where(F.lower("name").endswith(".json")).select("folder", F.col("name").alias("note"), F.from_json(F.col("content").cast("string"), _SIDECAR).alias("side"))
    named = images.select("rel", "folder", "name").join(notes, "folder")
    full, bare = F.concat("name", F.lit(".supplemental-metadata.json")), F.concat("name", F.lit(".json"))
    cut = F.startswith("note", F.concat("name", F.lit(".supplement")))
    rank = F.when(F.col("note") == full, 0).when(F.col("note") == bare, 1).when(cut, 2)
    named = named.withColumn("rank", rank).where("rank is not null")
    best = first_by_min(named.select("rel", "rank", "note", "side"), ["rel"], ["rank", "note"]).select("rel", "side")
    taken = F.timestamp_micros((F.col("side.photoTakenTime.timestamp").try_cast("double") * 1_000_000).cast("long"))
    lat, lon = F.col("side.geoData.latitude"), F.col("side.geoData.longitude")
    placed = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    joined = images.join(best, "rel", "left").withColumn("side_ts", taken).withColumn("side_lat", F.when(placed, lat)).withColumn("side_lon", F.when(placed, lon))
    ask = F.col("side_ts").isNull()
    joined = joined.withColumn("head", F.when(ask, exif("content")))
    wall = F.try_to_timestamp("head.taken", F.lit("yyyy:MM:dd HH:mm:ss"))
    return joined.select(
        "rel", "depth",
        F.coalesce("side_ts", local_to_utc(wall, source_tz)).alias("ts"),
        F.coalesce("side_lat", "head.lat").alias("lat"), F.coalesce("side_lon", "head.lon").alias("lon"),
        F.when(~ask, "sidecar").when(wall.isNotNull(), "exif").alias("taken_source"),
        (ask & F.col("head").isNull()).alias("lost"),
    )
