"""SMS and MMS backups in XML. The built-in reader splits large files by row tag and never resolves entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ordered import with_rank
from quillon.sources.common import normalized, stem

_SMS = "_address string, _date string, _type string, _body string, _contact_name string"
_MMS = (
    "_address string, _date string, _msg_box string, _contact_name string, "
    "parts struct<part: array<struct<_VALUE: string, _ct: string, _text: string, _data: string>>>, addrs struct<addr: array<struct<_VALUE: string, _address: string, _type: string>>>"
)


def _val(c: Column) -> Column:
    """The literal text null counts as missing."""
    return F.when(c != "null", c)


def _time(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("long"))


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    return rows.withColumn("file", F.input_file_name()).withColumn("place", F.monotonically_increasing_id())


def _sms(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, "sms", _SMS)
    got = F.col("_type") == "1"
    return rows.where("_type in ('1', '2')").select(
        F.lit("sms").alias("source"), _val(F.col("_address")).alias("thread"), _time(F.col("_date")).alias("ts"), F.when(got, _val(F.col("_contact_name"))).otherwise("me").alias("sender"),
        _val(F.col("_body")).alias("text"), F.lit(None).cast("string").alias("media_path"), F.when(got, "received").otherwise("sent").alias("direction"), _val(F.col("_address")).alias("address"),
        F.lit(None).cast("boolean").alias("mms_media"), "file", "place",
    )


def _mms(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, "mms", _MMS)
    got = F.col("_msg_box") == "1"
    texts = F.filter(F.transform(F.filter("parts.part", lambda p: p["_ct"] == "text/plain"), lambda p: _val(p["_text"])), lambda t: t.isNotNull() & (t != ""))
    other = F.exists("parts.part", lambda p: ~F.coalesce(p["_ct"].isin("text/plain") | p["_ct"].startswith("application/smil"), F.lit(False)) & _val(p["_data"]).isNotNull())
    address = F.try_element_at(F.filter("addrs.addr", lambda a: a["_type"] == "137"), F.lit(-1))["_address"]
    return rows.where("_msg_box in ('1', '2')").select(
        F.lit("mms").alias("source"), _val(address).alias("thread"), _time(F.col("_date")).alias("ts"), F.when(got, _val(address)).otherwise("me").alias("sender"),
        F.nullif(F.array_join(texts, "\n"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("media_path"), F.when(got, "received").otherwise("sent").alias("direction"),
        _val(address).alias("address"), F.when(other, F.lit(True)).alias("mms_media"), "file", "place",
    )


def read_sms_xml(spark: SparkSession, path: str, group_by: str = "file") -> DataFrame:
    """Items of SMS/MMS backups. Drafts and unknown types are left out (``dropped`` counts the latter). The two row
    tags are read apart, so order within a file is by time, then place. ``group_by`` 'file' keeps all contacts of a
    file in one group, 'thread' makes one of each contact."""
    rows = _sms(spark, path).unionByName(_mms(spark, path))
    rows = with_rank(rows.withColumn("no_ts", F.col("ts").isNull()), ["file"], ["no_ts", "ts", "source", "place"], "seq")
    meta = F.to_json(F.struct("thread", "direction", "address", "mms_media"))
    group = F.concat(F.lit("sms:"), stem(F.col("file")) if group_by == "file" else F.coalesce("thread", F.lit("")))
    made = rows.withColumn("meta", meta).withColumn("source_group", group).withColumn("is_system", F.lit(False))
    return normalized(made)


def dropped(spark: SparkSession, path: str) -> DataFrame:
    """(what, kind, n): rows of unknown type or box, for warnings; drafts are not among them."""
    a = _read(spark, path, "sms", _SMS).where("coalesce(_type, '') not in ('1', '2', '3')").select(F.lit("sms").alias("what"), F.col("_type").alias("kind"))
    b = _read(spark, path, "mms", _MMS).where("coalesce(_msg_box, '') not in ('1', '2')").select(F.lit("mms").alias("what"), F.col("_msg_box").alias("kind"))
    return a.unionByName(b).groupBy("what", "kind").agg(F.count("*").alias("n"))
