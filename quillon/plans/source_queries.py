"""Queries of the readers: exports in the readers' formats are written from the test tables, read back, and compared
with what SQL says of the tables. Files lie in the session's shared folder; text and JSON files are written by
executors, a SQLite store by a streaming writer, as it is one file."""

from __future__ import annotations

import hashlib
import json
import plistlib
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.operators import windows
from quillon.operators.evals import load_gold
from quillon.sources import phone_backup as pb
from quillon.sources import render
from quillon.sources.chat_text import orphan_lines, read_chat_text
from quillon.sources.dispatch import read
from quillon.sources.dm_json import read_dm_json
from quillon.sources.photos import read_photos
from quillon.sources.sms_xml import dropped, read_sms_xml
from quillon.session import scratch_path, shared_file_dir, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Seconds that bring the orders beyond 2001, from which the phone counts.
LATER = 630_720_000
_ORDERS = "(SELECT *, CAST(o_orderkey % 86400 AS BIGINT) AS s FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("s", (F.col("o_orderkey") % 86400).cast("long"))
    return o.withColumn("wall", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s")))


def _chat_lines(spark: SparkSession, d: str) -> str:
    """A chat export of the orders: four kinds of message, some with a second line, in both header forms."""
    o = _orders(spark, d)
    k = F.col("o_orderkey") % 4
    bracket = F.concat(F.lit("["), F.date_format("wall", "dd/MM/yyyy, HH:mm:ss"), F.lit("] "))
    dash = F.concat(F.date_format("wall", "M/d/yyyy, h:mm:ss a"), F.lit(" - "))
    who = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    body = (
        F.when(k == 0, F.concat(bracket, who, F.lit(": "), "o_orderpriority", F.lit(": ok\n\nand "), F.col("o_orderkey").cast("string")))
        .when(k == 1, F.concat(dash, who, F.lit(": my photo "), F.col("o_orderkey").cast("string"), F.lit(".jpg (file attached)")))
        .when(k == 2, F.concat(F.lit("‎"), bracket, who, F.lit(": <attached: ../"), F.col("o_orderkey").cast("string"), F.lit("> late")))
        .otherwise(F.concat(dash, F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" was closed")))
    )
    path = scratch_path(spark, "chat")
    o.select(body.alias("value")).write.text(path)
    return path


@query(f"""
SELECT CASE WHEN k = 3 THEN NULL ELSE 'Customer ' || o_custkey END AS sender,
  CASE k WHEN 0 THEN o_orderpriority || ': ok' || chr(10) || 'and ' || o_orderkey WHEN 1 THEN NULL WHEN 2 THEN 'late [unsafe media path rejected: ''../' || o_orderkey || ''']' ELSE 'order ' || o_orderkey || ' was closed' END AS text,
  CASE k WHEN 1 THEN 'my photo ' || o_orderkey || '.jpg' END AS media_path, k = 3 AS is_system, epoch_us(o_orderdate) + (s - 19800) * 1000000 AS us
FROM (SELECT *, o_orderkey % 4 AS k FROM {_ORDERS})""")
def chat_text_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = read_chat_text(spark, _chat_lines(spark, d), "Asia/Kolkata", "orders")
    return rows.select("sender", "text", "media_path", "is_system", F.unix_micros("ts").alias("us"))


@query("SELECT 'messages' AS what, count(*) AS n FROM orders UNION ALL SELECT 'places', count(*) FROM orders UNION ALL SELECT 'lines before a header', 0")
def chat_text_order(spark: SparkSession, d: str) -> DataFrame:
    """Every message has its own place in its file, and no line lies before the first header."""
    path = _chat_lines(spark, d)
    rows = read_chat_text(spark, path, "UTC", "orders")
    place = F.struct("id", "seq", F.get_json_object("meta", "$.line"))
    counts = [rows.agg(F.lit("messages").alias("what"), F.count("*").alias("n")), rows.agg(F.lit("places").alias("what"), F.count_distinct(place).alias("n"))]
    return counts[0].unionByName(counts[1]).unionByName(orphan_lines(spark, path).agg(F.lit("lines before a header").alias("what"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def _write_xml(elements: DataFrame, path: str) -> None:
    """One file with a root for each partition."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(["<?xml version='1.0'?>", "<smses>"])], names=["value"])
        yield from batches
        yield pa.record_batch([pa.array(["</smses>"])], names=["value"])

    elements.mapInArrow(rooted, "value string").write.text(path)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'sms' ELSE 'mms' END AS source, '+' || c_custkey AS thread, CASE WHEN c_custkey % 4 = 3 THEN 'me' WHEN c_custkey % 4 = 1 THEN c_name ELSE '+' || c_custkey END AS sender,
  CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE 'one' || chr(10) || c_mktsegment END AS text, 1500000000000000 + c_custkey * 1000 AS us, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'true' END AS mms_media
FROM customer WHERE c_custkey % 4 <> 0""")
def sms_xml_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    date = (F.col("c_custkey") + 1_500_000_000_000).cast("string")
    sms = F.concat(F.lit('<sms address="+'), key, F.lit('" date="'), date, F.lit('" type="'), F.when(F.col("c_custkey") % 4 == 1, "1").otherwise("3"), F.lit('" body="'), "c_mktsegment", F.lit('" contact_name="'), "c_name", F.lit('"/>'))
    box = F.when(F.col("c_custkey") % 4 == 2, "1").otherwise("2")
    parts = F.concat(F.lit('<parts><part ct="application/smil" text="no"/><part ct="text/plain" text="one"/><part ct="text/plain" text="null"/><part ct="text/plain" text="'), "c_mktsegment", F.lit('"/><part ct="image/png" data="AA=="/></parts>'))
    mms = F.concat(F.lit('<mms date="'), date, F.lit('" msg_box="'), box, F.lit('">'), parts, F.lit('<addrs><addr address="+0" type="151"/><addr address="+'), key, F.lit('" type="137"/></addrs></mms>'))
    path = scratch_path(spark, "sms")
    _write_xml(c.select(F.when(F.col("c_custkey") % 4 < 2, sms).otherwise(mms).alias("value")), path)
    rows = read_sms_xml(spark, path, "thread")
    return rows.select(
        ((F.unix_millis("ts") - 1_500_000_000_000).cast("long")).alias("c_custkey"), "source", F.get_json_object("meta", "$.thread").alias("thread"), "sender", "text", F.unix_micros("ts").alias("us"),
        F.get_json_object("meta", "$.mms_media").alias("mms_media"),
    )


@query("SELECT 'sms' AS what, CAST(n_regionkey + 5 AS VARCHAR) AS kind, count(*) AS n FROM nation GROUP BY n_regionkey")
def sms_xml_dropped(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sms")
    n = table(spark, d, "nation")
    _write_xml(n.select(F.concat(F.lit('<sms address="1" date="1" body="x" type="'), (F.col("n_regionkey") + 5).cast("string"), F.lit('"/>')).alias("value")), path)
    return dropped(spark, path)


@query("""
SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY s_ms, o_orderkey) AS seq, sender, text, us FROM (
  SELECT 'chat_' || (o_custkey % 40) AS thread, o_orderkey, epoch_us(o_orderdate) // 1000 AS s_ms, 'Zoë ' || o_custkey AS sender, o_orderpriority || ' – naïve' AS text, epoch_us(o_orderdate) AS us FROM orders)""")
def dm_json_messages(spark: SparkSession, d: str) -> DataFrame:
    """Threads of two files whose texts are UTF-8 read as Latin-1; their messages keep the order of time, file, place."""
    root = str(shared_file_dir(spark, "dm"))

    def write(rows: pa.Table) -> pa.Table:
        folder = Path(root) / "inbox" / rows["thread"][0].as_py()
        folder.mkdir(parents=True, exist_ok=True)
        made = sorted(rows.select(["key", "ms", "sender", "text"]).to_pylist(), key=lambda r: r["key"])
        half = len(made) // 2
        for k, part in enumerate((made[:half], made[half:]), 1):
            messages = [{"sender_name": r["sender"].encode().decode("latin-1"), "timestamp_ms": r["ms"], "content": r["text"].encode().decode("latin-1")} for r in part]
            (folder / f"message_{k}.json").write_text(json.dumps({"participants": [], "messages": messages}))
        return pa.table({"n": pa.array([len(made)], pa.int64())})

    o = table(spark, d, "orders")
    rows = o.select(
        F.concat(F.lit("chat_"), (F.col("o_custkey") % 40).cast("string")).alias("thread"), F.col("o_orderkey").alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"),
        F.concat(F.lit("Zoë "), F.col("o_custkey").cast("string")).alias("sender"), F.concat("o_orderpriority", F.lit(" – naïve")).alias("text"),
    )
    rows.groupBy("thread").applyInArrow(write, "n long").count()  # a thread is one folder of two files
    made = read_dm_json(spark, f"{root}/inbox")
    return made.select(F.get_json_object("meta", "$.thread").alias("thread"), "seq", "sender", "text", F.unix_micros("ts").alias("us"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 1600000000000000 + s_suppkey * 1000000 END AS us, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) / 1000 END AS lat,
  CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE 'sidecar' END AS taken_source FROM supplier""")
def photo_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """Photos with a full sidecar, with one of no place and a shortened name, and without one; copies below them."""
    root = str(shared_file_dir(spark, "photos"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, body = Path(root) / f"p{k}.jpg", b"\xff\xd8\xff\xd9" + str(k).encode()
                name.write_bytes(body)
                copy = Path(root) / "album"
                copy.mkdir(exist_ok=True)
                (copy / f"copy{k}.JPG").write_bytes(body)
                side = {"photoTakenTime": {"timestamp": str(1_600_000_000 + k)}, "creationTime": {"timestamp": "1"}, "geoData": {"latitude": k / 1000 if k % 3 == 0 else 0.0, "longitude": 1.0 if k % 3 == 0 else 0.0}}
                if k % 3 < 2:
                    Path(f"{name}.supplemental-{'metadata' if k % 3 == 0 else 'me'}.json").write_text(json.dumps(side))
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    table(spark, d, "supplier").select("s_suppkey").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    r = read_photos(spark, root, "UTC")
    key = F.regexp_extract("media_path", r"^p(\d+)\.jpg$", 1).cast("long")
    return r.select(key.alias("s_suppkey"), F.unix_micros("ts").alias("us"), F.get_json_object("meta", "$.lat").cast("double").alias("lat"), F.get_json_object("meta", "$.taken_source").alias("taken_source"))


def _backup(spark: SparkSession, stores: list[tuple[str, str, dict[str, tuple[str, DataFrame]]]]) -> Path:
    """A backup folder with SQLite stores whose tables (columns, rows) are streamed from DataFrames."""
    root = shared_file_dir(spark, "backup")
    (root / "Manifest.plist").write_bytes(plistlib.dumps({"IsEncrypted": False}))
    files = []
    for domain, path, tables in stores:
        name = hashlib.sha1(f"{domain}-{path}".encode()).hexdigest()
        (root / name[:2]).mkdir(exist_ok=True)
        files.append((name, domain, path))
        with sqlite3.connect(root / name[:2] / name) as db:
            for t, (columns, rows) in tables.items():
                db.execute(f"CREATE TABLE {t} ({columns})")
                db.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows.columns))})", (tuple(r) for r in rows.toLocalIterator()))
    with sqlite3.connect(root / "Manifest.db") as db:
        db.execute("CREATE TABLE Files (fileID TEXT, domain TEXT, relativePath TEXT, flags INTEGER)")
        db.executemany("INSERT INTO Files VALUES (?, ?, ?, 1)", files)
    return root


def _messages(spark: SparkSession, d: str) -> Path:
    o = table(spark, d, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 978_307_200 + LATER
    k = F.col("o_orderkey") % 3
    blob = F.concat(F.encode(F.lit("streamtyped NSString \x01"), "UTF-8"), F.lit(bytes([0x94, 0x84, 0x01])), F.lit(b"+"), F.lit(bytes([4])), F.encode(F.lit("kept"), "UTF-8"), F.lit(bytes([0x86, 0x84])))
    message = o.select(
        F.col("o_orderkey"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")), F.when(k != 2, F.col("o_orderpriority")), F.when(k == 1, blob), F.col("o_custkey") % 100, F.when(k == 0, seconds * 1_000_000_000).otherwise(seconds),
        F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0), F.when(F.col("o_orderkey") % 7 == 0, 2000).otherwise(0),
    )
    link = o.where(F.col("o_orderkey") % 11 != 0).select(F.col("o_custkey") % 30, "o_orderkey")
    n = table(spark, d, "nation")
    chat = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("+"), F.col("n_nationkey").cast("string"))).otherwise(F.lit("")), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.lit("room"))
    tables = {
        "message": ("ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, attributedBody BLOB, handle_id INTEGER, date INTEGER, is_from_me INTEGER, associated_message_type INTEGER", message),
        "chat_message_join": ("chat_id INTEGER, message_id INTEGER", link),
        "chat": ("ROWID INTEGER PRIMARY KEY, chat_identifier TEXT, display_name TEXT, room_name TEXT", chat),
        "handle": ("ROWID INTEGER PRIMARY KEY, id TEXT", n.select("n_nationkey", F.concat(F.lit("h:"), "n_name"))),
    }
    return _backup(spark, [(*pb.MESSAGES, tables)])


@query("""
SELECT 'g' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'me' ELSE 'h:' || h.n_name END AS sender, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'kept' END AS text, o_orderkey % 7 = 0 AS is_system,
  epoch_us(o_orderdate) + 630720000000000 AS us, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN c.n_nationkey % 2 = 0 THEN '+' || c.n_nationkey ELSE 'chat-' || (o_custkey % 30) END END AS thread,
  CASE WHEN c.n_nationkey IS NOT NULL THEN CASE WHEN c.n_nationkey % 3 = 0 THEN c.n_name ELSE 'room' END END AS shown, row_number() OVER (ORDER BY o_orderdate, coalesce('imessage:' ||
    CASE WHEN o_orderkey % 11 <> 0 THEN coalesce(CASE WHEN c.n_nationkey IS NOT NULL THEN CASE WHEN c.n_nationkey % 3 = 0 THEN c.n_name ELSE 'room' END END, CAST(o_custkey % 30 AS VARCHAR)) END, '') , o_orderkey) AS seq
FROM orders LEFT JOIN nation h ON h.n_nationkey = o_custkey % 100 LEFT JOIN nation c ON c.n_nationkey = o_custkey % 30 AND o_orderkey % 11 <> 0""")
def messages_left_join(spark: SparkSession, d: str) -> DataFrame:
    """The phone's message store, read from SQLite: message, bridge, chat and handle by left joins, texts in tiers."""
    r = read(spark, _messages(spark, d), "UTC")
    return r.select("id", "sender", "text", "is_system", F.unix_micros("ts").alias("us"), F.get_json_object("meta", "$.thread").alias("thread"), F.get_json_object("meta", "$.thread_display_name").alias("shown"), "seq")


def _chat_store(spark: SparkSession, d: str, variant: str, modulus: int) -> tuple[str, str, dict]:
    o = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == modulus)
    seconds = (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 978_307_200).cast("double") + 0.5
    kind = F.when(F.col("o_orderkey") % 10 < 8, 0).when(F.col("o_orderkey") % 10 == 8, 6).otherwise(14)
    message = o.select("o_orderkey", F.col("o_custkey") % 40, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 60), F.lit("from"), (F.col("o_orderkey") % 4 == 0).cast("int"), seconds, "o_orderpriority", kind, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("st"), F.col("o_orderkey").cast("string"))).otherwise(F.lit("")))
    n = table(spark, d, "nation")
    jid = F.concat(F.lit("j"), F.col("n_nationkey").cast("string"))
    by_chat = n.where("n_nationkey % 2 = 0").select("n_nationkey", jid, F.lower("n_name"))
    by_member = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey") + 100, F.concat(F.lit("m"), F.col("n_nationkey").cast("string")), F.lit("member"))
    tables = {
        "ZWAMESSAGE": ("Z_PK INTEGER PRIMARY KEY, ZCHATSESSION INTEGER, ZGROUPMEMBER INTEGER, ZFROMJID TEXT, ZISFROMME INTEGER, ZMESSAGEDATE REAL, ZTEXT TEXT, ZMESSAGETYPE INTEGER, ZSTANZAID TEXT", message),
        "ZWACHATSESSION": ("Z_PK INTEGER PRIMARY KEY, ZCONTACTJID TEXT, ZPARTNERNAME TEXT", n.select("n_nationkey", jid, "n_name")),
        "ZWAGROUPMEMBER": ("Z_PK INTEGER PRIMARY KEY, ZCHATSESSION INTEGER, ZMEMBERJID TEXT", n.select(F.col("n_nationkey") + 25, "n_nationkey", F.concat(F.lit("m"), F.col("n_nationkey").cast("string")))),
        "ZWAPROFILEPUSHNAME": ("Z_PK INTEGER PRIMARY KEY, ZJID TEXT, ZPUSHNAME TEXT", by_chat.union(by_member)),
    }
    domain, path = next((x[1], x[2]) for x in pb.CHAT_STORES if x[0] == variant)
    return domain, path, tables


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'st' || o_orderkey END AS stanza, CASE WHEN o_orderkey % 4 = 0 THEN 'me' WHEN m.n_nationkey IS NOT NULL THEN 'm' || m.n_nationkey WHEN c.n_nationkey IS NOT NULL THEN 'j' || c.n_nationkey ELSE 'from' END AS sender,
  CASE WHEN o_orderkey % 4 = 0 THEN 'me' WHEN m.n_nationkey IS NOT NULL THEN CASE WHEN m.n_nationkey % 3 = 0 THEN 'member' ELSE 'm' || m.n_nationkey END WHEN c.n_nationkey IS NOT NULL THEN CASE WHEN c.n_nationkey % 2 = 0 THEN lower(c.n_name) ELSE c.n_name END END AS shown,
  CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderpriority END AS text, o_orderkey % 10 = 8 AS is_system, epoch_us(o_orderdate) + 500000 AS us, CASE WHEN o_orderkey % 2 = 0 THEN 'personal' ELSE 'business' END AS variant,
  CASE WHEN c.n_nationkey IS NOT NULL THEN 'whatsapp-' || CASE WHEN o_orderkey % 2 = 0 THEN 'personal' ELSE 'business' END || ':' || c.n_name ELSE 'whatsapp-' || CASE WHEN o_orderkey % 2 = 0 THEN 'personal' ELSE 'business' END || ':' || (o_custkey % 40) END AS source_group
FROM orders LEFT JOIN nation c ON c.n_nationkey = o_custkey % 40 LEFT JOIN nation m ON m.n_nationkey + 25 = o_custkey % 60 AND o_orderkey % 3 = 0""")
def double_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Both chat stores of a backup, read from SQLite: session, member and push names twice, by left joins."""
    r = pb.read_chat_store(spark, _backup(spark, [_chat_store(spark, d, "personal", 0), _chat_store(spark, d, "business", 1)]))

    def meta(name: str):
        return F.get_json_object("meta", f"$.{name}")

    return r.select(
        meta("message_rowid").cast("long").alias("o_orderkey"), F.when(F.col("id").startswith("st"), F.col("id")).alias("stanza"), "sender", meta("sender_display_name").alias("shown"), "text", "is_system", F.unix_micros("ts").alias("us"),
        meta("whatsapp_variant").alias("variant"), "source_group",
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE epoch_us(o_orderdate) + 250000 END AS us FROM orders")
def chat_store_times(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.0)).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 978_307_200 + 0.25)
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(scalars.whatsapp_timestamp(raw)).alias("us"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_name ELSE NULL END AS text FROM part""")
def message_text_tiers(spark: SparkSession, d: str) -> DataFrame:
    """An archived string wins over the column, the column over the marks, nothing gives null."""
    name = F.encode("p_name", "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length("p_name")), 2, "0"))
    archived = F.concat(F.encode(F.lit("streamtyped NSString"), "UTF-8"), F.lit(b"\x01\x94\x84\x01+"), size, name, F.lit(b"\x86\x84"))
    marked = F.concat(F.encode(F.lit("streamtyped other"), "UTF-8"), F.lit(b"\x01+"), size, name, F.lit(b"\x86\x84zz"))
    k = F.col("p_partkey") % 4
    blob = F.when(k == 0, archived).when(k == 1, marked).when(k == 2, marked)
    text = F.when(k < 2, F.col("p_type")).when(k == 2, F.lit(""))
    return table(spark, d, "part").select("p_partkey", scalars.message_text(blob, text).alias("text"))


@query("SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 2 = 0 THEN 'event' ELSE 'habit' END AS kind, n_name AS statement, list_value('^' || n_name, 'k' || n_regionkey) AS must_match FROM nation")
def gold_from_yaml(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    at = shared_file_dir(spark, "gold") / "gold.yaml"
    lines = [f"- kind: {'event' if r.n_nationkey % 2 == 0 else 'habit'}\n  statement: {json.dumps(r.n_name)}\n  must_match: [{json.dumps('^' + r.n_name)}, {json.dumps(f'k{r.n_regionkey}')}]\n" for r in n.orderBy("n_nationkey").collect()]  # 25 rows at every scale
    at.write_text("".join(lines))
    return load_gold(spark, str(at)).select("seq", "kind", "statement", "must_match")


_COUNTER = "(SELECT o_orderkey, o_custkey % 30 AS g, o_orderdate AS ts, CASE WHEN o_orderkey % 3 = 0 THEN 'me' WHEN o_orderkey % 3 = 1 THEN 'c' || (o_custkey % 7) ELSE 'd' || (o_custkey % 5) END AS sender FROM orders)"


@query(f"""
WITH s AS {_COUNTER}, p AS (SELECT a.o_orderkey, arg_min(b.sender, (abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.o_orderkey)) AS near FROM s a JOIN s b ON a.g = b.g AND b.sender <> 'me' WHERE a.sender = 'me' GROUP BY a.o_orderkey)
SELECT s.o_orderkey, CASE WHEN s.sender = 'me' THEN p.near ELSE s.sender END AS counterparty FROM s LEFT JOIN p ON p.o_orderkey = s.o_orderkey""")
def nearest_counterparty(spark: SparkSession, d: str) -> DataFrame:
    """Who else of the group spoke nearest in time; of equally near ones the earlier."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    sender = F.when(k == 0, F.lit("me")).when(k == 1, F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))).otherwise(F.concat(F.lit("d"), (F.col("o_custkey") % 5).cast("string")))
    items = o.select("o_orderkey", (F.col("o_custkey") % 30).cast("string").alias("source_group"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("seq"), sender.alias("sender"))
    return windows.nearest_counterparty(items).select("o_orderkey", "counterparty")


_RENDERED = "SELECT '{f}' AS format, CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE 'Zoë ' || o_custkey END AS sender, {text} AS text, {media} AS media_path, epoch_us(o_orderdate) AS us FROM orders"


@query(" UNION ALL ".join((
    _RENDERED.format(f="chat", text="CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || chr(10) || '– \"' || o_orderkey || '\"' END", media="CASE WHEN o_orderkey % 5 = 0 THEN 'p ' || o_orderkey || '.jpg' END"),
    _RENDERED.format(f="dm", text="CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || chr(10) || '– \"' || o_orderkey || '\"' END", media="CASE WHEN o_orderkey % 5 = 0 THEN 'p ' || o_orderkey || '.jpg' END"),
    _RENDERED.format(f="sms", text="CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority || chr(10) || '– \"' || o_orderkey || '\"' END", media="NULL"),
)))
def rendered_exports(spark: SparkSession, d: str) -> DataFrame:
    """Items rendered in three formats and read back: chats, direct messages with texts mis-decoded, SMS backups."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    items = o.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 9).cast("string")).alias("thread"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(key % 2 == 0, "me").otherwise(F.concat(F.lit("Zoë "), F.col("o_custkey").cast("string"))).alias("sender"),
        F.when(key % 5 != 0, F.concat("o_orderpriority", F.lit('\n– "'), key.cast("string"), F.lit('"'))).alias("text"), F.when(key % 5 == 0, F.concat(F.lit("p "), key.cast("string"), F.lit(".jpg"))).alias("media_path"),
        F.lit(False).alias("is_system"), F.lit("g").alias("source_group"), key.alias("seq"),
    )
    chat, dm, sms = scratch_path(spark, "chat"), str(shared_file_dir(spark, "dm")), scratch_path(spark, "sms")
    # Two digits of a year mean this century, so the chat is told twenty years later.
    later = F.make_ym_interval(F.lit(20))
    render.render_chat_text(items.withColumn("ts", (F.col("ts").cast("timestamp_ntz") + later).cast("timestamp")), chat)
    render.render_dm_json(items, f"{dm}/inbox")
    render.render_sms_xml(items.withColumn("thread", F.lit(None).cast("string")), sms)
    got = [("chat", read_chat_text(spark, chat, "UTC", "t").withColumn("ts", (F.col("ts").cast("timestamp_ntz") - later).cast("timestamp"))), ("dm", read_dm_json(spark, f"{dm}/inbox")), ("sms", read_sms_xml(spark, sms))]
    parts = [df.select(F.lit(f).alias("format"), "sender", "text", "media_path", F.unix_micros("ts").alias("us")) for f, df in got]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
