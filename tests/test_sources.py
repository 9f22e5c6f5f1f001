import json
import plistlib
import sqlite3
import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillon.operators.windows import nearest_counterparty
from quillon.sources import phone_backup as pb
from quillon.sources.chat_text import orphan_lines, read_chat_text
from quillon.sources.dispatch import read, read_corpus
from quillon.sources.dm_json import read_dm_json
from quillon.sources.photos import read_photos, unreadable
from quillon.sources.render import render_dm_json, render_sms_xml
from quillon.sources.sms_xml import dropped, read_sms_xml

DASH = """lost line
1/15/25, 10:30 AM - Messages are now secured
1/15/25, 10:32 AM - Nell Oru: first line
second line

third line
1/15/25, 12:05 PM - Bo: <Media omitted>
1/15/25, 12:06 AM - Bo: cat.jpg (file attached)
1/15/25, 1:07 PM - Bo: <attached: ../../x>
"""
BRACKET = "‎[03/02/24, 23:15:10] Ana: <attached: pic.jpg>\n[4/2/2024, 08:00] Ana: hi: there\n"


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.source_group or "", r.seq))


def utc(*a):
    return datetime(*a)


def test_chat_text_dash(spark, tmp_path):
    (tmp_path / "trip.txt").write_text(DASH)
    r = rows(read_chat_text(spark, str(tmp_path / "trip.txt"), "America/New_York"))
    assert len(r) == 5
    assert r[0].is_system and r[0].sender is None and r[0].text == "Messages are now secured"
    assert r[1].text == "first line\nsecond line\nthird line" and r[1].ts == utc(2025, 1, 15, 15, 32)
    assert r[2].text == "<Media omitted>" and r[2].ts == utc(2025, 1, 15, 17, 5)
    assert r[3].media_path == "cat.jpg" and r[3].text is None and r[3].ts == utc(2025, 1, 15, 5, 6)
    assert r[4].media_path is None and r[4].text == "[unsafe media path rejected: '../../x']"
    assert len({x.id for x in r}) == 5 and all(len(x.id) == 16 for x in r)
    assert orphan_lines(spark, str(tmp_path / "trip.txt")).first().n == 1


def test_chat_text_bracket_and_no_message(spark, tmp_path):
    (tmp_path / "a.txt").write_text(BRACKET)
    r = rows(read_chat_text(spark, str(tmp_path / "a.txt"), "Europe/Berlin"))
    assert r[0].media_path == "pic.jpg" and r[0].ts == utc(2024, 2, 3, 22, 15, 10)
    assert r[1].text == "hi: there" and r[1].ts == utc(2024, 2, 4, 7, 0)
    (tmp_path / "b.txt").write_text("nothing here\n")
    assert read_chat_text(spark, str(tmp_path / "b.txt"), "UTC").count() == 0


def test_sms_xml(spark, tmp_path):
    f = tmp_path / "s.xml"
    f.write_text(
        """<?xml version='1.0'?><!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><smses>
<sms address="+1" date="1700000000000" type="1" body="hello" contact_name="Ria"/>
<sms address="+1" date="1700000001000" type="2" body="null" contact_name="Ria"/>
<sms address="+1" date="1700000002000" type="3" body="draft" contact_name="Ria"/>
<sms address="+1" date="bad" type="1" body="x" contact_name="null"/>
<sms address="+1" date="1" type="9" body="x" contact_name="null"/>
<mms date="1700000003000" msg_box="1" address="+2"><parts><part ct="application/smil" text="z" data="q"/><part ct="text/plain" text="one"/><part ct="text/plain" text="two"/><part ct="image/png" text="null" data="AAAA"/></parts><addrs><addr address="+7" type="137"/><addr address="+8" type="151"/></addrs></mms>
</smses>"""
    )
    r = rows(read_sms_xml(spark, str(f)))
    assert [x.sender for x in r] == ["Ria", "me", "+7", None]
    assert r[1].text is None and r[2].text == "one\ntwo" and json.loads(r[2].meta)["mms_media"] is True
    assert r[3].ts is None and r[0].ts == utc(2023, 11, 14, 22, 13, 20)
    assert [tuple(x) for x in dropped(spark, str(f)).collect()] == [("sms", "9", 1)]
    assert "root:" not in str(r)


def test_dm_json(spark, tmp_path):
    d = tmp_path / "inbox" / "anna_1"
    d.mkdir(parents=True)
    bad = "Größe".encode().decode("latin-1")
    (d / "message_1.json").write_text(json.dumps({"messages": [{"sender_name": bad, "timestamp_ms": 3000, "content": "c"}, {"sender_name": "B", "timestamp_ms": 1000, "photos": [{"uri": "p/1.jpg"}]}]}))
    (d / "message_2.json").write_text(json.dumps({"messages": [{"sender_name": "B", "timestamp_ms": 2000, "content": "€ Ã"}]}))
    r = rows(read_dm_json(spark, str(d)))
    assert [x.ts.second for x in r] == [1, 2, 3] and r[0].media_path == "p/1.jpg"
    assert r[1].text == "€ Ã" and r[2].sender == "Größe" and r[0].source_group == "instagram:anna_1"


def jpeg(taken=None, gps=None, pad=b""):
    if taken is None:
        return b"\xff\xd8\xff\xd9" + pad
    text = taken.encode() + b"\0"
    exif_at = 8 + 2 + 12 * 2 + 4
    sub = struct.pack("<H", 1) + struct.pack("<HHII", 36867, 2, len(text), exif_at + 2 + 12 + 4) + struct.pack("<I", 0) + text
    gps_at = exif_at + len(sub) + len(sub) % 2
    sub += b"\0" * (len(sub) % 2)
    data_at = gps_at + 2 + 12 * 4 + 4
    rat = lambda v: b"".join(struct.pack("<II", int(x), 1) for x in v)
    block = struct.pack("<H", 4) + struct.pack("<HHI4s", 1, 2, 2, gps[1].encode() + b"\0\0\0") + struct.pack("<HHII", 2, 5, 3, data_at)
    block += struct.pack("<HHI4s", 3, 2, 2, gps[3].encode() + b"\0\0\0") + struct.pack("<HHII", 4, 5, 3, data_at + 24) + struct.pack("<I", 0) + rat(gps[0]) + rat(gps[2])
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x8769, 4, 1, exif_at) + struct.pack("<HHII", 0x8825, 4, 1, gps_at) + struct.pack("<I", 0) + sub + block
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9" + pad


def test_photos(spark, tmp_path):
    (tmp_path / "Album").mkdir()
    a = jpeg("2024:06:01 23:30:00", ((10, 30, 0), "N", (20, 0, 36), "W"))
    (tmp_path / "a.JPG").write_bytes(a)
    (tmp_path / "Album" / "dup.jpg").write_bytes(a)
    (tmp_path / "b.jpg").write_bytes(jpeg(pad=b"b"))
    (tmp_path / "b.jpg.supplemental-metadata.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1700000000"}, "creationTime": {"timestamp": "1"}, "geoData": {"latitude": 1.5, "longitude": 2.5}}))
    (tmp_path / "c.jpg").write_bytes(jpeg(pad=b"c"))
    (tmp_path / "c.jpg.supplemental-me.json").write_text(json.dumps({"photoTakenTime": {"timestamp": "1700000001"}, "geoData": {"latitude": 0.0, "longitude": 0.0}}))
    (tmp_path / "d.jpg").write_bytes(b"no image")
    (tmp_path / "e.jpg").write_bytes(jpeg(pad=b"e"))
    (tmp_path / "e.jpg.json").write_text("{broken")
    r = {x.media_path: x for x in read_photos(spark, str(tmp_path), "America/New_York").collect()}
    assert set(r) == {"a.JPG", "b.jpg", "c.jpg", "e.jpg"}
    assert r["a.JPG"].ts == utc(2024, 6, 2, 3, 30)
    meta = json.loads(r["a.JPG"].meta)
    assert meta["lat"] == 10.5 and round(meta["lon"], 4) == -20.01 and meta["taken_source"] == "exif"
    assert r["b.jpg"].ts == utc(2023, 11, 14, 22, 13, 20) and json.loads(r["b.jpg"].meta)["lon"] == 2.5
    assert r["c.jpg"].ts == utc(2023, 11, 14, 22, 13, 21) and "lat" not in json.loads(r["c.jpg"].meta)
    assert r["e.jpg"].ts is None
    assert [x.rel for x in unreadable(spark, str(tmp_path)).collect()] == ["d.jpg"]


def backup(tmp_path, encrypted=False, old=False):
    root = tmp_path / "backup"
    root.mkdir()
    (root / "Manifest.plist").write_bytes(plistlib.dumps({"IsEncrypted": encrypted}))
    (root / "Info.plist").write_bytes(plistlib.dumps({"Device Name": "Test phone", "Last Backup Date": datetime(2024, 1, 1)}))
    db = sqlite3.connect(root / "Manifest.db")
    db.execute("CREATE TABLE Files (fileID TEXT, domain TEXT, relativePath TEXT, flags INTEGER)")

    def store(domain, path):
        name = pb.file_id(domain, path)
        db.execute("INSERT INTO Files VALUES (?, ?, ?, 1)", (name, domain, path))
        (root / name[:2]).mkdir(exist_ok=True)
        return sqlite3.connect(root / name[:2] / name)

    s = store(*pb.MESSAGES)
    extra = "" if old else ", date_edited INTEGER, associated_message_emoji TEXT"
    s.execute(f"CREATE TABLE message (ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, attributedBody BLOB, handle_id INTEGER, service TEXT, date INTEGER, is_from_me INTEGER, associated_message_guid TEXT, associated_message_type INTEGER, cache_has_attachments INTEGER{extra})")
    s.execute("CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT)")
    s.execute("CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, chat_identifier TEXT, display_name TEXT, room_name TEXT)")
    s.execute("CREATE TABLE chat_message_join (chat_id INTEGER, message_id INTEGER)")
    s.execute("CREATE TABLE chat_handle_join (chat_id INTEGER, handle_id INTEGER)")
    s.executemany("INSERT INTO handle VALUES (?, ?)", [(1, "+100"), (2, "+200")])
    s.executemany("INSERT INTO chat VALUES (?, ?, ?, ?)", [(1, "+100", "", None), (2, "", "Group", "room1")])
    s.executemany("INSERT INTO chat_handle_join VALUES (?, ?)", [(2, 1), (2, 2)])
    blob = b"streamtyped\x81NSString\x01\x94\x84\x01+\x05hello\x86"
    cols = "(ROWID, guid, text, attributedBody, handle_id, service, date, is_from_me, associated_message_guid, associated_message_type, cache_has_attachments)"
    s.executemany(
        f"INSERT INTO message {cols} VALUES (?,?,?,?,?,?,?,?,?,?,?)",
        [(1, "g1", "plain", None, 1, "SMS", 700000000, 0, None, 0, 0), (2, "g2", None, blob, 2, "iMessage", 700000001 * 10**9, 0, None, 0, 1), (3, "g3", None, None, 1, "iMessage", 0, 1, "g1", 2000, 0)],
    )
    s.executemany("INSERT INTO chat_message_join VALUES (?, ?)", [(1, 1), (2, 2), (1, 3)])
    s.commit()
    w = store(pb.CHAT_STORES[0][1], pb.CHAT_STORES[0][2])
    w.execute("CREATE TABLE ZWACHATSESSION (Z_PK INTEGER PRIMARY KEY, ZCONTACTJID TEXT, ZPARTNERNAME TEXT)")
    w.execute("CREATE TABLE ZWAGROUPMEMBER (Z_PK INTEGER PRIMARY KEY, ZCHATSESSION INTEGER, ZMEMBERJID TEXT)")
    w.execute("CREATE TABLE ZWAPROFILEPUSHNAME (Z_PK INTEGER PRIMARY KEY, ZJID TEXT, ZPUSHNAME TEXT)")
    w.execute("CREATE TABLE ZWAMESSAGE (Z_PK INTEGER PRIMARY KEY, ZCHATSESSION INTEGER, ZGROUPMEMBER INTEGER, ZFROMJID TEXT, ZTOJID TEXT, ZISFROMME INTEGER, ZMESSAGEDATE REAL, ZTEXT TEXT, ZMESSAGETYPE INTEGER, ZSTANZAID TEXT, ZVCARDSTRING TEXT)")
    w.execute("INSERT INTO ZWACHATSESSION VALUES (1, 'c@x', 'Cleo')")
    w.execute("INSERT INTO ZWAGROUPMEMBER VALUES (1, 1, 'm@x')")
    w.execute("INSERT INTO ZWAPROFILEPUSHNAME VALUES (1, 'm@x', 'Mo')")
    w.executemany(
        "INSERT INTO ZWAMESSAGE VALUES (?,?,?,?,?,?,?,?,?,?,?)",
        [(1, 1, None, "c@x", None, 0, 700000000.5, "hey", 0, "s1", None), (2, 1, 1, "m@x", None, 0, 700000002.0, "gone", 14, "", None), (3, 1, None, None, "c@x", 1, 700000001.0, None, 6, "s3", "VCARD")],
    )
    w.commit()
    db.commit()
    return root


def test_phone_backup(spark, tmp_path):
    root = backup(tmp_path)
    assert pb.file_id("HomeDomain", "Library/SMS/sms.db").startswith("3d0d7e5f")
    assert pb.discover_backups([tmp_path])[0]["device"] == "Test phone"
    r = rows(pb.read_messages(spark, root))
    by = {x.id: x for x in r}
    assert len(r) == 3 and by["g2"].text == "hello" and by["g1"].ts == utc(2023, 3, 8, 20, 26, 40)
    assert by["g2"].sender == "+200" and by["g3"].sender == "me" and by["g3"].is_system and by["g3"].ts is None
    assert by["g2"].source_group == "imessage:Group" and json.loads(by["g2"].meta)["thread"] == "chat-2"
    assert max(r, key=lambda x: x.seq).id == "g3"
    c = {x.seq: x for x in pb.read_chat_store(spark, root).collect()}
    assert [c[k].text for k in (1, 2, 3)] == ["hey", None, None]
    assert c[1].id == "s1" and c[2].is_system and len(c[3].id) == 16 and c[3].sender == "m@x"
    assert json.loads(c[3].meta)["sender_display_name"] == "Mo"
    assert read(spark, root, "UTC").count() == 6


def test_phone_backup_errors_and_old_schema(spark, tmp_path):
    with pytest.raises(pb.BackupError):
        pb.discover_backups([tmp_path])
    root = backup(tmp_path, encrypted=True, old=True)
    with pytest.raises(pb.BackupError):
        pb.read_messages(spark, root)
    (root / "Manifest.plist").write_bytes(plistlib.dumps({"IsEncrypted": False}))
    assert pb.read_messages(spark, root).count() == 3


def test_dispatch(spark, tmp_path):
    (tmp_path / "whatsapp").mkdir()
    (tmp_path / "whatsapp" / "x.txt").write_text(BRACKET)
    assert read_corpus(spark, tmp_path, "UTC").count() == 2
    (tmp_path / "odd.bin").write_bytes(b"")
    with pytest.raises(ValueError):
        read(spark, tmp_path / "odd.bin", "UTC")
    assert datetime.now(timezone.utc)


def test_chat_text_seconds_blanks_and_anchors(spark, tmp_path):
    lines = [
        "1/15/25, 10:32:07 AM - Ann: one", "1/15/25, 22:33:08 - Bo: two", "1/15/25, 10:34 PM - Bo: my beach photo.jpg (file attached)", "1/15/25, 10:35 PM - Bo: look <attached: x.jpg> there",
        "1/15/25, 10:36 PM - Bo: see photo.v2.jpg (file attached)", "1/2/25 10:30 - no header", "[15/01/25, 22:41:03] Cy: ‎<attached: a b.jpg> with words",
    ]
    (tmp_path / "c.txt").write_text("\r\n".join(lines) + "\r\n")
    r = rows(read_chat_text(spark, str(tmp_path / "c.txt"), "UTC"))
    assert [(x.sender, x.text, x.media_path) for x in r] == [
        ("Ann", "one", None), ("Bo", "two", None), ("Bo", None, "my beach photo.jpg"), ("Bo", "look <attached: x.jpg> there", None),
        ("Bo", "see photo.v2.jpg (file attached)\n1/2/25 10:30 - no header", None), ("Cy", "with words", "a b.jpg"),
    ]
    assert [x.ts for x in r[:3]] == [utc(2025, 1, 15, 10, 32, 7), utc(2025, 1, 15, 22, 33, 8), utc(2025, 1, 15, 22, 34)]


def test_chat_text_over_splits(spark, tmp_path):
    """Messages and their lines keep their numbers where a file is read in several splits."""
    text = "".join(f"1/15/25, 10:32 AM - P{k}: message {k}\nmore of {k}\n\n" for k in range(500))
    (tmp_path / "c.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        r = rows(read_chat_text(spark, str(tmp_path / "c.txt"), "UTC"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(x.seq, x.sender, x.text, json.loads(x.meta)["line"]) for x in r] == [(k + 1, f"P{k}", f"message {k}\nmore of {k}", 3 * k) for k in range(500)]


def test_rendered_threads_span_files_and_neighbours_are_found_in_one_run(spark, tmp_path):
    """A thread longer than a file comes back in order, and no frame of rows runs to the end of its part."""
    rows = [("t", datetime(2024, 1, 1), f"S{k % 3}", f"n{k} – ok" if k % 5 else None, None if k % 5 else f"p{k}.jpg", k) for k in range(23)] + [("u", datetime(2024, 1, 2), "A", "one", None, 99)]
    items = spark.createDataFrame(rows, "thread string, ts timestamp, sender string, text string, media_path string, seq long")
    assert render_dm_json(items, str(tmp_path / "dm"), file_messages=2) == 2
    assert sorted(p.name for p in (tmp_path / "dm" / "t").iterdir()) == [f"message_{k:02}.json" for k in range(1, 13)]
    assert [p.name for p in (tmp_path / "dm" / "u").iterdir()] == ["message_1.json"]
    assert json.loads((tmp_path / "dm" / "t" / "message_12.json").read_text())["participants"] == [{"name": f"S{k}"} for k in range(3)]
    back = read_dm_json(spark, str(tmp_path / "dm")).where("source_group = 'instagram:t'").orderBy("seq").select("sender", "text", "media_path").collect()
    assert [tuple(r) for r in back] == [r[2:5] for r in rows[:23]]

    spoken = [(k * 7 % 50, k * k % 7 % 4) for k in range(60)]
    turns = [("g", datetime(2024, 1, 1, 0, 0, s), k, "me" if who < 2 else f"c{who}{k % 5}") for k, (s, who) in enumerate(spoken)]
    got = nearest_counterparty(spark.createDataFrame(turns, "source_group string, ts timestamp, seq long, sender string"))
    others = [t for t in turns if t[3] != "me"]
    want = {t[2]: t[3] if t[3] != "me" else min(others, key=lambda o: (abs(o[1] - t[1]), o[1], o[2]))[3] for t in turns}
    assert {r["seq"]: r["counterparty"] for r in got.collect()} == want
    assert "CURRENTROW$(), UNBOUNDEDFOLLOWING$()" not in got._jdf.queryExecution().optimizedPlan().toString().upper()


def test_sms_attributes_and_chat_headers_with_odd_text(spark, tmp_path):
    odd = "a \"b\" 'c' & <d>\ttab\nnext\x1f|end"
    rows = [(None, datetime(2024, 1, 1), "Zoë & \"co\"", odd.replace("\x1f", ""), None, 1), ("", datetime(2024, 1, 2), "me", "", None, 2), ("+1", datetime(2024, 1, 3), None, None, None, 3)]
    items = spark.createDataFrame(rows, "thread string, ts timestamp, sender string, text string, media_path string, seq long").withColumn("source_group", F.lit("g"))
    render_sms_xml(items, str(tmp_path / "sms"))
    back = read_sms_xml(spark, str(tmp_path / "sms")).orderBy("ts").select("sender", "text", F.get_json_object("meta", "$.address").alias("address")).collect()
    assert [(r.sender, r.text, r.address) for r in back] == [(rows[0][2], rows[0][3], rows[0][2]), ("me", "", None), (None, None, "+1")]
    chat = tmp_path / "chat.txt"
    chat.write_text(f"1/2/24, 3:04 PM - A: {odd.splitlines()[0]}\x1fmore\n[03/02/2024, 05:06:07] B: x\x1fy: z\n[1/1/24, 10:00] it began\n1/2/2024, 23:04 - C: w \n", encoding="utf-8")
    got = read_chat_text(spark, str(chat), "UTC").orderBy("seq").select("ts", "sender", "text").collect()
    assert [tuple(r) for r in got] == [
        (datetime(2024, 1, 2, 15, 4), "A", odd.splitlines()[0] + "\x1fmore"), (datetime(2024, 2, 3, 5, 6, 7), "B", "x\x1fy: z"), (datetime(2024, 1, 1, 10), None, "it began"), (datetime(2024, 1, 2, 23, 4), "C", "w"),
    ]
