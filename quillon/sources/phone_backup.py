"""Phone backups: message stores in SQLite, found through the backup's manifest.

A Python data source reads one table of one SQLite file, in ranges of its row ids, so a large store is read by
several tasks; the joins between tables are DataFrame joins.
"""

from __future__ import annotations

import hashlib
import os
import plistlib
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillon.functions.scalars import apple_timestamp, message_text, whatsapp_timestamp
from quillon.identity import py_or
from quillon.operators.ordered import with_number
from quillon.session import shared_file_dir
from quillon.sources.common import normalized

# Where the stores lie in a backup, and the message type codes that matter.
MESSAGES = ("HomeDomain", "Library/SMS/sms.db")
CHAT_STORES = (("personal", "AppDomainGroup-group.net.whatsapp.WhatsApp.shared", "ChatStorage.sqlite"), ("business", "AppDomainGroup-group.net.whatsapp.WhatsAppSMB.shared", "ChatStorage.sqlite"))
SYSTEM_TYPE, DELETED_TYPE = 6, 14
BACKUP_ROOTS = (r"%USERPROFILE%\Apple\MobileSync\Backup", r"%APPDATA%\Apple Computer\MobileSync\Backup")
#: A message store with fewer rows deserves a warning.
FEW_ROWS = 10
#: Row ids in one input partition.
SLICE = 250_000


class BackupError(Exception):
    """The folder is no backup, is encrypted, or lacks the store."""


def file_id(domain: str, path: str) -> str:
    return hashlib.sha1(f"{domain}-{path}".encode()).hexdigest()


def is_backup(folder: str | Path) -> bool:
    return (Path(folder) / "Manifest.plist").is_file() and (Path(folder) / "Manifest.db").is_file()


def find_backup_roots() -> list[Path]:
    """The two folders that the desktop programs write backups to, whether or not they exist."""
    return [Path(os.path.expandvars(p)) for p in BACKUP_ROOTS]


def discover_backups(roots: list[str | Path] | None = None) -> list[dict]:
    """All backups in or directly below the roots, with what they say about themselves; a BackupError that names
    the roots if there is none."""
    found = []
    roots = find_backup_roots() if roots is None else roots
    for root in map(Path, roots):
        for folder in [root, *(sorted(p for p in root.iterdir() if p.is_dir()) if root.is_dir() else [])]:
            if is_backup(folder):
                info = {}
                if (folder / "Info.plist").is_file():
                    info = plistlib.loads((folder / "Info.plist").read_bytes())
                found.append({"path": str(folder), "device": info.get("Device Name"), "date": info.get("Last Backup Date"), "encrypted": _encrypted(folder)})
    if not found:
        raise BackupError(f"no backup in {', '.join(map(str, roots))}")
    return found


def _encrypted(folder: Path) -> bool:
    return bool(plistlib.loads((folder / "Manifest.plist").read_bytes()).get("IsEncrypted"))


def stored_file(folder: str | Path, domain: str, path: str) -> Path | None:
    """The stored copy of a file, by its id or the manifest."""
    folder = Path(folder)
    if not is_backup(folder):
        raise BackupError(f"{folder} is no backup")
    if _encrypted(folder):
        raise BackupError("the backup is encrypted; decrypted backups only")
    name = file_id(domain, path)
    with sqlite3.connect(f"file:{folder / 'Manifest.db'}?mode=ro", uri=True) as db:
        try:
            row = db.execute("SELECT fileID FROM Files WHERE domain = ? AND relativePath = ?", (domain, path)).fetchone()
            name = row[0] if row else name
        except sqlite3.DatabaseError:
            pass
    at = folder / name[:2] / name
    return at if at.is_file() else None


def sqlite_columns(path: str | Path, name: str) -> dict[str, str]:
    with sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True) as db:
        return {r[1]: (r[2] or "").upper() for r in db.execute(f'PRAGMA table_info("{name}")')}


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("table", …).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        kinds = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "TIMESTAMP": "double", "BLOB": "binary"}
        columns = sqlite_columns(self.options["path"], self.options["table"])
        return ", ".join(["`ROWID` long", *(f"`{c}` {kinds.get(t.split('(')[0], 'string')}" for c, t in columns.items() if c.upper() != "ROWID")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema_, self.path, self.table = schema, options["path"], options["table"]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[_Slice]:
        with self._open() as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None:
            return [_Slice(0, 0)]
        return [_Slice(a, a + SLICE) for a in range(lo, hi + 1, SLICE)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        kinds = [f.dataType.typeName() for f in self.schema_]
        convert = {"long": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with self._open() as db:
            names = ", ".join("rowid" if f.name == "ROWID" else f'"{f.name}"' for f in self.schema_)
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (part.lo, part.hi)):
                yield tuple(None if v is None else convert[k](v) for v, k in zip(row, kinds))


def sqlite_table(spark: SparkSession, path: str | Path, name: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", str(path)).option("table", name).load()


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or null where an older schema lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _staged(spark: SparkSession, path: Path) -> Path:
    """A private copy with its write-ahead log folded in, so that readers need no lock. It lies in the shared folder,
    which executors read, and goes with the session's other scratch."""
    copy = shared_file_dir(spark, "sqlite") / path.name
    for extra in ("", "-wal", "-shm"):
        if Path(str(path) + extra).is_file():
            Path(str(copy) + extra).write_bytes(Path(str(path) + extra).read_bytes())
    with sqlite3.connect(copy) as db:
        db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    return copy


def _numbered(rows: DataFrame) -> DataFrame:
    numbered = with_number(rows.withColumn("no_ts", F.col("ts").isNull()), ["no_ts", "ts", "source_group", "rowid"], "seq")
    return numbered.drop("no_ts").withColumn("seq", F.col("seq").cast("long"))


def read_messages(spark: SparkSession, backup: str | Path, warnings: list[str] | None = None) -> DataFrame:
    """Items of the phone's message store. The bridge between chats and participants is not joined: it would repeat
    a group's messages per participant. ``warnings`` is told if the store has very few messages."""
    store = stored_file(backup, *MESSAGES)
    if store is None:
        raise BackupError(f"{backup} holds no message store")
    db = _staged(spark, store)
    if warnings is not None:
        with sqlite3.connect(f"file:{db}?mode=ro&immutable=1", uri=True) as opened:
            n = opened.execute("SELECT count(*) FROM (SELECT 1 FROM message LIMIT ?)", (FEW_ROWS,)).fetchone()[0]
        if n < FEW_ROWS:
            warnings.append(f"{store}: only {n} messages; they may be kept in the cloud and not in the backup")
    m, link, chat, handle = (sqlite_table(spark, db, t) for t in ("message", "chat_message_join", "chat", "handle"))
    m = m.select(
        F.col("ROWID").alias("rowid"), _has(m, "guid").alias("guid"), _has(m, "text").alias("plain"), _has(m, "attributedBody", "binary").alias("blob"), _has(m, "handle_id", "long").alias("handle_id"),
        _has(m, "service").alias("service"), _has(m, "date", "long").alias("date"), _has(m, "is_from_me", "long").alias("own"), _has(m, "associated_message_guid").alias("associated_guid"),
        _has(m, "associated_message_type", "long").alias("associated_type"), _has(m, "associated_message_emoji").alias("associated_emoji"), _has(m, "date_edited", "long").alias("edited"),
        _has(m, "cache_has_attachments", "long").alias("attachments"),
    )
    link = link.select("chat_id", F.col("message_id").alias("rowid"))
    chat = chat.select(F.col("ROWID").alias("chat_id"), _has(chat, "chat_identifier").alias("identifier"), _has(chat, "display_name").alias("display"), _has(chat, "room_name").alias("room"))
    handle = handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"))
    rows = m.join(link, "rowid", "left").join(chat, "chat_id", "left").join(handle, "handle_id", "left")
    thread = py_or(F.col("identifier"), F.concat(F.lit("chat-"), F.col("chat_id").cast("string")))
    shown = py_or(F.col("display"), F.col("room"))
    meta = F.struct(
        thread.alias("thread"), F.col("chat_id").alias("chat_rowid"), F.col("identifier").alias("thread_identifier"), shown.alias("thread_display_name"), "service", F.col("associated_guid").alias("associated_message_guid"),
        F.col("associated_type").alias("associated_message_type"), F.col("associated_emoji").alias("associated_message_emoji"), apple_timestamp(F.col("edited")).alias("date_edited"), (F.coalesce("attachments", F.lit(0)) != 0).alias("has_attachments"),
    )
    made = rows.select(
        "rowid", "guid", F.lit("imessage").alias("source"), thread.alias("thread"), apple_timestamp(F.col("date")).alias("ts"), F.when(F.col("own") == 1, "me").otherwise(F.col("handle")).alias("sender"),
        message_text(F.col("blob"), F.col("plain")).alias("text"), F.lit(None).cast("string").alias("media_path"), (F.coalesce("associated_type", F.lit(0)) != 0).alias("is_system"), F.to_json(meta).alias("meta"),
        F.concat(F.lit("imessage:"), py_or(shown, py_or(F.col("identifier"), F.col("chat_id").cast("string")))).alias("source_group"),
    )
    return normalized(_numbered(made), "guid")


def read_chat_store(spark: SparkSession, backup: str | Path) -> DataFrame | None:
    """Items of the chat app's stores, personal and business together; None if the backup has neither."""
    parts = []
    for variant, domain, path in CHAT_STORES:
        store = stored_file(backup, domain, path)
        if store is not None:
            parts.append(_chat_rows(spark, _staged(spark, store), variant))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return normalized(_numbered(rows), "stanza")


def _chat_rows(spark: SparkSession, db: Path, variant: str) -> DataFrame:
    m, session, member, push = (sqlite_table(spark, db, t) for t in ("ZWAMESSAGE", "ZWACHATSESSION", "ZWAGROUPMEMBER", "ZWAPROFILEPUSHNAME"))
    m = m.select(
        F.col("ROWID").alias("rowid"), F.col("ZCHATSESSION").alias("chat"), _has(m, "ZGROUPMEMBER", "long").alias("member"), _has(m, "ZFROMJID").alias("from_jid"), _has(m, "ZTOJID").alias("to_jid"),
        _has(m, "ZISFROMME", "long").alias("own"), _has(m, "ZMESSAGEDATE", "double").alias("date"), _has(m, "ZTEXT").alias("plain"), _has(m, "ZMESSAGETYPE", "long").alias("type"),
        _has(m, "ZSTANZAID").alias("stanza"), _has(m, "ZVCARDSTRING").alias("vcard"),
    )
    session = session.select(F.col("ROWID").alias("chat"), _has(session, "ZCONTACTJID").alias("chat_jid"), _has(session, "ZPARTNERNAME").alias("partner"))
    member = member.select(F.col("ROWID").alias("member"), _has(member, "ZMEMBERJID").alias("member_jid"))
    names = push.select(_has(push, "ZJID").alias("jid"), _has(push, "ZPUSHNAME").alias("push"))
    by_member = names.select(F.col("jid").alias("member_jid"), F.col("push").alias("member_push"))
    by_chat = names.select(F.col("jid").alias("chat_jid"), F.col("push").alias("chat_push"))
    rows = m.join(session, "chat", "left").join(member, "member", "left").join(by_member, "member_jid", "left").join(by_chat, "chat_jid", "left")
    system = F.coalesce(F.col("type") == SYSTEM_TYPE, F.lit(False))
    deleted = F.coalesce(F.col("type") == DELETED_TYPE, F.lit(False))
    own = F.coalesce(F.col("own") == 1, F.lit(False))
    sender = F.when(own, "me").otherwise(py_or(F.col("member_jid"), py_or(F.col("chat_jid"), F.col("from_jid"))))
    shown = F.when(own, "me").otherwise(F.when(F.col("member_jid").isNotNull(), py_or(F.col("member_push"), F.col("member_jid"))).otherwise(py_or(F.col("chat_push"), py_or(F.col("partner"), F.col("chat_jid")))))
    meta = F.struct(
        F.col("chat_jid").alias("thread"), F.lit(variant).alias("whatsapp_variant"), F.col("chat").alias("chat_rowid"), F.col("rowid").alias("message_rowid"), F.col("type").alias("message_type"),
        F.col("partner").alias("thread_display_name"), shown.alias("sender_display_name"), "member_jid", "from_jid", "to_jid", "vcard",
    )
    return rows.select(
        "rowid", "stanza", F.lit("whatsapp").alias("source"), F.col("chat_jid").alias("thread"), whatsapp_timestamp(F.col("date")).alias("ts"), sender.alias("sender"), F.when(~deleted, F.col("plain")).alias("text"),
        F.lit(None).cast("string").alias("media_path"), system.alias("is_system"), F.to_json(meta).alias("meta"),
        F.concat(F.lit(f"whatsapp-{variant}:"), py_or(F.col("partner"), py_or(F.col("chat_jid"), F.col("chat").cast("string")))).alias("source_group"),
    )
