"""Reading whatever lies at a path, by its shape."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.chat_text import read_chat_text
from quillon.sources.dm_json import read_dm_json
from quillon.sources.phone_backup import is_backup, read_chat_store, read_messages
from quillon.sources.photos import read_photos
from quillon.sources.sms_xml import read_sms_xml


def read(spark: SparkSession, path: str | Path, source_tz: str) -> DataFrame:
    """Items of a backup folder, a direct-message thread, a photo folder, a chat text or an SMS backup; ValueError
    for anything else."""
    at = Path(path)
    if at.is_dir():
        if is_backup(at):
            chats = read_chat_store(spark, at)
            own = read_messages(spark, at)
            return own if chats is None else own.unionByName(chats)
        if any(at.glob("message_*.json")):
            return read_dm_json(spark, str(at))
        return read_photos(spark, str(at), source_tz)
    if at.suffix.lower() == ".txt":
        return read_chat_text(spark, str(at), source_tz)
    if at.suffix.lower() == ".xml":
        return read_sms_xml(spark, str(at))
    raise ValueError(f"unknown kind of source: {path}")


def read_corpus(spark: SparkSession, folder: str | Path, source_tz: str) -> DataFrame:
    """All sources of a corpus folder (whatsapp, sms, instagram/inbox, photos), or of a backup."""
    root = Path(folder)
    if is_backup(root):
        return read(spark, root, source_tz)
    parts = []
    if any(root.glob("whatsapp/*.txt")):
        parts.append(read_chat_text(spark, str(root / "whatsapp" / "*.txt"), source_tz))
    if any(root.glob("sms/*.xml")):
        parts.append(read_sms_xml(spark, str(root / "sms" / "*.xml")))
    if any(root.glob("instagram/inbox/*/message_*.json")):
        parts.append(read_dm_json(spark, str(root / "instagram" / "inbox")))
    if (root / "photos").is_dir() and any((root / "photos").rglob("*.*")):
        parts.append(read_photos(spark, str(root / "photos"), source_tz))
    if not parts:
        raise ValueError(f"no source in {folder}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
