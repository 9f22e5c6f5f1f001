"""Items back into the export formats, as the inverse of the readers: to hand data on, and to make corpora for tests.
Every function is given items (thread, ts, sender, text, media_path, is_system; ts in UTC) and writes on the
executors; the folders must be shared by them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ordered import with_rank
from quillon.operators.windows import nearest_counterparty

#: Messages in one file of a direct-message thread; a longer thread has several, as such exports do.
FILE_MESSAGES = 20_000


def misread(c: Column) -> Column:
    """A text as an export shows it whose UTF-8 was read as Latin-1."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def chat_lines(items: DataFrame) -> DataFrame:
    """(value): the messages of a chat export with a dash header, which has no seconds; a message may span lines."""
    header = F.concat(F.date_format("ts", "M/d/yy, h:mm a"), F.lit(" - "))
    text = F.coalesce("text", F.lit(""))
    attached = F.when(F.col("media_path").isNotNull(), F.concat("media_path", F.lit(" (file attached)"), F.when(F.length(text) > 0, F.concat(F.lit("\n"), text)).otherwise("")))
    body = F.when(F.coalesce("is_system", F.lit(False)), text).otherwise(F.concat("sender", F.lit(": "), F.coalesce(attached, text)))
    return items.select(F.concat(header, body).alias("value"))


def render_chat_text(items: DataFrame, path: str) -> None:
    """One chat export, in the order of time; its part files follow one another."""
    chat_lines(items.orderBy("ts", "seq")).write.text(path)


def render_dm_json(items: DataFrame, root: str, file_messages: int = FILE_MESSAGES) -> int:
    """A folder for each thread below ``root`` with its messages, mis-decoded as such exports are, in files of
    ``file_messages`` at most whose names sort as their messages; returns the number of threads."""

    def write(rows: pa.Table, files: pa.Table) -> pa.Table:
        of = files.to_pylist()[0]
        messages = []
        for r in rows.sort_by("no").to_pylist():
            entry = {"sender_name": r["sender"], "timestamp_ms": r["ms"]}
            messages.append(entry | ({"photos": [{"uri": r["media_path"], "creation_timestamp": r["ms"] // 1000}]} if r["media_path"] else {"content": r["text"]}))
        folder = Path(root) / of["thread"]
        folder.mkdir(parents=True, exist_ok=True)
        name = f"message_{of['file'] + 1:0{len(str(of['files']))}}.json"
        (folder / name).write_text(json.dumps({"participants": [{"name": n} for n in of["names"]], "messages": messages}))
        return pa.table({"n": pa.array([int(of["file"] == 0)], pa.int64())})

    rows = items.select("thread", F.unix_millis("ts").alias("ms"), "seq", misread(F.col("sender")).alias("sender"), misread(F.col("text")).alias("text"), "media_path")
    threads = rows.groupBy("thread").agg(F.sort_array(F.collect_set(F.nullif("sender", F.lit("")))).alias("names"), F.ceil(F.count("*") / file_messages).alias("files"))
    files = threads.withColumn("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("files") - 1)))
    numbered = with_rank(rows, ["thread"], ["ms", "seq"], "no").withColumn("file", F.floor((F.col("no") - 1) / file_messages))
    key = ["thread", "file"]
    return numbered.groupBy(*key).cogroup(files.groupBy(*key)).applyInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _attribute(c: Column) -> Column:
    """A text as a quoted attribute of XML."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return F.concat(F.lit('"'), c, F.lit('"'))


def render_sms_xml(items: DataFrame, path: str, owner: str = "me") -> None:
    """SMS backups, each partition a file with a root. The address of a message that the owner sent is the counterparty's:
    ``thread`` where it is given, else who spoke nearest in time."""
    near = nearest_counterparty(items, owner)
    sent = F.coalesce(F.col("sender") == owner, F.lit(False))
    no_text = F.lit("null")
    given = {
        "address": F.coalesce(F.nullif("thread", F.lit("")), F.when(F.col("thread").isNull(), F.nullif("counterparty", F.lit(""))), no_text), "date": F.unix_millis("ts").cast("string"), "type": F.when(sent, "2").otherwise("1"),
        "body": F.coalesce("text", no_text), "contact_name": F.when(sent, no_text).otherwise(F.coalesce(F.nullif("sender", F.lit("")), no_text)),
    }
    rows = near.select(F.concat(F.lit("<sms "), F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), _attribute(F.coalesce(v, F.lit("None")))) for k, v in given.items())), F.lit("/>")).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(["<?xml version='1.0' encoding='UTF-8'?>", "<smses>"])], names=["value"])
        for batch in batches:
            yield pa.record_batch([batch.column(0)], names=["value"])
        yield pa.record_batch([pa.array(["</smses>"])], names=["value"])

    rows.mapInArrow(write, "value string").write.text(path)
