"""Deterministic identities, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_or(a: Column, b: Column) -> Column:
    """``a or b`` for texts: an empty text counts as missing."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 of a UTC timestamp; six fraction digits only if there are microseconds."""
    micros = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def item_id(source: Column, thread: Column, ts: Column, sender: Column, text: Column, media_path: Column) -> Column:
    """Sixteen hex digits of the sha256 of the six parts; an absent part is empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (source, thread, iso_utc(ts), sender, py_or(text, media_path))]
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(16))


def window_hash(ids: Column) -> Column:
    """Of the item ids in their order."""
    return F.sha2(F.array_join(ids, "|"), 256)


def statement_hash(statement: Column) -> Column:
    return F.md5(statement)


def uuid_of(key: Column) -> Column:
    """A UUID-shaped id from a natural key, the same in every run."""
    d = F.md5(key)
    return F.concat_ws("-", *(F.substr(d, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def entity_id(name: Column, kind: Column) -> Column:
    return uuid_of(F.concat_ws("|", name, kind))


def backup_file_id(domain: Column, relative_path: Column) -> Column:
    return F.sha1(F.concat_ws("-", domain, relative_path))


def citation(fact_id: Column) -> Column:
    """The short form that profiles cite."""
    return F.format_string("[fact:%s]", F.substr(fact_id, F.lit(1), F.lit(8)))
