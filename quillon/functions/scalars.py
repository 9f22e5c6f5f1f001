"""Scalar functions as column expressions. Python runs only where the JVM has no counterpart (Unicode
normalisation and case folding, byte scans, image headers)."""

from __future__ import annotations

import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.schemas import TAG_LABELS

# The Apple epoch in Unix seconds, the magnitude from which message times are nanoseconds.
APPLE_EPOCH, NANOSECONDS_FROM = 978_307_200, 10**12


def utf8_read_as_latin1(c: Column) -> Column:
    """UTF-8 bytes that were read as Latin-1, put right. Where the whole is no such text, those runs of it that are
    are put right; every other text as it is."""
    raw = F.encode(c, "ISO-8859-1")
    whole = c.rlike(r"^[\x00-\x{FF}]*$") & F.is_valid_utf8(raw.cast("string"))
    runs = c.rlike(_LATIN1_RUN.pattern)
    return F.when(whole, F.decode(raw, "UTF-8")).when(runs, _runs_put_right(c)).otherwise(c)


#: UTF-8 sequences of two to four bytes as Latin-1 shows them.
_LATIN1_RUN = regex.compile(r"[\u00c2-\u00df][\u0080-\u00bf]|[\u00e0-\u00ef][\u0080-\u00bf]{2}|[\u00f0-\u00f4][\u0080-\u00bf]{3}")


def _run(m: regex.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


@F.arrow_udf(T.StringType())
def _runs_put_right(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _LATIN1_RUN.sub(_run, t) for t in text.to_pylist()], pa.string())


# The characters that names are compared without.
_EMOJI = regex.compile("[\U0001f300-\U0001faff\u2600-\u27bf\U0001f1e6-\U0001f1ff\u2b00-\u2bff\ufe0f\u200d]")


@F.arrow_udf(T.StringType())
def normalize_name(name: pa.Array) -> pa.Array:
    """Comparable form of a name: no emoji, separators as blanks, NFKC, case folded, single blanks."""
    out = []
    for n in name.to_pylist():
        if n is not None:
            n = _EMOJI.sub("", n).replace(".", " ").replace("_", " ").replace("-", " ")
            n = " ".join(unicodedata.normalize("NFKC", n).casefold().split())
        out.append(n)
    return pa.array(out, pa.string())


def normalize_ascii_name(c: Column) -> Column:
    """``normalize_name`` for ASCII names, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[._\-]+", " ")), r"\s+", " "))


def first_token(normalized: Column) -> Column:
    return F.element_at(F.split(normalized, " "), 1)


def prefix_related(a: Column, b: Column) -> Column:
    """Whether one non-empty first token begins the other."""
    x, y = first_token(a), first_token(b)
    return (F.length(x) > 0) & (F.length(y) > 0) & (x.startswith(y) | y.startswith(x))


def exact_match(mention: Column, name: Column, aliases: Column) -> Column:
    """Normalised equality with the name or an alias; an empty mention matches nothing."""
    return (F.length(mention) > 0) & ((mention == name) | F.coalesce(F.array_contains(aliases, mention), F.lit(False)))


def first_date(text: Column) -> Column:
    """The first ISO date in a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def extract_section(markdown: Column, name: Column) -> Column:
    """The body of a ``## name`` block up to the next heading, any case; null if there is none."""
    found = F.filter(F.split(F.concat(F.lit("\n"), markdown), r"\n## "), lambda s: F.lower(F.trim(F.substring_index(s, "\n", 1))) == F.lower(F.trim(name)))
    block = F.get(found, F.lit(0))
    return F.regexp_replace(F.regexp_replace(block, r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")


def apple_timestamp(raw: Column) -> Column:
    """Seconds or, from 1e12 on, nanoseconds since 2001 as a timestamp; 0 and null are missing."""
    raw = raw.cast("long")
    micros = F.when(raw >= NANOSECONDS_FROM, F.call_function("div", raw, F.lit(1000))).otherwise(F.try_multiply(raw, F.lit(1_000_000)))
    return F.when(raw != 0, F.timestamp_micros((micros + APPLE_EPOCH * 1_000_000).cast("long")))


def whatsapp_timestamp(raw: Column) -> Column:
    """Seconds since 2001, never switched by magnitude; 0 and null are missing."""
    return F.when(raw != 0, F.timestamp_micros(F.round((raw + APPLE_EPOCH) * 1_000_000).cast("long")))


def unsafe_media_path(path: Column) -> Column:
    """Whether a path is absolute, in a home or on a drive, or climbs out of its folder."""
    return F.translate(path, "\\", "/").rlike(r"^[/~]|^[A-Za-z]:|(^|/)\.\.(/|$)")


def unsafe_path_note(path: Column) -> Column:
    """The note that replaces a rejected path, quoted as Python shows a text."""
    quoted = F.when(path.contains("'") & ~path.contains('"'), F.concat(F.lit('"'), F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return F.concat(F.lit("[unsafe media path rejected: "), quoted, F.lit("]"))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is all zero, null if either is null or the lengths differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def best_label(tags: Column) -> Column:
    """The label with the highest score; ties go by the order of the labels."""
    order = F.array(*(F.lit(x) for x in TAG_LABELS))

    def rank(e: Column) -> Column:
        place = F.array_position(order, e["key"])
        return F.struct(-e["value"], F.when(place == 0, len(TAG_LABELS) + 1).otherwise(place), e["key"].alias("label"))

    return F.get(F.array_sort(F.transform(F.map_entries(tags), rank)), F.lit(0))["label"]


def top_labels(tags: Column, n: int = 3) -> Column:
    ordered = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("label"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["label"])


def combined_score(tags: Column) -> Column:
    """How much a photo tells: the scores of people and event together."""
    return F.coalesce(tags["people"], F.lit(0.0)) + F.coalesce(tags["event"], F.lit(0.0))


def month_bucket(date: Column) -> Column:
    return F.substr(date.cast("string"), F.lit(1), F.lit(7))


def sigmoid_score(similarity: Column, scale: Column, bias: Column) -> Column:
    return 1 / (1 + F.exp(-(similarity * scale + bias)))


def l2_normalize(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def transcript_line(sender: Column, ts: Column, text: Column, ocr_lines: Column, tags: Column) -> Column:
    """``[sender @ ts]: text OCR: a | b tags: x, y`` with what there is."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("["), F.coalesce(sender, F.lit("SYSTEM")), F.lit(" @ "), F.coalesce(ts, F.lit("unknown")), F.lit("]:")),
        F.nullif(text, F.lit("")),
        F.when(F.size(ocr_lines) > 0, F.concat(F.lit("OCR: "), F.array_join(ocr_lines, " | "))),
        F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "))),
    )


def cited_ids(answer: Column) -> Column:
    """The ids in ``[fact:…]`` markers, in their order."""
    return F.regexp_extract_all(answer, F.lit(r"\[fact:([0-9a-fA-F\-]+)\]"), F.lit(1))


def _stream_text(blob: bytes) -> str | None:
    """The text of an archived attributed string: it follows the class name, with a length in one, two or four
    bytes before it."""
    at = blob.find(b"NSString")
    if at < 0:
        return None
    plus = blob.find(b"+", at)
    if plus < 0 or plus + 1 >= len(blob):
        return None
    size, start = blob[plus + 1], plus + 2
    if size == 0x81:
        size, start = int.from_bytes(blob[start : start + 2], "little"), start + 2
    elif size == 0x82:
        size, start = int.from_bytes(blob[start : start + 4], "little"), start + 4
    text = blob[start : start + size].decode("utf-8", "ignore")
    return text or None


# The bytes before and after the text of an archived string.
_TEXT_BEGINS, _TEXT_ENDS = b"\x01+", b"\x86\x84"


def _scanned_text(blob: bytes) -> str | None:
    """What stands between the marks of an archived string, less its length: one character, or three where the bytes
    are no sound UTF-8."""
    at = blob.find(_TEXT_BEGINS)
    end = blob.find(_TEXT_ENDS, at + 3, len(blob) - 1) if at >= 0 else -1
    if end < 0:
        return None
    part = blob[at + 2 : end]
    try:
        return part.decode("utf-8")[1:] or None
    except UnicodeDecodeError:
        return part.decode("utf-8", "replace")[3:] or None


@F.arrow_udf(T.StringType())
def attributed_text(blob: pa.Array) -> pa.Array:
    return pa.array([_stream_text(b) if b else None for b in blob.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def scanned_text(blob: pa.Array) -> pa.Array:
    return pa.array([_scanned_text(b) if b else None for b in blob.to_pylist()], pa.string())


def message_text(blob: Column, text: Column) -> Column:
    """The text of a message row: the archived string where it can be read, else the plain column, else what stands
    between the archive's marks. An empty text counts as none."""
    return F.coalesce(attributed_text(blob), F.nullif(text, F.lit("")), scanned_text(blob))


def _exif(data: bytes | None) -> dict | None:
    """Time and place tags of a JPEG; None for bytes that are no readable image."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    out: dict = {"taken": None, "lat": None, "lon": None}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            try:
                _tiff(data[at + 10 : at + 2 + size], out)
            except (struct.error, IndexError, UnicodeDecodeError, ZeroDivisionError):
                pass
            break
        if data[at + 1] in (0xDA, 0xD9):
            break
        at += 2 + size
    return out


def _tiff(block: bytes, out: dict) -> None:
    end = "<" if block[:2] == b"II" else ">"

    def entries(at: int) -> dict[int, tuple[int, int, bytes]]:
        found = {}
        for k in range(struct.unpack(end + "H", block[at : at + 2])[0]):
            e = block[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(end + "HHI", e[:8])
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
            where = struct.unpack(end + "I", e[8:12])[0]
            found[tag] = (kind, count, e[8 : 8 + size] if size <= 4 else block[where : where + size])
        return found

    def number(entry: tuple[int, int, bytes]) -> int:
        return struct.unpack(end + ("H" if entry[0] == 3 else "I"), entry[2][: 2 if entry[0] == 3 else 4])[0]

    def degrees(entry: tuple[int, int, bytes], ref: tuple[int, int, bytes] | None) -> float:
        d, m, s = (a / b for a, b in (struct.unpack(end + "II", entry[2][8 * k : 8 * k + 8]) for k in range(3)))
        return (d + m / 60 + s / 3600) * (-1 if ref and ref[2][:1].upper() in (b"S", b"W") else 1)

    first = entries(struct.unpack(end + "I", block[4:8])[0])
    if 0x8769 in first:
        taken = entries(number(first[0x8769])).get(36867)
        if taken:
            out["taken"] = taken[2].split(b"\0")[0].decode("ascii")
    if 0x8825 in first:
        gps = entries(number(first[0x8825]))
        if 2 in gps and 4 in gps:
            out["lat"], out["lon"] = degrees(gps[2], gps.get(1)), degrees(gps[4], gps.get(3))


EXIF = T.StructType([T.StructField("taken", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.arrow_udf(EXIF)
def exif(content: pa.Array) -> pa.Array:
    kind = pa.struct([("taken", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])
    return pa.array([_exif(b) for b in content.to_pylist()], kind)
