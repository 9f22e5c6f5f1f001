"""Mixed timestamp texts to UTC instants.

Each text is tokenised into a character-class shape mask (digits ``9``, letters ``a``, the rest as it is). A
distinct mask is matched once against a small grammar over masks; the groups of that match are the column slices
of every text with the mask, so a whole batch of such texts is read as one fixed-width matrix with numpy. Wall
clocks become UTC through the zone transition tables of ``quillon.functions.zones``.

Defined results: null, empty, placeholder (``0``, ``-1``, words) and impossible texts give null; a reading without
a zone in the text takes the zone given beside it and gives null if that zone is null or unknown; an hour that
occurs twice means its first pass, a skipped reading is taken with the offset before the change; parts the text
leaves out are zero; digits beyond microseconds are cut. Texts of any length are trimmed and matched; a long one
that is no time gives null. Ties and repeated rows need no care, each row is read alone.
"""

from __future__ import annotations

import functools
import re
import zoneinfo
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.zones import ZoneTables, fixed_offset

# Month names, and offsets in minutes that zone abbreviations stand for when the zone beside the
# text does not use the abbreviation itself.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "TRT": 180, "EAT": 180, "SAST": 120, "NPT": 345, "PKT": 300, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}
#: Seconds from 1970 to 2001, from which imessage and whatsapp count.
EPOCH_2001 = 978_307_200
FROM_2001 = ("imessage", "whatsapp")
#: Masks longer than this are matched like others but not remembered, so that the cache stays small.
REMEMBERED_MASK = 64

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?"
_ZONE = r"(?: ?(?P<z>a{1,5}|[+-]99:?99|[+-]99))?"
_HALF = r"(?: ?(?P<ap>aa))?"
GRAMMAR = tuple(
    re.compile(x)
    for x in (
        r"^(?P<n>9{1,20})(?:\.(?P<f>9{1,12}))?$",
        r"^(?P<Y>9999)(?P<sep>[-:/.])(?P<M>99?)(?P=sep)(?P<D>99?)(?:(?P<t>a)| )" + _TIME + _ZONE + "$",
        r"^(?P<Y>9999)(?P<M>99)(?P<D>99)(?P<t>a)(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{1,12}))?)?" + _ZONE + "$",
        r"^(?P<mon>a{3,9})\.? (?P<D>99?),? (?P<Y>9999),? " + _TIME + r"(?: (?P<ap>aa)(?= |$))?" + _ZONE + "$",
        r"^(?:aaa, )?(?P<D>99?) (?P<mon>aaa) (?P<Y>9999) " + _TIME + _ZONE + "$",
        r"^\[(?P<D>99?)/(?P<M>99?)/(?P<Y>99(?:99)?),? " + _TIME + _HALF + r"\](?: -)?$",
        r"^(?P<M>99?)/(?P<D>99?)/(?P<Y>99(?:99)?),? " + _TIME + _HALF + r"(?: -)?$",
    )
)
_INVISIBLE = "‎‏‪‫‬⁦⁧⁨⁩﻿"
_BLANKS = "   "


def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """The column slices of the fields in every text with this mask; None if no form has it."""
    return (_parser_of if len(mask) <= REMEMBERED_MASK else _parser_of.__wrapped__)(mask)


@functools.lru_cache(maxsize=65_536)
def _parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    for form in GRAMMAR:
        m = form.match(mask)
        if m:
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for j in range(*span):
        out = out * 10 + (chars[:, j] - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(chars[:, span[0] : span[1]].astype(np.uint32))
    return part.view(f"U{span[1] - span[0]}").ravel()


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of a proleptic Gregorian date, and whether the date exists."""
    month = (y - 1970) * 12 + np.clip(m, 1, 12) - 1
    start = month.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    end = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return start + d - 1, (m >= 1) & (m <= 12) & (d >= 1) & (d <= end - start) & (y >= 1)


def _by_value(values: np.ndarray) -> list[tuple[object, np.ndarray]]:
    names, inverse = np.unique(values, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse, minlength=len(names)))
    return [(n, order[e - c : e]) for n, e, c in zip(names, ends, np.bincount(inverse, minlength=len(names)))]


def _plain_numbers(chars: np.ndarray, at: dict, since_2001: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digits = at["n"][1] - at["n"][0]
    if digits > 18:  # nanoseconds: the last three digits are cut before they could overflow
        value, per = _number(chars, (at["n"][0], at["n"][1] - 3)), 1
    elif digits >= 18:
        value, per = _number(chars, at["n"]) // 1000, 1
    else:
        value, per = _number(chars, at["n"]), 1 if digits >= 15 else 1000 if digits >= 12 else 1_000_000
    ok, micros = value > 0, value * per
    if "f" in at and per > 1:
        width = min(at["f"][1] - at["f"][0], 6)
        micros = micros + _number(chars, (at["f"][0], at["f"][0] + width)) * per // 10**width
        ok = micros > 0
    return micros + np.where(since_2001, EPOCH_2001 * 1_000_000, 0), ok


def _calendar(chars: np.ndarray, at: dict, zones: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    n = len(chars)
    zero = np.zeros(n, np.int64)
    year = _number(chars, at["Y"])
    if at["Y"][1] - at["Y"][0] == 2:
        year = year + 2000
    ok = np.ones(n, bool)
    if "mon" in at:
        month = zero.copy()
        for name, rows in _by_value(_words(chars, at["mon"])):
            name = str(name).lower()
            month[rows] = MONTHS.index(name[:3]) + 1 if name[:3] in MONTHS else 0
    else:
        month = _number(chars, at["M"])
    if "t" in at:
        ok &= (chars[:, at["t"][0]] | 32) == ord("t")
    days, real = _days(year, month, _number(chars, at["D"]))
    hour, minute = _number(chars, at["h"]), _number(chars, at["mi"])
    second = _number(chars, at["s"]) if "s" in at else zero
    ok &= real & (minute < 60) & (second < 60)
    if "ap" in at:
        half = chars[:, at["ap"][0] : at["ap"][1]] | 32
        pm = half[:, 0] == ord("p")
        ok &= (pm | (half[:, 0] == ord("a"))) & (half[:, 1] == ord("m")) & (hour <= 12)
        hour = hour % 12 + np.where(pm, 12, 0)
    ok &= hour < 24
    wall = days * 86_400 + hour * 3600 + minute * 60 + second
    utc = wall.copy()
    if "z" in at:
        written = _words(chars, at["z"])
        signed = written[0][0] in "+-"
        if not signed and len(at_name := np.unique(written)) and any(len(x) > 1 for x in at_name):
            both = np.array([f"{a}\t{b}" for a, b in zip(written, zones)])
        else:
            both = written
        for name, rows in _by_value(both):
            text, _, zone = str(name).partition("\t")
            offset = fixed_offset(text) if signed else None
            if signed and offset is not None and (abs(offset) > 18 * 3600 or offset % 3600 // 60 > 59):
                offset = None
            if not signed:
                table = tables.get(zone) if zone else None
                offset = table.offset_of_name(text.upper()) if table is not None else None
                if offset is None and text.upper() in ABBREVIATIONS:
                    offset = ABBREVIATIONS[text.upper()] * 60
            if offset is None:
                ok[rows] = False
            else:
                utc[rows] = wall[rows] - offset
    else:
        for zone, rows in _by_value(zones):
            table = tables.get(str(zone)) if zone else None
            if table is None:
                ok[rows] = False
            else:
                utc[rows] = table.to_utc(wall[rows])
    micros = utc * 1_000_000
    if "f" in at:
        width = min(at["f"][1] - at["f"][0], 6)
        micros = micros + _number(chars, (at["f"][0], at["f"][0] + width)) * 10 ** (6 - width)
    return micros, ok


def convert(source: pa.Array, ts: pa.Array, zone: pa.Array, tables: ZoneTables | str) -> pa.Array:
    """One batch: microseconds since 1970 UTC, null where no instant can be told. Zone tables travel here; given the
    version of the installed data instead, those of the batch's zones are built on the spot."""
    if isinstance(tables, str):
        tables = ZoneTables([z for z in zone.to_pylist() if z])
    n = len(ts)
    out, valid = np.zeros(n, np.int64), np.zeros(n, bool)
    text = pc.replace_substring_regex(pc.fill_null(ts, ""), f"[{_INVISIBLE}]", "")
    text = pc.utf8_trim_whitespace(pc.replace_substring_regex(text, f"[{_BLANKS}]", " "))
    mask = pc.replace_substring_regex(pc.replace_substring_regex(text, "[A-Za-z]", "a"), "[0-9]", "9")
    coded = mask.dictionary_encode() if not isinstance(mask, pa.DictionaryArray) else mask
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    texts = np.asarray(text.to_pylist(), dtype=object)
    zones = np.asarray(pc.fill_null(zone, "").to_pylist(), dtype=str)
    since_2001 = np.isin(np.asarray(pc.fill_null(pc.utf8_lower(source), "").to_pylist(), dtype=str), FROM_2001)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for k, shape in enumerate(coded.dictionary.to_pylist()):
        at = parser_of(shape)
        if at is None:
            continue
        rows = order[edges[k] : edges[k + 1]]
        chars = np.frombuffer("".join(texts[rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), len(shape)).astype(np.int64)
        if "n" in at:
            micros, ok = _plain_numbers(chars, at, since_2001[rows])
        else:
            micros, ok = _calendar(chars, at, zones[rows], tables)
        out[rows], valid[rows] = micros, ok
    return pa.array(out, pa.int64(), mask=~valid)


def instant_udf(tables: ZoneTables) -> Callable[..., Column]:
    """An Arrow UDF (source, text, zone) -> microseconds, which carries the driver's zone tables."""

    @F.arrow_udf("long")
    def instant(source: pa.Array, ts: pa.Array, zone: pa.Array) -> pa.Array:
        return convert(source, ts, zone, tables)

    return instant


def with_instants(items: DataFrame, exports: DataFrame, to: str = "epoch_us") -> DataFrame:
    """``items`` (source, ts, export_id and any other columns) with a column ``to`` of UTC microseconds.

    A column of that name is replaced. ``exports`` gives source_tz by export_id; of an export listed twice the
    smallest source_tz counts. An item whose export is unknown has no zone. The join is left to Catalyst, which
    broadcasts ``exports`` only below the session's size threshold and splits skewed export ids otherwise.
    """
    zone = "__zone"
    zones = exports.where(F.col("export_id").isNotNull()).groupBy(F.col("export_id").alias("__export")).agg(F.min("source_tz").alias(zone))
    joined = items.join(zones, items["export_id"] == zones["__export"], "left")
    # The zones of the IANA data that occur bound the tables; other names have none.
    named = [r[0] for r in zones.select(F.trim(zone).alias(zone)).where(F.col(zone).isin(sorted(zoneinfo.available_timezones()))).distinct().collect()]
    instant = instant_udf(ZoneTables(named))(items["source"], items["ts"], zones[zone])
    return joined.select(*(items[c] for c in items.columns if c != to), instant.alias(to))


def found(items: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, epoch_us): one row per distinct id whose instant can be told; rows with a null id are left out, of
    deliveries that disagree the earliest instant counts."""
    made = with_instants(items.select("id", "source", "ts", "export_id").where(F.col("id").isNotNull()), exports)
    return made.where(F.col("epoch_us").isNotNull()).groupBy("id").agg(F.min("epoch_us").alias("epoch_us"))
