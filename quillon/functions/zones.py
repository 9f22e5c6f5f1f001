"""Versioned zone transition tables: UTC transition instants and offsets of a zone as sorted arrays.

The tables of the zones that a query names are built once, on the driver, from the installed IANA data, and travel to
the executors with a version, so every executor converts by the same rules whatever zone data it has. There are about
600 zones in the IANA data, which bounds the size (about 2 MB). The version is that of the IANA data with a digest of
the tables, so that equal versions mean equal rules even where the installed data does not say its version.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np

UTC = timezone.utc
FIRST_YEAR, LAST_YEAR = 1900, 2100

_FIXED = re.compile(r"^\s*(?:UTC|GMT|Z)?\s*([+-])(\d{1,2}):?(\d{2})?\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class ZoneTable:
    """``offsets[i]`` seconds hold from ``starts[i]`` (UTC seconds) on; ``starts[0]`` is the least int64."""

    starts: np.ndarray
    offsets: np.ndarray
    names: tuple[str, ...]

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC seconds of wall-clock seconds. An hour that occurs twice means its first pass; a skipped reading is
        taken with the offset before the change."""
        # A wall reading w belongs to segment i or later once w >= starts[i] + offsets[i-1] and also
        # w >= starts[i] + offsets[i]: with the larger of both, the earlier offset wins in gaps and overlaps.
        if len(self.starts) == 1:
            return wall - self.offsets[0]
        edges = self.starts[1:] + np.maximum(self.offsets[1:], self.offsets[:-1])
        return wall - self.offsets[np.searchsorted(edges, wall, side="right")]

    def offset_of_name(self, abbreviation: str) -> int | None:
        """The latest offset this zone writes as ``abbreviation``, or None."""
        for name, offset in zip(reversed(self.names), self.offsets[::-1]):
            if name == abbreviation:
                return int(offset)
        return None


def data_version() -> str:
    """What the installed IANA data calls itself."""
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "system"


def fixed_offset(text: str) -> int | None:
    """Seconds of a fixed offset such as ``+05:30``, or None."""
    m = _FIXED.match(text)
    if m:
        seconds = int(m[2]) * 3600 + int(m[3] or 0) * 60
        return -seconds if m[1] == "-" else seconds
    return 0 if text.strip().upper() in ("Z", "UTC", "GMT") else None


def _build(zone: zoneinfo.ZoneInfo) -> ZoneTable:
    def at(s: int) -> tuple[int, str]:
        d = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=s)).astimezone(zone)
        return int(d.utcoffset().total_seconds()), d.tzname()

    marks = [int((datetime(y, m, 1, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) for y in range(FIRST_YEAR, LAST_YEAR) for m in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    starts, offsets, names = [-(2**62)], [], []
    prev = at(marks[0])
    offsets.append(prev[0])
    names.append(prev[1])
    for lo, hi in zip(marks, marks[1:]):
        # Two changes within a month (Ramadan pauses) are seen from the middle.
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid, hi)):
            end = at(b)
            while prev != end:
                left, right = a, b
                while right - left > 1:
                    m = (left + right) // 2
                    if at(m) == prev:
                        left = m
                    else:
                        right = m
                now = at(right)
                starts.append(right)
                offsets.append(now[0])
                names.append(now[1])
                prev, a = now, right
    return ZoneTable(np.array(starts, np.int64), np.array(offsets, np.int64), tuple(names))


@functools.lru_cache(maxsize=1024)
def zone_table(name: str, version: str | None = None) -> ZoneTable | None:
    """The table of an IANA zone by the installed data, of the version given if any, or of a fixed offset; None for an
    unknown name."""
    fixed = fixed_offset(name)
    if fixed is not None:
        return ZoneTable(np.array([-(2**62)], np.int64), np.array([fixed], np.int64), ("",))
    if version is not None and version != data_version():
        raise RuntimeError(f"zone data {version} was asked for, {data_version()} is installed")
    try:
        return _build(zoneinfo.ZoneInfo(name.strip()))
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


class ZoneTables:
    """The tables of some zones with their version; fixed offsets need none."""

    def __init__(self, names: list[str]) -> None:
        self.tables = {n: t for n in sorted(set(names)) if (t := zone_table(n)) is not None}
        digest = hashlib.sha256()
        for n, t in self.tables.items():
            digest.update(f"{n} {t.names}".encode() + t.starts.tobytes() + t.offsets.tobytes())
        self.version = f"{data_version()}-{digest.hexdigest()[:16]}"

    def get(self, name: str) -> ZoneTable | None:
        return self.tables.get(name.strip()) or (zone_table(name) if fixed_offset(name) is not None else None)
