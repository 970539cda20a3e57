"""All valid readings of a text as a time: an instant, a local date and time, or a time of day."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
EPOCH = date(1970, 1, 1).toordinal()

# Month names, and minutes from UTC of the US and European zone abbreviations.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0,
    "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "MET": 60, "CEST": 120, "MEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}

INSTANT, LOCAL, CLOCK = 0, 1, 2

_ZONE = r"(?:\s*(?P<tz>[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5})(?:\[(?P<region>[\w/+-]+)\])?|\s*\[(?P<region2>[\w/+-]+)\])?"
_HALF = r"(?:\s*(?P<half>[AaPp])\.?(?:[Mm]\.?)?(?![A-Za-z]))?"
_HMS = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?" + _HALF + _ZONE
_FORMS = [
    ("iso", re.compile(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})[Tt ]" + _HMS)),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt ](?P<hh>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:\.(?P<f>\d{1,9}))?)?" + _ZONE)),
    ("slash", re.compile(r"(?P<a>\d{1,2})[/.-](?P<b>\d{1,2})[/.-](?P<y>\d{4}) " + _HMS)),
    ("dashed", re.compile(r"(?P<d>\d{1,2})-(?P<mon>[A-Za-z]{3})-(?P<y>\d{4}|\d{2}) (?:(?P<hhmm>\d{1,4})" + _ZONE + r")")),
    ("mail", re.compile(r"(?:[A-Za-z]{3},? )?(?P<d>\d{1,2}) (?P<mon>[A-Za-z]{3})[a-z]* (?P<y>\d{4}) " + _HMS)),
    ("named", re.compile(r"(?P<mon>[A-Za-z]{3})[a-z]* (?P<d>\d{1,2}),? (?P<y>\d{4}),? " + _HMS)),
    ("clock", re.compile(_HMS)),
]
FORMATS = ["hhmm", "epoch_s", "epoch_ms", "epoch_us", "iso", "compact", "slash_dm", "slash_md", "dashed", "mail", "named", "clock"]
CODE = {f: i for i, f in enumerate(FORMATS)}
_EPOCH_DIGITS = {10: ("epoch_s", SECOND), 13: ("epoch_ms", 1000), 16: ("epoch_us", 1)}


def clock_of_hhmm(digits: str) -> int | None:
    """Microseconds since midnight of up to four digits; 2400 is the end of the day."""
    v = int(digits)
    h, m = divmod(v, 100)
    return (h * 60 + m) * MINUTE if m < 60 and (h < 24 or v == 2400) else None


def _clock(g: dict) -> int | None:
    if g.get("hhmm") is not None:
        return clock_of_hhmm(g["hhmm"])
    h, m, s = int(g.get("h") or g.get("hh")), int(g["mi"]), int(g["s"] or 0)
    if m > 59 or s > 59:
        return None
    if half := g.get("half"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (half in "pP")
    frac = int((g.get("f") or "0")[:6].ljust(6, "0"))
    if h > 24 or h == 24 and (m or s or frac):
        return None
    return ((h * 60 + m) * 60 + s) * SECOND + frac


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return date(y, m, d).toordinal() - EPOCH
    except ValueError:
        return None


def offset_minutes(text: str) -> int | None:
    """Minutes from UTC of ``+05:30``, ``-0600``, ``+01`` or an abbreviation."""
    if text[0] in "+-":
        d = text[1:].replace(":", "")
        h, m = int(d[:2]), int(d[2:] or 0)
        return (h * 60 + m) * (-1 if text[0] == "-" else 1) if h <= 18 and m < 60 else None
    return ABBREVIATIONS.get(text.upper())


def readings(text: str | None) -> list[tuple[int, int, int, str | None]]:
    """All valid readings; short texts, which recur, are read once per process."""
    return _short(text) if text is not None and len(text) <= 5 else _read(text)


@lru_cache(maxsize=100_000)
def _short(text: str) -> list[tuple[int, int, int, str | None]]:
    return _read(text)


def _read(text: str | None) -> list[tuple[int, int, int, str | None]]:
    """(format code, kind, microseconds, zone written without an offset) of every valid reading.

    Microseconds count from 1970 UTC (instants), from 1970 in local time, or from midnight (clock times).
    """
    if text is None:
        return []
    t = text.strip()
    if t.isascii() and t.isdigit():
        if len(t) <= 4:
            c = clock_of_hhmm(t)
            return [] if c is None else [(CODE["hhmm"], CLOCK, c, None)]
        if len(t) in _EPOCH_DIGITS:
            name, unit = _EPOCH_DIGITS[len(t)]
            return [(CODE[name], INSTANT, int(t) * unit, None)]
        return []
    if not t or not t.isascii():
        return []
    out = []
    for name, form in _FORMS:
        m = form.fullmatch(t)
        if not m:
            continue
        g = m.groupdict()
        c = _clock(g)
        if c is None:
            continue
        off = None
        if g["tz"]:
            off = offset_minutes(g["tz"])
            if off is None:
                continue
        region = g["region2"]
        if name == "clock":
            if off is not None:
                region = ("-" if off < 0 else "+") + f"{abs(off) // 60:02d}:{abs(off) % 60:02d}"
            out.append((CODE[name], CLOCK, c, region))
            continue
        if name == "slash":
            a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
            days = [("slash_dm", _day(y, b, a)), ("slash_md", _day(y, a, b))]
        else:
            y = int(g["y"])
            month = MONTHS.get(g["mon"].lower(), 0) if g.get("mon") else int(g["m"])
            days = [(name, _day(y + 2000 if y < 100 else y, month, int(g["d"])))]
        seen = set()
        for fmt, day in days:
            if day is None or day in seen:
                continue
            seen.add(day)
            us = day * DAY + c
            out.append((CODE[fmt], LOCAL, us, region) if off is None else (CODE[fmt], INSTANT, us - off * MINUTE, None))
        break
    return out


@lru_cache(maxsize=4096)
def zone_named(name: str):
    """A zone by name, or fixed minutes by offset text; null if there is none such."""
    name = name.strip()
    if name and name[0] in "+-":
        try:
            return offset_minutes(name)
        except ValueError:
            return None
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown or malformed names raise several types
        return ABBREVIATIONS.get(name.upper())


def _naive(us: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


def offsets_at_wall(zone, us: int) -> tuple[int, int]:
    """Offsets (microseconds) that a wall time may have: equal unless a clock change skips or repeats it."""
    if isinstance(zone, int):
        return zone * MINUTE, zone * MINUTE
    w = _naive(us)
    a = w.replace(tzinfo=zone).utcoffset()
    b = w.replace(tzinfo=zone, fold=1).utcoffset()
    return a // timedelta(microseconds=1), b // timedelta(microseconds=1)


def wall_at(zone, utc: int) -> int:
    """Wall time (microseconds since 1970 in local time) of an instant."""
    if isinstance(zone, int):
        return utc + zone * MINUTE
    u = _naive(utc).replace(tzinfo=zone)
    return utc + zone.fromutc(u).utcoffset() // timedelta(microseconds=1)
