"""Reading timestamps in mixed notations into wall-clock parts.

``parse_timestamp`` is an Arrow-batched UDF from text to a small struct.  The same
parse as a chain of Spark SQL projections was tried: it ran, but a filter or join
above it made the optimizer's constraint propagation take minutes, so only the
conversion between zones (``wall_to_utc``) is left to Spark SQL.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of months in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fevrier fév febrero",
    3: "march mar märz mär mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc decembre diciembre dic",
}

#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "NST": -210, "NDT": -150, "BRT": -180, "ART": -180,
    "IST": 330, "NPT": 345, "PKT": 300, "ICT": 420, "WIB": 420, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120, "EAT": 180, "WAT": 60,
}

_MICRO = 1_000_000
_DAY = 86_400
_EPOCH = datetime.date(1970, 1, 1).toordinal()
_MONTH_NUMBER = {word: number for number, words in MONTHS.items() for word in words.split()}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?: ?(?P<half>[ap])\.?m\.?)?(?: uhr)?"
_AFTER = rf"(?:(?:t|,? at |,? um |,? à |, | ){_TIME})?$"
_HAN_TIME = r"(?P<half>上午|下午|凌晨|早上|中午|晚上|午前|午後)? ?(?P<h>\d{1,2})[:时時点](?P<mi>\d{1,2})?(?:[:分](?P<s>\d{1,2})?(?:[.,](?P<f>\d+))?秒?)?"
#: One pattern for each notation family, tried in this order on the text without its zone.
_FAMILIES = [
    ("date", re.compile(r"(?P<y>\d{4})([-/.])(?P<m>\d{1,2})\2(?P<d>\d{1,2})" + _AFTER)),
    ("date", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:t(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?)?$")),
    ("ordinal", re.compile(r"(?P<y>\d{4})-(?P<d>\d{3})" + _AFTER)),
    ("week", re.compile(r"(?P<y>\d{4})-w(?P<m>\d{2})-(?P<d>\d)" + _AFTER)),
    ("numeric", re.compile(r"(?P<d>\d{1,2})([-/.])(?P<m>\d{1,2})\2(?P<y>\d{4})" + _AFTER)),
    ("named", re.compile(r"(?:[^\d\s,.]+[.,]* )?(?P<d>\d{1,2})\.?(?:st|nd|rd|th)? (?:de )?(?P<m>[^\d\s,.]+)[.,]* (?:de )?(?P<y>\d{4})" + _AFTER)),
    ("named", re.compile(r"(?:[^\d\s,.]+[.,] )?(?P<m>[^\d\s,.]+)\.? (?P<d>\d{1,2})(?:st|nd|rd|th)?,? (?P<y>\d{4})" + _AFTER)),
    ("date", re.compile(rf"(?P<y>\d{{4}})年(?P<m>\d{{1,2}})月(?P<d>\d{{1,2}})[日号]?(?: ?{_HAN_TIME})?$")),
]
_NUMBER = re.compile(r"(\d{10,19})(?:\.(\d+))?$")
_BRACKET = re.compile(r"\[([\w+\-]+(?:/[\w+\-]+)*)\]$")
_NUMERIC_ZONE = re.compile(r"(?i)(.*(?::\d{2}(?:[.,]\d+)?|\dt\d{4,6}(?:[.,]\d+)?)) ?([+-])(\d{2}):?(\d{2})?$")
_NAMED_ZONE = re.compile(r"(?i)(.*\d(?: ?[ap]\.?m\.?(?![a-z]))?) ?((?!am$|pm$|uhr$)[a-z]{1,5}|[a-z_]+(?:/[a-z_+\-0-9]+)+)$")
_MORNING, _EVENING = {"a", "上午", "凌晨", "早上", "午前"}, {"p", "下午", "中午", "晚上", "午後"}

PARSED = T.StructType().add("epoch_micros", "long").add("wall_micros", "long").add("offset_minutes", "integer").add("zone", "string")
_NOTHING = (None, None, None, None)


def known_zones() -> list[str]:
    """Names of the time zone database, regions only."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/")))


_ZONES = frozenset(known_zones()) | {"UTC", "GMT"}


def _day_number(kind: str, y: int, m: str | None, d: int, order: str | None) -> int | None:
    """Days since 1970-01-01, or None where there is no such date."""
    try:
        if kind == "ordinal":
            day = datetime.date(y, 1, 1).toordinal() + d - 1
            return day - _EPOCH if d >= 1 and datetime.date.fromordinal(day).year == y else None
        if kind == "week":
            return datetime.date.fromisocalendar(y, int(m), d).toordinal() - _EPOCH
        if kind == "named":
            month = _MONTH_NUMBER[m]
        elif kind == "numeric" and order == "mdy":
            month, d = d, int(m)
        else:
            month = int(m)
        return datetime.date(y, month, d).toordinal() - _EPOCH
    except (ValueError, KeyError, OverflowError):
        return None


def _micros(fraction: str | None) -> int:
    return int((fraction or "0")[:6].ljust(6, "0"))


def read_moment(text: str | None, order: str | None) -> tuple[int | None, int | None, int | None, str | None]:
    """The parse of one text; see :func:`parse_timestamp`."""
    if not text:
        return _NOTHING
    s = " ".join(unicodedata.normalize("NFKC", text).replace("​", " ").replace("﻿", " ").replace("−", "-").replace("–", "-").split())
    if number := _NUMBER.match(s):
        count, size = int(number[1]), len(number[1])
        part = _micros(number[2])
        micros = count * _MICRO + part if size < 12 else count * 1000 + part // 1000 if size < 15 else count if size < 18 else count // 1000
        return micros, None, None, None
    offset = zone = None
    if bracket := _BRACKET.search(s):
        zone, s = bracket[1], s[: bracket.start()].rstrip()
    if tail := _NUMERIC_ZONE.match(s):
        s, hours, minutes = tail[1], int(tail[3]), int(tail[4] or 0)
        if hours > 18 or minutes > 59:
            return _NOTHING
        offset = (hours * 60 + minutes) * (-1 if tail[2] == "-" else 1)
    elif tail := _NAMED_ZONE.match(s):
        s = tail[1]
        if "/" in tail[2]:
            zone = tail[2]
        else:
            offset = ABBREVIATIONS.get(tail[2].upper())
            if offset is None:
                return _NOTHING
    if zone is not None and zone not in _ZONES:
        return _NOTHING
    local = s.strip().lower()
    for kind, pattern in _FAMILIES:
        if not (found := pattern.match(local)):
            continue
        g = found.groupdict()
        day = _day_number(kind, int(g["y"]), g.get("m"), int(g["d"]), order)
        if day is None:
            return _NOTHING
        h, mi, sec, half = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0), g.get("half")
        if half in ("a", "p") and not 1 <= h <= 12:
            return _NOTHING
        if half in _MORNING and h == 12:
            h = 0
        elif half in _EVENING and h < 12:
            h += 12
        if h > 23 or mi > 59 or sec > 59:
            return _NOTHING
        wall = (day * _DAY + h * 3600 + mi * 60 + sec) * _MICRO + _micros(g["f"])
        return None, wall, offset, zone if offset is None else None
    return _NOTHING


@F.pandas_udf(PARSED)
def parse_timestamp(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What a text says: ``struct<epoch_micros, wall_micros, offset_minutes, zone>``.

    ``epoch_micros`` is set for plain epoch numbers, ``wall_micros`` (microseconds
    of the wall clock, counted as if UTC) for everything else.  ``offset_minutes``
    holds a numeric offset or abbreviation of the text, ``zone`` a region that it
    names; with an offset the region is left aside.  The second argument, a date
    order ('dmy', 'mdy'; anything else counts as 'dmy'), is used only for all-digit
    dates that the year doesn't lead.  Text that denotes no valid moment, null and
    empty text give nulls throughout; a named but unknown zone makes the text no moment.
    """
    for texts, orders in batches:
        rows = [read_moment(t, o) for t, o in zip(texts, orders, strict=True)]
        frame = pd.DataFrame(rows, columns=["epoch_micros", "wall_micros", "offset_minutes", "zone"], dtype=object)
        yield frame.astype({"epoch_micros": "Int64", "wall_micros": "Int64", "offset_minutes": "Int32"})


def wall_to_utc(wall_micros: Column, zone: Column) -> Column:
    """UTC microseconds of a wall-clock time in a region.

    A time that occurs twice means the first; one that the clock skips moves on by
    the length of the gap.
    """
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_micros), zone))
