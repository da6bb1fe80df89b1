"""Dates in strings: one date of a known field (F15), and all dates in running text."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.text import trim_space

# Month names and zone abbreviations of mail dates.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

_ISO = r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)? ?(Z|z|[+-]\d{2}:?\d{2})?$"
_DAY_FIRST = r"(?i)^(?:[a-z]+,? +)?(\d{1,2})[ -]([a-z]{3})[a-z]*\.?[ -](\d{4})(?:,? +(\d{1,2}):(\d{2})(?::(\d{2}))?)? *([a-z]{1,4}|(?:GMT|UTC)?[+-]\d{2}:?\d{2})?$"
_MONTH_FIRST = r"(?i)^(?:[a-z]+,? +)?([a-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})(?:,? +(\d{1,2}):(\d{2})(?::(\d{2}))?)? *([a-z]{1,4}|(?:GMT|UTC)?[+-]\d{2}:?\d{2})?$"
_SLASHED = r"^(\d{4})/(\d{1,2})/(\d{1,2})(?:,? +(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


def _offset(zone: str | None) -> timedelta | None:
    """The offset that a zone's name or digits stand for; none means UTC; an unknown name gives null."""
    if not zone:
        return timedelta()
    if (name := zone.upper()) in ZONES:
        return timedelta(hours=ZONES[name])
    if m := re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{2}):?(\d{2})", name):
        return (1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3]))
    return None


def _moment(year, month, day, hour=None, minute=None, second=None, fraction=None, zone=None) -> datetime | None:
    off = _offset(zone)
    if off is None or not month:
        return None
    try:
        at = datetime(int(year), int(month), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=UTC)
        return at + timedelta(milliseconds=int(float(fraction or 0) * 1000)) - off
    except (ValueError, OverflowError):
        return None


def _month(name: str) -> int | None:
    return next((i for i, m in enumerate(MONTHS, 1) if m.startswith(name.lower()[:3])), None)


def parse_moment(s: str | None) -> datetime | None:
    """A date string of a field, as UTC to the millisecond; without a zone it is UTC. Weekdays are not checked. Null if it is none."""
    s = (s or "").strip()
    if m := re.match(_ISO, s):
        return _moment(m[1], m[2] or 1, m[3] or 1, m[4], m[5], m[6], m[7], m[8])
    if m := re.match(_DAY_FIRST, s):
        return _moment(m[3], _month(m[2]), m[1], m[4], m[5], m[6], None, m[7])
    if m := re.match(_MONTH_FIRST, s):
        return _moment(m[3], _month(m[1]), m[2], m[4], m[5], m[6], None, m[7])
    if m := re.match(_SLASHED, s):
        return _moment(*m.groups())
    return None


def parse_date(s: Column) -> Column:
    """``parse_moment`` with built-in expressions: each known form is rewritten to ISO and cast."""
    s = trim_space(s)

    def iso(form: str, year: int, month: Column, day: int, hour: int, zone: int | None, fraction: int | None = None) -> Column:
        part = lambda i, width, default: F.lpad(F.coalesce(F.nullif(F.regexp_extract(s, form, i), F.lit("")), F.lit(default)), width, "0")
        clock = F.concat_ws(":", part(hour, 2, "00"), part(hour + 1, 2, "00"), part(hour + 2, 2, "00"))
        more = F.substring(F.concat(F.regexp_extract(s, form, fraction)), 1, 4) if fraction else F.lit("")
        name = F.upper(F.regexp_extract(s, form, zone)) if zone else F.lit("")
        digits = F.regexp_replace(F.regexp_replace(name, "^(GMT|UTC)(?=[+-])", ""), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
        known = F.create_map(*(F.lit(x) for k, v in ZONES.items() for x in (k, f"{'-' if v < 0 else '+'}{abs(v):02d}:00")))
        shift = F.when(digits == "", "+00:00").when(digits.rlike("^[+-]"), digits).otherwise(known[digits])
        return F.when(s.rlike(form), F.concat(part(year, 4, "0"), F.lit("-"), month, F.lit("-"), part(day, 2, "01"), F.lit("T"), clock, more, shift).try_cast("timestamp"))

    def named(form: str, group: int) -> Column:
        short = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3], f"{i:02d}")))
        return short[F.lower(F.regexp_extract(s, form, group))]

    numbered = lambda form, group: F.lpad(F.coalesce(F.nullif(F.regexp_extract(s, form, group), F.lit("")), F.lit("01")), 2, "0")
    return F.coalesce(
        iso(_ISO, 1, numbered(_ISO, 2), 3, 4, 8, 7),
        iso(_DAY_FIRST, 3, named(_DAY_FIRST, 2), 1, 4, 7),
        iso(_MONTH_FIRST, 3, named(_MONTH_FIRST, 1), 2, 4, 7),
        iso(_SLASHED, 1, numbered(_SLASHED, 2), 3, 4, None),
    )


_MONTH_NAMES = {n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
_RUN = re.compile("[A-Za-z]+|[0-9]+")
_CLOCK_CHARS = frozenset("0123456789:.+-Z")
_BLANK = " \t\n\r\f\v"


def _is_gap(gap: str, first: str) -> bool:
    """Whether a gap between two runs is white space, after ``first`` at most once."""
    rest = gap.removeprefix(first)
    return rest != "" and not rest.strip(_BLANK)


def _numeric(text: str, runs: list, mark: str) -> tuple[int, int] | None:
    """Where year, month and day by digits, with ``mark`` between them and not around them, begin and end."""
    (a, _, y), (c, _, m), (e, f, d) = runs
    if (len(y), len(m), len(d)) != (4, 2, 2) or text[runs[0][1] : c] != mark or text[runs[1][1] : e] != mark:
        return None
    return None if text[a - 1 : a] == mark or text[f : f + 1] == mark else (a, f)


def _with_clock(text: str, start: int, end: int) -> tuple[int, datetime | None]:
    """(end, moment) of a date at ``start`` whose time of day, at least to the second, follows the T at ``end``; the date's end and none without one."""
    last = next((i for i in range(end + 1, len(text)) if text[i] not in _CLOCK_CHARS), len(text))
    stamp = text[start:last].rstrip(".:+-")
    if len(stamp) < end - start + 9 or stamp[end - start + 3] != ":" or stamp[end - start + 6] != ":":
        return end, None
    try:
        at = datetime.fromisoformat(stamp)
        at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    except (ValueError, OverflowError):
        return end, None
    return start + len(stamp), at.replace(microsecond=at.microsecond // 1000 * 1000)


def _spelt(text: str, runs: list) -> tuple[str, int, str] | None:
    """(year, month, day) of three runs that are a date with the month's name, in either order."""
    first, second, year = (r[2] for r in runs)
    gaps = text[runs[0][1] : runs[1][0]], text[runs[1][1] : runs[2][0]]
    if len(year) != 4 or not year.isdigit():
        return None
    if (month := _MONTH_NAMES.get(first.lower())) and second.isdigit() and len(second) <= 2:
        return (year, month, second) if _is_gap(gaps[0], ".") and gaps[1][:1] == "," and _is_gap(gaps[1], ",") else None
    if (month := _MONTH_NAMES.get(second.lower())) and first.isdigit() and len(first) <= 2:
        return (year, month, first) if _is_gap(gaps[0], "") and _is_gap(gaps[1], ".") else None
    return None


def dates_with_places(text: str, now: datetime) -> list[tuple[int, int, datetime]]:
    """(start, end, date) of every date in the text by start: Sep 2, 2026; 2 Sep 2026; ISO with or without a time; 2026/09/02.

    Years run from 1990 to the one after ``now``'s. Without an offset a date is UTC. Runs of letters and of digits are read three at a time.
    """
    runs = [(m.start(), m.end(), m[0]) for m in _RUN.finditer(text)]
    found = []
    for three in zip(runs, runs[1:], runs[2:], strict=False):
        end, exact = three[2][1], None
        if three[0][2].isdigit() and three[1][2].isdigit():
            iso = _numeric(text, three, "-") if three[2][2].isdigit() else None
            if iso is None and not (three[2][2].isdigit() and _numeric(text, three, "/")):
                continue
            parts = tuple(r[2] for r in three)
            if iso and text[end : end + 1] == "T":
                end, exact = _with_clock(text, three[0][0], end)
        elif (parts := _spelt(text, three)) is None:
            continue
        year, month, day = (int(x) for x in parts)
        at = _moment(year, month, day) if C.MIN_YEAR <= year <= now.year + 1 and month and day else None
        if at is not None:
            found.append((three[0][0], end, exact or at))
    return found


def dates_in(text: str, now: datetime) -> list[datetime]:
    return [d for *_, d in dates_with_places(text, now)]


def plausible(at: datetime | None, now: datetime) -> bool:
    return at is not None and C.MIN_YEAR <= at.year <= now.year + 1


def find_date_texts(text: Column, now: datetime) -> Column:
    """All dates in a text, by place; null for a null text."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if s is None else dates_in(s, now) for s in column.to_pylist()], pa.list_(pa.timestamp("us", "UTC")))

    return F.arrow_udf(run, "array<timestamp>")(text)
