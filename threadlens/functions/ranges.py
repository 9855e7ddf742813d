"""Duration literals and date ranges, read on the driver; the present moment is passed in."""

from __future__ import annotations

import re
from datetime import datetime, time, timedelta

_UNITS = {"d": "days", "h": "hours", "m": "minutes"}
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
END_OF_DAY = timedelta(days=1) - timedelta(microseconds=1)


def parse_duration(text: str | None) -> timedelta | None:
    """Nd, Nh or Nm; None for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhm])\s*", text or "", re.I)
    return timedelta(**{_UNITS[m[2].lower()]: int(m[1])}) if m else None


def _shifted(now: datetime, n: int, unit: str) -> datetime:
    """n units on; a month or year that lacks the day runs over into the next month, as `date` has it."""
    if unit not in ("month", "year"):
        return now + timedelta(**{f"{unit}s": n})
    months = now.year * 12 + now.month - 1 + n * (12 if unit == "year" else 1)
    return now.replace(year=months // 12, month=months % 12 + 1, day=1) + timedelta(days=now.day - 1)


def _calendar(text: str, now: datetime, midnight: datetime) -> datetime | None:
    """Relative units, weekdays and dates with a month's name; None for anything else."""
    unit = r"(minute|hour|day|week|month|year)"
    if m := re.fullmatch(rf"(\d+)\s+{unit}s?\s+ago", text):
        return _shifted(now, -int(m[1]), m[2])
    if m := re.fullmatch(rf"(last|next)\s+{unit}", text):
        return _shifted(now, 1 if m[1] == "next" else -1, m[2])
    if m := re.fullmatch(rf"(?:(last|next|this)\s+)?({'|'.join(_DAYS)})[a-z]*", text):
        ahead = (_DAYS.index(m[2]) - now.weekday()) % 7
        return midnight + timedelta(days={"last": ahead - 7, "next": ahead or 7}.get(m[1], ahead))
    month = rf"({'|'.join(_MONTHS)})[a-z]*"
    if m := re.fullmatch(rf"{month}\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?|(\d{{1,2}})\s+{month}(?:\s+(\d{{4}}))?", text):
        name, day, year = (m[1], m[2], m[3]) if m[1] else (m[5], m[4], m[6])
        try:
            return midnight.replace(year=int(year or now.year), month=_MONTHS.index(name) + 1, day=int(day))
        except ValueError:
            return None
    return None


def parse_moment(text: str, now: datetime) -> datetime:
    """ISO date or time, or common English words for one."""
    text = text.strip().lower()
    midnight = datetime.combine(now.date(), time(), now.tzinfo)
    words = {"now": now, "today": midnight, "yesterday": midnight - timedelta(days=1), "tomorrow": midnight + timedelta(days=1)}
    if text in words:
        return words[text]
    if found := _calendar(text, now, midnight):
        return found
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"unrecognised date expression: {text}") from None
    return moment if moment.tzinfo or not now.tzinfo else moment.replace(tzinfo=now.tzinfo)


def parse_range(text: str | None, now: datetime, last_run: datetime | None = None) -> tuple[datetime, datetime, bool]:
    """(start, end, whether the last-run marker moves on): new, today, yesterday, last week, since X, A..B or one date."""
    arg = (text or "").strip().lower() or "new"
    if arg == "new":
        return last_run or now - timedelta(days=1), now, True
    if arg == "last week":
        return now - timedelta(days=7), now, False
    if arg.startswith("since "):
        return parse_moment(arg[6:], now), now, False
    if ".." in arg:
        start, end = (parse_moment(x, now) for x in arg.split("..", 1))
        return start, end + END_OF_DAY if end.time() == time() else end, False
    day = parse_moment(arg, now)
    return day, day + END_OF_DAY, False
