"""Calendar and rolling report periods."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

CONTEXT_DAYS = 13
DAILY_UP_TO = 62


@dataclass(frozen=True)
class Period:
    name: str
    start: date
    end: date
    monthly: bool
    #: Where the series begins; a single day has the days ahead of it as context.
    series_start: date


def named(name: str, today: date) -> Period:
    """day, month or year around ``today``; anything else is the month."""
    if name == "day":
        return Period("day", today, today, False, today - timedelta(days=CONTEXT_DAYS))
    if name == "year":
        first = date(today.year, 1, 1)
        return Period("year", first, date(today.year, 12, 31), True, first)
    first = today.replace(day=1)
    return Period("month", first, today.replace(day=calendar.monthrange(today.year, today.month)[1]), False, first)


def last_days(days: int, today: date) -> Period:
    first = today - timedelta(days=max(0, days - 1))
    return Period("days", first, today, days > DAILY_UP_TO, first)
