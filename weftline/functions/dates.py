"""Days that a question names, in Portuguese or English, on the driver."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date, datetime, timedelta
from typing import NamedTuple
from zoneinfo import ZoneInfo

#: Month names.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


class DayRange(NamedTuple):
    """Days from first to last, both included."""

    first: date
    last: date

    def instants(self, zone: str = "UTC") -> tuple[datetime, datetime]:
        """The half-open range of instants in a time zone; days of 23 or 25 hours included."""
        start = datetime(self.first.year, self.first.month, self.first.day, tzinfo=ZoneInfo(zone))
        after = self.last + timedelta(days=1)
        return start, datetime(after.year, after.month, after.day, tzinfo=ZoneInfo(zone))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _day(year: int | None, month: int, day: int, today: date) -> DayRange | None:
    """One day; without a year the last such day that isn't in the future. Impossible days are none."""
    try:
        found = date(year or today.year, month, day)
        if year is None and found > today:
            found = found.replace(year=found.year - 1)
    except ValueError:
        return None
    return DayRange(found, found)


def _year(digits: str | None) -> int | None:
    return None if not digits else int(digits) + (2000 if len(digits) == 2 else 0)


def _ago(first: int, last: int = 0) -> Callable[[date], DayRange]:
    return lambda today: DayRange(today - timedelta(days=first), today - timedelta(days=last))


def _week(back: int) -> Callable[[date], DayRange]:
    def resolve(today: date) -> DayRange:
        monday = today - timedelta(days=today.weekday() + 7 * back)
        return DayRange(monday, monday + timedelta(days=6) if back else today)

    return resolve


def _month(back: int) -> Callable[[date], DayRange]:
    def resolve(today: date) -> DayRange:
        first = today.replace(day=1)
        if not back:
            return DayRange(first, today)
        last = first - timedelta(days=1)
        return DayRange(last.replace(day=1), last)

    return resolve


def _whole_year(back: int) -> Callable[[date], DayRange]:
    return lambda today: DayRange(date(today.year - back, 1, 1), date(today.year - 1, 12, 31) if back else today)


#: Phrases by the range they name; those of one language before the other's, in order.
KEYWORDS: tuple[tuple[str, Callable[[date], DayRange]], ...] = (
    (r"\banteontem\b", _ago(2, 2)), (r"\bontem\b", _ago(1, 1)), (r"\bhoje\b", _ago(0)),
    (r"\bsemana (passada|anterior)\b", _week(1)), (r"\b(esta|essa|nesta|nessa) semana\b", _week(0)), (r"\bultima semana\b", _ago(6)),
    (r"\bmes (passado|anterior)\b", _month(1)), (r"\b(este|esse|neste|nesse) mes\b", _month(0)),
    (r"\bano passado\b", _whole_year(1)), (r"\b(este|esse|neste|nesse) ano\b", _whole_year(0)),
    (r"\bday before yesterday\b", _ago(2, 2)), (r"\byesterday\b", _ago(1, 1)), (r"\btoday\b", _ago(0)),
    (r"\b(last|previous) week\b", _week(1)), (r"\bthis week\b", _week(0)), (r"\bpast week\b", _ago(6)),
    (r"\b(last|previous) month\b", _month(1)), (r"\bthis month\b", _month(0)),
    (r"\blast year\b", _whole_year(1)), (r"\bthis year\b", _whole_year(0)),
)


def day_range(question: str, today: date, day_first: bool = True) -> tuple[DayRange, str] | None:
    """The days a question names and the words that name them; explicit dates before keywords."""
    text = _folded(question)

    def iso() -> tuple[DayRange | None, str] | None:
        m = re.search(r"\b(\d{4})-(\d{2})-(\d{2})\b", text)
        return m and (_day(int(m[1]), int(m[2]), int(m[3]), today), m[0])

    def slashes() -> tuple[DayRange | None, str] | None:
        m = re.search(r"\b(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?\b", text)
        return m and (_day(_year(m[3]), int(m[2 if day_first else 1]), int(m[1 if day_first else 2]), today), m[0])

    def named() -> tuple[DayRange | None, str] | None:
        m = re.search(rf"\b(\d{{1,2}}) de ({'|'.join(MONTHS)})(?: de (\d{{4}}))?\b", text)
        return m and (_day(_year(m[3]), MONTHS.index(m[2]) + 1, int(m[1]), today), m[0])

    def english() -> tuple[DayRange | None, str] | None:
        month = "(" + "|".join([*ENGLISH_MONTHS, *(m[:3] for m in ENGLISH_MONTHS), "sept"]) + ")"
        number = lambda name: next(i for i, m in enumerate(ENGLISH_MONTHS, 1) if m[:3] == name[:3])
        m = re.search(rf"\b{month}\.?\s+(\d{{1,2}})(st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b", text)
        modal = m and m[1] == "may" and not m[3] and not re.search(r"\b(on|since|until|from|by|of|in)\s+$", text[: m.start()])
        if m and not modal:
            return _day(_year(m[4]), number(m[1]), int(m[2]), today), m[0]
        m = re.search(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{month}\.?(?:,?\s+(\d{{4}}))?\b", text)
        return m and (_day(_year(m[3]), number(m[2]), int(m[1]), today), m[0])

    def last_days() -> tuple[DayRange | None, str] | None:
        m = re.search(r"\b(?:ultimos|last|past) (\d{1,3}) (?:dias|days)\b", text)
        return m and (_ago(int(m[1]) - 1)(today) if int(m[1]) else None, m[0])

    def keyword() -> tuple[DayRange | None, str] | None:
        return next(((resolve(today), m[0]) for pattern, resolve in KEYWORDS if (m := re.search(pattern, text))), None)

    for detect in (iso, slashes, named, english, last_days, keyword):
        found = detect()
        if found and found[0]:
            return found
    return None
