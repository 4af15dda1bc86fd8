"""Frequencies: fixed steps and calendar anchors as index arithmetic on microseconds.

A frequency numbers its anchors: `index(t)` is the number of the last anchor at or before t, `anchor(i)` is when anchor i is.
Fixed steps (weeks to microseconds) count from an origin; calendar ones (MS, ME, SMS, SME, QS, QE, YS, YE) count months.
Calendar anchors are at midnight. Everything is built of SQL expressions, so it stays in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.axis import ntz, ntz_micros

#: Microseconds of the fixed units (fixed values).
UNITS = {"W": 604_800_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}
_ALIASES = {"H": "h", "T": "min", "S": "s", "L": "ms", "U": "us", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE"}
#: Months between anchors, and anchors in that span.
CALENDAR = {"MS": (1, 1), "ME": (1, 1), "QS": (3, 1), "QE": (3, 1), "YS": (12, 1), "YE": (12, 1), "SMS": (1, 2), "SME": (1, 2)}
DAY = UNITS["D"]
#: Weeks end on Sunday; 1970-01-04 was one.
_SUNDAY = 3 * DAY


@dataclass(frozen=True)
class Frequency:
    n: int
    unit: str

    @classmethod
    def parse(cls, text: str | Frequency) -> Frequency:
        if isinstance(text, Frequency):
            return text
        m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
        unit = m and (m[2] if m[2] in UNITS or m[2] in CALENDAR else _ALIASES.get(m[2], m[2]))
        if not m or unit not in UNITS and unit not in CALENDAR or m[1] and not int(m[1]):
            raise ValueError(f"unknown frequency {text!r}")
        return cls(int(m[1] or 1), unit)

    @property
    def is_calendar(self) -> bool:
        return self.unit in CALENDAR

    @property
    def ends(self) -> bool:
        """Anchors are ends of periods, which by default close and label on the right."""
        return self.unit in ("ME", "QE", "YE", "SME", "W")

    @property
    def default_side(self) -> str:
        return "right" if self.unit in ("ME", "QE", "YE", "W") else "left"

    @property
    def step(self) -> int:
        """Microseconds of a fixed frequency."""
        if self.is_calendar:
            raise ValueError(f"{self.unit} has no fixed length")
        return self.n * UNITS[self.unit]

    def index(self, t: Column, origin: Column | None = None) -> Column:
        """Number of the last anchor at or before t (microseconds); the origin's is 0 where one is given."""
        if not self.is_calendar:
            start = origin if origin is not None else F.lit(_SUNDAY if self.unit == "W" else 0)
            return _floor_div(t - start, self.step)
        own = _calendar_index(ntz(t), self.unit)
        base = _calendar_index(ntz(origin), self.unit) if origin is not None else F.lit(0)
        return _floor_div((own - base).cast("long"), self.n)

    def anchor(self, i: Column, origin: Column | None = None) -> Column:
        """Microseconds of anchor i."""
        if not self.is_calendar:
            start = origin if origin is not None else F.lit(_SUNDAY if self.unit == "W" else 0)
            return start + i * self.step
        base = _calendar_index(ntz(origin), self.unit) if origin is not None else F.lit(0)
        return ntz_micros(_calendar_anchor((i * self.n + base).cast("int"), self.unit))


def _floor_div(x: Column, n: int) -> Column:
    """Whole quotient toward minus infinity, in integers."""
    x = x.cast("long")
    rest = F.pmod(x, F.lit(n).cast("long"))
    return F.call_function("div", x - rest, F.lit(n).cast("long"))


def _months(t: Column) -> Column:
    return (F.year(t) - 1970) * 12 + F.month(t) - 1


def _calendar_index(t: Column, unit: str) -> Column:
    span, _ = CALENDAR[unit]
    months = _months(t)
    if unit in ("MS", "QS", "YS"):
        return _floor_div(months, span)
    at_end = F.to_date(t) >= F.last_day(t)
    if unit in ("ME", "QE", "YE"):
        done = F.when(at_end, months).otherwise(months - 1)
        return _floor_div(done + 1, span) - 1
    half = F.dayofmonth(t) >= 15
    if unit == "SMS":
        return (months * 2 + half.cast("int")).cast("long")
    return (months * 2 + F.when(at_end, 1).when(half, 0).otherwise(-1)).cast("long")


def _calendar_anchor(i: Column, unit: str) -> Column:
    span, _ = CALENDAR[unit]
    first = lambda months: F.add_months(F.lit("1970-01-01").cast("date"), months)
    if unit in ("MS", "QS", "YS"):
        day = first(i * span)
    elif unit in ("ME", "QE", "YE"):
        day = F.last_day(first(i * span + (span - 1)))
    else:
        month, second = first(_floor_div(i, 2).cast("int")), F.pmod(i, F.lit(2)) == 1
        middle = F.date_add(month, 14)
        day = F.when(second, middle).otherwise(month) if unit == "SMS" else F.when(second, F.last_day(month)).otherwise(middle)
    return day.cast("timestamp_ntz")


def floor_ts(value: Column, freq: str) -> Column:
    """The last anchor at or before a timestamp (NTZ)."""
    f = Frequency.parse(freq)
    return ntz(f.anchor(f.index(ntz_micros(value.cast("timestamp_ntz")))))


def ceil_ts(value: Column, freq: str) -> Column:
    """The next anchor strictly after a timestamp (NTZ)."""
    f = Frequency.parse(freq)
    return ntz(f.anchor(f.index(ntz_micros(value.cast("timestamp_ntz"))) + 1))


def floor_value(value: datetime, freq: str) -> datetime:
    """floor_ts for one Python value; the planner uses it on file bounds."""
    f = Frequency.parse(freq)
    epoch = datetime(1970, 1, 1)
    if not f.is_calendar:
        start = epoch + timedelta(microseconds=_SUNDAY if f.unit == "W" else 0)
        return start + ((value - start) // timedelta(microseconds=f.step)) * timedelta(microseconds=f.step)
    day = datetime(value.year, value.month, value.day)
    while not _is_anchor(day, f.unit):
        day -= timedelta(days=1)
    return day


def _is_anchor(day: datetime, unit: str) -> bool:
    last = (day + timedelta(days=1)).day == 1
    span = CALENDAR[unit][0]
    if unit in ("MS", "QS", "YS"):
        return day.day == 1 and (day.month - 1) % span == 0
    if unit in ("ME", "QE", "YE"):
        return last and day.month % span == 0
    return day.day in (1, 15) if unit == "SMS" else day.day == 15 or last
