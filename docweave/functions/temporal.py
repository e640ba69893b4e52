"""Partial dates: the instants they cover, and the columns they are sorted by."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?")


def bounds(value: str) -> tuple[datetime, datetime] | None:
    """[first, last) of a year, a month, a day or an instant (of one second), in UTC without zone; None if it is neither.

    The last bound past year 9999 is the greatest datetime.
    """
    try:
        if re.fullmatch(r"\d{4}", value):
            first, last = datetime(int(value), 1, 1), (int(value) + 1, 1, 1)
        elif re.fullmatch(r"\d{4}-\d{2}", value):
            y, m = map(int, value.split("-"))
            first, last = datetime(y, m, 1), (y + m // 12, m % 12 + 1, 1)
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            day = date.fromisoformat(value)
            first = datetime(day.year, day.month, day.day)
            return first, (datetime.max if day == date.max else first + timedelta(days=1))
        elif INSTANT.fullmatch(value):
            at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value))
            at = (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
            return at, at + timedelta(seconds=1)
        else:
            return None
        return first, (datetime.max if last[0] > 9999 else datetime(*last))
    except (ValueError, OverflowError):
        return None


def literal(at: datetime, kind: str) -> Column:
    """A constant of the column's own type, so that comparisons reach the scan as they are."""
    if kind == "date":
        return F.lit(at.date())
    return F.lit(at.isoformat(sep=" ")).cast(kind)


def date_sort(column: Column) -> Column:
    """The first day of a year, month or day; null if it is none."""
    ok = column.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
    full = F.when(F.length(column) == 4, F.concat(column, F.lit("-01-01"))).when(F.length(column) == 7, F.concat(column, F.lit("-01"))).otherwise(column)
    return F.when(ok, F.try_to_date(full, "yyyy-MM-dd") if hasattr(F, "try_to_date") else full.try_cast("date"))


def datetime_sort(column: Column) -> Column:
    """The instant at which a partial date, a datetime or an instant begins; without an offset it is UTC."""
    day = date_sort(column)
    column = F.regexp_replace(column, r":60(?=\D|$)", ":59")  # a leap second
    zoned = F.when(column.rlike(r"(Z|[+-]\d{2}:\d{2})$"), column).otherwise(F.concat(column, F.lit("Z")))
    return F.when(F.contains(column, F.lit("T")), zoned.try_cast("timestamp")).otherwise(day.cast("timestamp"))
