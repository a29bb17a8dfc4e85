"""Columns. Timestamps have no zone; nothing here depends on the session's."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, TOTAL = "decimal(18,2)", "decimal(38,2)"


def text(c: str | Column) -> Column:
    return F.trim(c)


def code(c: str | Column) -> Column:
    """Lower-cased and trimmed."""
    return F.lower(F.trim(c))


def filled(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c, F.lit(""))


def moment(c: str) -> Column:
    return F.col(c).try_cast("timestamp_ntz")


def money(c: str) -> Column:
    return F.col(c).try_cast(MONEY)


def whole(c: str) -> Column:
    return F.col(c).try_cast("int")


def seconds(t: str | Column) -> Column:
    """Whole seconds since 1970 on the clock of the timestamp itself."""
    t = F.col(t) if isinstance(t, str) else t
    return F.datediff(t.cast("date"), F.lit(date(1970, 1, 1))).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def days_between(start: str | Column, end: str | Column) -> Column:
    """Date boundaries crossed."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.datediff(end.cast("date"), start.cast("date")).cast("long")


def month(t: str | Column) -> Column:
    return F.trunc(F.col(t).cast("date") if isinstance(t, str) else t.cast("date"), "month")


def as_of(day: date | None) -> Column:
    return F.lit(day) if day else F.current_date()


def total(c: str | Column, where: Column | None = None) -> Column:
    """The sum of the rows that qualify, null if there are none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c if where is None else F.when(where, c)).cast(TOTAL)


def total0(c: str | Column, where: Column | None = None) -> Column:
    return F.coalesce(total(c, where), F.lit(0).cast(TOTAL))


def zero(c: str | Column, kind: str = TOTAL) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast(kind)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """A double; null where the denominator is zero."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (numerator, denominator))
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def matches(c: str | Column, pattern: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(pattern)


def iso_weekday(c: str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(c) + 1).cast("int")
