"""Period labels and calendar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillmark.functions.exprs import ColumnOrName, bucketize, col

# Day names, Sunday first.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def year_month(day: ColumnOrName) -> Column:
    """Integer such as 202407."""
    return F.year(col(day)) * 100 + F.month(col(day))


def month_label(day: ColumnOrName) -> Column:
    """Text such as ``2024-M07``."""
    return F.concat(F.year(col(day)), F.lit("-M"), F.lpad(F.month(col(day)).cast("string"), 2, "0"))


def week_label(day: ColumnOrName) -> Column:
    """ISO year and week such as ``2024-W31``; the year is the week's own year."""
    c = F.date_trunc("week", col(day))
    return F.concat(
        F.year(F.date_add(c, 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(day)).cast("string"), 2, "0")
    )


def quarter_label(day: ColumnOrName) -> Column:
    return F.concat(F.year(col(day)).cast("string"), F.lit(" Q"), F.quarter(col(day)).cast("string"))


def week_index(day: ColumnOrName, start) -> Column:
    """Weeks since ``start``, the first being 1."""
    origin = start if isinstance(start, Column) else F.lit(start).cast("date")
    return (F.floor(F.datediff(col(day), origin) / 7) + 1).cast("int")


def month_number(day: ColumnOrName) -> Column:
    """Months on a continuous scale, for differences between months."""
    return F.year(col(day)) * 12 + F.month(col(day))


def day_name(day: ColumnOrName) -> Column:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    return F.element_at(names, F.dayofweek(col(day)))


def month_part(day: ColumnOrName, edges: Sequence[int] = (0, 10, 20, 31), labels: Sequence | None = None) -> Column:
    """Part of the month by day number: thirds by default, ``(0, 7, 14, 21, 28, 31)`` for W1..W5."""
    labels = labels or [f"P{i}" for i in range(1, len(edges))]
    return bucketize(F.dayofmonth(col(day)), edges, labels)


def label_windows(day: ColumnOrName, windows: Sequence[tuple[str, str, str]], default: str | None = None) -> Column:
    """First (label, start, end) window holding the day, both ends included."""
    c = col(day)
    out = None
    for label, start, end in windows:
        inside = c.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))


def in_period(day: ColumnOrName, start, end) -> Column:
    """Both ends included; literals, so the predicate reaches the scan."""
    return col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def compact_date(value: ColumnOrName) -> Column:
    """``yyyyMMdd`` text or integer to date."""
    return F.to_date(col(value).cast("string"), "yyyyMMdd")
