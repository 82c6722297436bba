"""Weekly snapshot ids (YYWW of the ISO week) and the dates behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snapshot_of(when: Column, days: int = 0) -> Column:
    """Snapshot of a date or timestamp, optionally moved by some days first."""
    d = F.date_add(when.cast("date"), days) if days else when.cast("date")
    year = F.extract(F.lit("YEAROFWEEK"), d)
    return (year % 100 * 100 + F.weekofyear(d)).cast("int")


def current_snapshot() -> Column:
    return snapshot_of(F.current_date())


def _number(snapshot: Column) -> tuple[Column, Column]:
    sn = snapshot.cast("int")
    return F.floor(sn / 100).cast("int") + 2000, sn % 100


def monday_of(snapshot: Column) -> Column:
    """First day of the week: 4 January always lies in ISO week 1."""
    year, week = _number(snapshot)
    first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.date_add(first, ((week - 1) * 7).cast("int"))


def sunday_of(snapshot: Column) -> Column:
    return F.date_add(monday_of(snapshot), 6)


def thursday_of(snapshot: Column) -> Column:
    return F.date_add(monday_of(snapshot), 3)


def next_snapshot(snapshot: Column) -> Column:
    return snapshot_of(monday_of(snapshot), 7)


def previous_snapshot(snapshot: Column) -> Column:
    return snapshot_of(monday_of(snapshot), -7)


def snapshots_between(start: Column, end: Column) -> Column:
    """Array of snapshots from start in steps of a week, end not included."""
    a, b = start.cast("date"), F.date_sub(end.cast("date"), 1)
    weeks = F.sequence(a, b, F.expr("interval 7 days"))
    return F.when(a <= b, F.transform(weeks, lambda d: snapshot_of(d))).otherwise(
        F.array().cast("array<int>")
    )


def last_snapshots(snapshot: Column, n: int) -> Column:
    """Array of the n snapshots before this one, newest first."""
    monday = monday_of(snapshot)
    steps = F.sequence(F.lit(1), F.lit(n))
    return F.transform(steps, lambda i: snapshot_of(F.date_sub(monday, (i * 7).cast("int"))))


def week_label(snapshot: Column) -> Column:
    year, week = _number(snapshot)
    return F.concat(F.lit("W"), week.cast("string"), F.lit("-'"), F.lpad((year % 100).cast("string"), 2, "0"))


def week_span(snapshot: Column) -> Column:
    first, last = monday_of(snapshot), sunday_of(snapshot)
    return F.concat_ws(
        " - ", F.date_format(first, "MMM d"), F.date_format(last, "MMM d, yyyy")
    )
