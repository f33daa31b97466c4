"""Dates as statements and registers write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a date looks like once its separators are dashes, and the pattern that reads it. No text fits two of them.
SHAPES = {
    r"\d{1,2}-\d{1,2}-\d{4}": "d-M-yyyy",
    r"\d{1,2}-\d{1,2}-\d{2}": "d-M-yy",
    r"\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d",
    r"\d{1,2}-[A-Za-z]{3}-\d{4}": "d-MMM-yyyy",
    r"\d{1,2}-[A-Za-z]{3}-\d{2}": "d-MMM-yy",
    r"\d{1,2}-[A-Za-z]{4,}-\d{4}": "d-MMMM-yyyy",
    r"\d{1,2}-[A-Za-z]{4,}-\d{2}": "d-MMMM-yy",
    r"[A-Za-z]{3}-\d{1,2}-\d{4}": "MMM-d-yyyy",
    r"[A-Za-z]{4,}-\d{1,2}-\d{4}": "MMMM-d-yyyy",
    r"\d{8}": "yyyyMMdd",
}


def any_date(c: Column) -> Column:
    """A date in any of SHAPES, after a time of day is dropped and / . and spaces become dashes; else null. One pattern is tried.

    The text is bound once, by the one-element array around it.
    """
    text = F.trim(F.regexp_replace(c, r"[ T]\d{1,2}:\d{2}(:\d{2})?.*$", ""))
    text = F.regexp_replace(text, r"[/.,\s-]+", "-")

    def read(t: Column) -> Column:
        found = F
        for shape, pattern in SHAPES.items():
            found = found.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(pattern)).cast("date"))
        return found

    return F.get(F.transform(F.array(text), read), 0)


def day_month_year(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "/", "-"), F.lit("d-M-yyyy")).cast("date")


def day_of_month(reference: Column, day: Column) -> Column:
    """The reference's month with that day; the reference itself where the month has no such day."""
    made = F.try_to_timestamp(F.concat_ws("-", F.year(reference), F.month(reference), day), F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(made, reference)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
