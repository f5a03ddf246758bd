"""Dates and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the ladder, tried in this order.
LADDER = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "d MMMM yyyy", "MMMM yyyy", "yyyy")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def ladder(c: Column, formats: tuple[str, ...] = LADDER) -> Column:
    """The first format that fits; missing parts are the first of the month or year; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def years(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)))


def months(c: Column) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.contains(m), m) for m in MONTHS]))


def compatible(a: Column, b: Column) -> Column:
    """Share a year and, if both name months, a month."""
    both = (F.size(months(a)) > 0) & (F.size(months(b)) > 0)
    return F.arrays_overlap(years(a), years(b)) & (~both | F.arrays_overlap(months(a), months(b)))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9
