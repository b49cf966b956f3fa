"""Dates: German dates in texts and addresses, ranges with the year left out, and an offer's status at a moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOON = "interval 12 hours"
# Date ranges as leaflets print them.
FULL_RANGE = r"(\d{2})\.(\d{2})\.(\d{4})\s*-\s*(\d{2})\.(\d{2})\.(\d{4})"
SHORT_RANGE = r"(\d{2})\.(\d{2})\.\s*-\s*(\d{2})\.(\d{2})\."


def date_in_text(c: Column) -> Column:
    """The first dd.mm.yyyy, at noon UTC; impossible dates are null."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("")), F.lit("dd.MM.yyyy")) + F.expr(NOON)


def all_dates(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(\d{2}\.\d{2}\.\d{4})"), 1)
    return F.array_compact(F.transform(found, lambda d: F.try_to_timestamp(d, F.lit("dd.MM.yyyy")) + F.expr(NOON)))


def earliest_date(c: Column) -> Column:
    return F.array_min(all_dates(c))


def latest_date(c: Column) -> Column:
    return F.array_max(all_dates(c))


def date_in_url(c: Column) -> Column:
    """/d.dd-mm-yyyy.html"""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"/d\.(\d{2}-\d{2}-\d{4})\.html", 1), F.lit("")), F.lit("dd-MM-yyyy")) + F.expr(NOON)


def leaflet_dates(c: Column) -> tuple[Column, Column]:
    """-dd-mm-yyyy-dd-mm-yyyy/, at noon UTC"""
    part = lambda k: F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"-(\d{2}-\d{2}-\d{4})-(\d{2}-\d{2}-\d{4})/", k), F.lit("")), F.lit("dd-MM-yyyy")) + F.expr(NOON)
    return part(1), part(2)


def iso_prefix(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))


def date_range(c: Column, as_of: Column) -> tuple[Column, Column]:
    """dd.mm.yyyy - dd.mm.yyyy, or dd.mm. - dd.mm. in the year of as_of, ending in the next where the months say so.

    Both at noon UTC. Days and months have two digits; what a month or year has too many of runs on into the next.
    """
    full, short = FULL_RANGE, SHORT_RANGE
    number = lambda pattern, k: F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).try_cast("int")
    stamp = lambda y, m, d: F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(12), F.lit(0), F.lit(0)) + F.make_interval(months=m - 1) + F.make_interval(days=d - 1)
    year = F.year(as_of)
    is_full, is_short = c.rlike(full), c.rlike(short)
    begin = F.when(is_full, stamp(number(full, 3), number(full, 2), number(full, 1))).when(is_short, stamp(year, number(short, 2), number(short, 1)))
    later = F.when(number(short, 4) < number(short, 2), year + 1).otherwise(year)
    end = F.when(is_full, stamp(number(full, 6), number(full, 5), number(full, 4))).when(is_short, stamp(later, number(short, 4), number(short, 3)))
    return begin, end


def status(valid_from: Column, valid_to: Column, snapshot: Column, as_of: Column) -> Column:
    return (
        F.when(F.coalesce(snapshot, F.lit(False)), "active").when(valid_from > as_of, "upcoming").when(valid_to < as_of, "expired")
        .when(valid_from.isNotNull() | valid_to.isNotNull(), "active").otherwise("unknown")
    )


def active_today(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    """Overlap with as_of's day in UTC; a missing bound doesn't bind."""
    day = F.date_trunc("day", as_of)
    return F.coalesce(valid_from < day + F.expr("interval 1 day"), F.lit(True)) & F.coalesce(valid_to >= day, F.lit(True))


def valid_at(valid_from: Column, valid_to: Column, snapshot: Column, as_of: Column) -> Column:
    """Bounds include as_of; a missing bound needs a snapshot."""
    snap = F.coalesce(snapshot, F.lit(False))
    return F.coalesce(valid_from <= as_of, snap) & F.coalesce(valid_to >= as_of, snap)


def iso_millis(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hours_between(c: Column, as_of: Column) -> Column:
    return (F.unix_millis(as_of) - F.unix_millis(c)) / 3.6e6


def add_days(c: Column, n: int) -> Column:
    """n days of 24 hours later."""
    return c + F.make_dt_interval(F.lit(n))


def in_window(start: Column, end: Column, now: Column) -> Column:
    """Neither over nor yet to come; an open end doesn't exclude."""
    return F.coalesce(end >= now, F.lit(True)) & F.coalesce(start <= now, F.lit(True))


def last_seen(*times: Column) -> Column:
    """The first of updated, created, valid to and valid from that is given."""
    return F.coalesce(*times)
