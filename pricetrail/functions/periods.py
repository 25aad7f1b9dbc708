"""Promotion periods read from Romanian text, and where a moment lies in one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetrail.functions.binding import let
from pricetrail.functions.text import strip_accents

# Romanian month names, January to December.
MONTHS = (
    "ianuarie", "februarie", "martie", "aprilie", "mai", "iunie",
    "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie",
)
# Fixed value: the last instant of a period's closing day.
DAY_END = "23:59:59.999"


def _try_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")


def _dates(text: Column, pattern: str, month) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(s: Column) -> Column:
        day, mon, year = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3))
        return F.concat_ws("-", year, month(mon), day)

    return F.transform(found, one)


def promotion_period(text: Column, zone: str) -> Column:
    """struct(start_date, end_date, starts_at, ends_at, error): exactly two ordered days.

    Days are whole days of the shop's zone; the bounds are returned in UTC.
    """
    number = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(str(i)))])

    def days_in(plain: Column) -> Column:
        spelled = _dates(plain, r"\b(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})\b", lambda m: number[m])
        short = _dates(plain, r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b", lambda m: m)
        found = let(spelled, lambda long: F.when(F.size(long) > 0, long).otherwise(short))
        return F.transform(found, _try_date)

    def at(day: Column, clock: str) -> Column:
        local = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" " + clock)))
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)

    def described(days: Column) -> Column:
        first, last = F.get(days, F.lit(0)), F.get(days, F.lit(1))
        good = F.coalesce((F.size(days) == 2) & (first <= last), F.lit(False))
        return F.struct(
            F.when(good, first).alias("start_date"),
            F.when(good, last).alias("end_date"),
            F.when(good, at(first, "00:00:00")).alias("starts_at"),
            F.when(good, at(last, DAY_END)).alias("ends_at"),
            F.when(~good, "period_not_two_ordered_days").alias("error"),
        )

    return let(let(strip_accents(text), days_in), described)


def campaign_status(start: Column, end: Column, at: Column) -> Column:
    return F.when(at < start, "upcoming").when(at > end, "expired").otherwise("active")


def remaining(end: Column, at: Column) -> Column:
    """Whole seconds left, never negative, and split for a countdown."""
    micros = F.greatest(F.unix_micros(end.cast("timestamp")) - F.unix_micros(at.cast("timestamp")), F.lit(0))
    seconds = F.floor(micros / 1_000_000).cast("long")
    return F.struct(
        seconds.alias("seconds"),
        F.floor(seconds / 86400).cast("long").alias("days"),
        F.floor(seconds % 86400 / 3600).cast("long").alias("hours"),
        F.floor(seconds % 3600 / 60).cast("long").alias("minutes"),
        (seconds % 60).alias("rest"),
    )
