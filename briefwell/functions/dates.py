"""Date columns: parsing, relative hints, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FRESHNESS

# Hours of each unit of a relative time hint.
UNIT_HOURS = {
    "phút": 1 / 60, "phut": 1 / 60, "minutes": 1 / 60, "minute": 1 / 60, "mins": 1 / 60, "min": 1 / 60, "giờ": 1, "gio": 1, "hours": 1, "hour": 1, "hrs": 1, "hr": 1, "ngày": 24, "ngay": 24, "days": 24, "day": 24,
    "tuần": 168, "tuan": 168, "weeks": 168, "week": 168, "tháng": 720, "thang": 720, "months": 720, "month": 720, "năm": 8760, "nam": 8760, "years": 8760, "year": 8760,
}
# Forms of dates beside ISO ones, without and with a zone.
FORMATS = ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
# Names of zones in mail dates, and their offsets.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_timestamp(text: Column) -> Column:
    """ISO dates and times with or without fractions and offsets, mail dates, and a few more forms; in UTC; null if none fits.

    A time without a zone is taken as UTC.
    """
    t = F.trim(text)
    iso = "^(\\d{4}-\\d{2}-\\d{2})(?:[T ](\\d{2}:\\d{2})(:\\d{2})?(?:[.,](\\d{1,6})\\d*)?)?\\s?(Z|z|[+-]\\d{2}:?\\d{2})?$"
    part = lambda k: F.regexp_extract(t, iso, k)
    clock = F.concat(part(1), F.lit(" "), F.when(part(2) == "", "00:00").otherwise(part(2)), F.when(part(3) == "", ":00").otherwise(part(3)))
    local = F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss"))
    micros = F.rpad(part(4), 6, "0").try_cast("long")
    sign = F.when(part(5).startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(part(5), "[^0-9]", "")
    offset = F.coalesce(sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60), F.lit(0))
    from_iso = F.when(part(1) != "", F.timestamp_micros(F.unix_micros(local) + F.coalesce(micros, F.lit(0)) - offset.cast("long") * 1_000_000))
    mail = F.regexp_replace(t, "^[A-Za-z]{3,9},\\s*", "")
    zone = F.regexp_extract(mail, "\\s([A-Za-z]{1,3}|[+-]\\d{4})$", 1)
    named = reduce(lambda acc, kv: acc.when(F.upper(zone) == kv[0], kv[1]), list(ZONES.items())[1:], F.when(F.upper(zone) == "GMT", ZONES["GMT"])).otherwise(zone)
    shift = F.coalesce(F.when(named.startswith("-"), -1).otherwise(1) * (F.substring(named, 2, 2).try_cast("int") * 3600 + F.substring(named, 4, 2).try_cast("int") * 60), F.lit(0))
    bare = F.when(zone != "", F.regexp_replace(mail, "\\s([A-Za-z]{1,3}|[+-]\\d{4})$", "")).otherwise(mail)
    other = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])
    return F.coalesce(from_iso, F.timestamp_micros(F.unix_micros(other) - shift.cast("long") * 1_000_000))


def hint_hours(text: Column) -> Column:
    """Age in hours of a hint that begins like ``3 days``; 24 for yesterday, 0 for just now; null without one."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pattern = "(?U)^([0-9]+)\\s*(" + "|".join(UNIT_HOURS) + ")\\b"
    n, unit = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    first, *rest = UNIT_HOURS.items()
    hours = reduce(lambda acc, kv: acc.when(unit == kv[0], F.lit(float(kv[1]))), rest, F.when(unit == first[0], F.lit(float(first[1]))))
    return F.when(low.isin("yesterday", "hôm qua", "hom qua"), F.lit(24.0)).when(low.isin("just now", "vừa xong"), F.lit(0.0)).when(n != "", n.cast("double") * hours)


def freshness_bucket(age_hours: Column) -> Column:
    """breaking, fresh, recent, aging or stale by age; dates ahead of now are breaking, null is unknown."""
    ladder = reduce(lambda acc, x: acc.when(age_hours <= x[1], x[0]), FRESHNESS, F.when(age_hours.isNull(), "unknown"))
    return ladder.otherwise("stale")
