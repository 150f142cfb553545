"""Dates as integers YYYYMMDD (0 for none), times as HHMM, date-times as YYYYMMDDHHMM; all functions are column expressions.

Results follow the calendar: formats, month ends and differences are those of real dates, without daylight-saving artefacts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 0000-12-31 to 1970-01-01: the day number of 1970-01-01 less 1 (a fixed value of the calendar).
EPOCH_DAY = 719_163


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def to_date(number) -> Column:
    """The date of YYYYMMDD; null for 0 and for what is no date."""
    return F.try_to_date(F.lpad(_c(number).cast("string"), 8, "0"), "yyyyMMdd")


def to_int(day) -> Column:
    """YYYYMMDD of a date or timestamp, null as 0."""
    d = _c(day)
    return F.coalesce(F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d), F.lit(0)).cast("int")


def compose(y, m, d) -> Column:
    """Year, month and day as a number, unchecked; month 0 gives 0; two-digit years fall within ten years from now or before."""
    year = _c(y)
    full = F.when(year >= 100, year).when(year + 2000 > F.year(F.current_date()) + 10, year + 1900).otherwise(year + 2000)
    return F.when(_c(m) == 0, F.lit(0)).otherwise(full * 10000 + _c(m) * 100 + _c(d)).cast("int")


def from_number(value) -> Column:
    """YYYYMMDD of a long that is a date-time, a date, epoch seconds or epoch milliseconds, tried in this order."""
    v = _c(value).cast("long")
    stamp = F.try_to_timestamp(v.cast("string"), F.lit("yyyyMMddHHmm"))
    day = F.try_to_date(v.cast("string"), "yyyyMMdd")
    epoch = F.when(F.abs(v) < 1_000_000_000_000, F.timestamp_seconds(v)).otherwise(F.timestamp_millis(v))
    return F.when(v.between(100_001_010_000, 999_912_312_359) & stamp.isNotNull(), to_int(stamp)).when(v.between(10_000_101, 99_991_231) & day.isNotNull(), to_int(day)).otherwise(to_int(epoch))


def today(zone: str | None = None) -> Column:
    now = F.current_timestamp()
    return to_int(F.convert_timezone(F.current_timezone(), F.lit(zone), now.cast("timestamp_ntz")) if zone else now)


def year(number) -> Column:
    return F.floor(_c(number) / 10000).cast("int")


def month(number) -> Column:
    return (F.floor(_c(number) / 100) % 100).cast("int")


def day(number) -> Column:
    return (_c(number) % 100).cast("int")


def add_days(number, n) -> Column:
    return to_int(F.date_add(to_date(number), _c(n)))


def add_months(number, n) -> Column:
    """Days past the month's end become its last."""
    return to_int(F.add_months(to_date(number), _c(n)))


def add_years(number, n) -> Column:
    """Adds to the year alone: 29 February stays, though the year may have none."""
    return F.when(_c(number) == 0, F.lit(0)).otherwise(_c(number) + _c(n) * 10000).cast("int")


def days_between(one, two) -> Column:
    """Days from the second to the first."""
    return F.datediff(to_date(one), to_date(two))


def format_date(number, pattern: str) -> Column:
    return F.coalesce(F.date_format(to_date(number), pattern), F.lit(""))


# Patterns of the usual forms.
SHORT, MEDIUM, ISO, LONG, LONG_WITH_DAY = "M/d/yy", "M/d/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "E, MMM d, yyyy"


def parse_date(text) -> Column:
    """``yyyy-m-d``, ``m/d/yyyy`` or ``m/d/yy`` (dots as slashes) as a number; anything else is 0."""
    t = F.replace(F.trim(_c(text)), F.lit("."), F.lit("/"))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k).cast("int")
    iso, us = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    number = F.when(t.rlike(iso), compose(part(iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(us), compose(part(us, 3), part(us, 1), part(us, 2)))
    return F.when(to_date(number).isNotNull(), number).otherwise(0).cast("int")


def julian(number) -> Column:
    """The number of the day, 0001-01-01 being 1; 0 and less stay."""
    n = _c(number)
    return F.when(n <= 0, n).otherwise(F.unix_date(to_date(n)) + EPOCH_DAY).cast("int")


def calendar(number) -> Column:
    """The date of a day number; 0 for 0 and less."""
    n = _c(number).cast("int")
    return F.when(n <= 0, F.lit(0)).otherwise(to_int(F.date_from_unix_date(n - EPOCH_DAY)))


def day_of_week(number) -> Column:
    """0 for Sunday to 6; -1 for no date."""
    return F.coalesce(F.dayofweek(to_date(number)) - 1, F.lit(-1))


def day_name(number) -> Column:
    return format_date(number, "EEEE")


def month_name(number) -> Column:
    return format_date(number, "MMMM")


# --- times


def now_time(zone: str | None = None) -> Column:
    """The time now as HHMM, in the session's zone or another."""
    return time_of(_now(zone))


def now(zone: str | None = None) -> Column:
    """The date and time now as YYYYMMDDHHMM."""
    return number_of(_now(zone))


def now_text(pattern: str = "MM/dd/yyyy h:mm a", zone: str | None = None) -> Column:
    return F.date_format(_now(zone), pattern)


def _now(zone: str | None) -> Column:
    moment = F.current_timestamp()
    return F.convert_timezone(F.current_timezone(), F.lit(zone), moment.cast("timestamp_ntz")) if zone else moment


def in_zone(number, of: str, to: str) -> Column:
    """A date-time of one zone as that of another."""
    return number_of(F.convert_timezone(F.lit(of), F.lit(to), stamp(number)))


def time_of(stamp) -> Column:
    """HHMM of a timestamp."""
    return (F.hour(_c(stamp)) * 100 + F.minute(_c(stamp))).cast("int")


def hour(time) -> Column:
    return F.floor(_c(time) / 100).cast("int")


def minutes(time) -> Column:
    return (_c(time) % 100).cast("int")


def military(time) -> Column:
    """``HH:MM``."""
    return F.format_string("%02d:%02d", hour(time), minutes(time))


def am_pm(time) -> Column:
    """``h:mm AM`` or ``PM``; noon is 12:00 PM."""
    h = hour(time)
    return F.concat(F.format_string("%d:%02d ", F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12).cast("int"), minutes(time)), F.when(h < 12, "AM").otherwise("PM"))


def parse_time(text) -> Column:
    """``330``, ``3:30``, ``2:30 pm``, ``8a`` ... as HHMM; -1 for anything else.

    One or two leading digits are hours; of three or four, the last two are minutes.  ``p`` adds twelve hours below twelve; without it twelve
    becomes 0 if something follows the minutes.
    """
    t = F.trim(_c(text))
    pattern = r"^(\d{1,2}?)(?:[:.\- ]?(\d{1,2}))?\s?([aApP])?[mM]?\.?$"
    only = r"^\d{1,2}$"
    h = F.when(t.rlike(only), t.cast("int")).otherwise(F.regexp_extract(t, r"^(\d{1,2}?)(?=\d{2}(?:\D|$)|\D)", 1).try_cast("int"))
    rest = F.regexp_extract(t, r"^\d{1,2}?(?=\d{2}(?:\D|$)|\D)[:.\- ]?(\d{0,2})", 1)
    m = F.when(t.rlike(only) | (rest == ""), F.lit(0)).otherwise(rest.try_cast("int"))
    half = F.lower(F.regexp_extract(t, r"([aApP])[mM]?\.?$", 1))
    adjusted = F.when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), F.lit(0)).otherwise(h)
    return F.when(t.rlike(pattern) & h.isNotNull(), adjusted * 100 + m).otherwise(-1).cast("int")


# --- date-times


def stamp(number) -> Column:
    """The timestamp of YYYYMMDDHHMM, without a zone; null for 0 and what is none."""
    n = _c(number).cast("long")
    return F.try_to_timestamp(F.lpad(n.cast("string"), 12, "0"), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def number_of(ts) -> Column:
    """YYYYMMDDHHMM of a timestamp, null as 0."""
    t = _c(ts)
    return F.coalesce(to_int(t).cast("long") * 10000 + time_of(t), F.lit(0)).cast("long")


def create(date, time) -> Column:
    return _c(date).cast("long") * 10000 + _c(time)


def from_epoch(value, zone: str) -> Column:
    """Epoch seconds or milliseconds in a zone; 0 stays 0."""
    v = _c(value).cast("long")
    utc = F.when(F.abs(v) < 100_000_000_000, F.timestamp_seconds(v)).otherwise(F.timestamp_millis(v))
    return F.when(v == 0, F.lit(0)).otherwise(number_of(F.convert_timezone(F.current_timezone(), F.lit(zone), utc.cast("timestamp_ntz")))).cast("long")


def to_epoch(number, zone: str) -> Column:
    """Epoch milliseconds of a date-time in a zone."""
    return F.unix_millis(F.convert_timezone(F.lit(zone), F.current_timezone(), stamp(number)).cast("timestamp"))


def date_part(number) -> Column:
    return F.floor(_c(number) / 10000).cast("int")


def time_part(number) -> Column:
    return (_c(number) % 10000).cast("int")


def plus(number, years=0, months=0, days=0, hours=0, mins=0) -> Column:
    """A date-time moved by calendar years and months (to the month's end at most), days, hours and minutes."""
    moved = stamp(number) + F.make_ym_interval(_c(years), _c(months)) + F.make_dt_interval(_c(days), _c(hours), _c(mins), F.lit(0))
    return number_of(moved)


def minutes_between(one, two, zone: str) -> Column:
    """Minutes from the second to the first, as time passed in the zone."""
    return F.floor((to_epoch(one, zone) - to_epoch(two, zone)) / 60000).cast("long")


def format_stamp(number, pattern: str = "MM/dd/yyyy h:mm a") -> Column:
    return F.when(_c(number) <= 0, "").otherwise(F.coalesce(F.date_format(stamp(number), pattern), F.lit("")))
