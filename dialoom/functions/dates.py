"""Date and time functions with the semantics of the source dialect.

Where a function reads the clock it takes ``as_of`` instead, so that a rerun gives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.base import as_col

# Unit spellings.
UNITS = {
    "year": "YEAR", "yy": "YEAR", "yyyy": "YEAR",
    "quarter": "QUARTER", "qq": "QUARTER", "q": "QUARTER",
    "month": "MONTH", "mm": "MONTH", "m": "MONTH",
    "week": "WEEK", "wk": "WEEK", "ww": "WEEK",
    "day": "DAY", "dd": "DAY", "d": "DAY",
    "hour": "HOUR", "hh": "HOUR",
    "minute": "MINUTE", "mi": "MINUTE", "n": "MINUTE",
    "second": "SECOND", "ss": "SECOND", "s": "SECOND",
}
MONTHS_PER = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}
SECONDS_PER = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}

# Format tokens of TO_CHAR, FORMAT and the percent style, and their Spark patterns.
TO_CHAR_TOKENS = {
    "YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd",
    "DAY": "EEEE", "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss",
    "FF3": "SSS", "FF6": "SSSSSS", "AM": "a", "PM": "a", "Q": "Q",
}
FORMAT_TOKENS = {
    "yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE",
    "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m",
    "ss": "ss", "s": "s", "fff": "SSS", "tt": "a",
}
PERCENT_TOKENS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%h": "hh", "%I": "hh",
    "%i": "mm", "%s": "ss", "%S": "ss", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%p": "a",
    "%f": "SSSSSS", "%j": "DDD", "%T": "HH:mm:ss", "%%": "%",
}
TSQL_STYLES = {112: "yyyyMMdd", 120: "yyyy-MM-dd HH:mm:ss", 101: "MM/dd/yyyy", 103: "dd/MM/yyyy", 23: "yyyy-MM-dd"}


def unit_name(unit: str) -> str:
    try:
        return UNITS[unit.lower()]
    except KeyError:
        raise ValueError(f"unknown date unit: {unit}") from None


def spark_pattern(pattern: str, dialect: str = "oracle") -> str:
    """Translate a format pattern; letters that are no token are quoted."""
    if dialect in ("tsql", "mssql", "synapse"):
        tokens, flags = FORMAT_TOKENS, 0
    elif dialect == "mysql":
        tokens, flags = PERCENT_TOKENS, 0
    else:
        tokens, flags = TO_CHAR_TOKENS, re.IGNORECASE
    longest_first = sorted(tokens, key=len, reverse=True)
    pieces = re.split("(" + "|".join(map(re.escape, longest_first)) + ")", pattern, flags=flags)
    out = []
    for i, piece in enumerate(pieces):
        if i % 2:
            out.append(tokens[piece.upper() if flags else piece])
        else:
            out.append(re.sub(r"[A-Za-z']+", lambda m: "'" + m.group(0).replace("'", "''") + "'", piece))
    return "".join(out)


def dateadd(unit: str, n: Column | int, date: Column | str) -> Column:
    """DATEADD / TIMESTAMPADD / DATE_ADD(... INTERVAL): month steps keep the day or clamp to month end."""
    unit, date = unit_name(unit), as_col(date)
    n = n if isinstance(n, Column) else F.lit(n)
    if unit in MONTHS_PER:
        step = F.make_interval(months=n * F.lit(MONTHS_PER[unit]))
    elif unit == "WEEK":
        step = F.make_interval(weeks=n)
    elif unit == "DAY":
        step = F.make_interval(days=n)
    elif unit == "HOUR":
        step = F.make_interval(hours=n)
    elif unit == "MINUTE":
        step = F.make_interval(mins=n)
    else:
        step = F.make_interval(secs=n)
    return date + step


def add_months(date: Column | str, n: Column | int, stick_to_month_end: bool = False) -> Column:
    """ADD_MONTHS. With ``stick_to_month_end`` the last day of a month stays a last day (Oracle, Teradata)."""
    date = as_col(date)
    moved = F.add_months(date, n)
    if not stick_to_month_end:
        return moved
    return F.when(F.to_date(date) == F.last_day(date), F.last_day(moved)).otherwise(moved)


def datediff(unit: str, start: Column | str, end: Column | str, week_start: str = "sunday") -> Column:
    """Number of unit boundaries crossed from ``start`` to ``end`` (T-SQL, Redshift, Snowflake)."""
    unit, start, end = unit_name(unit), as_col(start), as_col(end)
    if unit == "DAY":
        return F.datediff(end, start).cast("long")
    if unit == "WEEK":
        # Whole weeks since a fixed week start: 1970-01-04 was a Sunday, 1970-01-05 a Monday.
        shift = 4 if week_start == "sunday" else 3

        def week(day: Column) -> Column:
            return F.floor((F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(shift)) / F.lit(7))

        return (week(end) - week(start)).cast("long")
    if unit in MONTHS_PER:
        per = MONTHS_PER[unit]

        def index(day: Column) -> Column:
            return F.floor((F.year(day) * F.lit(12) + F.month(day) - F.lit(1)) / F.lit(per))

        return (index(end) - index(start)).cast("long")
    seconds = SECONDS_PER[unit]

    def ticks(ts: Column) -> Column:
        # On the clock's face, so that a change to summer time is no boundary.
        days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
        of_day = F.hour(ts) * F.lit(3600) + F.minute(ts) * F.lit(60) + F.second(ts)
        return F.floor((days * F.lit(86400) + of_day) / F.lit(seconds))

    return (ticks(end) - ticks(start)).cast("long")


def datediff_mysql(later: Column | str, earlier: Column | str) -> Column:
    """MySQL DATEDIFF(a, b): days from b to a."""
    return F.datediff(as_col(later), as_col(earlier))


def datepart(part: str, date: Column | str, dialect: str = "tsql") -> Column:
    """DATEPART / DAYOFWEEK / WEEK / MONTH / YEAR. MySQL WEEK counts from the year's first Sunday (0..53)."""
    date, part = as_col(date), part.lower()
    if part in ("weekday", "dw", "dayofweek"):
        return F.dayofweek(date)
    if part == "week" and dialect == "mysql":
        return F.floor((F.dayofyear(date) + F.lit(7) - F.dayofweek(date)) / F.lit(7)).cast("int")
    plain = {
        "week": F.weekofyear, "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
        "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second,
    }
    return plain[part](date)


def to_char(date: Column | str, pattern: str, dialect: str = "oracle") -> Column:
    """TO_CHAR(d, fmt) and FORMAT(d, fmt)."""
    return F.date_format(as_col(date), spark_pattern(pattern, dialect))


def convert_style(date: Column | str, style: int) -> Column:
    """CONVERT(varchar, d, style)."""
    return F.date_format(as_col(date), TSQL_STYLES[style])


def str_to_date(text: Column | str, pattern: str) -> Column:
    """STR_TO_DATE(s, '%Y-%m-%d'): NULL when the text does not fit."""
    return F.try_to_timestamp(as_col(text), F.lit(spark_pattern(pattern, "mysql")))


def trunc(date: Column | str, unit: str = "DD") -> Column:
    """TRUNC(d, 'DD') and its other units."""
    units = {"DD": "DAY", "DDD": "DAY", "MM": "MONTH", "MONTH": "MONTH", "Q": "QUARTER", "YYYY": "YEAR", "YY": "YEAR",
             "YEAR": "YEAR", "IW": "WEEK", "HH24": "HOUR", "HH": "HOUR", "MI": "MINUTE"}
    return F.date_trunc(units[unit.upper()], as_col(date))


def now(as_of: str | None = None) -> Column:
    """GETDATE / SYSDATE / SYSDATETIME / SYSTIMESTAMP / NOW, with the time of day."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def today(as_of: str | None = None) -> Column:
    """CURDATE / CURRENT_DATE."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def datetime_from_parts(year, month, day, hour=0, minute=0, second=0) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (year, month, day, hour, minute, second)]
    return F.make_timestamp_ntz(*parts)


def time_from_parts(hour, minute, second) -> Column:
    """TIMEFROMPARTS as text ``HH:mm:ss``; a time-of-day type is not in use."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (hour, minute, second)]
    return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])


def convert_tz(ts: Column | str, from_zone: str, to_zone: str) -> Column:
    """CONVERT_TZ / CONVERT_TIMEZONE on timestamps without a zone."""
    return F.convert_timezone(F.lit(from_zone), F.lit(to_zone), as_col(ts))


def from_unixtime(seconds: Column | str, pattern: str = "%Y-%m-%d %H:%i:%s") -> Column:
    return F.from_unixtime(as_col(seconds), spark_pattern(pattern, "mysql"))


def zone_text(epoch_ms: Column | str, zone: str = "Asia/Kolkata") -> Column:
    """Epoch milliseconds as local text such as ``Jan 05, 2024, 03:07 PM``."""
    seconds = (as_col(epoch_ms) / F.lit(1000)).cast("decimal(18,6)")
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=seconds)
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "MMM dd, yyyy, hh:mm a")


def minus_days(date: Column | str, n: Column | int) -> Column:
    return F.date_sub(as_col(date), n)


def add_interval(date: Column | str, n: int, unit: str) -> Column:
    """``d + INTERVAL 'n' WEEK|QUARTER|...`` on dates: a week is 7 days, a quarter 3 months."""
    unit, date = unit_name(unit), as_col(date)
    if unit in MONTHS_PER:
        return F.add_months(date, n * MONTHS_PER[unit])
    return F.date_add(date, n * (7 if unit == "WEEK" else 1))


def to_timestamp(text: Column | str, kind: str = "ntz", pattern: str | None = None) -> Column:
    """TO_TIMESTAMP_NTZ / _LTZ / _TZ; zoned kinds are instants shown in the session zone."""
    text = as_col(text)
    fmt = None if pattern is None else F.lit(spark_pattern(pattern, "snowflake"))
    if kind == "ntz":
        return F.to_timestamp_ntz(text) if fmt is None else F.to_timestamp_ntz(text, fmt)
    return F.to_timestamp_ltz(text) if fmt is None else F.to_timestamp_ltz(text, fmt)


def period(date: Column | str) -> Column:
    """``yyyymm`` text of a date."""
    return F.date_format(as_col(date), "yyyyMM")


def roll_period(yyyymm: Column | str, months: int) -> Column:
    """Move a ``yyyymm`` text by months, carrying the year."""
    first = F.to_date(F.concat(as_col(yyyymm), F.lit("01")), "yyyyMMdd")
    return F.date_format(F.add_months(first, months), "yyyyMM")


def in_periods(yyyymm: Column | str, fixed: list[str], months_back: int, as_of: str) -> Column:
    """Period is one of ``fixed`` or not older than ``as_of`` minus ``months_back`` months.

    ``as_of`` is a literal, so the bound folds to a constant and reaches the scan.
    """
    yyyymm = as_col(yyyymm)
    bound = F.date_format(F.add_months(F.lit(as_of).cast("date"), -months_back), "yyyyMM")
    return yyyymm.isin(fixed) | (yyyymm >= bound)


def duration_seconds(start_ms: Column | str, end_ms: Column | str) -> Column:
    """Seconds between two epoch-millisecond marks, one decimal."""
    return F.round((as_col(end_ms) - as_col(start_ms)) / F.lit(1000.0), 1)
