"""Date and time queries: dialect functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import dates as dt
from dialoom.plans.registry import query, table

DAY = "%Y-%m-%d"
SECOND = "%Y-%m-%d %H:%M:%S"


def day(col):
    return F.date_format(col, "yyyy-MM-dd")


def second(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query(
    "DT-1",
    f"""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 MONTH, '{DAY}') AS months,
      strftime(o_orderdate + INTERVAL 2 QUARTER, '{DAY}') AS quarters,
      strftime(o_orderdate + INTERVAL 1 YEAR, '{DAY}') AS years,
      strftime(o_orderdate + to_weeks(cast(o_orderkey % 5 AS integer)), '{DAY}') AS weeks,
      strftime(o_orderdate - INTERVAL 40 DAY, '{DAY}') AS days,
      strftime(o_orderdate + INTERVAL 30 HOUR, '{SECOND}') AS hours,
      strftime(o_orderdate + INTERVAL 90 MINUTE, '{SECOND}') AS minutes,
      strftime(o_orderdate - INTERVAL 1 SECOND, '{SECOND}') AS seconds FROM orders""",
)
def date_add_units(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        day(dt.dateadd("month", -3, d)).alias("months"),
        day(dt.dateadd("quarter", 2, d)).alias("quarters"),
        day(dt.dateadd("yy", 1, d)).alias("years"),
        day(dt.dateadd("week", F.expr("cast(o_orderkey % 5 AS int)"), d)).alias("weeks"),
        day(dt.dateadd("dd", -40, d)).alias("days"),
        second(dt.dateadd("hour", 30, d)).alias("hours"),
        second(dt.dateadd("mi", 90, d)).alias("minutes"),
        second(dt.dateadd("second", -1, d)).alias("seconds"),
    )


@query(
    "DT-2",
    f"""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 MONTH, '{DAY}') AS plain,
      strftime(CASE WHEN cast(o_orderdate AS date) = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH)
        ELSE cast(o_orderdate + INTERVAL 1 MONTH AS date) END, '{DAY}') AS sticky FROM orders""",
)
def add_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        day(dt.add_months("o_orderdate", -3)).alias("plain"),
        day(dt.add_months("o_orderdate", 1, stick_to_month_end=True)).alias("sticky"),
    )


@query(
    "DT-3 DT-5",
    """SELECT o_orderkey, datediff('day', o_orderdate, TIMESTAMP '1999-06-15 10:00:00') AS days,
      datediff('month', o_orderdate, TIMESTAMP '1999-06-15 10:00:00') AS months,
      datediff('quarter', o_orderdate, TIMESTAMP '1999-06-15 10:00:00') AS quarters,
      datediff('year', o_orderdate, TIMESTAMP '1999-06-15 10:00:00') AS years,
      datediff('hour', o_orderdate, TIMESTAMP '1999-06-15 10:00:00') AS hours,
      datediff('day', DATE '1995-01-01' - (dayofweek(DATE '1995-01-01')) * INTERVAL 1 DAY,
        cast(o_orderdate AS date) - dayofweek(o_orderdate) * INTERVAL 1 DAY) // 7 AS sundays,
      datediff('day', date_trunc('week', DATE '1995-01-01'), date_trunc('week', o_orderdate)) // 7 AS mondays FROM orders""",
)
def datediff_boundaries(spark, sf_dir):
    d, end = F.col("o_orderdate"), F.lit("1999-06-15 10:00:00").cast("timestamp_ntz")
    base = F.lit("1995-01-01").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dt.datediff("day", d, end).alias("days"),
        dt.datediff("month", d, end).alias("months"),
        dt.datediff("quarter", d, end).alias("quarters"),
        dt.datediff("year", d, end).alias("years"),
        dt.datediff("hour", d, end).alias("hours"),
        dt.datediff("week", base, d).alias("sundays"),
        dt.datediff("week", base, d, week_start="monday").alias("mondays"),
    )


@query(
    "DT-5 DT-3",
    """SELECT event_id, datediff('minute', ts, TIMESTAMP '2024-02-01 00:00:30') AS minutes,
      datediff('second', ts, TIMESTAMP '2024-02-01 00:00:30') AS seconds FROM events""",
)
def timediff_events(spark, sf_dir):
    end = F.lit("2024-02-01 00:00:30").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        dt.datediff("minute", "ts", end).alias("minutes"),
        dt.datediff("second", "ts", end).alias("seconds"),
    )


@query(
    "DT-4",
    "SELECT o_orderkey, cast(datediff('day', DATE '1998-02-03', cast(o_orderdate AS date)) AS int) AS days FROM orders",
)
def datediff_mysql(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dt.datediff_mysql("o_orderdate", F.lit("1998-02-03").cast("date")).alias("days")
    )


@query(
    "DT-6",
    """SELECT o_orderkey, cast(dayofweek(o_orderdate) + 1 AS int) AS weekday, cast(month(o_orderdate) AS int) AS month_no,
      cast(year(o_orderdate) AS int) AS year_no, cast(strftime(o_orderdate, '%U') AS int) AS mysql_week,
      cast(weekofyear(o_orderdate) AS int) AS iso_week FROM orders""",
)
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dt.datepart("weekday", d).alias("weekday"),
        dt.datepart("month", d).alias("month_no"),
        dt.datepart("year", d).alias("year_no"),
        dt.datepart("week", d, "mysql").alias("mysql_week"),
        dt.datepart("week", d).alias("iso_week"),
    )


@query(
    "DT-7",
    """SELECT event_id, strftime(ts, '%Y/%m/%d at %H:%M:%S') AS oracle_text, strftime(ts, '%d.%m.%y %I:%M %p') AS tsql_text,
      strftime(ts, '%d-%b-%Y') AS mon_text, strftime(ts, '%Y%m%d') AS style_112,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS style_120 FROM events""",
)
def format_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        dt.to_char("ts", "YYYY/MM/DD \"at\" HH24:MI:SS".replace('"', ""), "oracle").alias("oracle_text"),
        dt.to_char("ts", "dd.MM.yy hh:mm tt", "tsql").alias("tsql_text"),
        dt.to_char("ts", "DD-MON-YYYY", "snowflake").alias("mon_text"),
        dt.convert_style("ts", 112).alias("style_112"),
        dt.convert_style("ts", 120).alias("style_120"),
    )


@query(
    "DT-8",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE strftime(o_orderdate, '{DAY}') END AS parsed
    FROM orders""",
)
def str_to_date(spark, sf_dir):
    text = F.when(F.expr("o_orderkey % 10 = 0"), "soon").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.coalesce(day(dt.str_to_date("t", "%d.%m.%Y")), F.lit("none")).alias("parsed"))


@query(
    "DT-9",
    f"""SELECT event_id, strftime(date_trunc('day', ts), '{SECOND}') AS to_day,
      strftime(date_trunc('month', ts), '{SECOND}') AS to_month, strftime(date_trunc('hour', ts), '{SECOND}') AS to_hour,
      strftime(date_trunc('week', ts), '{SECOND}') AS to_week FROM events""",
)
def truncate_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        second(dt.trunc("ts")).alias("to_day"),
        second(dt.trunc("ts", "MM")).alias("to_month"),
        second(dt.trunc("ts", "HH24")).alias("to_hour"),
        second(dt.trunc("ts", "IW")).alias("to_week"),
    )


@query(
    "DT-10",
    """SELECT count(*) AS recent FROM events WHERE ts > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAY
      AND cast(ts AS date) < DATE '2024-01-31'""",
)
def rows_before_now(spark, sf_dir):
    """A filter against the clock, fixed at a given instant."""
    as_of = "2024-01-31 12:00:00"
    ts = F.col("ts").cast("timestamp")
    since = dt.dateadd("day", -7, dt.now(as_of))
    kept = table(spark, sf_dir, "events").filter((ts > since) & (F.to_date("ts") < dt.today(as_of[:10])))
    return kept.agg(F.count(F.lit(1)).alias("recent"))


@query(
    "DT-11",
    f"""SELECT l_orderkey, l_partkey, l_linenumber,
      strftime(make_timestamp(2000 + cast(l_linenumber AS bigint), 1 + cast(l_orderkey % 12 AS bigint), 1 + l_partkey % 28,
        cast(l_suppkey % 24 AS bigint), 5, cast(6 AS double)), '{SECOND}') AS built,
      lpad(cast(l_suppkey % 24 AS varchar), 2, '0') || ':05:06' AS time_text FROM lineitem""",
)
def from_parts(spark, sf_dir):
    e = F.expr
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        second(
            dt.datetime_from_parts(
                e("2000 + l_linenumber"),
                e("cast(1 + l_orderkey % 12 AS int)"),
                e("cast(1 + l_partkey % 28 AS int)"),
                e("cast(l_suppkey % 24 AS int)"),
                5,
                6,
            )
        ).alias("built"),
        dt.time_from_parts(e("cast(l_suppkey % 24 AS int)"), 5, 6).alias("time_text"),
    )


@query(
    "DT-12",
    f"""SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '{SECOND}') AS kolkata,
      strftime(ts - INTERVAL 5 HOUR, '{SECOND}') AS new_york FROM events""",
)
def convert_time_zones(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        second(dt.convert_tz("ts", "UTC", "Asia/Kolkata")).alias("kolkata"),
        second(dt.convert_tz("ts", "UTC", "America/New_York")).alias("new_york"),
    )


@query(
    "DT-13",
    """SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS unix_text,
      strftime(ts + INTERVAL 330 MINUTE, '%b %d, %Y, %I:%M %p') AS local_text FROM events""",
)
def unix_time_text(spark, sf_dir):
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        dt.from_unixtime(secs, "%d/%m/%Y %H:%i").alias("unix_text"),
        dt.zone_text(secs * 1000).alias("local_text"),
    )


@query(
    "DT-14",
    f"""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 10 DAY, '{DAY}') AS minus_days,
      strftime(o_orderdate + INTERVAL 7 DAY, '{DAY}') AS plus_week,
      strftime(o_orderdate + INTERVAL 3 MONTH, '{DAY}') AS plus_quarter FROM orders""",
)
def date_intervals(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        day(dt.minus_days(d, 10)).alias("minus_days"),
        day(dt.add_interval(d, 1, "week")).alias("plus_week"),
        day(dt.add_interval(d, 1, "quarter")).alias("plus_quarter"),
    )


@query(
    "DT-15",
    f"""SELECT event_id, strftime(date_trunc('second', ts), '{SECOND}') AS ntz,
      strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '{SECOND}') AS zoned FROM events""",
)
def to_timestamp_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")).alias("tz"),
    )
    return rows.select(
        "event_id",
        second(dt.to_timestamp("t", "ntz", "YYYY-MM-DD HH24:MI:SS")).alias("ntz"),
        second(F.to_utc_timestamp(dt.to_timestamp("tz", "tz"), F.current_timezone())).alias("zoned"),
    )


@query(
    "DT-16",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period,
      strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y%m') AS rolled FROM orders""",
)
def roll_periods(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dt.period("o_orderdate").alias("period"))
    return rows.withColumn("rolled", dt.roll_period("period", 2))


@query(
    "DT-17",
    """SELECT event_id, round(cast(cast(value * 1000 AS bigint) AS double) / 1000.0, 1) AS seconds FROM events""",
)
def run_durations(spark, sf_dir):
    start = F.expr("event_id * 1000")
    return table(spark, sf_dir, "events").select(
        "event_id", dt.duration_seconds(start, start + F.expr("cast(round(value * 1000) AS bigint)")).alias("seconds")
    )
