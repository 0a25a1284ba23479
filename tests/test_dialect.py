import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from dialoom.functions import dates, maths, nested
from dialoom.functions import strings as st
from dialoom.operators import types as ty


def day(text):
    return F.lit(text).cast("date")


def test_month_steps(one):
    assert one(dates.dateadd("MONTH", -3, day("2020-05-31"))) == dt.date(2020, 2, 29)
    assert one(dates.add_months(day("2020-02-29"), 1, stick_to_month_end=True)) == dt.date(2020, 3, 31)
    assert one(dates.add_months(day("2020-02-29"), 1)) == dt.date(2020, 3, 29)


def test_datediff_counts_boundaries(one):
    assert one(dates.datediff("MONTH", day("2020-01-31"), day("2020-02-01"))) == 1
    assert one(dates.datediff("year", day("2020-12-31"), day("2021-01-01"))) == 1
    assert one(dates.datediff("week", day("2024-01-06"), day("2024-01-07"))) == 1  # Saturday to Sunday
    assert one(dates.datediff("week", day("2024-01-07"), day("2024-01-08"), week_start="monday")) == 1
    assert one(dates.datediff("hour", F.lit("2020-01-01 00:59:00").cast("timestamp"),
                              F.lit("2020-01-01 01:00:00").cast("timestamp"))) == 1
    assert one(dates.datediff_mysql(day("2020-01-05"), day("2020-01-01"))) == 4
    with pytest.raises(ValueError, match="unknown date unit"):
        dates.datediff("eon", day("2020-01-01"), day("2020-01-01"))


@pytest.mark.parametrize(
    ("pattern", "dialect", "expected"),
    [
        ("YYYY-MM-DD HH24:MI:SS", "oracle", "yyyy-MM-dd HH:mm:ss"),
        ("DD MON YY", "netezza", "dd MMM yy"),
        ("%Y-%m-%dT%H", "mysql", "yyyy-MM-dd'T'HH"),
        ("yyyyMMdd hh:mm tt", "tsql", "yyyyMMdd hh:mm a"),
    ],
)
def test_patterns(pattern, dialect, expected):
    assert dates.spark_pattern(pattern, dialect) == expected


def test_dates_and_periods(one):
    assert one(dates.str_to_date(F.lit("2024-02-30"), "%Y-%m-%d")) is None
    assert one(dates.in_periods(F.lit("202009"), ["201912"], 6, "2021-03-15"))
    assert not one(dates.in_periods(F.lit("202008"), ["201912"], 6, "2021-03-15"))
    assert one(dates.in_periods(F.lit("201912"), ["201912"], 6, "2021-03-15"))
    assert one(dates.roll_period(F.lit("202011"), 2)) == "202101"
    assert one(dates.zone_text(F.lit(0).cast("long"))) == "Jan 01, 1970, 05:30 AM"
    assert one(dates.zone_text(F.lit(1704441420999).cast("long"), "America/New_York")) == "Jan 05, 2024, 02:57 AM"
    assert one(dates.duration_seconds(F.lit(0), F.lit(1250))) == 1.3
    assert one(dates.time_from_parts(1, 2, 3)) == "01:02:03"
    assert one(dates.now("2024-01-01 10:00:00")) == dt.datetime(2024, 1, 1, 10)


def test_concat_and_length(one):
    null = F.lit(None).cast("string")
    assert one(st.concat(F.lit("a"), null)) is None
    assert one(st.concat(F.lit("a"), null, dialect="oracle")) == "a"
    assert one(st.concat(null, null, dialect="oracle")) is None
    assert one(st.length(F.lit("a  "), "tsql"), st.length(F.lit("a  "))) == (1, 3)


def test_tokens_and_regex(one):
    assert one(st.strtok(F.lit("a,,b c"), ", ", 3)) == "c"
    assert one(st.strtok(F.lit("a"), "-]", 2)) is None
    assert one(st.split_to_array(F.lit("a.b|c"), ".")) == ["a", "b|c"]
    assert one(st.regexp_replace(F.lit("aXbxc"), "x", "-", "i")) == "a-bxc"
    assert one(st.regexp_replace(F.lit("aXbxc"), "x", "-", "gi")) == "a-b-c"
    assert one(st.regexp_replace(F.lit("abc"), "z", "-", "")) == "abc"
    assert one(st.regexp_replace(F.lit("k=v;k=w"), "(k)=(.)", "$2$1", "")) == "vk;k=w"
    assert one(st.otranslate(F.lit("abc"), "abc", "x")) == "x"


def test_hashes(one):
    text = "é"
    for name, plain in (("MD5", "md5"), ("SHA1", "sha1"), ("SHA2_256", "sha256"), ("SHA2_512", "sha512")):
        assert one(st.hashbytes(name, F.lit(text))) == hashlib.new(plain, text.encode()).hexdigest()


def test_normalize_columns(spark):
    df = spark.range(1).toDF("[Amount before Tax]")
    assert st.normalize_columns(df).columns == ["Amount before Tax"]
    with pytest.raises(ValueError, match="become equal"):
        st.normalize_columns(spark.range(1).selectExpr("id AS `@a`", "id AS `A`"))


def test_div0_and_decode(one):
    null = F.lit(None).cast("double")
    got = one(maths.div0(F.lit(5), F.lit(0)), maths.div0(null, F.lit(0)), maths.div0(F.lit(5), null), maths.div0(F.lit(6), F.lit(3)))
    assert got == (0.0, 0.0, None, 2.0)
    assert one(maths.decode(F.lit(None).cast("int"), 1, "a", None, "b", default="c")) == "b"
    assert one(maths.iff(F.lit(None).cast("boolean"), 1, 2)) == 2
    assert one(maths.convert(F.lit("x"), "int", strict=False)) is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(maths.convert(F.lit("x"), "int"))


def test_objects_and_json(one):
    null = F.lit(None).cast("string")
    assert one(nested.object_construct(a=F.lit("1"), b=null)) == {"a": "1"}
    doc = F.lit('{"a": {"b": [1, "x"]}, "s": "t"}')
    assert one(nested.json_get(doc, "{a,b,1}"), nested.json_value(doc, "$.a"), nested.json_query(doc, "$.a")) == (
        "x", None, '{"b":[1,"x"]}',
    )


@pytest.mark.parametrize(
    ("declared", "dialect", "expected"),
    [
        ("MONEY", "mssql", "decimal(19,4)"),
        ("uniqueidentifier", "synapse", "string"),
        ("NUMBER(10,0)", "snowflake", "decimal(10,0)"),
        ("NUMBER", "snowflake", "decimal(38,0)"),
        ("VARCHAR2(100)", "oracle", "string"),
        ("TIMESTAMP(6) WITH TIME ZONE", "teradata", "timestamp"),
        ("integer[]", "postgresql", "array<int>"),
        ("DOUBLE  PRECISION", "netezza", "double"),
        ("int unsigned", "mysql", "bigint"),
        ("SUPER", "redshift", "string"),
        ("DECIMAL(7)", "redshift", "decimal(7,0)"),
        ("INT UNSIGNED ZEROFILL", "mysql", "bigint"),
        ("ROW(a INT, b ROW(c TEXT, d DECIMAL(3,1)))", "postgresql", "struct<a:int,b:struct<c:string,d:decimal(3,1)>>"),
    ],
)
def test_spark_type(declared, dialect, expected):
    assert ty.spark_type(declared, dialect) == expected


def test_map_schema_modes(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    declared = {"a": "INT", "b": "INT"}
    got = ty.map_schema(df, "mssql", declared, strict=False).first()
    assert got.a == 1 and got.b is None and got["_cast_failures"] == ["b"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ty.map_schema(df, "mssql", declared).collect()
    with pytest.raises(ValueError, match="no mapping"):
        ty.spark_type("NOPE", "mssql")
    with pytest.raises(ValueError, match="no mapping"):
        ty.spark_type("ROW(a)", "postgresql")


def test_results_do_not_depend_on_the_session_zone(spark, one):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        before, after = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-10 01:30:00", "2024-03-10 03:30:00"))
        assert one(dates.datediff("hour", before, after)) == 2
        assert one(dates.zone_text(F.lit(0).cast("long"))) == "Jan 01, 1970, 05:30 AM"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
