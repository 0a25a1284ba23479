"""Written results: every stage writes a new path and hands it on.

A stage never overwrites what it reads, so a failed write leaves the earlier result as it was.
"""

from __future__ import annotations

import random
import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.base import as_col

# Table name prefix and the time stamp inside table names.
TABLE_PREFIX = "conversion_result"
STAMP_FORMAT = "%Y%m%d%H%M%S"
STAMP_IN_NAME = r"_(\d{14})_"
STAMP_ANYWHERE = r"(\d{14})"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended; asked of Spark's reader, so any storage will do."""
    try:
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS")
    except AnalysisException:
        return False
    return True


def version_name(prefix: str = TABLE_PREFIX, now: datetime | None = None, tag: str | None = None) -> str:
    """``prefix_yyyyMMddHHmmss_rand4``."""
    now = now or datetime.now()
    tag = tag or f"{random.randrange(16**4):04x}"
    return f"{prefix}_{now.strftime(STAMP_FORMAT)}_{tag}"


def write_result_version(df: DataFrame, base: str, name: str | None = None, prefix: str = TABLE_PREFIX) -> str:
    """Write a stage's output below ``base`` and return its path; a finished table of that name is reused."""
    path = f"{base.rstrip('/')}/{name or version_name(prefix)}"
    if name and finished(df.sparkSession, path):
        return path
    df.write.mode("overwrite" if name else "errorifexists").parquet(path)
    return path


def written(df: DataFrame, base: str, prefix: str = TABLE_PREFIX) -> DataFrame:
    """The rows from a new path below ``base``, computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(write_result_version(df, base, prefix=prefix))


def versions(spark: SparkSession, base: str, prefix: str = TABLE_PREFIX) -> DataFrame:
    """``name`` of the versions below ``base`` that have files, finished or not: one row each."""
    try:
        # Only paths are read, no content.
        files = spark.read.format("binaryFile").load(f"{base.rstrip('/')}/{prefix}_*/*.parquet").select("path")
    except AnalysisException:  # none matches
        return spark.createDataFrame([], "name string")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()


def restore(spark: SparkSession, base: str, prefix: str = TABLE_PREFIX) -> DataFrame | None:
    """Undo: the newest finished version below ``base``; unfinished later ones are passed over. None without any.

    The end mark that Spark's writer leaves decides; there is no pointer file that could name a
    version that is not whole.
    """
    names = versions(spark, base, prefix)
    while (name := latest_table(names, prefix).first()["latest_table"]) is not None:
        path = f"{base.rstrip('/')}/{name}"
        if finished(spark, path):
            return spark.read.parquet(path)
        names = names.filter(F.col("name") != name)
    return None


def latest_table(names: DataFrame, prefix: str, column: str = "name", stamp: str = STAMP_IN_NAME) -> DataFrame:
    """One row: the newest table by the stamp in its name; names without a stamp are oldest; none is NULL."""
    name = F.col(column)
    found = F.try_to_timestamp(F.nullif(F.regexp_extract(name, stamp, 1), F.lit("")), F.lit("yyyyMMddHHmmss"))
    rank = F.struct(F.coalesce(found, F.lit("0001-01-01 00:00:00").cast("timestamp")), name)
    return names.filter(name.startswith(prefix)).agg(F.max_by(name, rank).alias("latest_table"))


@contextmanager
def stage(df: DataFrame):
    """A temporary, transient or volatile table: written once, dropped at the end of the block."""
    spark, name = df.sparkSession, version_name("stage")
    df.write.saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Column of a table that takes inserts with returned rows: the insert that stored a row.
INSERT_ID = "insert_id"


def insert_returning(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """INSERT ... RETURNING *: append the rows and give back what the table stored of them.

    ``table`` is partitioned by ``insert_id``, so an insert is a partition: reading it back opens
    the files of this insert alone, with the table's defaults and casts, and inserts at the same
    time do not see each other's rows. Columns that ``rows`` lacks take their defaults.
    """
    mark = uuid.uuid4().hex
    view = f"rows_{mark}"
    rows.createOrReplaceTempView(view)
    try:
        names = ", ".join(f"`{c}`" for c in rows.columns)
        spark.sql(f"INSERT INTO {table} ({names}, {INSERT_ID}) SELECT {names}, '{mark}' FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(table).filter(F.col(INSERT_ID) == mark).drop(INSERT_ID)


def full_table_name(catalog: str, schema: str, name: Column | str) -> Column:
    return F.concat(F.lit(f"{catalog}.{schema}."), as_col(name))
