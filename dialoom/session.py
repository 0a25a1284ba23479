"""Session helpers."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and measurements; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dialoom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Only a local session, which has no other machine to share with, falls back to a folder of
    its own; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="dialoom-checkpoint-")
    context.setCheckpointDir(configured)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from there.

    The rows are computed once, survive the loss of executors, and come back with a known size,
    so that later joins broadcast them only when they are small.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """A fixed table as one literal of the plan; no Python worker is needed to read it."""
    names = [n for n, _ in columns]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    schema = "array<struct<" + ",".join(f"{n}:{t}" for n, t in columns) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def met(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that moves both sides.

    For sides with a row for each row of the input: written, such tables are so small (paths, numbers, repeated texts)
    that they would be broadcast, but at the driver they are many times as large.
    """
    return df.hint("merge")


# Fixed value: rows that a task of a large grouping or join takes.
TASK_ROWS = 400_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt by ``keys`` over as many tasks as ``rows`` asks for, so that a task's memory stays when the input grows."""
    return df.repartition(max(parallelism(df.sparkSession), -(-rows // TASK_ROWS)), *keys)
