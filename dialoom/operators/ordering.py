"""Positions and ordered concatenation that hold when one group owns a large share of the rows.

``row_number`` over a window puts a whole group (or, unpartitioned, the whole table) into one
task. Here the rows are range-partitioned by (group, order), so that many tasks share a group;
each task numbers its own slice and a small table of slice sizes supplies the offsets. All groups
go the same way, whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.session import materialize


def _order_columns(order: Sequence[Column | str]) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def _sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partitioned and sorted rows; partition numbers follow the order.

    Spark samples the input for the ranges, so the input is evaluated twice: a costly one should be
    a written table.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_no", start: int = 1) -> DataFrame:
    """Consecutive numbers in ``order`` over the whole frame without a single-task window.

    ``order`` should end in a unique column. The sorted rows are written once, because a second
    evaluation could cut the ranges elsewhere.
    """
    placed = materialize(_sorted_slices(df, _order_columns(order)).withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id = partition number << 33 | position, so both can be read back.
    placed = placed.withColumn("_slice", F.shiftrightunsigned("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy(F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per slice: as many as partitions, never as many as rows.
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    joined = placed.join(F.broadcast(offsets), F.col("_slice") == F.col("_s"))
    number = F.lit(start).cast("long") + F.col("_before") + F.col("_at")
    return joined.withColumn(name, number).drop("_at", "_slice", "_s", "_before")


def _count_runs(position: str, run: str, schema: T.StructType):
    """Adds each row's 1-based position in its run of equal groups, and the run's number in the slice from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, length, runs = None, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_g1", "_g2"))
            new = np.concatenate(([(a[0], b[0]) != last], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            at = np.arange(len(a))
            # Rows before the first new run go on counting the one of the batch before.
            begin = np.maximum.accumulate(np.where(new, at, -length))
            positions, numbers = at - begin + 1, runs + np.cumsum(new)
            last, length, runs = (a[-1], b[-1]), int(positions[-1]), int(numbers[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(positions, pa.int64()), pa.array(numbers, pa.int64())], [*batch.schema.names, position, run]
            )

    return count, T.StructType([*schema.fields, T.StructField(position, T.LongType()), T.StructField(run, T.LongType())])


def _group_hashes(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """128 bits that name a group; -0.0 and 0.0 are one value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    values = [F.col(c) + F.lit(0.0) if c in floats else F.col(c) for c in by]
    # A NULL leaves the hash as it is, so the pattern of NULLs is hashed too.
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in by])
    return [F.xxhash64(nulls, *values).alias("_g1"), F.xxhash64(*values, nulls, F.lit(1)).alias("_g2")]


def position_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str, total: str | None = None
) -> DataFrame:
    """1-based position inside each group of ``by``; ``order`` should end in a unique column.

    ``total`` adds the number of the group's rows. Two-level prefix sums: every slice of the sorted
    rows counts within its runs of equal groups while it streams by, and the rows are written once.
    Only a slice's first and last run can belong to a group that crosses a border, so the offsets
    are a table of one row per slice; nothing is joined on the group.
    """
    by, order = list(by), _order_columns(order)
    marked = df.select("*", *_group_hashes(df, by))
    keys = [F.col(c) for c in by]
    slices = marked.repartitionByRange(*keys, *order)
    if total:
        # Counted from the end as well: a sort within the slice turns the rows round, none moves.
        back = slices.sortWithinPartitions(*keys, *order).withColumn("_turn", F.monotonically_increasing_id())
        back = back.sortWithinPartitions(F.col("_turn").desc())
        slices = back.mapInArrow(*_count_runs("_rest", "_from_end", back.schema)).sortWithinPartitions("_turn").drop("_turn")
    else:
        slices = slices.sortWithinPartitions(*keys, *order)
    counted = slices.mapInArrow(*_count_runs("_pos", "_run", slices.schema))
    placed = materialize(counted.withColumn("_slice", F.spark_partition_id().cast("long")))
    # The first and the last run of every slice with their lengths; a lone run is the first one.
    ends = placed.groupBy("_slice").agg(
        F.max("_run").alias("last"),
        F.max(F.when(F.col("_run") == 0, F.struct("_pos", "_g1", "_g2"))).alias("head"),
        F.max(F.struct("_run", "_pos", "_g1", "_g2")).alias("tail"),
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), "head._pos", "head._g1", "head._g2"),
        F.when(F.col("last") > 0, F.struct(F.lit(1).alias("kind"), "tail._pos", "tail._g1", "tail._g2")),
    )
    runs = ends.select("_slice", F.inline(F.array_compact(kinds)))
    of_group = Window.partitionBy("_g1", "_g2")
    earlier = of_group.orderBy("_slice", "kind").rowsBetween(Window.unboundedPreceding, -1)
    summed = runs.select("_slice", "kind", F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("before"), F.sum("_pos").over(of_group).alias("all"))
    of_kind = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    offsets = materialize(
        summed.groupBy(F.col("_slice").alias("_s")).agg(
            of_kind(0, "before").alias("_before"), of_kind(0, "all").alias("_head_all"), of_kind(1, "all").alias("_tail_all")
        )
    )
    joined = placed.join(F.broadcast(offsets), F.col("_slice") == F.col("_s"))
    out = joined.withColumn(name, F.col("_pos") + F.when(F.col("_run") == 0, F.col("_before")).otherwise(0))
    if not total:
        return out.select(*df.columns, name)
    inside = F.col("_pos") + F.col("_rest") - 1
    tail = F.when((F.col("_from_end") == 0), F.coalesce("_tail_all", "_head_all"))
    whole = F.when(F.col("_run") == 0, F.col("_head_all")).otherwise(F.coalesce(tail, inside))
    return out.withColumn(total, whole).select(*df.columns, name, total)


def ordered_values(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    separator: str | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per group, the non-NULL values in order: an array, or one text when ``separator`` is given.

    One exchange. The finished value of a group is one row by definition, so its values meet in
    one task in any case. ``extra`` holds aggregates to carry along, aliased to their names.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    kept = F.when(F.col(value).isNotNull(), item)
    values = F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["_v"])
    out = df.groupBy(*by).agg(values.alias(name), *extra)
    if separator is None:
        return out
    text = F.when(F.size(name) > 0, F.array_join(F.col(name).cast("array<string>"), separator))
    return out.withColumn(name, text)
