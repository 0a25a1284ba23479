"""Checking, splitting and composing scripts."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dialoom.functions.base import as_col, is_blank, size0
from dialoom.functions.rules import parse_error_count
from dialoom.functions.scripts import flatten_sql
from dialoom.functions.text import CELL_MARKER, basename, stem
from dialoom.messages import DEFAULT_LANGUAGE, KEYS, MESSAGES, messages_table
from dialoom.operators import pyscripts
from dialoom.operators.ordering import position_within
from dialoom.operators.relational import apply_explode
from dialoom.session import materialize, met

CHECK_TYPE = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("statements", T.ArrayType(T.StringType()))]
)


@F.arrow_udf(CHECK_TYPE)
def _check_python(code: pa.Array) -> pa.Array:
    # One script at a time leaves the batch, whatever the size of the batch.
    checked = (pyscripts.check_python(c.as_py()) for c in code)
    return pa.array(({"error": e, "statements": s} for e, s in checked), to_arrow_type(CHECK_TYPE))


# Marked so that filters on a result are not pushed below it with a second run of the function.
_check_python = _check_python.asNondeterministic()


def syntax_check_python(df: DataFrame, col: str = "result_content", strip_comments_first: bool = False) -> DataFrame:
    """Add ``result_python_parse_error`` and ``result_extracted_sqls`` (flattened statements)."""
    checked = df.withColumn("_check", _check_python(F.col(col)))
    return checked.withColumns(
        {
            "result_python_parse_error": F.col("_check.error"),
            "result_extracted_sqls": F.transform(
                F.col("_check.statements"), lambda s: flatten_sql(s, strip_comments_first)
            ),
        }
    ).drop("_check")


def extract_sql(df: DataFrame, key: str, col: str = "result_content") -> DataFrame:
    """One row per extracted statement: (key, idx, sql)."""
    checked = syntax_check_python(df.select(key, col), col)
    rows = apply_explode(checked, F.col("result_extracted_sqls"), "sql", with_index=True, index="idx")
    return rows.select(key, "idx", "sql")


def error_rate(df: DataFrame, by: str) -> DataFrame:
    """Share of files with a Python error per group."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("result_python_parse_error").isNotNull()).alias("failed"),
        F.avg(F.col("result_python_parse_error").isNotNull().cast("int")).alias("error_rate"),
    )


def error_classes(df: DataFrame) -> DataFrame:
    """Error messages without their positions, most frequent first."""
    kind = F.regexp_replace("result_python_parse_error", r"\s*\(<unknown>, line \d+\)", "")
    return (
        df.filter(F.col("result_python_parse_error").isNotNull())
        .groupBy(kind.alias("error_class"))
        .agg(F.count(F.lit(1)).alias("files"))
        .orderBy(F.col("files").desc(), "error_class")
    )


# Statement checks. The default is structural and runs as expressions, without Python workers.

# Words a statement may start with.
LEADING_VERBS = (
    "ALTER", "ANALYZE", "CACHE", "CALL", "CLEAR", "COMMENT", "CREATE", "DECLARE", "DELETE", "DESC", "DESCRIBE",
    "DROP", "EXECUTE", "EXPLAIN", "FROM", "GRANT", "INSERT", "LOAD", "MERGE", "MSCK", "OPTIMIZE", "REFRESH",
    "REPLACE", "RESET", "REVOKE", "SELECT", "SET", "SHOW", "TABLE", "TRUNCATE", "UNCACHE", "UPDATE", "USE",
    "VACUUM", "VALUES", "WITH",
)
CLOSED_PARTS = (
    r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
    r"|`[^`]*+`"
    r"|--[^\n]*+"
    r"|/\*.*?\*/"
)
STACK_MARK = "JVM stacktrace:"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fault(bare: Column) -> Column:
    steps = F.transform(
        F.regexp_extract_all(bare, F.lit("[()]"), F.lit(0)), lambda p: F.when(p == "(", F.lit(1)).otherwise(F.lit(-1))
    )
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))
    walk = F.aggregate(
        steps,
        state,
        lambda s, d: F.struct(
            (s["depth"] + d).alias("depth"), F.least(s["lowest"], s["depth"] + d).alias("lowest")
        ),
    )
    brackets = _once(
        walk,
        lambda w: F.when(w["lowest"] < 0, "closing bracket without an opening one").when(w["depth"] > 0, "unclosed bracket"),
    )
    verb = F.upper(F.regexp_extract(bare, r"\A[\s(;]*([A-Za-z_]+)", 1))
    first = _once(verb, lambda v: F.when(~v.isin(*LEADING_VERBS), F.concat(F.lit("unknown statement: "), v)))
    return (
        F.when(is_blank(bare), "empty statement")
        .when(bare.rlike("['\"`]"), "unclosed quote")
        .when(bare.contains("/*"), "unclosed comment")
        .otherwise(F.coalesce(brackets, first))
    )


def statement_error(sql: Column | str) -> Column:
    """First structural fault of a statement, or NULL: quotes, comments, brackets, leading word."""
    return _once(F.regexp_replace(as_col(sql), CLOSED_PARTS, " "), _fault)


def attach_sql_checks(
    df: DataFrame,
    check_fn: Callable[[str], str | None] | None = None,
    statements: str = "result_extracted_sqls",
    name: str = "result_sql_parse_errors",
) -> DataFrame:
    """Messages ``Error in query {idx}: ...`` per file; empty when all statements are sound.

    A file's statements sit in one row, so the check needs no shuffle. ``check_fn`` (statement ->
    message or None) replaces the structural check; it runs in tasks and sees each distinct
    statement of a batch once.
    """
    col = F.col(statements)
    if check_fn is None:
        found = F.transform(col, lambda s: statement_error(s))
    else:

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def run(values: pd.Series) -> pd.Series:
            known: dict[str, str | None] = {}

            def message(sql):
                if sql not in known:
                    known[sql] = check_fn(sql)
                return known[sql]

            return values.map(lambda row: None if row is None else [message(s) for s in row])

        found = run.asNondeterministic()(col)

    def labelled(message: Column, idx: Column) -> Column:
        kept = F.when(message.contains(STACK_MARK), F.trim(F.substring_index(message, STACK_MARK, 1)))
        return F.concat(F.lit("Error in query "), idx.cast("string"), F.lit(": "), F.coalesce(kept, message))

    return df.withColumn(name, F.array_compact(F.transform(found, labelled)))


# Cells.


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _cell_starts(code: pa.Array) -> pa.Array:
    return pa.array((pyscripts.cell_starts(c.as_py()) for c in code), pa.list_(pa.int32()))


_cell_starts = _cell_starts.asNondeterministic()


# The ends of lines as Python's parser knows them; the ends stay with their lines.
LINE_CUT = r"(?<=\n)|(?<=\r)(?!\n)"


def with_cells(df: DataFrame, col: str = "result_content", name: str = "cells") -> DataFrame:
    """Array of cells (start_line, end_line, text). Python returns line numbers only; the text is cut here.

    Lines end at ``\\r\\n``, ``\\r`` or ``\\n`` and keep their ends; a cell's last end before another
    cell goes.
    """
    lines = F.split(F.col(col), LINE_CUT, -1)

    def cell(start: Column, i: Column) -> Column:
        after = F.get(F.col("_starts"), i + F.lit(1))
        end = F.coalesce(after - F.lit(1), F.size(F.col("_lines")))
        text = F.array_join(F.slice(F.col("_lines"), start, end - start + F.lit(1)), "")
        text = F.when(after.isNull(), text).otherwise(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""))
        return F.struct(start.alias("start_line"), end.alias("end_line"), text.alias("text"))

    ready = df.withColumn("_starts", _cell_starts(F.col(col))).withColumn("_lines", lines)
    return ready.withColumn(name, F.transform("_starts", cell)).drop("_starts", "_lines")


def join_cells(cells: Column | str) -> Column:
    """Cells with the marker line before each; repeated markers become one."""
    marked = F.transform(as_col(cells), lambda c: F.concat(F.lit(CELL_MARKER + "\n"), c["text"]))
    joined = F.array_join(marked, "\n")
    return F.regexp_replace(joined, rf"(?:{CELL_MARKER}\n)+(?={CELL_MARKER})", "")


def split_cells(df: DataFrame, key: str, col: str = "result_content") -> DataFrame:
    """One row per cell: (key, cell_no, start_line, end_line, text)."""
    rows = apply_explode(with_cells(df.select(key, col), col), F.col("cells"), "_c", with_index=True, index="_i")
    return rows.select(key, (F.col("_i") + F.lit(1)).alias("cell_no"), "_c.*")


# Documents.


def compose_document(
    df: DataFrame,
    lang: str | None = DEFAULT_LANGUAGE,
    messages: DataFrame | None = None,
    output_path: str = "export_output_path",
) -> DataFrame:
    """Add ``document``: header, source path, body and check results in the wanted language.

    One language for all rows is taken from the catalogue as literals. With ``lang=None`` a column
    ``comment_lang`` names the language of each row and the catalogue is joined.
    """
    texts = messages_table(df.sparkSession) if messages is None else messages
    if lang is None:
        joined = df.join(texts, F.col("comment_lang") == F.col("language"))
    else:
        found = texts.filter(F.col("language") == lang).first() if messages is not None else None
        chosen = found.asDict() if found else dict(zip(KEYS, MESSAGES[lang], strict=True))
        joined = df.withColumns({key: F.lit(chosen[key]) for key in KEYS})
    py, sqls = F.col("result_python_parse_error"), F.col("result_sql_parse_errors")
    has_py = py.isNotNull() & (py != "")
    has_sql = size0(sqls) > 0

    def magic(*parts: Column | str) -> Column:
        cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.concat(F.lit("# MAGIC "), *cols, F.lit("\n"))

    header = F.concat(
        F.lit("# Databricks notebook source\n"),
        magic("%md"),
        magic("# ", basename(output_path)),
        magic(F.col("notebook_description")),
        magic(""),
        magic(F.col("source_script"), ": `", F.col("input_file_path"), "`"),
        F.lit(CELL_MARKER + "\n"),
        F.col("result_content"),
        F.lit("\n" + CELL_MARKER + "\n"),
        magic("%md"),
        magic("## ", F.col("syntax_check_results")),
    )
    fence = magic("```")
    py_part = F.concat(magic("### ", F.col("python_syntax_errors")), fence, magic(py), fence)
    sql_lines = F.array_join(F.transform(sqls, lambda e: magic(e)), "")
    sql_part = F.concat(magic("### ", F.col("spark_sql_syntax_errors")), fence, sql_lines, fence)
    found = F.concat(
        magic(F.col("errors_from_checks")),
        F.when(has_py, py_part).otherwise(F.lit("")),
        F.when(has_sql, sql_part).otherwise(F.lit("")),
    )
    clean = F.concat(magic(F.col("no_errors_detected")), magic(F.col("review_code")))
    document = F.concat(header, F.when(has_py | has_sql, found).otherwise(clean))
    return joined.withColumn("document", document).select(
        *df.columns,
        "document",
        parse_error_count("result_python_parse_error", "result_sql_parse_errors").alias("parse_error_count"),
    )


def _named(stem_col: Column, k: Column) -> Column:
    return F.when(k == 0, stem_col).otherwise(F.concat(stem_col, F.lit("_"), k.cast("string")))


TAKEN_SCHEMA = "parent string, child string, displaced int, threshold long"
_RUN_SCHEMA = "slice long, run long, parent string, passed long, steps binary"


class _Passing:
    """What a stretch of competing numbers does to the count of numbers passed over before it.

    A number ``k`` is passed over when fewer than ``k - before`` are, and then counts itself. So a
    stretch maps a count ``c`` to ``c`` plus the number of its ``steps`` that lie above ``c``;
    stretches that follow each other are applied one after the other.
    """

    def __init__(self) -> None:
        self.steps: list[int] = []  # ascending

    def add(self, limit: int) -> None:
        """A number with ``k - before = limit`` at the stretch's end."""
        low, high = 0, max(limit, 0)
        while low < high:  # the least count that the stretch carries to the limit
            middle = (low + high) // 2
            if middle + len(self.steps) - bisect.bisect_right(self.steps, middle) >= limit:
                high = middle
            else:
                low = middle + 1
        if low > 0:
            bisect.insort(self.steps, low)


def _sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last run of stems in each sorted slice: the first one as a function of the
    incoming count, the last one, if it is another, by the count it ends with."""
    columns = [c.split()[0] for c in _RUN_SCHEMA.split(", ")]
    at, stem_, run, passed, passing, head = None, None, -1, 0, _Passing(), None

    def ended() -> list[tuple]:
        steps = np.array(passing.steps, np.int64).tobytes()
        return [(at, 0, stem_, passed, steps)] if run == 0 else [head, (at, run, stem_, passed, b"")]

    for batch in batches:
        out = []
        for number, parent, k, before in batch[["_slice", "parent", "k", "before"]].itertuples(index=False):
            if number != at:
                out += ended() if run >= 0 else []
                at, stem_, run, passed, passing = number, parent, 0, 0, _Passing()
            elif parent != stem_:
                head = ended()[0] if run == 0 else head
                stem_, run, passed = parent, run + 1, 0
            if run == 0:
                passing.add(k - before)
            passed += passed < k - before
        yield pd.DataFrame(out, columns=columns)
    if run >= 0:
        yield pd.DataFrame(ended(), columns=columns)


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The count that reaches each slice's first run, from the runs of a stem in order."""
    stem_, count = None, 0
    for batch in batches:
        out = []
        for number, run, parent, passed, steps in batch[["slice", "run", "parent", "passed", "steps"]].itertuples(index=False):
            if parent != stem_:
                stem_, count = parent, 0
            if run == 0:
                out.append((number, count))
                above = np.frombuffer(steps, np.int64)
                count += len(above) - int(np.searchsorted(above, count, "right"))
            else:
                count = passed
        yield pd.DataFrame(out, columns=["slice", "incoming"])


def _settle_blocks(blocks: DataFrame) -> DataFrame:
    """Walk the competing numbers ``k`` of each stem upwards.

    ``before`` is how many renamed files of the stem precede the real file ``stem_k``. With ``c``
    numbers passed over so far, ``stem_k`` is the turn of renamed file ``k - c``. Is that file
    later than the real one, the number is passed over from there on (``threshold``); else the
    real file finds its name taken (``displaced``).

    An associative scan, so that one stem spreads over tasks: the numbers are range-partitioned and
    written once, each slice is summed up as a step function of the count that comes in, the few
    functions of slices that a stem crosses are applied in order, and every slice is then walked
    from its own count.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stem_, passed = None, None, 0
        for batch in batches:
            out = []
            for number, parent, k, child, before, incoming in batch[
                ["_slice", "parent", "k", "child", "before", "incoming"]
            ].itertuples(index=False):
                if number != at or parent != stem_:
                    passed = incoming if number != at else 0
                    at, stem_ = number, parent
                turn = k - passed
                if turn > before:
                    passed += 1
                    out.append((parent, child, 0, turn))
                else:
                    out.append((parent, child, 1, None))
            frame = pd.DataFrame(out, columns=["parent", "child", "displaced", "threshold"])
            frame["threshold"] = frame["threshold"].astype("Int64")
            yield frame

    placed = blocks.repartitionByRange("parent", "k").sortWithinPartitions("parent", "k")
    placed = materialize(placed.withColumn("_slice", F.spark_partition_id().cast("long")))
    in_slices = placed.repartition("_slice").sortWithinPartitions("_slice", "parent", "k")

    runs = materialize(in_slices.select("_slice", "parent", "k", "before").mapInPandas(_sum_up, _RUN_SCHEMA))
    in_order = runs.repartition("parent").sortWithinPartitions("parent", "slice", "run")
    incoming = materialize(in_order.mapInPandas(_carry, "slice long, incoming long"))
    # One row per slice.
    started = in_slices.join(F.broadcast(incoming), F.col("_slice") == F.col("slice"), "left").drop("slice")
    return started.withColumn("incoming", F.coalesce("incoming", F.lit(0))).sortWithinPartitions("_slice", "parent", "k").mapInPandas(walk, TAKEN_SCHEMA)


def _competing_numbers(rows: DataFrame, order: str) -> DataFrame | None:
    """Real stems ``stem_k`` beside a stem: (parent, child, k, files), files = earlier files of the parent.

    None when there is no such stem.
    """
    stems = rows.filter("_pos = 1").select(F.col("stem").alias("child"), F.col(order).alias("_at"))
    number = F.regexp_extract("child", r"_([1-9]\d*)\z", 1).try_cast("bigint")
    numbered = stems.withColumn("k", number).filter(F.col("k").isNotNull())
    numbered = numbered.withColumn("parent", F.regexp_replace("child", r"_[1-9]\d*\z", ""))
    real = materialize(numbered.join(met(stems.select(F.col("child").alias("parent"))), "parent", "left_semi"))
    if real.isEmpty():
        return None
    files = rows.join(real.select(F.col("parent").alias("stem")).distinct(), "stem", "left_semi")
    marks = real.select(F.col("parent").alias("stem"), F.col("_at").alias(order), "child", "k")
    nothing = [F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("k")]
    merged = files.select("stem", order, *nothing).unionByName(marks)
    merged = position_within(merged, ["stem"], [F.col(order)], "_all").filter(F.col("k").isNotNull())
    merged = position_within(merged, ["stem"], [F.col(order)], "_marks")
    return merged.select(F.col("stem").alias("parent"), "child", "k", (F.col("_all") - F.col("_marks")).alias("files"))


def unique_output_paths(
    df: DataFrame,
    directory: str,
    path: str = "input_file_path",
    order: str = "input_file_number",
    name: str = "output_path",
) -> DataFrame:
    """``directory/stem``, then ``stem_1``, ``stem_2``, ... for later files of the same stem.

    The names are those of handing them out one file at a time in ``order`` (unique per file): a
    file takes the first of its names that no earlier file holds. A stem without namesakes such as
    ``stem_1`` is settled by its files' positions. Beside real namesakes, a file's number is its
    position among the stem's renamed files and the numbers passed over before its turn; those are
    found stem by stem from the shortest name on, one step per added ``_number``.
    """
    rows = df.select(F.col(order), stem(path).alias("stem"))
    rows = materialize(position_within(rows, ["stem"], [F.col(order)], "_pos"))
    blocks, steps = _competing_numbers(rows, order), []
    if blocks is not None:
        blocks = materialize(blocks)
        roots = blocks.select("parent").subtract(blocks.select("child"))
        known = roots.select(F.col("parent").alias("stem"), F.lit(0).alias("moved"))
    while blocks is not None:
        now = blocks.join(known, F.col("parent") == F.col("stem"))
        # A stem's first file keeps its name unless it was displaced, so it is no renamed file.
        renamed = F.greatest(F.col("files") - F.lit(1) + F.col("moved"), F.lit(0))
        done = materialize(_settle_blocks(now.select("parent", "k", "child", renamed.alias("before"))))
        if done.isEmpty():
            break
        steps.append(done)
        known = done.select(F.col("child").alias("stem"), F.col("displaced").alias("moved"))
    if not steps:
        numbered = rows.select(order, "stem", (F.col("_pos") - F.lit(1)).alias("k"))
    else:
        settled = steps[0]
        for step in steps[1:]:
            settled = settled.unionByName(step)
        moved = settled.select(F.col("child").alias("stem"), F.col("displaced").alias("_moved"))
        turn = F.col("_pos") - F.lit(1) + F.coalesce("_moved", F.lit(0))
        placed = rows.join(moved, "stem", "left").select(order, "stem", turn.alias("turn"))
        passed = settled.filter(F.col("threshold").isNotNull()).select(
            F.lit(None).cast(rows.schema[order].dataType).alias(order), F.col("parent").alias("stem"),
            F.col("threshold").alias("turn"),
        )
        kind = F.when(F.col(order).isNull(), 0).otherwise(1)
        renamed = placed.filter("turn > 0").unionByName(passed).withColumn("_kind", kind)
        renamed = position_within(renamed, ["stem"], [F.col("turn"), F.col("_kind")], "k")
        first = placed.filter("turn = 0").select(order, "stem", F.lit(0).cast("long").alias("k"))
        numbered = first.unionByName(renamed.filter("_kind = 1").select(order, "stem", "k"))
    named = numbered.select(
        order, F.concat(F.lit(directory.rstrip("/") + "/"), _named(F.col("stem"), F.col("k"))).alias(name)
    )
    return df.join(met(named), order)


# Fixed value: separator line between files of one text.
FILE_MARK = r"(?m)^# === (.+?) ===[ \t]*$\n?"


def split_marked_files(df: DataFrame, key: str, col: str) -> DataFrame:
    """Text with ``# === name ===`` lines -> one row per file: (key, file_no, name, content)."""
    names = F.regexp_extract_all(F.col(col), F.lit(FILE_MARK), F.lit(1))
    parts = F.split(F.col(col), FILE_MARK, -1)
    # What stands before the first mark belongs to no file.
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.lit(1), F.lit(0)))
    zipped = F.arrays_zip(names.alias("name"), bodies.alias("content"))
    rows = apply_explode(df.select(key, col), zipped, "_f", with_index=True, index="_i")
    return rows.select(key, (F.col("_i") + F.lit(1)).alias("file_no"), F.col("_f.name"), F.col("_f.content"))


def lint_frequency(df: DataFrame, rules: str = "lint") -> DataFrame:
    """How many scripts each residual-syntax rule fires on."""
    fired = apply_explode(df.select(rules), F.col(rules), "rule")
    return fired.groupBy("rule").agg(F.count(F.lit(1)).alias("scripts"))
