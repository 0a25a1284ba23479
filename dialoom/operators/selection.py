"""Choosing rows: targets, converted and failed rows, row checks, existence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.functions.base import as_col, is_blank
from dialoom.functions.text import is_notebook

# Columns of the report load and allowed path prefixes.
REPORT_COLUMNS = (
    "input_file_number",
    "input_file_path",
    "input_file_content",
    "result_extracted_sqls",
    "result_sql_parse_errors",
    "accuracy_percent",
    "result_content",
)
WORKSPACE_PREFIXES = ("/Workspace/", "/Users/", "/Shared/")
TARGET_TYPES = ("notebook", "file")
SOURCE_FORMATS = ("sql", "generic")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def select_targets(
    df: DataFrame,
    threshold: int = 20000,
    tokens: str = "input_file_token_count_preprocessed",
    name: str = "is_conversion_target",
) -> DataFrame:
    return df.withColumn(name, rules.is_target(tokens, threshold))


LISTED = ("input_file_number", "input_file_path", "input_file_token_count_preprocessed")


def targets(df: DataFrame) -> DataFrame:
    return df.filter("is_conversion_target").select(*LISTED).orderBy("input_file_number")


def over_threshold(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_conversion_target").select(*LISTED).orderBy("input_file_number")


def require_targets(df: DataFrame) -> DataFrame:
    """The target rows; an error when there is none."""
    chosen = df.filter("is_conversion_target")
    if chosen.isEmpty():
        raise ValueError("no file is a conversion target")
    return chosen


def converted(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("result_content").isNotNull())
        .select(
            "input_file_number", "input_file_path", "result_content", "input_file_token_count_preprocessed",
            "result_prompt_tokens", "result_completion_tokens", "result_total_tokens", "result_timestamp",
        )
        .orderBy("input_file_number")
    )


def failed(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("result_error").isNotNull())
        .select("input_file_number", "input_file_path", "result_error", "result_timestamp")
        .orderBy("input_file_number")
    )


def with_skip_reason(df: DataFrame, content: str = "content", name: str = "skip_reason") -> DataFrame:
    """Why a row is left out: unreadable, no notebook, no code; NULL for rows to keep."""
    text = F.col(content)
    reason = (
        F.when(text.isNull(), "Could not read file")
        .when(~is_notebook(text), "Not a Databricks notebook")
        .when(is_blank(text), "Empty code")
    )
    return df.withColumn(name, reason)


def without_empty_code(df: DataFrame, code: str = "result_content") -> DataFrame:
    """Rows that have code to export."""
    return df.filter(F.col(code).isNotNull() & (F.col(code) != ""))


def report_columns(df: DataFrame, limit: int | None = None, order: str = "input_file_number") -> DataFrame:
    """The report's columns of all rows, or of the first ``limit`` in ``order`` when the caller asks for so many."""
    chosen = df.select(*REPORT_COLUMNS)
    return chosen if limit is None else chosen.orderBy(order).limit(limit)


def where_exists(df: DataFrame, other: DataFrame, keys: Sequence[str], negate: bool = False) -> DataFrame:
    """Correlated EXISTS / NOT EXISTS on equal keys.

    The other side is reduced to its distinct keys before it is moved, so a key that holds many
    of its rows costs one row.
    """
    keys = list(keys)
    return df.join(other.select(*keys).distinct(), keys, "left_anti" if negate else "left_semi")


def any_rows(df: DataFrame, negate: bool = False) -> bool:
    """Whole-table EXISTS / NOT EXISTS; stops at the first row."""
    return df.isEmpty() if negate else not df.isEmpty()


# Row checks. Each gives a message or NULL; ``check_rows`` collects the messages of all of them.


def check_enum(column: str, allowed: Sequence[str]) -> Column:
    value = F.col(column)
    message = F.concat(F.lit(f"Invalid {column}: '"), value, F.lit(f"'. Supported: {', '.join(allowed)}"))
    return F.when(value.isNull(), f"{column} is required but got None").when(~value.isin(list(allowed)), message)


def check_positive(column: str) -> Column:
    value = F.col(column)
    message = F.concat(F.lit(f"{column} must be positive, got: "), value.cast("string"))
    return F.when(value.isNull(), f"{column} is required but got None").when(value <= 0, message)


def check_non_negative(column: str) -> Column:
    value = F.col(column)
    message = F.concat(F.lit(f"{column} must be non-negative, got: "), value.cast("string"))
    return F.when(value.isNull(), f"{column} is required but got None").when(value < 0, message)


def check_json(column: str) -> Column:
    value = F.col(column)
    return F.when((value != "") & F.try_parse_json(value).isNull(), f"{column} is not valid JSON")


def check_path_prefix(column: str, required: bool = True) -> Column:
    value = F.col(column)
    allowed = F.lit(False)
    for prefix in WORKSPACE_PREFIXES:
        allowed = allowed | value.startswith(prefix)
    message = F.concat(
        F.lit(f"{column} must be a workspace path (start with /Workspace/, /Users/, or /Shared/), got: "), value
    )
    missing = F.coalesce(value, F.lit("")) == ""
    return F.when(missing, F.lit(f"{column} is required") if required else F.lit(None)).when(~allowed, message)


def check_required_if(column: str, other: str, equals: str) -> Column:
    missing = F.coalesce(F.col(column), F.lit("")) == ""
    return F.when((F.col(other) == equals) & missing, f"{column} is required when {other}='{equals}'")


def check_rows(df: DataFrame, checks: Sequence[Column], name: str = "errors") -> DataFrame:
    """All messages of a row, in check order; an empty array means the row is valid."""
    return df.withColumn(name, F.array_compact(F.array(*checks)))


def job_checks() -> list[Column]:
    """The checks of a job definition row."""
    return [
        check_enum("target_type", TARGET_TYPES),
        check_enum("source_format", SOURCE_FORMATS),
        check_enum("log_level", LOG_LEVELS),
        check_positive("token_count_threshold"),
        check_positive("concurrency"),
        check_non_negative("max_fix_attempts"),
        check_json("request_params"),
        check_path_prefix("output_dir"),
        check_path_prefix("sql_output_dir", required=False),
        check_required_if("output_extension", "target_type", "file"),
    ]


def normalize_enum(value: Column | str, allowed: Sequence[str]) -> Column:
    """Exact match, else the canonical spelling of a case-insensitive match, else unchanged.

    The allowed values are a short fixed list, so this is an expression and needs no join.
    """
    value = as_col(value)
    out = F.when(value.isin(list(allowed)), value)
    for canonical in allowed:
        out = out.when(F.lower(value) == canonical.lower(), canonical)
    return out.otherwise(value)


def join_enum(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``normalize_enum`` against a table of canonical values (column ``value``)."""
    keyed = values.select(F.lower("value").alias("_key"), F.col("value").alias("_canonical"))
    joined = df.join(keyed, F.lower(F.col(column)) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).select(*df.columns)
