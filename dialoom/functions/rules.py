"""Predicates and derived labels over the result table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.base import as_col, is_blank, size0

# Accuracy by number of errors, pass and review marks, export size limit.
ACCURACY_EMPTY = 0.0
ACCURACY_CLEAN = 100.0
ACCURACY_ONE_ERROR = 85.0
ACCURACY_TWO_ERRORS = 75.0
ACCURACY_MORE_ERRORS = 60.0
PASS_MARK = 90.0
REVIEW_MARK = 70.0
MAX_EXPORT_BYTES = 10 * 1024 * 1024
EXPORTED, EXPORT_FAILED = "exported", "export_failed"


def is_target(tokens: Column | str, threshold: int = 20000) -> Column:
    """At or below the threshold; an unknown count is a target."""
    return F.when(as_col(tokens) > threshold, F.lit(False)).otherwise(F.lit(True))


def has_syntax_error(python_error: Column | str, sql_errors: Column | str) -> Column:
    return as_col(python_error).isNotNull() | (size0(sql_errors) > 0)


def parse_error_count(python_error: Column | str, sql_errors: Column | str) -> Column:
    """One for a (non-empty) Python error plus the number of SQL errors."""
    python_error = as_col(python_error)
    one = F.when(python_error.isNotNull() & (python_error != ""), 1).otherwise(0)
    return one + size0(sql_errors)


def accuracy(content: Column | str, errors: Column | str, comma_count: bool = False) -> Column:
    """0 without content, 100 without errors, else 85 / 75 / 60 for one, two and more errors.

    ``comma_count`` counts the comma-separated pieces of the joined messages instead of the
    messages, so a message that holds commas weighs more.
    """
    errors = as_col(errors)
    if comma_count:
        joined = F.coalesce(F.array_join(errors, ", "), F.lit(""))
        count = F.when(is_blank(joined), 0).otherwise(F.size(F.split(joined, ",")))
    else:
        count = size0(errors)
    return (
        F.when(is_blank(content), F.lit(ACCURACY_EMPTY))
        .when(count == 0, F.lit(ACCURACY_CLEAN))
        .when(count == 1, F.lit(ACCURACY_ONE_ERROR))
        .when(count == 2, F.lit(ACCURACY_TWO_ERRORS))
        .otherwise(F.lit(ACCURACY_MORE_ERRORS))
    )


def grade(score: Column | str) -> Column:
    score = as_col(score)
    return F.when(score >= PASS_MARK, "Pass").when(score >= REVIEW_MARK, "Needs Review").otherwise("Fail")


def conversion_status(content: Column | str, python_error: Column | str, sql_errors: Column | str) -> Column:
    return (
        F.when(as_col(content).isNull(), "Not converted")
        .when(has_syntax_error(python_error, sql_errors), "Converted with errors")
        .otherwise("Converted successfully")
    )


def export_label(status: Column | str) -> Column:
    status = as_col(status)
    return (
        F.when(status.isNull(), "Not exported")
        .when(status == EXPORTED, "Exported successfully")
        .otherwise("Export failed")
    )


def normalize_export_status(status: Column | str) -> Column:
    """Both export flavours to ``exported`` / ``export_failed``; NULL stays NULL."""
    status = as_col(status)
    return F.when(status.isin(EXPORTED, "success", "true"), EXPORTED).when(status.isNotNull(), EXPORT_FAILED)


def error_detail_text(python_error, sql_errors, result_error, export_error) -> Column:
    """The first kind of error present, spelled out; NULL when there is none."""
    python_error, sql_errors = as_col(python_error), as_col(sql_errors)
    result_error, export_error = as_col(result_error), as_col(export_error)
    listed = F.concat(
        F.lit("SQL errors ("), F.size(sql_errors).cast("string"), F.lit("): "), F.array_join(sql_errors, "; ")
    )
    return (
        F.when(python_error.isNotNull(), F.concat(F.lit("Python errors: "), python_error))
        .when(size0(sql_errors) > 0, listed)
        .when(result_error.isNotNull(), F.concat(F.lit("Conversion error: "), result_error))
        .when(export_error.isNotNull(), F.concat(F.lit("Export error: "), export_error))
    )


def export_gate_error(encoded_size: Column | str, max_bytes: int = MAX_EXPORT_BYTES) -> Column:
    return F.when(as_col(encoded_size) > max_bytes, "Content size exceeds 10MB limit")
