"""Summaries, status reports, run history, progress and judge scores over the result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.functions.base import is_blank
from dialoom.functions.dates import duration_seconds, zone_text
from dialoom.functions.nested import errors_text_or_empty
from dialoom.functions.scripts import classify_object
from dialoom.functions.text import base64_size, display_name, extract_json
from dialoom.operators.ordering import position_within
from dialoom.operators.relational import latest
from dialoom.schema import VERDICT_SCHEMA

PY_ERROR, SQL_ERRORS = "result_python_parse_error", "result_sql_parse_errors"


def _processed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("result_content").isNotNull() | F.col("result_error").isNotNull())


def conversion_summary(df: DataFrame) -> DataFrame:
    """One row of counts over the processed files."""
    return _processed(df).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("result_content").isNotNull()).alias("successful_conversions"),
        F.count_if(F.coalesce(F.col("export_status") == rules.EXPORTED, F.lit(False))).alias("successful_exports"),
        F.count_if(rules.has_syntax_error(PY_ERROR, SQL_ERRORS)).alias("files_with_errors"),
    )


def error_count(df: DataFrame) -> int:
    return df.filter(rules.has_syntax_error(PY_ERROR, SQL_ERRORS)).count()


def export_summary(df: DataFrame) -> DataFrame:
    """(success, size_mb) rows -> counts, average and total size."""
    return df.agg(
        F.count(F.lit(1)).alias("total_notebooks"),
        F.count_if("success").alias("successful_conversions"),
        F.count_if(~F.col("success")).alias("failed_conversions"),
        F.round(F.avg("size_mb"), 2).alias("avg_size_mb"),
        F.round(F.sum("size_mb"), 2).alias("total_size_mb"),
    )


def migration_report(df: DataFrame, comma_count: bool = False) -> DataFrame:
    """Per file: name, accuracy, status, messages, old and new text, and the text to show.

    The converted text is shown only for files without errors and full accuracy.
    """
    score = rules.accuracy("result_content", SQL_ERRORS, comma_count)
    rows = df.select(
        "input_file_number",
        display_name("input_file_path").alias("file_name"),
        score.alias("accuracy"),
        errors_text_or_empty(SQL_ERRORS).alias("errors"),
        F.coalesce("input_file_content", F.lit("")).alias("legacy_sql"),
        F.coalesce("result_content", F.lit("")).alias("converted_sql"),
    )
    hidden = ~is_blank("errors") | (F.col("accuracy") < rules.ACCURACY_CLEAN)
    return rows.withColumns(
        {
            "status": rules.grade("accuracy"),
            "shown_sql": F.when(hidden, F.lit("")).otherwise(F.col("converted_sql")),
        }
    )


def report_metrics(df: DataFrame, comma_count: bool = False) -> DataFrame:
    """Total, passed, failed, average accuracy (rounded half to even)."""
    score = rules.accuracy("result_content", SQL_ERRORS, comma_count)
    passed = F.count_if(F.col("accuracy") >= rules.PASS_MARK)
    return df.select(score.alias("accuracy")).agg(
        F.count(F.lit(1)).alias("total"),
        passed.alias("passed"),
        (F.count(F.lit(1)) - passed).alias("failed"),
        F.bround(F.avg("accuracy"), 2).alias("avg_accuracy"),
    )


def with_accuracy(df: DataFrame) -> DataFrame:
    """Fill ``accuracy_percent``."""
    return df.withColumn("accuracy_percent", rules.accuracy("result_content", SQL_ERRORS))


def status_detail(df: DataFrame) -> DataFrame:
    return (
        _processed(df)
        .select(
            "input_file_number",
            "input_file_path",
            rules.conversion_status("result_content", PY_ERROR, SQL_ERRORS).alias("conversion_status"),
            rules.export_label("export_status").alias("export_status"),
            "export_output_path",
            F.coalesce("export_content_size_bytes", F.lit(0)).alias("content_size_bytes"),
            rules.error_detail_text(PY_ERROR, SQL_ERRORS, "result_error", "export_error").alias("error_details"),
        )
        .orderBy("input_file_number")
    )


def check_status(df: DataFrame) -> DataFrame:
    label = F.when(rules.has_syntax_error(PY_ERROR, SQL_ERRORS), "Has errors").otherwise("No errors")
    return df.select(
        "input_file_number", "input_file_path", label.alias("check_status"), PY_ERROR, SQL_ERRORS
    ).orderBy("input_file_number")


def export_detail(df: DataFrame, done: str = "Successfully converted and exported",
                  not_done: str = "Failed to convert or export") -> DataFrame:
    """One line per exported script."""
    return df.select(
        "python_notebook_path",
        F.when(F.col("success"), done).otherwise(not_done).alias("conversion_status"),
        "sql_output_path",
        F.round("size_mb", 2).alias("size_mb"),
        "error",
    ).orderBy("python_notebook_path")


def export_share(df: DataFrame) -> DataFrame:
    """The summary line ``done/total``."""
    share = F.concat_ws("/", F.count_if("success").cast("string"), F.count(F.lit(1)).cast("string"))
    return df.agg(share.alias("converted"))


def error_listing(df: DataFrame, path: str = "python_notebook_path", error: str = "error") -> DataFrame:
    return df.filter(F.col(error).isNotNull()).select(path, error).orderBy(path)


def run_history(
    runs: DataFrame, zone: str = "Asia/Kolkata", limit: int = 100, host: str = "", tie: str | None = "run_id"
) -> DataFrame:
    """Newest runs with local start time, duration, status, output folder and link.

    runs(run_id, start_ms, end_ms, result_state, override_params map, job_params map). The newest
    rows are cut first, so the formatting works on at most ``limit`` rows.
    """
    newest = latest(runs, "start_ms", limit, tie=tie)
    folder = F.coalesce(
        F.nullif(F.try_element_at("override_params", F.lit("output_dir")), F.lit("")),
        F.try_element_at("job_params", F.lit("output_dir")),
    )
    started, ended = F.col("start_ms"), F.col("end_ms")
    # A zero mark counts as missing, as an absent one does.
    known = (F.coalesce(started, F.lit(0)) != 0) & (F.coalesce(ended, F.lit(0)) != 0)
    return newest.select(
        "run_id",
        F.when(F.coalesce(started, F.lit(0)) != 0, zone_text("start_ms", zone)).alias("start_time"),
        F.coalesce("result_state", F.lit("UNKNOWN")).alias("status"),
        F.when(known, duration_seconds("start_ms", "end_ms")).alias("duration"),
        folder.alias("output_dir"),
        F.when(
            F.coalesce(folder, F.lit("")) != "",
            F.concat(F.lit(f"https://{host}/#workspace"), F.replace(folder, F.lit("/Workspace"), F.lit(""))),
        ).alias("output_link"),
    )


def progress(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    running: Column | None = None,
    done: Column | None = None,
) -> DataFrame:
    """Progress mark of each upload event: its share of the run's uploads times 30.

    Rows where ``running`` holds stand at 60, rows where ``done`` holds at 100. Positions and totals
    come from one pass over the sorted rows.
    """
    placed = position_within(df, by, order, "upload_no", "uploads")
    share = (F.col("upload_no") / F.col("uploads") * F.lit(30)).cast("int")
    mark = share
    if running is not None:
        mark = F.when(running, F.lit(60)).otherwise(mark)
    if done is not None:
        mark = F.when(done, F.lit(100)).otherwise(mark)
    return placed.withColumn("progress", mark)


def export_gate(df: DataFrame, content: str = "document", max_bytes: int = rules.MAX_EXPORT_BYTES) -> DataFrame:
    """Encoded size, and whether the document may be exported; a document over the limit has failed."""
    error = rules.export_gate_error("encoded_size", max_bytes)
    sized = df.withColumn("encoded_size", base64_size(content)).withColumn("export_error", error)
    status = F.when(F.col("export_error").isNull(), rules.EXPORTED).otherwise(rules.EXPORT_FAILED)
    return sized.withColumn("export_status", status)


# Judge outcomes without a usable verdict.
ENDPOINT_ERROR_START = "Error calling model"
ENDPOINT_ERROR, FORMAT_ERROR = "Endpoint Offline", "JSON Parse Error"
FORMAT_REASON = "Model returned invalid format."


def judge(df: DataFrame, response: str = "response", script: str = "script", model: str = "",
          literals: bool = False) -> DataFrame:
    """Read the judge's answer: score, reason, errors, improvements and the script's object kind."""
    verdict = extract_json(response, VERDICT_SCHEMA, literals)
    read = df.withColumn("_verdict", verdict)
    offline = F.col(response).startswith(ENDPOINT_ERROR_START)
    unread = F.col("_verdict").isNull()

    def pick(if_offline: Column, if_unread: Column, otherwise: Column) -> Column:
        return F.when(offline, if_offline).when(unread, if_unread).otherwise(otherwise)

    return read.withColumns(
        {
            "overall_score": pick(F.lit(0.0), F.lit(0.0), F.coalesce("_verdict.overall_score", F.lit(0.0))),
            "summary_reasoning": pick(
                F.lit(f"Endpoint Error: {model}"), F.lit(FORMAT_REASON), F.col("_verdict.summary_reasoning")
            ),
            "critical_errors": pick(
                F.array(F.lit(ENDPOINT_ERROR)), F.array(F.lit(FORMAT_ERROR)), F.col("_verdict.critical_errors")
            ),
            "improvements_required": F.when(~offline & ~unread, F.col("_verdict.improvements_required")),
            "object_type_detected": classify_object(script),
        }
    ).drop("_verdict")


def judge_scores(df: DataFrame, by: str = "object_type_detected") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("scripts"), F.avg("overall_score").alias("avg_score"))
