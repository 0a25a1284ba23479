import pytest
from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.operators import reports
from dialoom.operators import selection as sel
from dialoom.schema import RESULT_SCHEMA, with_result_columns


def table(spark, rows, columns):
    schema = ", ".join(f"{c} {RESULT_SCHEMA[c].dataType.simpleString()}" for c in columns)
    return with_result_columns(spark.createDataFrame(rows, schema))


def test_accuracy_and_grade(spark):
    cases = [(None, None), ("ok", []), ("ok", None), ("ok", ["a"]), ("ok", ["a", "b"]), ("ok", ["a"] * 3), (" \n", []), ("ok", ["a, b"])]
    df = spark.createDataFrame(cases, "c string, e array<string>")
    got = [tuple(r) for r in df.select(rules.accuracy("c", "e").alias("a"), rules.accuracy("c", "e", True)).withColumn("g", rules.grade("a")).collect()]
    assert got == [
        (0.0, 0.0, "Fail"), (100.0, 100.0, "Pass"), (100.0, 100.0, "Pass"), (85.0, 85.0, "Needs Review"),
        (75.0, 75.0, "Needs Review"), (60.0, 60.0, "Fail"), (0.0, 0.0, "Fail"), (85.0, 75.0, "Needs Review"),
    ]


def test_target_threshold(spark):
    df = spark.createDataFrame([(20000,), (20001,), (None,)], "input_file_token_count_preprocessed int")
    assert [r.is_conversion_target for r in sel.select_targets(df).collect()] == [True, False, True]
    with pytest.raises(ValueError, match="no file"):
        sel.require_targets(sel.select_targets(df.filter("input_file_token_count_preprocessed > 20000")))


def test_export_gate_records_the_failure(spark):
    df = spark.createDataFrame([("a" * 6,), ("a" * 7,)], "document string")
    got = [(r.encoded_size, r.export_status, r.export_error) for r in reports.export_gate(df, max_bytes=8).collect()]
    assert got == [(8, "exported", None), (12, "export_failed", "Content size exceeds 10MB limit")]
    sizes = spark.createDataFrame([(10485760,), (10485761,)], "s long").select(rules.export_gate_error("s")).collect()
    assert [r[0] for r in sizes] == [None, "Content size exceeds 10MB limit"]


def test_status_detail_takes_the_first_error(spark):
    columns = ["input_file_number", "result_content", "result_error", "result_python_parse_error", "result_sql_parse_errors", "export_status", "export_error"]
    rows = [
        (1, "x", None, "py", ["s"], "exported", None), (2, "x", None, None, ["s", "t"], None, None),
        (3, None, "http", None, None, None, None), (4, "x", None, None, [], "export_failed", "disk"),
        (5, "x", None, None, None, "exported", None), (6, None, None, None, None, None, None),
    ]
    got = [(r.input_file_number, r.conversion_status, r.export_status, r.error_details) for r in reports.status_detail(table(spark, rows, columns)).collect()]
    assert got == [
        (1, "Converted with errors", "Exported successfully", "Python errors: py"),
        (2, "Converted with errors", "Not exported", "SQL errors (2): s; t"),
        (3, "Not converted", "Not exported", "Conversion error: http"),
        (4, "Converted successfully", "Export failed", "Export error: disk"),
        (5, "Converted successfully", "Exported successfully", None),
    ]
    summary = reports.conversion_summary(table(spark, rows, columns)).first()
    assert tuple(summary) == (5, 4, 2, 2)


def test_run_history(spark):
    rows = [
        (1, 1704441420000, 1704441421250, "SUCCESS", {"output_dir": "/Workspace/Shared/a"}, {"output_dir": "j"}),
        (2, None, None, None, None, {"output_dir": "/b"}),
        (3, 1704441420000, None, "FAILED", {"x": "y"}, None),
    ]
    schema = "run_id long, start_ms long, end_ms long, result_state string, override_params map<string,string>, job_params map<string,string>"
    got = [tuple(r) for r in reports.run_history(spark.createDataFrame(rows, schema), host="h").collect()]
    assert got == [
        (1, "Jan 05, 2024, 01:27 PM", "SUCCESS", 1.3, "/Workspace/Shared/a", "https://h/#workspace/Shared/a"),
        (3, "Jan 05, 2024, 01:27 PM", "FAILED", None, None, None),
        (2, None, "UNKNOWN", None, "/b", "https://h/#workspace/b"),
    ]


def test_judge(spark):
    rows = [
        ("Error calling model: x", "CREATE VIEW v"), ("no verdict", ""), ('{"overall_score": 0.5, "critical_errors": ["e"]}', ""),
        ('{"summary_reasoning": "r"}', ""),
    ]
    got = reports.judge(spark.createDataFrame(rows, "response string, script string"), model="m").collect()
    assert [(r.overall_score, r.summary_reasoning, r.critical_errors) for r in got] == [
        (0.0, "Endpoint Error: m", ["Endpoint Offline"]), (0.0, "Model returned invalid format.", ["JSON Parse Error"]),
        (0.5, None, ["e"]), (0.0, "r", None),
    ]
    assert got[0].object_type_detected == "VIEW"


def test_row_checks_accumulate(spark):
    schema = ("target_type string, source_format string, log_level string, token_count_threshold int, concurrency int, "
              "max_fix_attempts int, request_params string, output_dir string, sql_output_dir string, output_extension string")  # fmt: skip
    rows = [
        ("notebook", "sql", "INFO", 1, 1, 0, '{"a": 1}', "/Users/x", None, None),
        ("file", "sql", "INFO", 0, None, -1, "{", "/tmp", "", ""),
    ]
    got = [r.errors for r in sel.check_rows(spark.createDataFrame(rows, schema), sel.job_checks()).collect()]
    assert got[0] == [] and len(got[1]) == 6
    assert got[1][0] == "token_count_threshold must be positive, got: 0"


def test_enum_normalisation(spark):
    df = spark.createDataFrame([("NOTEBOOK",), ("file",), ("other",), (None,)], "v string")
    assert [r[0] for r in df.select(sel.normalize_enum("v", sel.TARGET_TYPES)).collect()] == ["notebook", "file", "other", None]


def test_skip_reasons(spark):
    df = spark.createDataFrame([(None,), ("x",), ("# MAGIC y",)], "content string")
    assert [r.skip_reason for r in sel.with_skip_reason(df).collect()] == ["Could not read file", "Not a Databricks notebook", None]
    empty = spark.createDataFrame([(None,), ("",), ("x",)], "result_content string")
    assert sel.without_empty_code(empty).count() == 1
    assert sel.any_rows(df) and not sel.any_rows(df.limit(0)) and sel.any_rows(df.limit(0), negate=True)


def test_progress(spark):
    df = spark.createDataFrame([(1, i) for i in range(1, 8)], "run int, i int")
    got = {r.i: r.progress for r in reports.progress(df, ["run"], ["i"], done=F.col("i") == 7).collect()}
    assert got == {i: int(i / 7 * 30) for i in range(1, 7)} | {7: 100}
