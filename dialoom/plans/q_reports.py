"""Report queries over the result table, the event log and judge answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.operators import reports
from dialoom.plans.derived import RESULT_SQL, SCRIPTS_SQL, result_table, scripts
from dialoom.plans.registry import query, table

HAS_ERROR = "(result_python_parse_error IS NOT NULL OR coalesce(len(result_sql_parse_errors), 0) > 0)"
ACCURACY = """CASE WHEN coalesce(trim(result_content), '') = '' THEN 0.0 WHEN coalesce(len(result_sql_parse_errors), 0) = 0
  THEN 100.0 WHEN len(result_sql_parse_errors) = 1 THEN 85.0 WHEN len(result_sql_parse_errors) = 2 THEN 75.0 ELSE 60.0 END"""
COMMA_ACCURACY = """CASE WHEN coalesce(trim(result_content), '') = '' THEN 0.0 WHEN coalesce(len(result_sql_parse_errors), 0) = 0
  THEN 100.0 WHEN len(result_sql_parse_errors) = 1 THEN 75.0 ELSE 60.0 END"""


@query(
    "AGG-1",
    f"""WITH {RESULT_SQL} SELECT count(*) AS total_files, count(result_content) AS successful_conversions,
      count(*) FILTER (export_status = 'exported') AS successful_exports, count(*) FILTER {HAS_ERROR.replace('(', '(WHERE (', 1)})
        AS files_with_errors FROM result WHERE result_content IS NOT NULL OR result_error IS NOT NULL""",
)
def conversion_summary(spark, sf_dir):
    return reports.conversion_summary(result_table(spark, sf_dir))


@query("AGG-2", f"WITH {RESULT_SQL} SELECT count(*) AS error_count FROM result WHERE {HAS_ERROR}")
def error_file_count(spark, sf_dir):
    failing = result_table(spark, sf_dir).filter(
        rules.has_syntax_error("result_python_parse_error", "result_sql_parse_errors")
    )
    return failing.agg(F.count(F.lit(1)).alias("error_count"))


EXPORTS = """exports AS (SELECT '/nb/' || doc_id AS python_notebook_path, doc_id % 5 > 0 AS success,
  '/sql/' || doc_id AS sql_output_path, n_chars / 1024.0 AS size_mb, CASE WHEN doc_id % 5 = 0 THEN 'timeout ' || source END AS error
  FROM documents)"""


def _exports(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "'/nb/' || cast(doc_id AS string) AS python_notebook_path",
        "doc_id % 5 > 0 AS success",
        "'/sql/' || cast(doc_id AS string) AS sql_output_path",
        "cast(n_chars AS double) / 1024 AS size_mb",
        "CASE WHEN doc_id % 5 = 0 THEN 'timeout ' || source END AS error",
    )


@query(
    "AGG-3",
    f"""WITH {EXPORTS} SELECT count(*) AS total_notebooks, count(*) FILTER (success) AS successful_conversions,
      count(*) FILTER (NOT success) AS failed_conversions, round(cast(avg(size_mb) AS double), 2) AS avg_size_mb,
      round(cast(sum(size_mb) AS double), 2) AS total_size_mb FROM exports""",
)
def export_summary(spark, sf_dir):
    return reports.export_summary(_exports(spark, sf_dir))


@query(
    "AGG-4 REP-3",
    f"""WITH {RESULT_SQL}, a AS (SELECT {ACCURACY} AS x FROM result) SELECT count(*) AS total,
      count(*) FILTER (x >= 90) AS passed, count(*) FILTER (x < 90) AS failed, round_even(cast(avg(x) AS double), 2) AS avg_accuracy FROM a""",
)
def report_metrics(spark, sf_dir):
    return reports.report_metrics(result_table(spark, sf_dir))


@query(
    "REP-1 REP-2",
    f"""WITH {RESULT_SQL}, a AS (SELECT input_file_number, cast({ACCURACY} AS double) AS accuracy,
        cast({COMMA_ACCURACY} AS double) AS comma_accuracy FROM result)
    SELECT *, CASE WHEN accuracy >= 90 THEN 'Pass' WHEN accuracy >= 70 THEN 'Needs Review' ELSE 'Fail' END AS status FROM a""",
)
def accuracy_and_status(spark, sf_dir):
    rows = result_table(spark, sf_dir)
    return rows.select(
        "input_file_number",
        rules.accuracy("result_content", "result_sql_parse_errors").alias("accuracy"),
        rules.accuracy("result_content", "result_sql_parse_errors", comma_count=True).alias("comma_accuracy"),
    ).withColumn("status", rules.grade("accuracy"))


@query(
    "REP-1",
    f"""WITH {RESULT_SQL} SELECT cast({ACCURACY} AS double) AS accuracy_percent, count(*) AS files FROM result GROUP BY 1""",
)
def filled_accuracy(spark, sf_dir):
    filled = reports.with_accuracy(result_table(spark, sf_dir))
    return filled.groupBy("accuracy_percent").agg(F.count(F.lit(1)).alias("files"))


@query(
    "REP-3",
    f"""WITH {RESULT_SQL}, a AS (SELECT *, cast({ACCURACY} AS double) AS accuracy,
        coalesce(array_to_string(result_sql_parse_errors, ', '), '') AS errors FROM result)
    SELECT input_file_number, cast(doc_id AS varchar) || '_' || lang || '.sql' AS file_name, accuracy, errors,
      md5(input_file_content) AS legacy_sql, md5(coalesce(result_content, '')) AS converted_sql,
      CASE WHEN accuracy >= 90 THEN 'Pass' WHEN accuracy >= 70 THEN 'Needs Review' ELSE 'Fail' END AS status,
      md5(CASE WHEN errors <> '' OR accuracy < 100 THEN '' ELSE coalesce(result_content, '') END) AS shown_sql FROM a""",
)
def migration_report(spark, sf_dir):
    report = reports.migration_report(result_table(spark, sf_dir))
    return report.withColumns({c: F.md5(c) for c in ("legacy_sql", "converted_sql", "shown_sql")})


@query(
    "REP-4",
    f"""WITH {RESULT_SQL} SELECT input_file_number, input_file_path, CASE WHEN result_content IS NULL THEN 'Not converted'
        WHEN {HAS_ERROR} THEN 'Converted with errors' ELSE 'Converted successfully' END AS conversion_status,
      CASE WHEN export_status IS NULL THEN 'Not exported' WHEN export_status = 'exported' THEN 'Exported successfully'
        ELSE 'Export failed' END AS export_status, export_output_path, coalesce(export_content_size_bytes, 0) AS content_size_bytes,
      coalesce(CASE WHEN result_python_parse_error IS NOT NULL THEN 'Python errors: ' || result_python_parse_error
        WHEN coalesce(len(result_sql_parse_errors), 0) > 0 THEN 'SQL errors (' || len(result_sql_parse_errors) || '): '
          || array_to_string(result_sql_parse_errors, '; ')
        WHEN result_error IS NOT NULL THEN 'Conversion error: ' || result_error
        WHEN export_error IS NOT NULL THEN 'Export error: ' || export_error END, 'none') AS error_details
    FROM result WHERE result_content IS NOT NULL OR result_error IS NOT NULL""",
)
def status_detail(spark, sf_dir):
    detail = reports.status_detail(result_table(spark, sf_dir))
    return detail.withColumns(
        {
            "error_details": F.coalesce("error_details", F.lit("none")),
            "content_size_bytes": F.col("content_size_bytes").cast("long"),
        }
    )


@query(
    "REP-5",
    f"""WITH {RESULT_SQL} SELECT input_file_number, CASE WHEN {HAS_ERROR} THEN 'Has errors' ELSE 'No errors' END AS check_status
    FROM result""",
)
def check_status(spark, sf_dir):
    return reports.check_status(result_table(spark, sf_dir)).select("input_file_number", "check_status")


@query(
    "REP-6",
    f"""WITH {EXPORTS} SELECT python_notebook_path, CASE WHEN success THEN 'Successfully converted and exported'
      ELSE 'Failed to convert or export' END AS conversion_status, sql_output_path,
      round(cast(size_mb AS double), 2) AS size_mb, coalesce(error, 'none') AS error FROM exports""",
)
def export_detail(spark, sf_dir):
    return reports.export_detail(_exports(spark, sf_dir)).withColumn("error", F.coalesce("error", F.lit("none")))


@query(
    "REP-6",
    f"WITH {EXPORTS} SELECT count(*) FILTER (success) || '/' || count(*) AS converted FROM exports",
)
def export_share(spark, sf_dir):
    return reports.export_share(_exports(spark, sf_dir))


@query("REP-7", f"WITH {EXPORTS} SELECT python_notebook_path, error FROM exports WHERE error IS NOT NULL")
def error_listing(spark, sf_dir):
    return reports.error_listing(_exports(spark, sf_dir))


START_MS = "CASE WHEN event_id % 50 = 0 THEN NULL ELSE {epoch} END"
PARAM = "CASE event_type WHEN 'click' THEN '/Workspace/Shared/a' WHEN 'view' THEN '' ELSE NULL END"


@query(
    "REP-8 LIM-3 DT-13 DT-17",
    f"""WITH r AS (SELECT event_id AS run_id, {START_MS.replace('{epoch}', "epoch_ms(date_trunc('second', ts))")} AS s,
        epoch_ms(date_trunc('second', ts)) + cast(round(value * 100) AS bigint) AS e,
        CASE event_type WHEN 'error' THEN 'UNKNOWN' ELSE event_type END AS status,
        coalesce(nullif({PARAM}, ''), '/Workspace/job/' || user_id) AS dir FROM events),
      n AS (SELECT * FROM r ORDER BY coalesce(s, 0) DESC, run_id LIMIT 250)
    SELECT run_id, strftime(epoch_ms(s) + INTERVAL 330 MINUTE, '%b %d, %Y, %I:%M %p') AS start_time, status,
      round(cast(e - s AS double) / 1000.0, 1) AS duration, dir AS output_dir,
      'https://host/#workspace' || replace(dir, '/Workspace', '') AS output_link FROM n""",
)
def run_history(spark, sf_dir):
    epoch = "unix_seconds(cast(ts AS timestamp)) * 1000"
    runs = table(spark, sf_dir, "events").selectExpr(
        "event_id AS run_id",
        START_MS.replace("{epoch}", epoch) + " AS start_ms",
        f"{epoch} + cast(round(value * 100) AS bigint) AS end_ms",
        "CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS result_state",
        f"CASE WHEN event_type IN ('click', 'view') THEN map('output_dir', {PARAM}) ELSE NULL END AS override_params",
        "map('x', 'y', 'output_dir', '/Workspace/job/' || cast(user_id AS string)) AS job_params",
    )
    return reports.run_history(runs, host="host", limit=250)


@query(
    "LIM-3",
    "SELECT event_id, value FROM events ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END DESC, event_id LIMIT 40",
)
def latest_events(spark, sf_dir):
    from dialoom.operators.relational import latest

    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "value", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS mark"
    )
    return latest(rows, "mark", 40, tie="event_id").select("event_id", "value")


@query(
    "REP-9",
    """WITH p AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 60
      ELSE cast(trunc(cast(i AS double) / n * 30) AS int) END AS progress FROM p""",
)
def upload_progress(spark, sf_dir):
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = reports.progress(
        rows, ["user_id"], ["ts", "event_id"], running=kind == "signup", done=kind == "purchase"
    )
    return out.select("event_id", "progress")


@query(
    "REP-10",
    """SELECT doc_id, (octet_length(encode(text)) + 2) // 3 * 4 AS encoded_size,
      CASE WHEN (octet_length(encode(text)) + 2) // 3 * 4 > 2000 THEN 'export_failed' ELSE 'exported' END AS export_status,
      CASE WHEN (octet_length(encode(text)) + 2) // 3 * 4 > 2000 THEN 'Content size exceeds 10MB limit' ELSE 'none' END AS export_error
    FROM documents""",
)
def export_size_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    gated = reports.export_gate(docs, max_bytes=2000)
    return gated.select(
        "doc_id", "encoded_size", "export_status", F.coalesce("export_error", F.lit("none")).alias("export_error")
    )


ANSWER = """CASE doc_id % 4 WHEN 0 THEN 'Error calling model: down' WHEN 1 THEN 'I think it is fine'
  WHEN 2 THEN '{"overall_score": 0.' || cast(n_chars % 9 AS string) || ', "critical_errors": ["a", "b"]}'
  ELSE 'Result: {"overall_score": 1.0, "summary_reasoning": "ok ' || lang || '"} done' END"""
SCORE = "CASE doc_id % 4 WHEN 2 THEN cast('0.' || (n_chars % 9) AS double) WHEN 3 THEN 1.0 ELSE 0.0 END"
KIND = """CASE doc_id % 10 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'TABLE' WHEN 3 THEN 'VIEW' WHEN 4 THEN 'PROCEDURE'
  WHEN 5 THEN 'FUNCTION' WHEN 7 THEN 'SEQUENCE' WHEN 8 THEN 'MACRO' WHEN 9 THEN 'TYPE' ELSE 'UNKNOWN' END"""


@query(
    "JDG-1",
    f"""SELECT doc_id, {SCORE} AS overall_score, CASE doc_id % 4 WHEN 0 THEN 'Endpoint Error: judge' WHEN 1 THEN
        'Model returned invalid format.' WHEN 2 THEN 'none' ELSE 'ok ' || lang END AS summary_reasoning,
      CASE doc_id % 4 WHEN 0 THEN 'Endpoint Offline' WHEN 1 THEN 'JSON Parse Error' WHEN 2 THEN 'a;b' ELSE 'none' END AS critical_errors,
      {KIND} AS object_type_detected FROM documents""",
)
def judge_answers(spark, sf_dir):
    judged = reports.judge(_answers(spark, sf_dir), "response", "content", model="judge")
    return judged.select(
        "doc_id",
        "overall_score",
        F.coalesce("summary_reasoning", F.lit("none")).alias("summary_reasoning"),
        F.coalesce(F.array_join("critical_errors", ";"), F.lit("none")).alias("critical_errors"),
        "object_type_detected",
    )


def _answers(spark, sf_dir):
    return scripts(spark, sf_dir).selectExpr("doc_id", "content", f"{ANSWER} AS response")


@query(
    "JDG-1",
    f"""WITH {SCRIPTS_SQL}, s AS (SELECT {KIND} AS object_type_detected, {SCORE} AS x FROM scripts)
    SELECT object_type_detected, count(*) AS scripts, round(avg(x), 9) AS avg_score FROM s GROUP BY object_type_detected""",
)
def judge_scores(spark, sf_dir):
    scores = reports.judge_scores(reports.judge(_answers(spark, sf_dir), "response", "content"))
    return scores.withColumn("avg_score", F.round("avg_score", 9))
