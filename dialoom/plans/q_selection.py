"""Row selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import dates, rules
from dialoom.functions import text as tx
from dialoom.operators import selection as sel
from dialoom.plans.derived import RESULT_SQL, result_table
from dialoom.plans.registry import query, table

NULLABLE_TOKENS = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE cast(n_chars AS int) END"


@query(
    "FIL-1",
    f"SELECT doc_id, coalesce(NOT (t > 416), true) AS is_conversion_target FROM "
    f"(SELECT doc_id, {NULLABLE_TOKENS} AS t FROM documents)",
)
def select_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NULLABLE_TOKENS} AS t")
    return sel.select_targets(docs, 416, "t").drop("t")


@query(
    "FIL-2",
    f"WITH {RESULT_SQL} SELECT input_file_number, input_file_path, input_file_token_count_preprocessed FROM result "
    "WHERE is_conversion_target",
)
def target_list(spark, sf_dir):
    return sel.targets(sel.require_targets(result_table(spark, sf_dir)))


@query(
    "FIL-2",
    f"WITH {RESULT_SQL} SELECT input_file_number, input_file_path, input_file_token_count_preprocessed FROM result "
    "WHERE NOT is_conversion_target",
)
def over_threshold_list(spark, sf_dir):
    return sel.over_threshold(result_table(spark, sf_dir))


@query(
    "FIL-3",
    f"""WITH {RESULT_SQL} SELECT input_file_number, input_file_path, md5(result_content) AS result_content,
      input_file_token_count_preprocessed, result_prompt_tokens, result_completion_tokens, result_total_tokens
    FROM result WHERE result_content IS NOT NULL""",
)
def converted_rows(spark, sf_dir):
    out = sel.converted(result_table(spark, sf_dir)).drop("result_timestamp")
    return out.withColumn("result_content", F.md5("result_content"))


@query(
    "FIL-3",
    f"WITH {RESULT_SQL} SELECT input_file_number, input_file_path, result_error FROM result "
    "WHERE result_error IS NOT NULL",
)
def failed_rows(spark, sf_dir):
    return sel.failed(result_table(spark, sf_dir)).drop("result_timestamp")


@query(
    "FIL-4",
    f"""WITH {RESULT_SQL} SELECT input_file_number, (result_python_parse_error IS NOT NULL
      OR coalesce(len(result_sql_parse_errors), 0) > 0) AS has_error FROM result""",
)
def syntax_error_flag(spark, sf_dir):
    return result_table(spark, sf_dir).select(
        "input_file_number",
        rules.has_syntax_error("result_python_parse_error", "result_sql_parse_errors").alias("has_error"),
    )


PLACED_MARK = """CASE doc_id % 4 WHEN 0 THEN '# Databricks notebook source' || chr(10) || text
  WHEN 1 THEN left(text, 300) || '# MAGIC %md' || text WHEN 2 THEN repeat('x', 500) || '# MAGIC' || text
  ELSE text || '# COMMAND ----------' END"""


@query(
    "FIL-5",
    f"""SELECT doc_id, (contains(left(body, 500), '# Databricks notebook source')
      OR contains(left(body, 500), '# MAGIC') OR contains(left(body, 500), '# COMMAND ----------')) AS notebook
    FROM (SELECT doc_id, {PLACED_MARK} AS body FROM documents)""",
)
def notebook_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PLACED_MARK} AS body")
    return docs.select("doc_id", tx.is_notebook("body").alias("notebook"))


SKIP_BODY = f"CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {PLACED_MARK} END"


@query(
    "FIL-6",
    f"""SELECT skip_reason, count(*) AS documents FROM (SELECT CASE WHEN body IS NULL THEN 'Could not read file'
      WHEN NOT (contains(left(body, 500), '# Databricks notebook source') OR contains(left(body, 500), '# MAGIC')
        OR contains(left(body, 500), '# COMMAND ----------')) THEN 'Not a Databricks notebook' ELSE 'kept' END
        AS skip_reason FROM (SELECT {SKIP_BODY} AS body FROM documents)) GROUP BY skip_reason""",
)
def skip_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(f"{SKIP_BODY} AS content")
    marked = sel.with_skip_reason(docs).select(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason"))
    return marked.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "FIL-7",
    f"""WITH {RESULT_SQL} SELECT 7 AS n_columns, least(count(*), 1000) AS n_rows FROM result""",
)
def report_load(spark, sf_dir):
    loaded = sel.report_columns(result_table(spark, sf_dir), 1000)
    return loaded.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(len(loaded.columns)).alias("n_columns"), "n_rows")


@query(
    "FIL-8 DT-16 AGG-5",
    """SELECT period, o_orderpriority, o_orderstatus, cast(sum(cast(o_totalprice AS decimal(19,4))) AS double) AS amount
    FROM (SELECT strftime(o_orderdate, '%Y%m') AS period, * FROM orders)
    WHERE period IN ('199512', '199612') OR period >= strftime(DATE '2001-03-15' - INTERVAL 6 MONTH, '%Y%m')
    GROUP BY period, o_orderpriority, o_orderstatus""",
)
def consumption_periods(spark, sf_dir):
    """Monthly amounts of fixed periods or the rolling last six months."""
    from dialoom.operators.relational import rollup_sum

    rows = table(spark, sf_dir, "orders").select(
        dates.period("o_orderdate").alias("period"), "o_orderpriority", "o_orderstatus", "o_totalprice"
    )
    kept = rows.filter(dates.in_periods("period", ["199512", "199612"], 6, "2001-03-15"))
    summed = rollup_sum(kept, ["period", "o_orderpriority", "o_orderstatus"], "o_totalprice")
    return summed.withColumn("amount", F.col("amount").cast("double"))


@query(
    "FIL-9",
    """SELECT 'exists' AS side, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders
      WHERE o_custkey = c_custkey AND o_totalprice > 490000)
    UNION ALL SELECT 'not exists', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders
      WHERE o_custkey = c_custkey AND o_totalprice > 490000)""",
)
def exists_gate(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey")
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 490000").selectExpr("o_custkey AS c_custkey")
    yes = sel.where_exists(people, big, ["c_custkey"]).select(F.lit("exists").alias("side"), "c_custkey")
    no = sel.where_exists(people, big, ["c_custkey"], negate=True)
    return yes.unionByName(no.select(F.lit("not exists").alias("side"), "c_custkey"))


JOB_COLUMNS = {
    "target_type": "CASE event_type WHEN 'click' THEN 'file' WHEN 'error' THEN NULL WHEN 'view' THEN 'pdf' "
    "ELSE 'notebook' END",
    "source_format": "CASE WHEN user_id % 3 = 0 THEN 'generic' ELSE 'sql' END",
    "log_level": "CASE WHEN user_id % 4 = 0 THEN 'debug' ELSE 'INFO' END",
    "token_count_threshold": "cast(event_id % 5 AS int) - 1",
    "concurrency": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(event_id % 3 AS int) END",
    "max_fix_attempts": "cast(event_id % 4 AS int) - 1",
    "request_params": "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN props ELSE '{' || props END",
    "output_dir": "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN '/tmp/x' "
    "ELSE '/Workspace/' || event_type END",
    "sql_output_dir": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'rel' ELSE '/Shared/y' END",
    "output_extension": "CASE WHEN user_id % 2 = 0 THEN '.py' ELSE NULL END",
}
JOBS = ", ".join(f"{expr} AS {name}" for name, expr in JOB_COLUMNS.items())


@query(
    "FIL-10",
    f"""WITH j AS (SELECT event_id, {JOBS} FROM events)
    SELECT event_id, array_to_string(list_filter([
      CASE WHEN target_type IS NULL THEN 'target_type is required but got None'
        WHEN target_type NOT IN ('notebook', 'file')
        THEN 'Invalid target_type: ''' || target_type || '''. Supported: notebook, file' END,
      CASE WHEN source_format NOT IN ('sql', 'generic') THEN 'bad' END,
      CASE WHEN log_level NOT IN ('DEBUG', 'INFO', 'WARNING', 'ERROR')
        THEN 'Invalid log_level: ''' || log_level || '''. Supported: DEBUG, INFO, WARNING, ERROR' END,
      CASE WHEN token_count_threshold <= 0
        THEN 'token_count_threshold must be positive, got: ' || token_count_threshold END,
      CASE WHEN concurrency IS NULL THEN 'concurrency is required but got None'
        WHEN concurrency <= 0 THEN 'concurrency must be positive, got: ' || concurrency END,
      CASE WHEN max_fix_attempts < 0 THEN 'max_fix_attempts must be non-negative, got: ' || max_fix_attempts END,
      CASE WHEN request_params <> '' AND NOT json_valid(request_params)
        THEN 'request_params is not valid JSON' END,
      CASE WHEN output_dir = '' THEN 'output_dir is required' WHEN NOT starts_with(output_dir, '/Workspace/')
        THEN 'output_dir must be a workspace path (start with /Workspace/, /Users/, or /Shared/), got: ' || output_dir END,
      CASE WHEN sql_output_dir IS NOT NULL AND NOT starts_with(sql_output_dir, '/Shared/')
        THEN 'sql_output_dir must be a workspace path (start with /Workspace/, /Users/, or /Shared/), got: '
          || sql_output_dir END,
      CASE WHEN target_type = 'file' AND output_extension IS NULL
        THEN 'output_extension is required when target_type=''file''' END
    ], lambda x: x IS NOT NULL), ' | ') AS errors FROM j""",
)
def check_job_rows(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").selectExpr(
        "event_id", *[f"{expr} AS {name}" for name, expr in JOB_COLUMNS.items()]
    )
    checked = sel.check_rows(jobs, sel.job_checks())
    return checked.select("event_id", F.array_join("errors", " | ").alias("errors"))


SEGMENTS = ("Building", "FURNITURE", "machinery", "HouseHold")
MIXED = "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment ELSE 'x' || c_mktsegment END"


@query(
    "FIL-11",
    f"""SELECT c_custkey, CASE WHEN v IN {SEGMENTS} THEN v ELSE CASE lower(v) WHEN 'building' THEN 'Building'
      WHEN 'furniture' THEN 'FURNITURE' WHEN 'machinery' THEN 'machinery' WHEN 'household' THEN 'HouseHold'
      ELSE v END END AS segment FROM (SELECT c_custkey, {MIXED} AS v FROM customer)""",
)
def normalize_enum_values(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MIXED} AS v")
    return people.select("c_custkey", sel.normalize_enum("v", SEGMENTS).alias("segment"))


@query(
    "FIL-11",
    """SELECT c_custkey, CASE WHEN lower(v) IN ('region_1', 'nation_3') THEN upper(v) ELSE v END AS v FROM (
      SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'nation_3' ELSE c_mktsegment END AS v FROM customer)""",
)
def normalize_enum_by_table(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_nationkey = 3 THEN 'nation_3' ELSE c_mktsegment END AS v"
    )
    return sel.join_enum(people, "v", table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")))
