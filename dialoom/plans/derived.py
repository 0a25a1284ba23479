"""Frames Spark derives from the given tables: scripts around each document, a result table, logs.

The defining expressions are plain SQL that Spark and the SQL check both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.plans.registry import table

# One SQL script per document: a comment line, a statement head, the whole text as a block comment,
# blank lines and a query. Heads and tails vary over the documents.
SCRIPT_PATH = "'/in/' || source || '/up_' || cast(doc_id AS string) || '_' || lang || '.sql'"
SCRIPT_HEAD = """CASE doc_id % 10
  WHEN 0 THEN 'create or  replace table' WHEN 1 THEN 'CREATE MULTISET TABLE' WHEN 2 THEN 'CREATE VOLATILE TABLE'
  WHEN 3 THEN 'create view' WHEN 4 THEN 'REPLACE PROCEDURE' WHEN 5 THEN 'CREATE OR REPLACE FUNCTION'
  WHEN 6 THEN 'MERGE INTO' WHEN 7 THEN 'Create Sequence' WHEN 8 THEN 'REPLACE MACRO' ELSE 'CREATE TYPE' END"""
SCRIPT_TAIL = """CASE doc_id % 7
  WHEN 0 THEN ' (a INT DEFAULT NEWID(), CHECK (a > 0), PRIMARY KEY (a DESC)) USING DELTA'
  WHEN 1 THEN ' WITH SCHEMABINDING AS SELECT a::int FROM b WHERE b.k = c.k(+)'
  WHEN 2 THEN ' BEGIN COMMIT; END' WHEN 3 THEN ' (a INT UNIQUE) CLUSTERED'
  WHEN 4 THEN ' BEGIN RETURN 1; END' WHEN 5 THEN ' USING DELTA' ELSE '' END"""
SCRIPT_CONTENT = (
    f"'-- ' || source || ' -- note' || chr(10) || ({SCRIPT_HEAD}) || ' obj_' || cast(doc_id AS string) "
    f"|| ({SCRIPT_TAIL}) || chr(10) || '/* ' || text || ' */' || chr(10) || '  ' || chr(10) || chr(9) || chr(10) "
    "|| 'SELECT ''' || lang || ''' AS lang, ' || cast(n_chars AS string) || ' AS n -- tail' || chr(10)"
)
SCRIPTS_SQL = (
    f"scripts AS (SELECT doc_id, lang, source, n_chars, {SCRIPT_PATH} AS path, {SCRIPT_CONTENT} AS content "
    "FROM documents)"
)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "source", "n_chars", f"{SCRIPT_PATH} AS path", f"{SCRIPT_CONTENT} AS content"
    )


# One Python script per document with two SQL calls, the whole text as a string, and for some
# documents a syntax error or trailing comments.
PY_CONTENT = """'# script ' || source || chr(10) || 'import os' || chr(10) || chr(10) || '# load' || chr(10)
 || 't = "tab_' || cast(doc_id AS string) || '"' || chr(10)
 || 'df = spark.sql(f"SELECT * FROM {t} WHERE n = {x}")' || chr(10) || chr(10) || chr(10)
 || 'note = \"\"\"' || text || chr(10) || '\"\"\"' || chr(10)
 || 'spark.sql("SELECT ' || cast(n_chars AS string) || ' AS n" + " FROM " + t)' || chr(10)
 || CASE doc_id % 6 WHEN 1 THEN 'def (' || chr(10) WHEN 2 THEN chr(10) || '# end' || chr(10)
    WHEN 3 THEN chr(10) || '# tail' || chr(10) || 'spark.sql("SELEC (1")' ELSE '' END"""
PY_SQL = f"pys AS (SELECT doc_id, lang, source, text, n_chars, {PY_CONTENT} AS code FROM documents)"


def python_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "source", "text", "n_chars", f"{PY_CONTENT} AS code"
    )


# A result table over the documents: some rows without content, some failed, some with errors.
RESULT_PARTS = {
    "input_file_number": "cast(doc_id + 1 AS int)",
    "input_file_path": SCRIPT_PATH,
    "input_file_token_count_preprocessed": "cast(n_chars / cast(3.4 AS double) AS int)",
    "is_conversion_target": "n_chars < 4000",
    "input_file_content": "text",
    "result_content": "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '  ' "
    "ELSE '```python' || chr(10) || text || chr(10) || '```' END",
    "result_prompt_tokens": "cast(n_chars % 1000 AS int)",
    "result_completion_tokens": "cast(n_chars % 700 AS int)",
    "result_total_tokens": "cast(n_chars % 1000 + n_chars % 700 AS int)",
    "result_error": "CASE WHEN doc_id % 10 = 0 THEN 'HTTP 500 for ' || source ELSE NULL END",
    "result_python_parse_error": "CASE WHEN doc_id % 13 = 0 THEN 'Python syntax error: ' || lang ELSE NULL END",
    "export_output_path": "'/out/' || source || '_' || cast(doc_id AS string)",
    "export_status": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'exported' "
    "ELSE 'export_failed' END",
    "export_error": "CASE WHEN doc_id % 3 = 2 THEN 'disk full' ELSE NULL END",
    "export_content_size_bytes": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END",
}
# Number of SQL errors per row: -1 is a NULL array; some messages hold commas.
SQL_ERROR_COUNT = "CASE WHEN doc_id % 4 = 0 THEN -1 ELSE cast(doc_id % 9 AS int) % 5 END"
DUCK_ERRORS = (
    f"CASE WHEN ({SQL_ERROR_COUNT}) < 0 THEN NULL ELSE list_transform(range(({SQL_ERROR_COUNT})), "
    "lambda i: 'Error in query ' || i || ': near ' || lang || ', ' || source) END"
)
RESULT_SQL = (
    "result AS (SELECT doc_id, lang, source, "
    + ", ".join(f"{expr} AS {name}" for name, expr in RESULT_PARTS.items()).replace(
        "cast(n_chars / cast(3.4 AS double) AS int)", "cast(trunc(n_chars / cast(3.4 AS double)) AS int)"
    )
    + f", {DUCK_ERRORS} AS result_sql_parse_errors FROM documents)"
)


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dialoom.schema import with_result_columns

    docs = table(spark, sf_dir, "documents")
    errors = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), F.greatest(F.expr(SQL_ERROR_COUNT), F.lit(0))),
        lambda i: F.concat(
            F.lit("Error in query "), i.cast("string"), F.lit(": near "), F.col("lang"), F.lit(", "), F.col("source")
        ),
    )
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        *[F.expr(expr).alias(name) for name, expr in RESULT_PARTS.items()],
        F.when(F.expr(SQL_ERROR_COUNT) >= 0, errors).alias("result_sql_parse_errors"),
    )
    return with_result_columns(rows)


# Warehouse tables in the shapes of the workloads.
def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_name", "c_nationkey", "c_mktsegment AS region"
    )


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "cast(o_orderdate AS date) AS order_date",
        "cast(o_totalprice AS decimal(10,2)) AS order_amount",
        "o_orderstatus AS order_status",
    )
