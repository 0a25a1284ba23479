"""Script queries: object kinds, Python checks, cells, documents, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.functions import scripts as sc
from dialoom.operators import scripts as ops
from dialoom.plans.derived import PY_SQL, RESULT_SQL, SCRIPTS_SQL, python_scripts, result_table, scripts
from dialoom.plans.registry import query, table

KIND = """CASE doc_id % 10 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'TABLE' WHEN 3 THEN 'VIEW' WHEN 4 THEN 'PROCEDURE'
  WHEN 5 THEN 'FUNCTION' WHEN 7 THEN 'SEQUENCE' WHEN 8 THEN 'MACRO' WHEN 9 THEN 'TYPE' ELSE 'UNKNOWN' END"""


@query("SCR-1", f"SELECT doc_id, {KIND} AS object_type FROM documents")
def classify_objects(spark, sf_dir):
    return scripts(spark, sf_dir).select("doc_id", sc.classify_object("content").alias("object_type"))


# Lines of a Python script before its last part: eight fixed ones, the text, the closing quotes, one call.
TEXT_LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"
PY_ERROR = f"""CASE WHEN doc_id % 6 = 1 THEN 'Python syntax error: invalid syntax (<unknown>, line ' || ({TEXT_LINES} + 11) || ')'
  ELSE 'none' END"""
FIRST_CALL = "'SELECT * FROM tab_' || doc_id || ' WHERE n = _placeholder_'"
SECOND_CALL = "'SELECT ' || n_chars || ' AS n FROM tab_' || doc_id"


@query("SCR-2", f"WITH {PY_SQL} SELECT doc_id, {PY_ERROR} AS error, CASE doc_id % 6 WHEN 1 THEN 0 WHEN 3 THEN 3 ELSE 2 END AS statements FROM pys")
def check_python_scripts(spark, sf_dir):
    checked = ops.syntax_check_python(python_scripts(spark, sf_dir).select("doc_id", "code"), "code")
    return checked.select(
        "doc_id",
        F.coalesce("result_python_parse_error", F.lit("none")).alias("error"),
        F.size("result_extracted_sqls").alias("statements"),
    )


@query(
    "SCR-2",
    """SELECT source, count(*) AS files, count(*) FILTER (doc_id % 6 = 1) AS failed,
      cast(count(*) FILTER (doc_id % 6 = 1) AS double) / count(*) AS error_rate FROM documents GROUP BY source""",
)
def python_error_rate(spark, sf_dir):
    checked = ops.syntax_check_python(python_scripts(spark, sf_dir).select("source", "code"), "code")
    return ops.error_rate(checked, "source")


@query(
    "SCR-2",
    "SELECT 'Python syntax error: invalid syntax' AS error_class, count(*) AS files FROM documents WHERE doc_id % 6 = 1",
)
def python_error_classes(spark, sf_dir):
    return ops.error_classes(ops.syntax_check_python(python_scripts(spark, sf_dir).select("code"), "code"))


@query(
    "SCR-3",
    f"""SELECT doc_id, cast(idx AS int) AS idx, sql FROM (
      SELECT doc_id, 0 AS idx, {FIRST_CALL} AS sql FROM documents WHERE doc_id % 6 <> 1
      UNION ALL SELECT doc_id, 1, {SECOND_CALL} FROM documents WHERE doc_id % 6 <> 1
      UNION ALL SELECT doc_id, 2, 'SELEC (1' FROM documents WHERE doc_id % 6 = 3)""",
)
def extract_sql_statements(spark, sf_dir):
    return ops.extract_sql(python_scripts(spark, sf_dir), "doc_id", "code")


@query(
    "SCR-4",
    f"""WITH {SCRIPTS_SQL} SELECT doc_id, md5(replace(replace(trim(replace(replace(c, chr(10), ' '), chr(13), ' ')), '{{', ''), '}}', ''))
      AS flat FROM (SELECT doc_id, ' {{' || content || chr(10) || chr(13) || '}} ' AS c FROM scripts)""",
)
def flatten_statements(spark, sf_dir):
    wrapped = scripts(spark, sf_dir).select(
        "doc_id", F.concat(F.lit(" {"), "content", F.lit("\n\r} ")).alias("c")
    )
    return wrapped.select("doc_id", F.md5(sc.flatten_sql("c")).alias("flat"))


@query(
    "SCR-5",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 3 THEN 'Error in query 2: unclosed bracket' ELSE '' END AS errors FROM documents""",
)
def check_sql_statements(spark, sf_dir):
    checked = ops.syntax_check_python(python_scripts(spark, sf_dir).select("doc_id", "code"), "code")
    return ops.attach_sql_checks(checked).select("doc_id", F.array_join("result_sql_parse_errors", "; ").alias("errors"))


def _too_long(sql: str) -> str | None:
    return f"long JVM stacktrace:\n\tat {sql}" if len(sql) > 47 else None


@query(
    "SCR-5",
    f"""SELECT doc_id, array_to_string(list_filter([
      CASE WHEN doc_id % 6 <> 1 AND length({FIRST_CALL}) > 47 THEN 'Error in query 0: long' END,
      CASE WHEN doc_id % 6 <> 1 AND length({SECOND_CALL}) > 47 THEN 'Error in query 1: long' END],
      lambda x: x IS NOT NULL), '; ') AS errors FROM documents""",
)
def check_sql_with_function(spark, sf_dir):
    checked = ops.syntax_check_python(python_scripts(spark, sf_dir).select("doc_id", "code"), "code")
    out = ops.attach_sql_checks(checked, _too_long)
    return out.select("doc_id", F.array_join("result_sql_parse_errors", "; ").alias("errors"))


FAULTY = """CASE doc_id % 8 WHEN 0 THEN 'SELECT 1; -- ' || text WHEN 1 THEN 'select ''' || replace(text, chr(39), '') || ''' AS t'
  WHEN 2 THEN 'SELECT ''' || text WHEN 3 THEN 'SELECT /* ' || text WHEN 4 THEN 'SELECT (1))' WHEN 5 THEN 'SELECT ((1)'
  WHEN 6 THEN 'SEL 1 -- (' ELSE '/* ' || text || ' */' END"""


@query(
    "SCR-5",
    """SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN 'unclosed quote' WHEN 3 THEN CASE WHEN contains(text, '"')
        AND (length(text) - length(replace(text, '"', ''))) % 2 = 1 THEN 'unclosed quote' ELSE 'unclosed comment' END
      WHEN 4 THEN 'closing bracket without an opening one' WHEN 5 THEN 'unclosed bracket' WHEN 6 THEN 'unknown statement: SEL'
      WHEN 7 THEN 'empty statement' ELSE 'none' END AS error FROM documents""",
)
def statement_faults(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{FAULTY} AS s")
    return rows.select("doc_id", F.coalesce(ops.statement_error("s"), F.lit("none")).alias("error"))


@query(
    "SCR-6",
    f"""WITH r AS (SELECT doc_id, {KIND} AS k, doc_id % 7 AS t FROM documents)
    SELECT doc_id, array_to_string(list_filter([
      CASE WHEN k = 'TABLE' AND t IN (0, 3) THEN 'table_check_or_unique' END,
      CASE WHEN k = 'TABLE' AND t = 0 THEN 'table_default_expression' END,
      CASE WHEN k = 'TABLE' AND t = 0 THEN 'table_volatile_default' END,
      CASE WHEN k = 'TABLE' AND t = 3 THEN 'table_index_keyword' END,
      CASE WHEN k = 'TABLE' AND t = 0 THEN 'table_key_direction' END,
      CASE WHEN k = 'TABLE' AND t NOT IN (0, 5) THEN 'table_missing_delta' END,
      CASE WHEN k = 'VIEW' THEN 'view_not_create_or_replace' END,
      CASE WHEN k = 'VIEW' AND t = 1 THEN 'view_outer_join_mark' END,
      CASE WHEN k = 'VIEW' AND t = 1 THEN 'view_schemabinding' END,
      CASE WHEN k = 'VIEW' AND t = 1 THEN 'view_double_colon_cast' END,
      CASE WHEN k = 'PROCEDURE' AND t = 2 THEN 'procedure_transaction' END,
      CASE WHEN k = 'FUNCTION' AND t IN (2, 4) THEN 'function_block' END], lambda x: x IS NOT NULL), ',') AS lint FROM r""",
)
def lint_scripts(spark, sf_dir):
    kinds = scripts(spark, sf_dir).select("doc_id", "content", sc.classify_object("content").alias("k"))
    return kinds.select("doc_id", F.array_join(sc.lint_sql("content", "k"), ",").alias("lint"))


@query(
    "SCR-6",
    f"""WITH r AS (SELECT {KIND} AS k, doc_id % 7 AS t FROM documents)
    SELECT rule, count(*) AS scripts FROM r JOIN (VALUES ('TABLE', [0, 3], 'table_check_or_unique'),
      ('TABLE', [0], 'table_default_expression'), ('TABLE', [0], 'table_volatile_default'), ('TABLE', [3], 'table_index_keyword'),
      ('TABLE', [0], 'table_key_direction'), ('TABLE', [1, 2, 3, 4, 6], 'table_missing_delta'),
      ('VIEW', [0, 1, 2, 3, 4, 5, 6], 'view_not_create_or_replace'), ('VIEW', [1], 'view_outer_join_mark'),
      ('VIEW', [1], 'view_schemabinding'), ('VIEW', [1], 'view_double_colon_cast'), ('PROCEDURE', [2], 'procedure_transaction'),
      ('FUNCTION', [2, 4], 'function_block')) AS fires(kind, tails, rule) ON k = kind AND list_contains(tails, t) GROUP BY rule""",
)
def lint_rule_frequency(spark, sf_dir):
    kinds = scripts(spark, sf_dir).select("content", sc.classify_object("content").alias("k"))
    return ops.lint_frequency(kinds.select(sc.lint_sql("content", "k").alias("lint")), "lint")


ALL_LINES = "cast(length(code) - length(replace(code, chr(10), '')) + 1 AS int)"
LAST_CALL = f"({TEXT_LINES} + 10)"


@query(
    "SCR-7",
    f"""WITH {PY_SQL}, w AS (SELECT doc_id, {ALL_LINES} AS lines, string_split(code, chr(10)) AS l,
        cast({LAST_CALL} AS int) AS call_line FROM pys),
      c AS (SELECT doc_id, 1 AS cell_no, 1 AS a, CASE WHEN doc_id % 6 = 1 THEN lines ELSE 3 END AS b, l FROM w
        UNION ALL SELECT doc_id, 2, 4, 8, l FROM w WHERE doc_id % 6 <> 1
        UNION ALL SELECT doc_id, 3, 9, CASE WHEN doc_id % 6 = 3 THEN call_line + 1 ELSE lines END, l FROM w WHERE doc_id % 6 <> 1
        UNION ALL SELECT doc_id, 4, call_line + 2, lines, l FROM w WHERE doc_id % 6 = 3)
    SELECT doc_id, cell_no, a AS start_line, b AS end_line, md5(array_to_string(l[a:b], chr(10))) AS text FROM c""",
)
def split_cells(spark, sf_dir):
    cells = ops.split_cells(python_scripts(spark, sf_dir), "doc_id", "code")
    return cells.withColumn("text", F.md5("text"))


@query(
    "SCR-7",
    f"""WITH {PY_SQL}, w AS (SELECT doc_id, code, string_split(code, chr(10)) AS l, cast({LAST_CALL} AS int) AS k FROM pys),
      m AS (SELECT '# COMMAND ----------' || chr(10) AS m)
    SELECT doc_id, md5(CASE doc_id % 6 WHEN 1 THEN m || code WHEN 3 THEN m || array_to_string(l[1:3], chr(10)) || chr(10) || m
        || array_to_string(l[4:8], chr(10)) || chr(10) || m || array_to_string(l[9:k + 1], chr(10)) || chr(10) || m
        || array_to_string(l[k + 2:], chr(10))
      ELSE m || array_to_string(l[1:3], chr(10)) || chr(10) || m || array_to_string(l[4:8], chr(10)) || chr(10) || m
        || array_to_string(l[9:], chr(10)) END) AS notebook FROM w, m""",
)
def join_cells(spark, sf_dir):
    cells = ops.with_cells(python_scripts(spark, sf_dir).select("doc_id", "code"), "code")
    return cells.select("doc_id", F.md5(ops.join_cells("cells")).alias("notebook"))


COMPOSED = """'# Databricks notebook source' || chr(10) || '# MAGIC %md' || chr(10) || '# MAGIC # ' || source || '_' || doc_id
  || chr(10) || '# MAGIC Dieses Notebook wurde automatisch aus dem unten stehenden Skript konvertiert. Es kann Fehler enthalten, verwenden Sie es als Ausgangspunkt und nehmen Sie die notwendigen Korrekturen vor.'
  || chr(10) || '# MAGIC ' || chr(10) || '# MAGIC Quellskript: `' || input_file_path || '`' || chr(10)
  || '# COMMAND ----------' || chr(10) || result_content || chr(10) || '# COMMAND ----------' || chr(10) || '# MAGIC %md'
  || chr(10) || '# MAGIC ## Ergebnisse der statischen Syntaxprüfung' || chr(10)"""
FOUND = """'# MAGIC Dies sind Fehler aus statischen Syntaxprüfungen. Für diese Fehler sind manuelle Korrekturen erforderlich.' || chr(10)
  || CASE WHEN result_python_parse_error IS NULL THEN '' ELSE '# MAGIC ### Python-Syntaxfehler' || chr(10) || '# MAGIC ```' || chr(10)
    || '# MAGIC ' || result_python_parse_error || chr(10) || '# MAGIC ```' || chr(10) END
  || CASE WHEN coalesce(len(result_sql_parse_errors), 0) = 0 THEN '' ELSE '# MAGIC ### Spark SQL-Syntaxfehler' || chr(10)
    || '# MAGIC ```' || chr(10) || array_to_string(list_transform(result_sql_parse_errors, lambda e: '# MAGIC ' || e || chr(10)), '')
    || '# MAGIC ```' || chr(10) END"""
NONE_FOUND = """'# MAGIC Bei der statischen Prüfung wurden keine Syntaxfehler festgestellt.' || chr(10)
  || '# MAGIC Überprüfen Sie den Code jedoch sorgfältig, da einige Probleme möglicherweise erst zur Laufzeit erkannt werden.' || chr(10)"""


@query(
    "SCR-8 SCR-9",
    f"""WITH {RESULT_SQL}, c AS (SELECT *, (CASE WHEN result_python_parse_error IS NULL THEN 0 ELSE 1 END
        + coalesce(len(result_sql_parse_errors), 0)) AS n FROM result WHERE result_content IS NOT NULL)
    SELECT input_file_number, md5({COMPOSED} || CASE WHEN n > 0 THEN {FOUND} ELSE {NONE_FOUND} END) AS document,
      cast(n AS int) AS parse_error_count FROM c""",
)
def compose_documents(spark, sf_dir):
    rows = result_table(spark, sf_dir).filter(F.col("result_content").isNotNull())
    composed = ops.compose_document(rows, "German")
    return composed.select("input_file_number", F.md5("document").alias("document"), "parse_error_count")


@query(
    "SCR-8",
    f"""WITH {RESULT_SQL} SELECT lang, count(*) AS documents, count(*) AS in_language
    FROM result WHERE result_content IS NOT NULL GROUP BY lang""",
)
def compose_by_language(spark, sf_dir):
    """Each row in its own language."""
    rows = result_table(spark, sf_dir).filter(F.col("result_content").isNotNull())
    language = F.when(F.col("lang") == "fr", "French").when(F.col("lang") == "es", "Spanish")
    language = language.when(F.col("lang") == "de", "German").otherwise("English")
    composed = ops.compose_document(rows.withColumn("comment_lang", language), lang=None)
    # What must stand before the source path and above the check results, language by language.
    marks = {
        "en": ("Source script", "Static Syntax Check Results"),
        "fr": ("Script source", "Résultats de la vérification syntaxique statique"),
        "es": ("Script fuente", "Resultados de la comprobación de sintaxis estática"),
        "de": ("Quellskript", "Ergebnisse der statischen Syntaxprüfung"),
    }
    right = F.lit(False)
    for lang, (source, results) in marks.items():
        found = F.col("document").contains(f"\n# MAGIC {source}: `") & F.col("document").contains(f"\n# MAGIC ## {results}\n")
        right = F.when(F.col("lang") == lang, found).otherwise(right)
    return composed.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(right).alias("in_language"))


@query(
    "SCR-9",
    f"""WITH {RESULT_SQL} SELECT input_file_number, cast(CASE WHEN result_python_parse_error IS NULL THEN 0 ELSE 1 END
      + coalesce(len(result_sql_parse_errors), 0) AS int) AS errors FROM result""",
)
def parse_error_counts(spark, sf_dir):
    return result_table(spark, sf_dir).select(
        "input_file_number",
        rules.parse_error_count("result_python_parse_error", "result_sql_parse_errors").alias("errors"),
    )


@query(
    "SCR-10",
    """SELECT doc_id, '/out/' || source || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS output_path FROM (
      SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)""",
)
def unique_output_paths(spark, sf_dir):
    """Few stems, many files of each."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'/in/' || cast(doc_id AS string) || '/' || source || '.sql' AS path"
    )
    return ops.unique_output_paths(docs.select("doc_id", "path"), "/out", "path", "doc_id").select("doc_id", "output_path")


MARKED = """'lead' || chr(10) || '# === ' || source || '.yml ===' || chr(10) || text || chr(10) || '# === b ' || lang || '.sql ==='
  || chr(10) || 'SELECT 1' || chr(10)"""


@query(
    "SCR-11",
    """SELECT doc_id, 1 AS file_no, source || '.yml' AS name, md5(text || chr(10)) AS content FROM documents
    UNION ALL SELECT doc_id, 2, 'b ' || lang || '.sql', md5('SELECT 1' || chr(10)) FROM documents""",
)
def split_marked_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MARKED} AS answer")
    return ops.split_marked_files(docs, "doc_id", "answer").withColumn("content", F.md5("content"))
