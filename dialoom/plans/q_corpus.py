"""Corpus queries: preprocessing, token counts, text clean-up, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import text as tx
from dialoom.operators import merges, tokens
from dialoom.operators.selection import select_targets
from dialoom.plans.derived import RESULT_SQL, SCRIPTS_SQL, result_table, scripts
from dialoom.plans.registry import query, table
from dialoom.session import dealt
from dialoom.sources.scripts import number_files
from dialoom.sources.versions import latest_table

STRIP = (
    "regexp_replace(regexp_replace(regexp_replace({c}, '--.*', '', 'g'), '/\\*.*?\\*/', '', 'gs'), "
    "'\\n\\s*\\n', chr(10) || chr(10), 'g')"
)
COLLAPSE = "regexp_replace({c}, '\\s+', ' ', 'g')"
TOKENS = "cast(trunc(length({c}) / cast(3.4 AS double)) AS int)"


def _sql(template: str, column: str) -> str:
    return template.replace("{c}", column)


@query(
    "TXT-1 TXT-2 TXT-4 FIL-1",
    f"""SELECT lang, is_target, count(*) AS documents, cast(sum(tokens) AS bigint) AS tokens FROM (
      SELECT lang, t AS tokens, NOT (t > 1000) AS is_target FROM (
        SELECT lang, {_sql(TOKENS, _sql(COLLAPSE, _sql(STRIP, 'text')))} AS t FROM documents))
    GROUP BY lang, is_target""",
)
def corpus_token_targets(spark, sf_dir):
    """Flagship: strip, collapse, count tokens, choose targets, sum per language."""
    docs = table(spark, sf_dir, "documents").select("lang", tx.estimate_tokens(tx.preprocess_sql("text")).alias("t"))
    chosen = select_targets(docs, 1000, "t", "is_target")
    return chosen.groupBy("lang", "is_target").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("t").alias("tokens")
    )


@query(
    "TXT-1",
    f"WITH {SCRIPTS_SQL} SELECT doc_id, md5({_sql(STRIP, 'content')}) AS stripped, "
    f"length({_sql(STRIP, 'content')}) AS chars FROM scripts",
)
def strip_sql_comments(spark, sf_dir):
    out = scripts(spark, sf_dir).select("doc_id", tx.strip_sql_comments("content").alias("s"))
    return out.select("doc_id", F.md5("s").alias("stripped"), F.length("s").cast("long").alias("chars"))


@query(
    "TXT-2",
    f"WITH {SCRIPTS_SQL} SELECT doc_id, md5({_sql(COLLAPSE, 'content')}) AS collapsed FROM scripts",
)
def collapse_white_space(spark, sf_dir):
    return scripts(spark, sf_dir).select("doc_id", F.md5(tx.collapse_ws("content")).alias("collapsed"))


@query(
    "TXT-3 TXT-6",
    f"""WITH {SCRIPTS_SQL}, p AS (SELECT doc_id, content, {_sql(COLLAPSE, _sql(STRIP, 'content'))} AS pre FROM scripts)
    SELECT doc_id, 'claude' AS tokenizer_type, 'claude' AS tokenizer_model,
      {_sql(TOKENS, 'content')} AS input_file_token_count,
      {_sql(TOKENS, 'pre')} AS input_file_token_count_preprocessed, md5(pre) AS preprocessed FROM p""",
)
def token_columns(spark, sf_dir):
    docs = scripts(spark, sf_dir).select("doc_id", F.col("content").alias("input_file_content"))
    return tokens.with_token_columns(docs).select(
        "doc_id",
        "tokenizer_type",
        "tokenizer_model",
        "input_file_token_count",
        "input_file_token_count_preprocessed",
        F.md5("input_file_content_preprocessed").alias("preprocessed"),
    )


@query(
    "TXT-3",
    f"WITH {SCRIPTS_SQL} SELECT doc_id, {_sql(TOKENS, 'content')} AS raw_tokens, "
    f"{_sql(TOKENS, 'content')} AS pre_tokens FROM scripts",
)
def token_columns_generic(spark, sf_dir):
    docs = scripts(spark, sf_dir).select("doc_id", F.col("content").alias("input_file_content"))
    counted = tokens.with_token_columns(docs, source_format="generic")
    return counted.select(
        "doc_id",
        F.col("input_file_token_count").alias("raw_tokens"),
        F.col("input_file_token_count_preprocessed").alias("pre_tokens"),
    )


@query("TXT-4", f"SELECT doc_id, {_sql(TOKENS, 'text')} AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"))


def _words(text: str) -> int:
    return len(text.split())


@query(
    "TXT-5",
    "SELECT doc_id, 'openai' AS tokenizer_type, 'words' AS tokenizer_model, "
    "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tokens FROM documents",
)
def count_tokens_with_function(spark, sf_dir):
    counter = tokens.choose_counter("openai", model="words", bpe=_words)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(counter.kind).alias("tokenizer_type"),
        F.lit(counter.model).alias("tokenizer_model"),
        counter.column("text").cast("long").alias("tokens"),
    )


RANGE_TEXT = (
    "cast(l_linenumber AS string) || '-' || cast(cast(l_quantity AS int) % 9 AS string) || ', ' "
    "|| cast(l_orderkey AS string)"
)


@query(
    "TXT-7",
    f"""WITH r AS (SELECT DISTINCT {RANGE_TEXT} AS ranges, l_linenumber AS a,
        cast(l_quantity AS int) % 9 AS b, l_orderkey AS c FROM lineitem)
    SELECT ranges, number, count(*) AS n FROM (
      SELECT ranges, cast(unnest(range(a, b + 1)) AS int) AS number FROM r
      UNION ALL SELECT ranges, cast(c AS int) FROM r) GROUP BY ranges, number""",
)
def expand_number_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    # One exchange by the text serves both groupings; the number of its tasks follows the rows.
    texts = dealt(lines.selectExpr(f"{RANGE_TEXT} AS ranges"), lines.count(), "ranges").distinct()
    return tokens.explode_ranges(texts, "ranges").groupBy("ranges", "number").agg(F.count(F.lit(1)).alias("n"))


FENCED = """CASE doc_id % 5 WHEN 0 THEN '```python' || chr(10) || text || chr(10) || '```'
  WHEN 1 THEN '  ```python' || chr(10) || text || '```tail' WHEN 2 THEN 'Here:' || chr(10) || '```python' || text || '```'
  WHEN 3 THEN '```python' || chr(10) || text ELSE '```sql' || chr(10) || text || '```' END"""


@query(
    "TXT-8",
    """SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN text || chr(10) WHEN 1 THEN text || chr(10)
      WHEN 2 THEN 'Here:' || chr(10) || text || '```' WHEN 3 THEN chr(10) || text
      ELSE '```sql' || chr(10) || text || '```' END) AS code FROM documents""",
)
def clean_code_fence(spark, sf_dir):
    fenced = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{FENCED} AS answer")
    return fenced.select("doc_id", F.md5(tx.clean_code_fence("answer")).alias("code"))


DIRTY_SQL = (
    "chr(10) || ' ```sql' || chr(10) || 'CREATE TABLE t (a STRING default  uuid ( ), b STRING DEFAULT NEWID(), "
    "c DATE Default SYSDATE) -- ' || text || '```' || chr(10)"
)


@query(
    "TXT-9",
    "SELECT doc_id, md5('CREATE TABLE t (a STRING , b STRING , c DATE ) -- ' || text) AS statement FROM documents",
)
def post_clean_sql(spark, sf_dir):
    dirty = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{DIRTY_SQL} AS answer")
    return dirty.select("doc_id", F.md5(tx.post_clean_sql("answer")).alias("statement"))


@query(
    "TXT-10 JN-4",
    f"""WITH {RESULT_SQL}, s AS (SELECT input_file_number, input_file_path,
        coalesce(length(result_content), 0) AS original_content_size,
        CASE WHEN result_content IS NULL THEN 0 WHEN starts_with(result_content, '```python')
          THEN length(result_content) - 13 ELSE length(result_content) END AS cleaned_content_size FROM result)
    SELECT input_file_number, input_file_path, cast(original_content_size AS int) AS original_content_size,
      cast(cleaned_content_size AS int) AS cleaned_content_size,
      cast(cleaned_content_size AS double) / original_content_size AS size_ratio FROM s
    WHERE original_content_size > 0 AND cast(cleaned_content_size AS double) / original_content_size < 0.97""",
)
def content_shrink_report(spark, sf_dir):
    before = result_table(spark, sf_dir)
    after = before.withColumn("result_content", tx.clean_code_fence("result_content"))
    return merges.content_shrink_report(before, after, 0.97)


@query(
    "TXT-10",
    f"""WITH {RESULT_SQL} SELECT input_file_number, cast(length(result_content) - 13 AS int) AS cleaned_content_size
    FROM result WHERE starts_with(result_content, '```python')
      AND cast(length(result_content) - 13 AS double) / length(result_content) < 0.9""",
)
def clean_shrink_report(spark, sf_dir):
    report = merges.clean_shrink_report(result_table(spark, sf_dir))
    return report.select("input_file_number", "cleaned_content_size")


@query(
    "TXT-11",
    f"""WITH {RESULT_SQL} SELECT input_file_number, CASE WHEN starts_with(result_content, '```python')
      THEN '2024-05-06 07:08:09' ELSE 'unset' END AS stamp,
      md5(coalesce(CASE WHEN starts_with(result_content, '```python')
        THEN substr(result_content, 11, length(result_content) - 13) ELSE result_content END, '')) AS content
    FROM result""",
)
def clean_and_touch(spark, sf_dir):
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    cleaned = merges.clean_results(result_table(spark, sf_dir), stamp)
    return cleaned.select(
        "input_file_number",
        F.coalesce(F.date_format("result_timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("unset")).alias("stamp"),
        F.md5(F.coalesce("result_content", F.lit(""))).alias("content"),
    )


@query(
    "TXT-12",
    """SELECT doc_id, md5(left(text, 200) || '... [truncated] ...' || right(text, 100)) AS head_and_tail,
      md5(CASE WHEN length(text) > 2000 THEN left(text, 1000) || ' ... [truncated ' || (length(text) - 2000)
        || ' chars] ... ' || right(text, 1000) ELSE text END) AS cut FROM documents""",
)
def preview_and_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(tx.preview("text")).alias("head_and_tail"),
        F.md5(tx.truncate_middle("text")).alias("cut"),
    )


@query(
    "TXT-12",
    """SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1000) || ' ... [truncated ' ||
      (length(text) - 2000) || ' chars] ... ' || right(text, 1000) ELSE text END AS cut FROM documents""",
)
def truncate_json_leaves(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct(F.array(F.struct("text")).alias("choices"))).alias("body")
    )
    short = docs.withColumn("body", tx.truncate_json_leaves("body"))
    return short.select("doc_id", F.get_json_object("body", "$.choices[0].text").alias("cut"))


@query(
    "TXT-13",
    """SELECT event_id, event_type AS summary_reasoning, value AS overall_score,
      CASE WHEN event_id % 4 = 3 THEN 'unreadable' ELSE 'read' END AS outcome FROM events
    WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, 'none', -1.0, 'unreadable' FROM events WHERE event_id % 4 = 3""",
)
def extract_json_verdict(spark, sf_dir):
    from dialoom.schema import VERDICT_SCHEMA

    answer = """CASE event_id % 4 WHEN 0 THEN '{"overall_score": ' || cast(value AS string) || ', "summary_reasoning": "'
        || event_type || '"}'
      WHEN 1 THEN 'Verdict:' || chr(10) || '{"summary_reasoning": "' || event_type || '", "overall_score": '
        || cast(value AS string) || ', "critical_errors": ["{x}"]} -- end'
      WHEN 2 THEN 'So: {''overall_score'': ' || cast(value AS string) || ', ''summary_reasoning'': '''
        || event_type || ''', ''critical_errors'': None}'
      ELSE 'no verdict {' || event_type END"""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{answer} AS answer")
    read = rows.withColumn("v", tx.extract_json("answer", VERDICT_SCHEMA, literals=True))
    return read.select(
        "event_id",
        F.coalesce("v.summary_reasoning", F.lit("none")).alias("summary_reasoning"),
        F.coalesce("v.overall_score", F.lit(-1.0)).alias("overall_score"),
        F.when(F.col("v").isNull(), "unreadable").otherwise("read").alias("outcome"),
    )


@query(
    "TXT-14",
    """SELECT doc_id, md5(to_base64(encode(text))) AS encoded, length(to_base64(encode(text))) AS encoded_size,
      md5(text) AS decoded, md5('plain ' || text) AS kept FROM documents""",
)
def base64_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.to_base64("text").alias("b64"))
    return docs.select(
        "doc_id",
        F.md5("b64").alias("encoded"),
        tx.base64_size("text").alias("encoded_size"),
        F.md5(tx.from_base64("b64")).alias("decoded"),
        F.md5(tx.from_base64(F.concat(F.lit("plain "), "text"))).alias("kept"),
    )


@query(
    "TXT-15",
    f"""WITH {SCRIPTS_SQL} SELECT doc_id, CASE WHEN starts_with(path, '/in/src1') THEN ltrim(substr(path, 9), '/')
        ELSE path END AS relative_path, split_part(path, '/', -1) AS base_name,
      replace(split_part(path, '/', -1), '.sql', '') AS stem_name,
      cast(doc_id AS varchar) || '_' || lang || '.sql' AS display_name FROM scripts""",
)
def path_helpers(spark, sf_dir):
    return scripts(spark, sf_dir).select(
        "doc_id",
        tx.relative_path("path", "/in/src1/").alias("relative_path"),
        tx.basename("path").alias("base_name"),
        tx.stem("path").alias("stem_name"),
        tx.display_name("path").alias("display_name"),
    )


@query(
    "TXT-16",
    "SELECT p_partkey, '/out/' || translate(p_name, ' ', '_') || '_' || p_brand || '_' || p_type || '.py' AS target "
    "FROM part",
)
def sanitize_names(spark, sf_dir):
    dirty = "concat('/a/', replace(p_name, ' ', '?'), ':', p_brand, '<', p_type, '.sql')"
    return table(spark, sf_dir, "part").select("p_partkey", tx.output_file_path(F.expr(dirty), "/out/", "py").alias("target"))


@query("SRC-2", f"WITH {SCRIPTS_SQL} SELECT path, cast(row_number() OVER (ORDER BY path) AS int) AS input_file_number FROM scripts")
def number_files_by_path(spark, sf_dir):
    return number_files(scripts(spark, sf_dir).select("path"))


@query(
    "SNK-3",
    """SELECT source, max_by(name, stamp) AS latest_table FROM (
      SELECT source, 'run_' || strftime(TIMESTAMP '2024-01-01' + to_minutes(cast(n_chars * 7 + doc_id AS integer)), '%Y%m%d%H%M%S')
        || '_' || doc_id AS name, TIMESTAMP '2024-01-01' + to_minutes(cast(n_chars * 7 + doc_id AS integer)) AS stamp
      FROM documents) WHERE source = 'src3' GROUP BY source""",
)
def latest_table_by_stamp(spark, sf_dir):
    stamp = F.date_format(
        F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.expr("cast(n_chars * 7 + doc_id AS int)")),
        "yyyyMMddHHmmss",
    )
    names = table(spark, sf_dir, "documents").select(
        F.concat(
            F.when(F.col("source") == "src3", "run_").otherwise("old_"), stamp, F.lit("_"), F.col("doc_id").cast("string")
        ).alias("name")
    )
    return latest_table(names, "run_").select(F.lit("src3").alias("source"), "latest_table")
