"""Source, sink and versioned-table queries; files go to the shared checkpoint folder."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.text import basename, stem
from dialoom.operators.inference import CallError
from dialoom.plans import corpus_run, warehouse
from dialoom.plans.derived import SCRIPTS_SQL, customers, orders, scripts
from dialoom.plans.q_corpus import COLLAPSE, STRIP, TOKENS
from dialoom.plans.registry import query, table
from dialoom.session import materialize, met, scratch_dir
from dialoom.sources.scripts import decode_content, read_archive_members, read_external_csv, read_scripts
from dialoom.sources.versions import INSERT_ID, insert_returning, restore, stage, version_name, write_result_version, written
from dialoom.sources.writers import write_text_files


def _written_scripts(spark, sf_dir, folder):
    """Every derived script as a file ``<doc_id>.sql`` in ``folder``; gives the status rows."""
    rows = scripts(spark, sf_dir).select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("input_file_path"),
        F.col("content").alias("result_content"),
    )
    return materialize(write_text_files(rows, folder, "sql"))


@query(
    "SNK-2",
    f"""WITH {SCRIPTS_SQL} SELECT doc_id || '.sql' AS file, 'exported' AS export_status,
      octet_length(encode(content)) AS export_content_size_bytes FROM scripts""",
)
def write_script_files(spark, sf_dir):
    done = _written_scripts(spark, sf_dir, scratch_dir(spark))
    return done.select(basename("export_output_path").alias("file"), "export_status", "export_content_size_bytes")


@query(
    "SRC-1 SRC-3",
    f"""WITH {SCRIPTS_SQL} SELECT doc_id, md5(content) AS content, 'utf-8' AS encoding FROM scripts""",
)
def read_script_files(spark, sf_dir):
    """Write the scripts as files, read them back through overlapping paths, decode."""
    folder = scratch_dir(spark)
    _written_scripts(spark, sf_dir, folder)
    files = read_scripts(spark, f"{folder}, {folder}/*.sql").select("path", "content")
    return decode_content(files).select(
        stem("path").cast("long").alias("doc_id"),
        F.md5("input_file_content").alias("content"),
        F.col("input_file_encoding").alias("encoding"),
    )


@query(
    "SRC-3",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\xff]') THEN 'none' ELSE md5(text) END AS latin, md5(text) AS utf16,
      md5(text) AS sniffed, 'utf-16' AS sniffed_encoding FROM documents""",
)
def decode_encodings(spark, sf_dir):
    """All texts through UTF-16, stated and found out, and those that fit through Latin-1."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.filter(~F.col("text").rlike(r"[^\x00-\xff]"))
    latin = decode_content(narrow.select("doc_id", F.encode("text", "ISO-8859-1").alias("content")), encoding="iso-8859-1")
    wide = docs.select("doc_id", F.encode("text", "UTF-16").alias("content"))
    utf16, sniffed = decode_content(wide, encoding="utf-16"), decode_content(wide)

    def digest(df, name):
        return df.select("doc_id", F.md5("input_file_content").alias(name))

    found = sniffed.select(
        "doc_id", F.md5("input_file_content").alias("sniffed"), F.col("input_file_encoding").alias("sniffed_encoding")
    )
    joined = digest(utf16, "utf16").join(found, "doc_id").join(digest(latin, "latin"), "doc_id", "left")
    return joined.fillna("none", ["latin"])


@F.pandas_udf(T.BinaryType())
def _zipped(number: pd.Series, name: pd.Series, text: pd.Series) -> pd.Series:
    def pack(n, label, body):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr(f"sub/{label}.sql", body)
            archive.writestr(f"{label}.bteq", "SEL 1")
            archive.writestr(f"{label}.SQL", "upper case suffix")
        whole = buffer.getvalue()
        return whole[: len(whole) // 2] if n % 50 == 0 else whole

    return pd.Series([pack(*row) for row in zip(number, name, text, strict=True)])


@query(
    "SRC-4",
    """SELECT doc_id, 'sub_' || source || '.sql' AS name, md5(text) AS content, false AS damaged FROM documents WHERE doc_id % 50 > 0
    UNION ALL SELECT doc_id, source || '.bteq', md5('SEL 1'), false FROM documents WHERE doc_id % 50 > 0
    UNION ALL SELECT doc_id, 'none', 'none', true FROM documents WHERE doc_id % 50 = 0""",
)
def archive_members(spark, sf_dir):
    """Zip files written, some of them cut off, and read back member by member."""
    folder = f"{scratch_dir(spark)}/zips"
    zips = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("input_file_path"),
        _zipped("doc_id", "source", "text").alias("result_content"),
    )
    materialize(write_text_files(zips, folder, "zip"))
    return read_archive_members(read_scripts(spark, folder).select("path")).select(
        stem("archive").cast("long").alias("doc_id"),
        F.coalesce("name", F.lit("none")).alias("name"),
        F.coalesce(F.md5("content"), F.lit("none")).alias("content"),
        F.col("error").isNotNull().alias("damaged"),
    )


@query(
    "SNK-2",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'export_failed' ELSE 'exported' END AS export_status FROM documents",
)
def unwritable_files(spark, sf_dir):
    """A storage that does not exist and a path with a NUL byte are reported, row by row."""
    folder = scratch_dir(spark)
    number = F.col("doc_id").cast("string")
    target = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("nosuch://out/"), number))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"{folder}/a\0"), number))
        .otherwise(F.concat(F.lit(f"{folder}/"), number, F.lit(".txt")))
    )
    rows = table(spark, sf_dir, "documents").select(number.alias("input_file_path"), target.alias("target"), "text")
    done = materialize(write_text_files(rows, folder, "txt", content="text", output="target"))
    return done.select(F.col("input_file_path").cast("long").alias("doc_id"), "export_status")


@query("SRC-5", "SELECT event_id, event_type, value FROM events")
def external_csv(spark, sf_dir):
    folder = f"{scratch_dir(spark)}/events"
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.csv(folder, header=False)
    return read_external_csv(spark, folder, "event_id BIGINT, event_type STRING, value DOUBLE")


@query(
    "SNK-1",
    "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
)
def result_versions(spark, sf_dir):
    """A stage's output written once; asking for the same name again reuses it."""
    base = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    first = write_result_version(docs, base, "stage_a")
    again = write_result_version(docs.limit(0), base, "stage_a")
    if first != again:
        raise RuntimeError("a finished table was not reused")
    return spark.read.parquet(again).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


def _sales_table(spark):
    """An empty table with a comment, a default and a partition per insert."""
    name = version_name("sales")
    spark.sql(
        f"""CREATE TABLE {name} (sale_id BIGINT, product_name STRING, sale_amount DECIMAL(10,2), channel STRING DEFAULT 'retail',
        {INSERT_ID} STRING) USING PARQUET PARTITIONED BY ({INSERT_ID}) COMMENT 'Sales table'"""
    )
    return name


@query(
    "DDL-1 DML-6",
    """SELECT o_orderkey AS sale_id, o_orderpriority AS product_name, cast(cast(o_totalprice AS decimal(10,2)) AS double) AS sale_amount,
      'retail' AS channel FROM orders""",
)
def create_and_insert(spark, sf_dir):
    """CREATE TABLE with comment and default, INSERT naming some columns: the stored rows."""
    name = _sales_table(spark)
    sales = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS sale_id", "o_orderpriority AS product_name", "cast(o_totalprice AS decimal(10,2)) AS sale_amount"
    )
    try:
        stored = insert_returning(spark, name, sales)
        return materialize(stored.withColumn("sale_amount", F.col("sale_amount").cast("double")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    "DML-6",
    """SELECT l_orderkey AS sale_id, cast(cast(l_extendedprice AS decimal(10,2)) AS double) AS sale_amount, 'retail' AS channel
    FROM lineitem""",
)
def insert_returning_rows(spark, sf_dir):
    """Of two inserts the second one's rows, whose amounts the table rounds and whose channel it fills in."""
    name = _sales_table(spark)
    try:
        orders_ = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sale_id", "'mail' AS channel")
        insert_returning(spark, name, orders_)
        lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS sale_id", "l_extendedprice AS sale_amount")
        stored = insert_returning(spark, name, lines)
        return materialize(stored.select("sale_id", F.col("sale_amount").cast("double").alias("sale_amount"), "channel"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("DDL-2", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def staged_table(spark, sf_dir):
    """A temporary table: written, read, dropped."""
    with stage(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")) as temp:
        return materialize(temp.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query(
    "DDL-3 DDL-4 DDL-5 DDL-7",
    """WITH s AS (SELECT o_orderkey AS k, cast(o_totalprice AS varchar) AS v FROM orders)
    SELECT 'added' AS step, count(*) AS rows, 'sale_id,sale_amount,discount' AS columns, 0 AS discounts FROM s
    UNION ALL SELECT 'renamed', count(*), 'sale_id,total_amount,discount', 0 FROM s
    UNION ALL SELECT 'dropped', count(*), 'sale_id,total_amount', -1 FROM s UNION ALL SELECT 'truncated', 0, 'sale_id,total_amount', -1""",
)
def alter_columns(spark, sf_dir):
    """Column changes and truncation as new written tables: rows, columns and values of each."""
    base = scratch_dir(spark)
    sales = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sale_id", "o_totalprice AS sale_amount")
    added = written(sales.withColumn("discount", F.lit(None).cast("decimal(5,2)")), base)
    renamed = written(added.withColumnRenamed("sale_amount", "total_amount"), base)
    dropped = written(renamed.drop("discount"), base)
    truncated = written(dropped.limit(0), base)
    out = None
    for name, content in {"added": added, "renamed": renamed, "dropped": dropped, "truncated": truncated}.items():
        given = F.count("discount") if "discount" in content.columns else F.lit(-1).cast("long")
        line = content.agg(F.count(F.lit(1)).alias("rows"), given.alias("discounts")).select(
            F.lit(name).alias("step"), "rows", F.lit(",".join(content.columns)).alias("columns"), "discounts"
        )
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "DML-5 DDL-4 DDL-5",
    "SELECT o_orderkey AS sale_id, o_totalprice AS total_amount FROM orders",
)
def alter_and_restore(spark, sf_dir):
    """A renamed column, then a change whose write fails half way: the rows of the newest finished version."""
    base = scratch_dir(spark)
    sales = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sale_id", "o_totalprice AS sale_amount")
    day = datetime(2024, 1, 1)
    write_result_version(sales, base, version_name("sales", day, "a"), "sales")
    renamed = sales.withColumnRenamed("sale_amount", "total_amount")
    write_result_version(renamed, base, version_name("sales", day.replace(day=2), "b"), "sales")
    failing = F.when(F.col("sale_id") % 7 == 0, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.lit(0.0))
    try:
        write_result_version(renamed.withColumn("total_amount", failing), base, version_name("sales", day.replace(day=3), "c"), "sales")
    except Exception as error:  # noqa: BLE001 - the failure is the point
        if "stop" not in str(error):
            raise
    return restore(spark, base, "sales")


@query(
    "DML-1 AGG-9",
    """SELECT o_custkey AS customer_id, cast(sum(cast(o_totalprice AS decimal(10,2))) AS double) AS total_revenue FROM orders
    WHERE o_totalprice > 0 GROUP BY o_custkey""",
)
def build_layers(spark, sf_dir):
    """Bronze, silver and gold as three written tables."""
    gold = warehouse.build_layers(orders(spark, sf_dir), scratch_dir(spark))
    return gold.withColumn("total_revenue", F.col("total_revenue").cast("double"))


@query(
    "DML-2",
    """SELECT city, category, cast(total_sales AS double) AS total_sales FROM (
      SELECT n_name AS city, p_brand AS category, sum(cast(l_extendedprice AS decimal(18,2))) AS total_sales FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_brand)""",
)
def refresh_layers(spark, sf_dir):
    """Refill the cache, rebuild the summary, append to the audit log."""
    tables = warehouse.silver_tables(spark, sf_dir)
    summary = warehouse.refresh_layers(*tables, scratch_dir(spark), as_of="2024-01-01 00:00:00")
    return summary.withColumn("total_sales", F.col("total_sales").cast("double"))


@query("DML-2", "SELECT '2024-01-01 00:00:00' AS ts, 'sp_refresh_gold_layer' AS job, 'SUCCESS' AS status")
def refresh_audit_log(spark, sf_dir):
    """The audit row a refresh leaves."""
    base = scratch_dir(spark)
    warehouse.refresh_layers(*warehouse.silver_tables(spark, sf_dir), base, as_of="2024-01-01 00:00:00")
    audit = spark.read.parquet(f"{base}/{warehouse.AUDIT_LOG}")
    return audit.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "job", "status")


@query(
    "DML-4 JN-12 DML-5",
    """SELECT c_custkey AS customer_id, CASE WHEN c_custkey = 9 THEN 'Changed' ELSE c_name END AS customer_name FROM customer""",
)
def undo_failed_change(spark, sf_dir):
    """A change is kept; a second one whose write fails leaves the table before it."""
    from dialoom.operators.merges import put_row

    base = scratch_dir(spark)
    people = customers(spark, sf_dir).select("customer_id", "customer_name")
    people = written(put_row(people, "customer_id", {"customer_id": 9, "customer_name": "Changed"}), base)
    lost = put_row(people, "customer_id", {"customer_id": 10, "customer_name": "Lost"})
    stopped = F.when(F.col("customer_id") == 10, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("customer_name"))
    try:
        people = written(lost.withColumn("customer_name", stopped), base)
    except Exception as error:  # noqa: BLE001 - the failure is the point
        if "stop" not in str(error):
            raise
    return people


def _echo(messages):
    """Stands in for the model: a script that runs the length of what it was asked as a statement."""
    size = len(messages[-1]["content"])
    if size % 5 == 0:
        raise CallError(400, "Bad Request", '{"message": "invalid parameter"}')
    return f"```python\nimport os\n\n\nspark.sql('SELECT {size} AS n')\n```"


# The text that is sent is the one without comments and with white space collapsed.
SENT = COLLAPSE.replace("{c}", STRIP.replace("{c}", "content"))


@query(
    "CTL-2 SRC-2 SNK-1",
    f"""WITH {SCRIPTS_SQL}, p AS (SELECT doc_id, content, cast(doc_id AS varchar) || '.sql' AS file, length({SENT}) AS sent,
        {TOKENS.replace('{c}', SENT)} AS pre FROM scripts)
    SELECT file, pre AS tokens, CASE WHEN pre > 25 THEN 'Skipped' WHEN sent % 5 = 0 THEN 'Not converted'
        ELSE 'Converted successfully' END AS conversion_status,
      CASE WHEN pre > 25 OR sent % 5 = 0 THEN 'Not exported' ELSE 'Exported successfully' END AS export_status,
      CASE WHEN pre > 25 OR sent % 5 = 0 THEN 'none' ELSE 'import os' || chr(10) || chr(10) || chr(10) || '# COMMAND ----------'
        || chr(10) || 'spark.sql(''SELECT ' || sent || ' AS n'')' || chr(10) END AS code,
      CASE WHEN pre > 25 OR sent % 5 = 0 THEN 0.0 ELSE 100.0 END AS accuracy
    FROM p""",
)
def corpus_run_documents(spark, sf_dir):
    """The whole run over script files: ingest, convert, check, split, compose, export; every file with its status."""
    base = scratch_dir(spark)
    _written_scripts(spark, sf_dir, f"{base}/in")
    cfg = corpus_run.RunConfig(f"{base}/in", f"{base}/out", f"{base}/result", token_count_threshold=25)
    done = corpus_run.run_corpus(spark, cfg, _echo)
    status = corpus_run.status_of_all(done).select("input_file_number", "conversion_status", "export_status")
    rows = done.select(
        "input_file_number",
        basename("input_file_path").alias("file"),
        F.col("input_file_token_count_preprocessed").alias("tokens"),
        F.coalesce(F.regexp_replace("result_content", r"\A# COMMAND ----------\n", ""), F.lit("none")).alias("code"),
        F.col("accuracy_percent").alias("accuracy"),
    )
    return rows.join(met(status), "input_file_number").drop("input_file_number")


@query(
    "CTL-2 FIL-6 REP-6 REP-7",
    f"""WITH {SCRIPTS_SQL}, p AS (SELECT doc_id, length({SENT}) AS sent, {TOKENS.replace('{c}', SENT)} AS pre FROM scripts)
    SELECT doc_id, CASE WHEN pre > 25 THEN 'over the token limit' WHEN sent % 5 = 0 THEN 'not converted' WHEN sent % 3 = 0 THEN 'failed'
        ELSE 'written' END AS status,
      CASE WHEN pre <= 25 AND sent % 5 > 0 AND sent % 3 = 0 THEN 'refused' ELSE 'none' END AS reason,
      CASE WHEN pre > 25 OR sent % 5 = 0 OR sent % 3 = 0 THEN 'none' ELSE 'SELECT ' || sent END AS sql_text
    FROM p""",
)
def corpus_run_sql_files(spark, sf_dir):
    """The stage after the run: what became of every script, and the SQL in the files that were written."""
    base = scratch_dir(spark)
    _written_scripts(spark, sf_dir, f"{base}/in")
    cfg = corpus_run.RunConfig(
        f"{base}/in", f"{base}/out", f"{base}/result", token_count_threshold=25, sql_output_dir=f"{base}/sql"
    )

    def to_sql(messages):
        statement = re.search(r"SELECT (\d+)", messages[-1]["content"])
        if int(statement[1]) % 3 == 0:
            raise CallError(400, "Bad Request", '{"message": "invalid parameter"}')
        return statement.group()

    done = corpus_run.run_corpus(spark, cfg, _echo, predict_sql=to_sql)
    stage_rows = spark.read.parquet(f"{base}/result/sql_files").select(
        stem("python_notebook_path").alias("name"), "success", "error", stem("sql_output_path").alias("made")
    )
    files = decode_content(read_scripts(spark, f"{base}/sql").select("path", "content"), encoding="utf-8")
    files = files.select(stem("path").alias("made"), F.trim("input_file_content").alias("sql_text"))
    scripts_ = done.select(
        stem("input_file_path").alias("name"), "is_conversion_target", "result_content", F.col("result_error").alias("call_error")
    )
    asked = F.col("result_content").isNotNull() | F.col("call_error").isNotNull()
    status = (
        F.when(F.col("success"), "written").when(F.col("error").isNotNull(), "failed")
        .when(asked, "not converted").otherwise("over the token limit")
    )
    joined = scripts_.join(met(stage_rows), "name", "left").join(met(files), "made", "left")
    reason = F.when(F.col("error").contains("Bad Request"), "refused").otherwise(F.coalesce("error", F.lit("none")))
    return joined.select(
        F.col("name").cast("long").alias("doc_id"), status.alias("status"), reason.alias("reason"),
        F.coalesce("sql_text", F.lit("none")).alias("sql_text"),
    )
