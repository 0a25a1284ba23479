"""Merge queries: responses, exports, upserts, updates, deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import merges
from dialoom.plans import warehouse
from dialoom.plans.derived import RESULT_SQL, SCRIPT_PATH, result_table
from dialoom.plans.registry import query, table
from dialoom.schema import EXPORT_SCHEMA, RESPONSE_SCHEMA

RESPONSES = """responses AS (SELECT doc_id + 1 AS input_file_number,
  CASE WHEN doc_id % 4 = 1 THEN NULL ELSE upper(source) || doc_id END AS new_content,
  CASE WHEN doc_id % 4 = 1 THEN 'HTTP 429' WHEN doc_id % 16 = 2 THEN 'cut' ELSE NULL END AS new_error,
  cast(n_chars % 50 AS int) AS new_tokens FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""


def responses(spark, sf_dir):
    """Responses for the documents that a quality label marks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    marked = docs.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    rows = marked.selectExpr(
        "doc_id + 1 AS input_file_number",
        "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE upper(source) || cast(doc_id AS string) END AS result_content",
        "cast(n_chars % 50 AS int) AS result_total_tokens",
        "CASE WHEN doc_id % 4 = 1 THEN 'HTTP 429' WHEN doc_id % 16 = 2 THEN 'cut' ELSE NULL END AS result_error",
    )
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in RESPONSE_SCHEMA if f.name not in rows.columns]
    return rows.select("*", *missing).select(*RESPONSE_SCHEMA.names)


MERGED = f"""WITH {RESULT_SQL}, {RESPONSES}
SELECT input_file_number, CASE WHEN new_content IS NOT NULL AND new_error IS NULL THEN false
    ELSE is_conversion_target END AS is_conversion_target,
  md5(coalesce(new_content, result_content, 'none')) AS content,
  coalesce(CASE WHEN new_content IS NOT NULL AND new_error IS NULL THEN NULL
    ELSE coalesce(new_error, result_error) END, 'none') AS error,
  coalesce(new_tokens, result_total_tokens) AS tokens, {{extra}}
FROM result LEFT JOIN responses r USING (input_file_number)"""


def _merged(df):
    return [
        "input_file_number",
        "is_conversion_target",
        F.md5(F.coalesce("result_content", F.lit("none"))).alias("content"),
        F.coalesce("result_error", F.lit("none")).alias("error"),
        F.col("result_total_tokens").alias("tokens"),
    ]


@query("JN-1", MERGED.replace("{extra}", "'gpt' AS endpoint, 'NULL' AS analysis"))
def merge_responses(spark, sf_dir):
    labels = {"model_serving_endpoint_for_conversion": "gpt"}
    out = merges.merge_responses(result_table(spark, sf_dir), responses(spark, sf_dir), labels)
    return out.select(
        *_merged(out),
        F.col("model_serving_endpoint_for_conversion").alias("endpoint"),
        F.coalesce("result_python_parse_error", F.array_join("result_sql_parse_errors", ";"), F.lit("NULL")).alias(
            "analysis"
        ),
    )


@query(
    "JN-1",
    MERGED.replace(
        "{extra}", "CASE WHEN r.input_file_number IS NULL THEN coalesce(len(result_sql_parse_errors), -1) ELSE -1 END AS n"
    ),
)
def merge_responses_keep_unmatched(spark, sf_dir):
    out = merges.merge_responses(result_table(spark, sf_dir), responses(spark, sf_dir), reset_all=False)
    return out.select(*_merged(out), F.coalesce(F.size("result_sql_parse_errors"), F.lit(-1)).cast("long").alias("n"))


EXPORT_STATUS = "CASE doc_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'exported' ELSE 'export_failed' END"


@query(
    "JN-2",
    f"""WITH {RESULT_SQL}, e AS (SELECT {SCRIPT_PATH} AS input_file_path, {EXPORT_STATUS} AS s, n_chars AS size,
        CASE WHEN doc_id % 2 = 1 THEN 'no space' END AS err FROM documents WHERE lang <> 'en')
    SELECT input_file_number, coalesce(CASE WHEN s IN ('success', 'exported') THEN 'exported'
        WHEN s IS NOT NULL THEN 'export_failed' END, export_status, 'none') AS export_status,
      coalesce(err, export_error, 'none') AS export_error,
      coalesce(size, export_content_size_bytes, -1) AS export_content_size_bytes
    FROM result LEFT JOIN e USING (input_file_path)""",
)
def merge_exports(spark, sf_dir):
    base = result_table(spark, sf_dir)
    export = base.filter("lang <> 'en'").selectExpr(
        "input_file_path",
        "cast(NULL AS string) AS export_output_path",
        f"{EXPORT_STATUS} AS export_status",
        "CASE WHEN doc_id % 2 = 1 THEN 'no space' END AS export_error",
        "cast(NULL AS timestamp) AS export_timestamp",
        "cast(length(input_file_content) AS bigint) AS export_content_size_bytes",
    )
    out = merges.merge_exports(base, export.select(*EXPORT_SCHEMA.names))
    return out.select(
        "input_file_number",
        F.coalesce("export_status", F.lit("none")).alias("export_status"),
        F.coalesce("export_error", F.lit("none")).alias("export_error"),
        F.coalesce("export_content_size_bytes", F.lit(-1)).cast("long").alias("export_content_size_bytes"),
    )


@query(
    "JN-3",
    """SELECT doc_id, lang, coalesce(cast(quality AS varchar), 'none') AS quality FROM documents LEFT JOIN labels USING (doc_id)""",
)
def attach_labels(spark, sf_dir):
    """The label side holds the key as text, the documents as a number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("old").alias("quality"))
    marks = table(spark, sf_dir, "labels").selectExpr("cast(doc_id AS string) AS doc_id", "cast(quality AS string) AS quality")
    out = merges.attach(docs, marks, "doc_id", ["quality"])
    return out.select("doc_id", "lang", F.coalesce("quality", F.lit("none")).alias("quality"))


@query(
    "JN-4",
    "SELECT doc_id, n_chars AS before, cast(length(trim(text)) AS bigint) AS after FROM documents",
)
def compare_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trimmed = docs.select("doc_id", F.length(F.trim("text")).cast("long").alias("n_chars"))
    return merges.compare(docs.select("doc_id", "n_chars"), trimmed, "doc_id", "n_chars")


STAGED = """staged AS (SELECT c_custkey * 2 AS c_custkey, upper(c_name) AS c_name, -c_acctbal AS c_acctbal FROM customer)"""


def _staging(spark, sf_dir):
    """All customers under doubled keys: half of them meet existing customers, half are new."""
    people = table(spark, sf_dir, "customer")
    return people.selectExpr("c_custkey * 2 AS c_custkey", "upper(c_name) AS c_name", "-c_acctbal AS c_acctbal")


@query(
    "JN-9",
    f"""WITH {STAGED} SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, c.c_name) AS c_name,
      coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(c.c_mktsegment, 'none') AS c_mktsegment
    FROM customer c FULL JOIN staged s ON c.c_custkey = s.c_custkey""",
)
def upsert_customers(spark, sf_dir):
    people = table(spark, sf_dir, "customer").drop("c_nationkey")
    out = merges.upsert(people, _staging(spark, sf_dir), ["c_custkey"])
    return out.withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("none")))


@query(
    "JN-9",
    f"""WITH {STAGED} SELECT c_custkey, c_name, c_acctbal FROM customer
    UNION ALL SELECT * FROM staged WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def insert_only_merge(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return merges.upsert(people, _staging(spark, sf_dir), ["c_custkey"], update=False)


@query(
    "JN-10",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE l_extendedprice END
      AS l_extendedprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'""",
)
def update_lines_from_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    new = done.selectExpr("o_orderkey AS l_orderkey", "o_totalprice AS l_extendedprice")
    return merges.update_from(lines, new, ["l_orderkey"], ["l_extendedprice"])


@query(
    "JN-11",
    """SELECT l_returnflag, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
      WHERE o_orderpriority = '1-URGENT') GROUP BY l_returnflag""",
)
def delete_lines_of_urgent_orders(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS l_orderkey")
    left = merges.delete_using(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), urgent, ["l_orderkey"])
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "JN-12",
    """SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'Renamed' ELSE c_name END AS c_name FROM customer
    UNION ALL SELECT -7, 'Newcomer'""",
)
def put_customer_rows(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = [{"c_custkey": 5, "c_name": "Renamed"}, {"c_custkey": -7, "c_name": "Newcomer"}]
    return merges.put_rows(people, "c_custkey", rows)


@query(
    "DML-3",
    "SELECT o_orderkey AS order_id, cast(o_totalprice AS double) AS order_amount FROM orders WHERE o_custkey = 370",
)
def lookup_customer_orders(spark, sf_dir):
    from dialoom.plans.derived import orders

    found = warehouse.lookup(orders(spark, sf_dir), customer_id=370)
    return found.select("order_id", F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "DML-3 DML-7",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY o_orderstatus",
)
def parameterised_statement(spark, sf_dir):
    return warehouse.run_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS n FROM IDENTIFIER(:t) WHERE o_totalprice > :low GROUP BY o_orderstatus",
        {"lookup_orders": table(spark, sf_dir, "orders")},
        {"t": "lookup_orders", "low": 250000},
    )


@query(
    "DML-4 JN-12",
    "SELECT p_partkey, p_name, 12.5 AS p_retailprice FROM part WHERE p_partkey = 17",
)
def update_part_price(spark, sf_dir):
    """Check that the row exists, update it, return it."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    _, row = warehouse.update_if_exists(parts, "p_partkey", 17, p_retailprice=12.5)
    return row
