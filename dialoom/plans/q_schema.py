"""Type mapping and table definition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import types as ty
from dialoom.plans.registry import query, table

TY_IDS = {
    "mssql": "TY-1", "oracle": "TY-2", "snowflake": "TY-3", "teradata": "TY-4", "postgresql": "TY-5",
    "mysql": "TY-6", "redshift": "TY-7", "netezza": "TY-8",
}

# Every declared type of a dialect's list with the Spark type and loss that the list asks for:
# written from the lists, not from the mapping. "!" marks a loss.
EXPECTED = {
    "mssql": """BIGINT=bigint|FLOAT=double|REAL=double|GEOGRAPHY=string!|GEOMETRY=string!|IMAGE=binary|INT=int|INTEGER=int
      |MONEY=decimal(19,4)|NUMERIC(12,3)=decimal(12,3)|DECIMAL( 9 , 2 )=decimal(9,2)|NTEXT=string|NVARCHAR(30)=string
      |ROWVERSION=binary!|SMALLMONEY=decimal(10,4)|SQL_VARIANT=string!|TEXT=string|uniqueidentifier=string|VARBINARY(8)=binary
      |VARCHAR(10)=string""",
    "oracle": """BLOB=binary|CLOB=string|NCLOB=string|DATE=date|NUMBER(10,2)=decimal(10,2)|NUMBER=decimal(38,0)|NUMBER(9)=decimal(9,0)
      |TIMESTAMP(6)=timestamp|TIMESTAMP WITH TIME ZONE=timestamp!|VARCHAR2(20)=string|NVARCHAR2(20)=string""",
    "snowflake": """CHAR(2)=string|VARCHAR(3)=string|NCHAR(2)=string|NVARCHAR(2)=string|TEXT=string|VARCHAR2(9)=string
      |DATETIME=timestamp|TIMESTAMP_NTZ(9)=timestamp_ntz|TIMESTAMP_LTZ=timestamp|TIMESTAMP_TZ=timestamp!|FLOAT4=double
      |FLOAT8=double|DOUBLE  PRECISION=double|INTEGER=bigint|INT=bigint|NUMBER(38,5)=decimal(38,5)|VARBINARY=binary""",
    "teradata": """BIGINT=bigint|BLOB=binary|VARBYTE(10)=binary|BYTEINT=tinyint|CHAR(1)=string|VARCHAR(20)=string
      |DECIMAL(10,2)=decimal(10,2)|INTEGER=int|SMALLINT=smallint|ST_GEOMETRY=string!|TIMESTAMP(6)=timestamp
      |TIMESTAMP(6) WITH TIME ZONE=timestamp!""",
    "postgresql": """BYTEA=binary|CHAR(1)=string|VARCHAR(3)=string|TEXT=string|DOUBLE PRECISION=double|REAL=double|INTEGER=int
      |NUMERIC(8,1)=decimal(8,1)|DECIMAL(7)=decimal(7,0)|SERIAL=int!|BIGSERIAL=bigint!|SMALLSERIAL=smallint!|UUID=string
      |INTEGER[]=array<int>|TEXT[][]=array<array<string>>|(street TEXT, zip INTEGER)=struct<street:string,zip:int>
      |ROW(a NUMERIC(5,2), b TEXT[], c SERIAL)=struct<a:decimal(5,2),b:array<string>,c:int>!""",
    "mysql": """BIGINT UNSIGNED=decimal(20,0)|BLOB=binary|LONGBLOB=binary|MEDIUMBLOB=binary|TINYBLOB=binary|INT UNSIGNED=bigint
      |INT(10) UNSIGNED ZEROFILL=bigint|MEDIUMINT=int|TINYINT=smallint|MEDIUMTEXT=string|LONGTEXT=string|TEXT=string
      |TINYTEXT=string|YEAR=int""",
    "redshift": """BIGINT=bigint|BOOLEAN=boolean|BYTEINT=tinyint|CHAR(4)=string|VARCHAR(4)=string|TEXT=string
      |DECIMAL(18,4)=decimal(18,4)|INT=int|INTEGER=int|SUPER=string!|HLLSKETCH=string!|TIMESTAMPTZ=timestamp!|TIMETZ=string!
      |VARBYTE=binary""",
    "netezza": """BYTEINT=tinyint|CHAR(3)=string|CHARACTER(5)=string|CHARACTER VARYING(9)=string|datetime=timestamp
      |DOUBLE PRECISION=double|numeric(9,3)=decimal(9,3)|NVARCHAR(5)=string|TIME=string!|TIME WITH TIME ZONE=string!
      |VARCHAR(5)=string|NO_SUCH_TYPE=none!""",
}


def _mapping_query(dialect: str):
    wanted = [part.strip().split("=") for part in EXPECTED[dialect].split("|")]
    rows = ", ".join(
        f"({i}, '{name}', '{kind.rstrip('!')}', {str(kind.endswith('!')).lower()})" for i, (name, kind) in enumerate(wanted)
    )
    sql = f"""SELECT doc_id, declared_type, spark_type, lossy FROM documents
      JOIN (VALUES {rows}) AS types(i, declared_type, spark_type, lossy) ON doc_id % {len(wanted)} = i"""

    def run(spark, sf_dir):
        names = F.array(*[F.lit(name) for name, _ in wanted])
        declared = table(spark, sf_dir, "documents").select(
            F.lit("synapse" if dialect == "mssql" else dialect).alias("dialect"),
            F.col("doc_id").cast("string").alias("column_name"),
            F.get(names, (F.col("doc_id") % len(wanted)).cast("int")).alias("declared_type"),
        )
        return ty.type_report(declared).select(
            F.col("column_name").cast("long").alias("doc_id"), "declared_type",
            F.coalesce("spark_type", F.lit("none")).alias("spark_type"), "lossy",
        )

    run.__name__ = f"map_schema_{dialect}"
    query(TY_IDS[dialect], sql)(run)


for _dialect in EXPECTED:
    _mapping_query(_dialect)


CASTS = {
    "o_orderkey": "BIGINT UNSIGNED", "o_totalprice": "DECIMAL(12,2)", "o_orderpriority": "MEDIUMTEXT", "o_custkey": "TINYINT",
    "o_orderstatus": "ROW(status TEXT, ranks INT[])",
}


@query(
    "TY-6",
    """SELECT cast(o_orderkey AS varchar) AS o_orderkey, cast(cast(o_totalprice AS decimal(12,2)) AS double) AS o_totalprice,
      o_orderpriority, CASE WHEN o_orderkey % 50 = 0 OR o_custkey > 32767 THEN 'none' ELSE cast(o_custkey AS varchar) END AS o_custkey,
      o_orderstatus || ':' || (o_custkey % 9) AS o_orderstatus,
      CASE WHEN o_orderkey % 50 = 0 OR o_custkey > 32767 THEN 'o_custkey' ELSE '' END AS failures FROM orders""",
)
def map_schema_casts(spark, sf_dir):
    """Text columns cast to their declared types; what does not fit is listed and NULL."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey AS string) AS o_orderkey", "cast(o_totalprice AS string) AS o_totalprice", "o_orderpriority",
        "CASE WHEN o_orderkey % 50 = 0 THEN '99999999999999999999x' ELSE cast(o_custkey AS string) END AS o_custkey",
        "concat('{\"status\": \"', o_orderstatus, '\", \"ranks\": [', o_custkey % 9, ']}') AS o_orderstatus",
    )
    mapped = ty.map_schema(rows, "mysql", CASTS, strict=False)
    return mapped.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        "o_orderpriority",
        F.coalesce(F.col("o_custkey").cast("string"), F.lit("none")).alias("o_custkey"),
        F.concat("o_orderstatus.status", F.lit(":"), F.get("o_orderstatus.ranks", 0).cast("string")).alias("o_orderstatus"),
        F.array_join("_cast_failures", ",").alias("failures"),
    )


@query(
    "TY-9",
    """WITH d AS (SELECT *, (doc_id % 8) AS i, doc_id AS p FROM documents)
    SELECT doc_id, declared_type, CASE i WHEN 0 THEN 'decimal(19,4)' WHEN 1 THEN 'decimal(' || (p % 20 + 3) || ',2)'
      WHEN 2 THEN 'timestamp_ntz' WHEN 3 THEN 'string' WHEN 4 THEN 'binary' WHEN 5 THEN 'decimal(20,0)'
      WHEN 6 THEN 'string' ELSE 'none' END AS spark_type, i IN (3, 6, 7) AS lossy FROM (
      SELECT *, CASE i WHEN 0 THEN 'money' WHEN 1 THEN 'NUMBER( ' || (p % 20 + 3) || ', 2 )' WHEN 2 THEN 'TIMESTAMP_NTZ(9)'
        WHEN 3 THEN 'ST_GEOMETRY' WHEN 4 THEN 'bytea' WHEN 5 THEN 'BIGINT  UNSIGNED' WHEN 6 THEN 'SUPER'
        ELSE 'NO_SUCH_TYPE' END AS declared_type FROM d)""",
)
def type_report(spark, sf_dir):
    dialects = F.array(*[F.lit(d) for d in ty.DIALECT_TYPES])
    declared = """CASE doc_id % 8 WHEN 0 THEN 'money' WHEN 1 THEN 'NUMBER( ' || cast(doc_id % 20 + 3 AS string) || ', 2 )'
        WHEN 2 THEN 'TIMESTAMP_NTZ(9)' WHEN 3 THEN 'ST_GEOMETRY' WHEN 4 THEN 'bytea' WHEN 5 THEN 'BIGINT  UNSIGNED'
        WHEN 6 THEN 'SUPER' ELSE 'NO_SUCH_TYPE' END AS declared_type"""
    rows = table(spark, sf_dir, "documents").select(
        F.get(dialects, F.expr("cast(doc_id % 8 AS int)")).alias("dialect"),
        F.col("doc_id").cast("string").alias("column_name"),
        F.expr(declared),
    )
    report = ty.type_report(rows)
    return report.select(
        F.col("column_name").cast("long").alias("doc_id"),
        "declared_type",
        F.coalesce("spark_type", F.lit("none")).alias("spark_type"),
        "lossy",
    )


@query(
    "DDL-3 DDL-5",
    """SELECT o_orderkey AS sale_id, cast(o_totalprice AS double) AS total_amount, 'NULL' AS discount FROM orders""",
)
def add_and_rename_columns(spark, sf_dir):
    """ALTER TABLE ADD COLUMN and RENAME COLUMN as projections of Spark's own, without a helper."""
    sales = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sale_id", "o_totalprice AS sale_amount")
    out = sales.withColumn("discount", F.lit(None).cast("decimal(5,2)")).withColumnRenamed("sale_amount", "total_amount")
    return out.withColumn("discount", F.coalesce(F.col("discount").cast("string"), F.lit("NULL")))


@query("DDL-4", "SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")
def drop_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_orderpriority", "o_orderdate")
