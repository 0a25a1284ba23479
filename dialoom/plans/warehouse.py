"""Layered builds and refreshes over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.relational import customer_revenue, rollup_sum, star_join
from dialoom.plans.registry import table
from dialoom.sources.versions import written


def silver_orders(bronze: DataFrame, amount: str = "order_amount") -> DataFrame:
    """Positive amounts only, equal rows once (a SET table)."""
    return bronze.filter(F.col(amount) > 0).dropDuplicates()


def gold_revenue(silver: DataFrame) -> DataFrame:
    return customer_revenue(silver)


def silver_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Enriched sales, clean customers and clean products in the shape of the gold views."""
    sales = star_join(
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey", "l_partkey AS product_id", "cast(l_extendedprice AS decimal(18,2)) AS sale_amount"
        ),
        [(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS customer_id"), ["l_orderkey"])],
    ).drop("l_orderkey")
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS city")
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer_id", "c_nationkey")
    products = table(spark, sf_dir, "part").selectExpr("p_partkey AS product_id", "p_brand AS category")
    return sales, people.join(nation, "c_nationkey").drop("c_nationkey"), products


def build_layers(raw: DataFrame, base: str) -> DataFrame:
    """Bronze as it came, silver filtered without repeats, gold per customer: three written tables."""
    bronze = written(raw, base, "bronze")
    silver = written(silver_orders(bronze), base, "silver")
    return written(gold_revenue(silver), base, "gold")


AUDIT_LOG = "etl_audit_log"


def refresh_layers(
    sales: DataFrame, customers: DataFrame, products: DataFrame, base: str, as_of: str | None = None,
    job: str = "sp_refresh_gold_layer",
) -> DataFrame:
    """Refill the cache, rebuild the summary, append an audit row; returns the new summary.

    Cache and summary go to new paths, so a failed step leaves the earlier ones as they were. The
    audit row, which tells failure too, is appended to the log below ``base``.
    """
    spark = sales.sparkSession
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")

    def log(status: str) -> None:
        row = spark.range(1).select(now.alias("ts"), F.lit(job).alias("job"), F.lit(status).alias("status"))
        row.write.mode("append").parquet(f"{base.rstrip('/')}/{AUDIT_LOG}")

    try:
        cache = written(sales, base, "silver_cache")
        joined = star_join(cache, [(customers, ["customer_id"]), (products, ["product_id"])])
        summary = written(rollup_sum(joined, ["city", "category"], "sale_amount", "total_sales"), base, "gold_sales_summary")
    except Exception:
        log("FAILED")
        raise
    log("SUCCESS")
    return summary


def lookup(df: DataFrame, **params) -> DataFrame:
    """Rows whose columns equal the given values."""
    for name, value in params.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, args: dict | None = None):
    """A statement with named parameters (``:p``, ``IDENTIFIER(:t)``) over given frames."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def update_if_exists(target: DataFrame, key: str, value, **changes) -> tuple[DataFrame, DataFrame] | None:
    """Update the row with this key and return (new table, changed row); None when there is no such row."""
    from dialoom.operators.merges import put_row

    if lookup(target, **{key: value}).isEmpty():
        return None
    changed = put_row(target, key, {key: value, **changes})
    return changed, lookup(changed, **{key: value})


