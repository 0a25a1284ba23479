"""Warehouse workload queries: joins, aggregates, ranking, sets, sequences, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.operators import relational as rel
from dialoom.plans import warehouse
from dialoom.plans.derived import customers, orders
from dialoom.plans.registry import query, table
from dialoom.session import materialize


@query(
    "JN-5",
    """SELECT n_name, p_type, count(*) AS lines, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS price
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_type""",
)
def star_join_totals(spark, sf_dir):
    fact = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    joined = rel.star_join(
        fact,
        [
            (table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c_custkey"), ["l_orderkey"]),
            (table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS n_nationkey"), ["c_custkey"]),
            (table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]),
            (table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_type"), ["l_partkey"]),
        ],
    )
    return joined.groupBy("n_name", "p_type").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query(
    "JN-6 AGG-8",
    """SELECT c_custkey AS customer_id, c_name AS customer_name, count(o_orderkey) AS total_orders,
      coalesce(cast(sum(cast(o_totalprice AS decimal(10,2))) AS double), -1.0) AS total_sales,
      coalesce(cast(sum(cast(o_totalprice AS decimal(10,2))) AS double) / count(o_orderkey), -1.0) AS avg_order_value
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
)
def customer_sales(spark, sf_dir):
    summed = rel.customer_sales(customers(spark, sf_dir), orders(spark, sf_dir))
    total = F.col("total_sales").cast("double")
    return summed.select(
        "customer_id",
        "customer_name",
        "total_orders",
        F.coalesce(total, F.lit(-1.0)).alias("total_sales"),
        F.coalesce(F.try_divide(total, F.col("total_orders")), F.lit(-1.0)).alias("avg_order_value"),
    )


@query(
    "JN-7",
    """SELECT 'left' AS side, n_name, coalesce(s_name, 'none') AS s_name FROM nation LEFT JOIN
        (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey
    UNION ALL SELECT 'right', coalesce(n_name, 'none'), s_name FROM (SELECT * FROM nation WHERE n_regionkey = 1)
      RIGHT JOIN supplier ON n_nationkey = s_nationkey""",
)
def outer_joins(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    left = rel.outer_join(nation, supplier.filter("s_acctbal > 5000"), ["n_nationkey"], "left")
    right = rel.outer_join(nation.filter("n_regionkey = 1"), supplier, ["n_nationkey"], "right")

    def shown(df, side):
        return df.select(
            F.lit(side).alias("side"),
            F.coalesce("n_name", F.lit("none")).alias("n_name"),
            F.coalesce("s_name", F.lit("none")).alias("s_name"),
        )

    return shown(left, "left").unionByName(shown(right, "right"))


@query(
    "JN-8",
    """SELECT c_custkey, o_orderkey, rn FROM (SELECT o_custkey AS c_custkey, o_orderkey,
      cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS int) AS rn FROM orders)
    WHERE rn <= 3""",
)
def top_orders_per_customer(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey", "o_totalprice")
    top = rel.top_per_key(rows, ["c_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return top.select("c_custkey", "o_orderkey", "rn")


@query(
    "JN-8",
    """SELECT doc_id, coalesce(word, 'none') AS word FROM (SELECT doc_id,
      unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM (SELECT doc_id,
        list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 16) AS w FROM documents))""",
)
def explode_outer_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 16).alias("w")
    )
    return rel.apply_explode(docs, F.col("w"), "word", outer=True).select(
        "doc_id", F.coalesce("word", F.lit("none")).alias("word")
    )


@query(
    "AGG-5b LIM-1 DT-2",
    """WITH r AS (SELECT o_orderkey, c_name AS customer_name, sum(cast(l_extendedprice AS decimal(18,2))
        * cast(l_quantity AS decimal(10,2))) AS total_amount FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > DATE '2001-05-20' - INTERVAL 3 MONTH
      GROUP BY o_orderkey, c_name, o_orderdate)
    SELECT customer_name, cast(sum(total_amount) AS double) AS total_spent FROM r GROUP BY customer_name
    ORDER BY total_spent DESC, customer_name LIMIT 10""",
)
def top_recent_spenders(spark, sf_dir):
    """The workload all source dialects share: recent order totals staged, then the top ten customers."""
    totals = rel.recent_order_totals(
        orders(spark, sf_dir).select("order_id", "customer_id", "order_date"),
        customers(spark, sf_dir).select("customer_id", "customer_name"),
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey AS order_id", "l_extendedprice AS price", "l_quantity AS quantity"
        ),
        "2001-05-20",
    )
    return rel.top_spenders(totals).withColumn("total_spent", F.col("total_spent").cast("double"))


@query(
    "AGG-5b",
    """SELECT o_orderkey AS order_id, c_name AS customer_name, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
      cast(sum(cast(l_extendedprice AS decimal(18,2)) * cast(l_quantity AS decimal(10,2))) AS double) AS total_amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderdate > DATE '1999-05-31' - INTERVAL 3 MONTH GROUP BY o_orderkey, c_name, o_orderdate""",
)
def recent_order_totals(spark, sf_dir):
    totals = rel.recent_order_totals(
        orders(spark, sf_dir).select("order_id", "customer_id", "order_date"),
        customers(spark, sf_dir).select("customer_id", "customer_name"),
        table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey AS order_id", "l_extendedprice AS price", "l_quantity AS quantity"
        ),
        "1999-05-31",
    )
    return totals.withColumns(
        {"order_date": F.date_format("order_date", "yyyy-MM-dd"), "total_amount": F.col("total_amount").cast("double")}
    )


GOLD = """gold AS (SELECT n_name AS city, p_brand AS category,
      sum(cast(l_extendedprice AS decimal(18,2))) AS total_sales, count(DISTINCT o_custkey) AS total_customers,
      count(DISTINCT l_partkey) AS total_products FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    GROUP BY n_name, p_brand)"""


@query(
    "AGG-6",
    f"WITH {GOLD} SELECT city, category, cast(total_sales AS double) AS total_sales, total_customers, total_products FROM gold",
)
def gold_sales_summary(spark, sf_dir):
    summary = rel.sales_summary(*warehouse.silver_tables(spark, sf_dir), rows=table(spark, sf_dir, "lineitem").count())
    return summary.withColumn("total_sales", F.col("total_sales").cast("double"))


@query(
    "AGG-7",
    f"""WITH {GOLD} SELECT city, cast(sum(total_sales) AS double) AS city_sales FROM gold GROUP BY city
    HAVING sum(total_sales) > 500000""",
)
def gold_top_city_sales(spark, sf_dir):
    summary = rel.sales_summary(*warehouse.silver_tables(spark, sf_dir), rows=table(spark, sf_dir, "lineitem").count())
    top = rel.top_groups(summary, "city", "total_sales", 500000, "city_sales")
    return top.withColumn("city_sales", F.col("city_sales").cast("double"))


@query(
    "AGG-9 DML-1 SET-3",
    """SELECT o_custkey AS customer_id, cast(sum(amount) AS double) AS total_revenue FROM (
      SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, cast(o_totalprice AS decimal(10,2)) AS amount, o_orderstatus
      FROM orders WHERE cast(o_totalprice AS decimal(10,2)) > 0) GROUP BY o_custkey""",
)
def layered_customer_revenue(spark, sf_dir):
    """Bronze rows with repeats, silver without, gold per customer."""
    raw = orders(spark, sf_dir)
    bronze = rel.load_multiset(raw, raw)
    gold = warehouse.gold_revenue(warehouse.silver_orders(bronze))
    return gold.withColumn("total_revenue", F.col("total_revenue").cast("double"))


@query(
    "AGG-10",
    """SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey) AS priorities,
      string_agg(CASE WHEN o_orderkey % 4 > 0 THEN cast(o_orderkey AS varchar) END, '; ' ORDER BY o_orderkey) AS keys
    FROM orders GROUP BY o_custkey""",
)
def string_aggregation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    first = rel.string_agg(
        rows.select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey"),
        ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"], ",", "priorities",
    )
    some = rows.selectExpr(
        "o_custkey", "o_orderkey", "CASE WHEN o_orderkey % 4 > 0 THEN cast(o_orderkey AS string) END AS k"
    )
    return first.join(rel.string_agg(some, ["o_custkey"], "k", ["o_orderkey"], "; ", "keys"), "o_custkey")


@query(
    "AGG-11",
    """SELECT l_suppkey, md5(array_to_string(array_agg(l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey), ',')) AS items,
      count(*) AS n FROM lineitem GROUP BY l_suppkey""",
)
def array_aggregation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    out = rel.array_agg(rows, ["l_suppkey"], "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select(
        "l_suppkey",
        F.md5(F.array_join(F.col("items").cast("array<string>"), ",")).alias("items"),
        F.size("items").cast("long").alias("n"),
    )


@query("AGG-12", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag")
def variance(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(rel.var_samp("l_quantity"), 6).alias("spread"))


@query(
    "AGG-13",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS within_bound FROM lineitem GROUP BY l_returnflag",
)
def approximate_distinct(spark, sf_dir):
    """The estimate beside the exact count: it lies within three standard errors."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey")
    estimated = rows.groupBy("l_returnflag").agg(rel.approx_distinct("l_partkey", 0.02).alias("estimate"))
    exact = rows.distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    near = F.abs(F.col("estimate") - F.col("parts")) <= F.lit(3 * 0.02) * F.col("parts")
    return exact.join(estimated, "l_returnflag").select("l_returnflag", "parts", near.alias("within_bound"))


@query(
    "AGG-14",
    """SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING",
      count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY",
      count(*) FILTER (c_mktsegment = 'FURNITURE') AS "FURNITURE" FROM customer GROUP BY c_nationkey""",
)
def pivot_segments(spark, sf_dir):
    counted = rel.pivot(
        table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"],
        F.count(F.lit(1)),
    )
    return counted.fillna(0)


@query(
    "AGG-14 SET-2",
    """SELECT o_orderkey, 'price' AS kind, o_totalprice AS amount FROM orders
    UNION ALL SELECT o_orderkey, 'year', cast(year(o_orderdate) AS double) FROM orders""",
)
def unpivot_amounts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_totalprice AS price", "cast(year(o_orderdate) AS double) AS year"
    )
    return rel.unpivot(rows, ["o_orderkey"], ["price", "year"], "kind", "amount")


@query(
    "WIN-1",
    """SELECT o_custkey, o_orderkey, o_totalprice,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS order_rank FROM orders""",
)
def rank_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.rank_within(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "order_rank")


@query(
    "WIN-1",
    """SELECT o_orderstatus, o_orderkey,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS status_rank FROM orders""",
)
def rank_large_groups(spark, sf_dir):
    """Three groups hold all rows: each is split over tasks."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    ranked = rel.rank_within(
        rows, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "status_rank"
    )
    return ranked.select("o_orderstatus", "o_orderkey", "status_rank")


@query(
    "LIM-1",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rel.top_n(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


@query(
    "LIM-2",
    "SELECT event_id, 3 AS page FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 10 OFFSET 20)",
)
def third_page(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return rel.page(events, ["-ts", "event_id"], 3).select("event_id", F.lit(3).alias("page"))


@query(
    "LIM-2",
    """SELECT event_id, event_type FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM (SELECT ts, event_id,
      row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events) WHERE i = n // 2)
    ORDER BY ts, event_id LIMIT 25""",
)
def page_after_a_row(spark, sf_dir):
    """The page behind the middle row, found by its keys."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    numbered = rel.page_index(events, ["ts", "event_id"], 1)
    middle = numbered.agg(F.max("page")).first()[0] // 2
    key = numbered.filter(F.col("page") == middle).first()
    return rel.seek_page(events, ["ts", "event_id"], (key.ts, key.event_id), 25).select("event_id", "event_type")


@query(
    "LIM-2",
    """SELECT (row_number() OVER (ORDER BY ts DESC, event_id) - 1) // 50 + 1 AS page, event_id AS first_event FROM events
    QUALIFY (row_number() OVER (ORDER BY ts DESC, event_id) - 1) % 50 = 0""",
)
def page_starts(spark, sf_dir):
    """The first row of every page of 50."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return rel.page_index(events, ["-ts", "event_id"], 50).select("page", F.col("event_id").alias("first_event"))


@query("LIM-2", "SELECT cast(ceil(count(*) / 10.0) AS bigint) AS pages FROM events")
def page_count(spark, sf_dir):
    return rel.page_count(table(spark, sf_dir, "events"))


@query(
    "LIM-2",
    """SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) // 10 + 1 AS page FROM events""",
)
def all_pages(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return rel.with_page(events, [F.col("ts").desc(), F.col("event_id")]).select("event_id", "page")


@query("SMP-1", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || ':7'), c_custkey LIMIT 50")
def sample_customers(spark, sf_dir):
    """A seeded sample of fixed size."""
    return rel.sample_n(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, "c_custkey", seed=7)


@query(
    "SMP-1",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE substr(md5(o_orderkey || ':3'), 1, 13) < '4000000000000'""",
)
def sample_quarter_of_orders(spark, sf_dir):
    """A seeded quarter of all orders, in expectation."""
    return rel.sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 0.25, "o_orderkey", seed=3)


@query(
    "SMP-1",
    """SELECT event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':5'), event_id) <= 20""",
)
def sample_events_per_type(spark, sf_dir):
    """Twenty events of every type."""
    return rel.sample_n_within(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 20, "event_id", seed=5)


@query(
    "SET-1",
    """SELECT 'distinct' AS kind, c_custkey, 1 AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders
      WHERE o_totalprice > 400000)
    UNION ALL SELECT 'all', k, cast(count(*) AS int) FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL
      SELECT o_custkey FROM orders WHERE o_totalprice > 250000) GROUP BY k""",
)
def minus_sets(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey")
    keys = table(spark, sf_dir, "orders").selectExpr("o_custkey AS c_custkey", "o_totalprice")
    first = rel.minus(people, keys.filter("o_totalprice > 400000").select("c_custkey"))
    rest = rel.minus(keys.select("c_custkey"), keys.filter("o_totalprice > 250000").select("c_custkey"), all=True)
    return rel.union_all(
        [
            first.select(F.lit("distinct").alias("kind"), "c_custkey", F.lit(1).alias("n")),
            rest.groupBy("c_custkey").agg(F.count(F.lit(1)).cast("int").alias("n")).select(
                F.lit("all").alias("kind"), "c_custkey", "n"
            ),
        ]
    )


@query(
    "SET-3",
    """SELECT o_custkey, count(*) AS rows_in_set FROM (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)
    GROUP BY o_custkey""",
)
def load_set_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    early = rows.filter("o_orderstatus = 'F'").dropDuplicates()
    loaded = rel.load_set(early, rows)
    return loaded.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("rows_in_set"))


@query(
    "SEQ-1",
    """SELECT strftime(d, '%Y-%m-%d') AS d, count(o_orderkey) AS orders FROM (
      SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 WEEK)) AS d)
    LEFT JOIN orders ON cast(o_orderdate AS date) = cast(d AS date) GROUP BY d""",
)
def weekly_series(spark, sf_dir):
    weeks = rel.generate_dates(spark, "1995-01-01", "2001-08-01", "1 week")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("o_orderkey").alias("orders"))
    joined = weeks.join(days, "d", "left").fillna(0)
    return joined.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "orders")


@query(
    "SEQ-1",
    """SELECT n, count(o_orderkey) AS orders FROM (SELECT unnest(generate_series(0, 500000, 25000)) AS n)
    LEFT JOIN orders ON cast(floor(o_totalprice / 25000) * 25000 AS bigint) = n GROUP BY n""",
)
def price_buckets(spark, sf_dir):
    marks = rel.generate_series(spark, 0, 500000, 25000)
    counted = table(spark, sf_dir, "orders").groupBy(
        (F.floor(F.col("o_totalprice") / 25000) * 25000).cast("long").alias("n")
    )
    counts = counted.agg(F.count("o_orderkey").alias("orders"))
    return marks.select(F.col("n").cast("long").alias("n")).join(counts, "n", "left").fillna(0)


@query(
    "SEQ-2",
    """WITH RECURSIVE up AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS depth FROM customer
      UNION ALL SELECT start, node // 3, depth + 1 FROM up WHERE node > 0)
    SELECT start, node, depth FROM up""",
)
def recursive_parents(spark, sf_dir):
    """Walk from each customer to the root of a tree kept as an edge table."""
    people = table(spark, sf_dir, "customer")
    edges = people.filter("c_custkey > 0").selectExpr("c_custkey AS node", "c_custkey div 3 AS parent")
    anchor = people.selectExpr("c_custkey AS start", "c_custkey AS node", "0 AS depth")

    def parents(level):
        return level.join(edges, "node").selectExpr("start", "parent AS node", "depth + 1 AS depth")

    return rel.recursive(anchor, parents)


# Each customer points to three others, round and round.
RING = """edges AS (SELECT c_custkey AS src, (c_custkey * 7 + 1) % (SELECT count(*) FROM customer) AS dst FROM customer UNION
    SELECT c_custkey, c_custkey // 2 FROM customer)"""


@query(
    "SEQ-2",
    f"""WITH RECURSIVE {RING}, reach AS (SELECT c_custkey AS node FROM customer WHERE c_name = (SELECT max(c_name) FROM customer)
      UNION SELECT dst FROM reach JOIN edges ON src = node)
    SELECT node FROM reach""",
)
def recursive_reach(spark, sf_dir):
    """All customers reached over edges full of cycles: UNION, every row once."""
    people = table(spark, sf_dir, "customer")
    size = people.agg(F.count(F.lit(1)).alias("n"))
    last = people.agg(F.max("c_name").alias("c_name"))
    ring = people.join(F.broadcast(size)).selectExpr("c_custkey AS src", "(c_custkey * 7 + 1) % n AS dst")
    # Written, as every level reads them.
    edges = materialize(ring.union(people.selectExpr("c_custkey", "c_custkey div 2")).distinct())
    start = people.join(last, "c_name", "left_semi").selectExpr("c_custkey AS node")
    return rel.recursive(start, lambda level: level.join(edges, level.node == edges.src).select(F.col("dst").alias("node")), "union")


@query(
    "SEQ-2",
    """WITH RECURSIVE edges AS (SELECT DISTINCT n_nationkey AS src, s_nationkey AS dst FROM nation JOIN (SELECT DISTINCT
        s_nationkey FROM supplier) ON s_nationkey IN ((n_nationkey * 3 + 1) % 25, (n_nationkey + 5) % 25)),
      walk AS (SELECT n_nationkey AS node, [n_nationkey] AS path, false AS is_cycle FROM nation WHERE n_nationkey < 5
        UNION ALL SELECT dst, list_append(path, dst), list_contains(path, dst) FROM walk JOIN edges ON src = node
        WHERE NOT is_cycle AND len(path) <= 6)
    SELECT node, is_cycle, array_to_string(path, '>') AS path FROM walk""",
)
def recursive_walks(spark, sf_dir):
    """Walks of up to six steps between nations that marks where each comes round: CYCLE."""
    nations, at = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    targets = F.explode(F.array((at * 3 + 1) % 25, (at + 5) % 25))
    pairs = nations.select(at.alias("src"), targets.alias("dst")).distinct()
    edges = pairs.join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dst")), "dst", "left_semi")

    def onward(level):
        return level.filter(F.size("path") <= 6).join(edges, level.node == edges.src).select(F.col("dst").alias("node"), "path")

    start = nations.filter(at < 5).select(at.alias("node"))
    found = rel.recursive(start, onward, "cycle", by=["node"])
    path = F.array_join(F.transform("path", lambda p: p["node"].cast("string")), ">")
    return found.select("node", "is_cycle", path.alias("path"))


@query(
    "SEQ-3",
    """SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_name, c_custkey) AS id FROM customer""",
)
def assign_keys(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    taken = table(spark, sf_dir, "supplier").selectExpr("cast(900 + s_suppkey % 101 AS bigint) AS id").unionByName(
        spark.range(1000, 1001)
    )
    return rel.assign_ids(people, ["c_name", "c_custkey"], existing=taken).select("c_custkey", "id")
