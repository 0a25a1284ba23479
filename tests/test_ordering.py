"""Numbering, ranking and ordered concatenation, with groups that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import ordering
from dialoom.operators import relational as rel


@pytest.fixture(scope="module")
def skewed(spark):
    """2000 rows, a third of them in group 0, many ties in the order column."""
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(10), i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "g int, o int, i int").repartition(7).cache()


def test_number_rows_is_consecutive(skewed):
    rows, df = skewed
    got = {r.i: r.n for r in ordering.number_rows(df, ["o", "i"], "n").collect()}
    assert got == {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}


def test_number_rows_of_nothing(spark):
    assert ordering.number_rows(spark.range(0), ["id"], "n").collect() == []


def test_positions_of_a_large_group(skewed):
    rows, df = skewed
    ranked = ordering.position_within(df, ["g"], [F.col("o").desc(), F.col("i")], "n")
    got = {r.i: r.n for r in ranked.collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected |= {r[2]: n for n, r in enumerate(group, 1)}
    assert got == expected


def test_positions_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, i int")
    got = {r.i: r.n for r in ordering.position_within(df, ["g"], ["i"], "n").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_ordered_text_and_array(skewed):
    rows, df = skewed
    valued = df.withColumn("v", F.when(F.col("i") % 5 > 0, F.col("i").cast("string")))
    texts = {r.g: r.t for r in rel.string_agg(valued, ["g"], "v", ["o", "i"], "|", "t").collect()}
    lists = {r.g: r.t for r in rel.array_agg(valued, ["g"], "v", ["o", "i"], "t").collect()}
    for g in {r[0] for r in rows}:
        values = [str(r[2]) for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[0] == g and r[2] % 5 > 0]
        assert texts[g] == "|".join(values)
        assert lists[g] == values


def test_ordered_text_keeps_empty_values_and_null_groups(spark):
    df = spark.createDataFrame([(1, 1, ""), (1, 2, "b"), (2, 1, None), (3, 1, "")], "g int, o int, v string")
    assert {r.g: r.t for r in rel.string_agg(df, ["g"], "v", ["o"], ",", "t").collect()} == {1: ",b", 2: None, 3: ""}
    assert {r.g: r.t for r in rel.array_agg(df, ["g"], "v", ["o"], "t").collect()} == {1: ["", "b"], 2: [], 3: [""]}


def test_assign_ids_goes_on_after_existing(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    existing = spark.createDataFrame([(41,), (7,)], "id long")
    assert sorted(r.id for r in rel.assign_ids(df, ["k"], existing=existing).collect()) == [42, 43, 44, 45, 46]
    none = spark.createDataFrame([], "id long")
    assert sorted(r.id for r in rel.assign_ids(df, ["k"], start=10, existing=none).collect()) == [10, 11, 12, 13, 14]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r.id for r in rel.sample_n(df, 50, "id", seed=1).collect()}
    assert len(first) == 50
    assert first == {r.id for r in rel.sample_n(df.repartition(9), 50, "id", seed=1).collect()}
    assert first != {r.id for r in rel.sample_n(df, 50, "id", seed=2).collect()}
    assert rel.sample_n(df, 5000, "id").count() == 1000


def test_approximate_distinct_stays_within_its_bound(spark):
    df = spark.range(200_000).withColumn("v", F.col("id") % 50_000)
    found = df.agg(rel.approx_distinct("v", 0.02)).first()[0]
    assert abs(found - 50_000) / 50_000 < 0.06


def test_left_summary_and_paging(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id int, customer_name string")
    fact = spark.createDataFrame([(1, 10, 2.0), (1, 11, 4.0)], "customer_id int, order_id int, order_amount double")
    got = {r.customer_id: (r.total_orders, r.total_sales, r.avg_order_value) for r in rel.customer_sales(dim, fact).collect()}
    assert got == {1: (2, 6.0, 3.0), 2: (0, None, None)}
    pages = rel.with_page(spark.range(21), ["id"]).groupBy("page").count().collect()
    assert {r.page: r["count"] for r in pages} == {1: 10, 2: 10, 3: 1}
    assert [r.id for r in rel.page(spark.range(21), ["id"], 3).collect()] == [20]
    assert [r.id for r in rel.page(spark.range(21), ["-id"], 3).collect()] == [0]
    assert rel.page(spark.range(21), ["id"], 4).count() == 0
    assert rel.page_count(spark.range(21)).first().pages == 3


def test_latest_gives_all_asked_for_and_puts_unknown_times_last(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(300)], "id int, ts int")
    got = rel.latest(df, "ts", 500, tie="id").collect()
    assert len(got) == 300 and got[0].id == 298
    assert [r.id for r in rel.latest(df.filter("id < 4"), "ts", 4, tie="id").collect()] == [2, 0, 1, 3]


def test_recursion_ends_and_tells_when_it_comes_round(spark):
    anchor = spark.createDataFrame([(0,)], "n int")
    done = rel.recursive(anchor, lambda level: level.filter("n < 5").selectExpr("n + 1 AS n"))
    assert sorted(r.n for r in done.collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(RuntimeError, match="comes round"):
        rel.recursive(anchor, lambda level: level.selectExpr("(n + 1) % 3 AS n"))
    assert rel.recursive(anchor.limit(0), lambda level: level).count() == 0


def test_recursion_over_branching_cycles(spark):
    """a-b-a and a-c-a: the levels grow and never repeat as a whole."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")], "src string, dst string")
    anchor = spark.createDataFrame([("a",)], "node string")
    onward = lambda level: level.join(edges, level.node == edges.src).select(F.col("dst").alias("node"), *[c for c in level.columns if c != "node"])
    with pytest.raises(RuntimeError, match="comes round"):
        rel.recursive(anchor, onward)
    assert sorted(r.node for r in rel.recursive(anchor, onward, "union").collect()) == ["a", "b", "c"]
    got = rel.recursive(anchor, onward, "cycle").collect()
    walks = sorted(("".join(p.node for p in r.path), r.is_cycle) for r in got)
    assert walks == [("a", False), ("ab", False), ("aba", True), ("ac", False), ("aca", True)]
    # Counting rows differ on every round, so only their place tells a cycle.
    counted = anchor.withColumn("n", F.lit(0))
    step = lambda level: level.join(edges, level.node == edges.src).select(F.col("dst").alias("node"), (F.col("n") + 1).alias("n"), "path")
    assert rel.recursive(counted, step, "cycle", by=["node"]).count() == 5
    nulls = spark.createDataFrame([(None,), (None,)], "node string")
    assert rel.recursive(nulls, lambda level: level, "union").count() == 1
    with pytest.raises(ValueError, match="unknown mode"):
        rel.recursive(anchor, onward, "some")


def test_seek_pages_in_all_orders(spark):
    rows = [(None if i % 5 == 0 else i % 3, i) for i in range(23)]
    df = spark.createDataFrame(rows, "a int, i int")
    for order in (["a", "i"], ["-a", "i"], ["a", "-i"], ["-a", "-i"]):
        whole = [tuple(r) for r in df.orderBy(*[F.col(k[1:]).desc() if k[0] == "-" else F.col(k) for k in order]).collect()]
        seen, after = [], None
        while part := [tuple(r) for r in rel.seek_page(df, order, after, 4).collect()]:
            seen, after = seen + part, part[-1]
        assert seen == whole, order
        index = rel.page_index(df, order, 4)
        assert [tuple(r) for n in range(1, 7) for r in rel.page(df, order, n, 4, index).collect()] == whole


def test_a_deep_page_bounds_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    last = events.agg(F.max("event_id")).first()[0]
    plan = rel.seek_page(events, ["event_id"], (last - 5,), 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id" in plan and "TakeOrderedAndProject(limit=10" in plan and "offset" not in plan


def test_samples_by_fraction_and_within_groups(spark):
    df = spark.range(20_000).withColumn("g", F.when(F.col("id") < 5, "few").otherwise("many"))
    part = rel.sample_fraction(df, 0.3, "id", seed=4)
    assert abs(part.count() - 6000) < 300
    assert {r.id for r in part.collect()} == {r.id for r in rel.sample_fraction(df.repartition(5), 0.3, "id", seed=4).collect()}
    assert rel.sample_fraction(df, 1, "id").count() == 20_000 and rel.sample_fraction(df, 0, "id").count() == 0
    assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
    counts = {r.g: r["count"] for r in rel.sample_n_within(df, ["g"], 50, "id").groupBy("g").count().collect()}
    assert counts == {"few": 5, "many": 50}
    with pytest.raises(ValueError, match="fraction"):
        rel.sample_fraction(df, 1.5, "id")


def test_series(spark):
    assert [r.n for r in rel.generate_series(spark, 1, 10, 4).orderBy("n").collect()] == [1, 5, 9]
    assert rel.generate_series(spark, 5, 1).count() == 0
    assert [str(r.d) for r in rel.generate_dates(spark, "2024-01-31", "2024-05-31", "1 month").orderBy("d").collect()] == [
        "2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30", "2024-05-31"]
    assert [str(r.d) for r in rel.generate_dates(spark, "2024-01-01", "2024-02-01", "2 weeks").orderBy("d").collect()] == [
        "2024-01-01", "2024-01-15", "2024-01-29"]
    assert rel.generate_dates(spark, "2024-02-01", "2024-01-01").count() == 0


def test_positions_and_totals_across_slices(spark):
    """Groups within a slice, over a border, over several slices and alone in some, in small Arrow batches."""
    rng = random.Random(7)
    sizes = [1, 2, 900, 3, 1, 2500, 40, 1, 700, 2]
    rows = [(None if g == 4 else g / 2 - 1, rng.randrange(50), i) for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rng.shuffle(rows)
    rows += [(-0.0, 100, 10_000)]  # the group of 0.0
    df = spark.createDataFrame(rows, "g double, o int, i int")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        got = ordering.position_within(df, ["g"], [F.col("o").desc(), "i"], "n", "all").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((-o, i))
    want = {i: (n, len(group)) for group in groups.values() for n, (_, i) in enumerate(sorted(group), 1)}
    assert {r.i: (r.n, r["all"]) for r in got} == want


def test_positions_need_one_write_and_no_join_on_the_group(skewed, monkeypatch):
    _, df = skewed
    written = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda d: (written.append(d.columns), real(d))[1])
    plan = ordering.position_within(df, ["g"], ["o", "i"], "n")._jdf.queryExecution().toString()
    assert sum("i" in columns for columns in written) == 1
    assert "SortMergeJoin" not in plan and "_slice" in plan
