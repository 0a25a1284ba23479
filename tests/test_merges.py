import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.operators import merges
from dialoom.operators import relational as rel
from dialoom.schema import EXPORT_SCHEMA, RESPONSE_SCHEMA, RESULT_SCHEMA, with_result_columns


def result(spark, rows):
    columns = ["input_file_number", "input_file_path", "is_conversion_target", "result_content", "result_error",
               "result_python_parse_error", "result_sql_parse_errors", "export_status"]
    schema = ", ".join(f"{c} {RESULT_SCHEMA[c].dataType.simpleString()}" for c in columns)
    return with_result_columns(spark.createDataFrame(rows, schema))


def responses(spark, rows):
    full = [(n, c, None, None, None, None, None, e) for n, c, e in rows]
    return spark.createDataFrame(full, RESPONSE_SCHEMA)


def test_result_schema_has_thirty_columns():
    assert len(RESULT_SCHEMA) == 30
    assert RESULT_SCHEMA["result_processing_time_seconds"].dataType.simpleString() == "float"


def test_merge_responses(spark):
    source = result(spark, [
        (1, "a", True, None, "old error", "p", ["s"], None),
        (2, "b", True, "old", "old error", "p", ["s"], None),
        (3, "c", True, "old", "old error", "p", ["s"], None),
        (4, "d", True, "old", None, None, None, None),
    ])
    new = responses(spark, [(1, "new", None), (2, None, "failed"), (4, "partial", "cut")])
    got = {r.input_file_number: r for r in merges.merge_responses(source, new, {"request_params_for_fix": "{}"}).collect()}
    assert (got[1].result_content, got[1].result_error, got[1].is_conversion_target) == ("new", None, False)
    assert (got[2].result_content, got[2].result_error, got[2].is_conversion_target) == ("old", "failed", True)
    assert (got[3].result_content, got[3].result_error) == ("old", "old error")
    assert (got[4].result_content, got[4].result_error, got[4].is_conversion_target) == ("partial", "cut", True)
    assert all(r.result_python_parse_error is None and r.result_sql_parse_errors is None for r in got.values())
    assert all(r.request_params_for_fix == "{}" for r in got.values())
    kept = {r.input_file_number: r for r in merges.merge_responses(source, new, reset_all=False).collect()}
    assert kept[1].result_sql_parse_errors is None and kept[3].result_sql_parse_errors == ["s"]
    assert merges.merge_responses(source, new).columns == source.columns


def test_merge_exports_normalises_both_flavours(spark):
    source = result(spark, [(i, p, True, "x", None, None, None, "exported") for i, p in enumerate("abcd")])
    rows = [("a", "/o/a", "success", None, None, 5), ("b", None, "failed", "disk", None, 1), ("c", "/o/c", "exported", None, None, 2)]
    got = {r.input_file_path: r for r in merges.merge_exports(source, spark.createDataFrame(rows, EXPORT_SCHEMA)).collect()}
    assert [got[p].export_status for p in "abcd"] == ["exported", "export_failed", "exported", "exported"]
    assert got["b"].export_error == "disk" and got["a"].export_content_size_bytes == 5


def test_shrink_report(spark):
    pairs = [(1, "a" * 100, "a" * 80), (2, "a" * 100, "a" * 95), (3, "", ""), (4, None, None), (5, "abc", None)]
    before = spark.createDataFrame([(i, f"p{i}", b) for i, b, _ in pairs], "input_file_number int, input_file_path string, result_content string")
    after = spark.createDataFrame([(i, a) for i, _, a in pairs], "input_file_number int, result_content string")
    got = {r.input_file_number: r.size_ratio for r in merges.content_shrink_report(before, after).collect()}
    assert got == {1: 0.8, 5: 0.0}


KEYS = st.one_of(st.none(), st.integers(0, 6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, st.text("ab", max_size=2)), max_size=8), st.dictionaries(st.integers(0, 9), st.text("xy", max_size=2), max_size=6))
def test_upsert_equals_a_dictionary_merge(spark, target, source):
    left = spark.createDataFrame([(k, v, "z") for k, v in target], "k int, v string, w string")
    right = spark.createDataFrame([(k, v) for k, v in source.items()], "k int, v string")
    got = sorted(((r.k, r.v, r.w) for r in merges.upsert(left, right, ["k"]).collect()), key=repr)
    present = {k for k, _ in target}
    expected = [(k, source.get(k, v), "z") for k, v in target]
    expected += [(k, v, None) for k, v in source.items() if k not in present]
    assert got == sorted(expected, key=repr)


def test_duplicate_source_keys_raise(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="duplicate source key: 1"):
        merges.upsert(target, source, ["k"]).collect()


def test_update_can_set_null_and_keeps_unmatched(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(1, None)], "k int, v string")
    assert {r.k: r.v for r in merges.update_from(target, source, ["k"], ["v"]).collect()} == {1: None, 2: "b"}


def test_set_and_multiset_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    twice = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    assert rel.load_set(empty, twice).count() == 1
    assert rel.load_multiset(empty, twice).count() == 2
    assert rel.load_set(rel.load_set(empty, twice), twice).count() == 1


def test_clean_results_moves_only_changed_stamps(spark):
    rows = [(1, "a", True, "```python\nx\n```", None, None, None, None), (2, "b", True, "x", None, None, None, None),
            (3, "c", True, None, None, None, None, None)]
    got = merges.clean_results(result(spark, rows), F.lit("2024-01-01").cast("timestamp")).orderBy("input_file_number").collect()
    assert [(r.result_content, r.result_timestamp is not None) for r in got] == [("x\n", True), ("x", False), (None, False)]
