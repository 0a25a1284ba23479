import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.functions import scripts as sc
from dialoom.functions import text as tx
from dialoom.functions.base import WS_CHARS, is_blank, strip
from dialoom.operators import tokens
from dialoom.schema import VERDICT_SCHEMA


def col(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", fn("v")).orderBy("i").collect()]


def plain_strip_comments(text):
    text = re.sub(r"--.*", "", text)
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.DOTALL)
    return re.sub(r"\n\s*\n", "\n\n", text)


def test_preprocess_literals(spark):
    cases = {
        "SELECT 1 -- c\nFROM t /* x\ny */ WHERE a": "SELECT 1 FROM t WHERE a",
        "": "",
        " a  b\x1cc ": " a b c ",
    }
    assert col(spark, list(cases), tx.preprocess_sql) == list(cases.values())


def test_comment_rules_keep_their_order(spark):
    got = col(spark, ["SELECT '--x' AS a", "/* a -- b */ SELECT 1", "a\r-- b\rc\nd", None], tx.strip_sql_comments)
    assert got == ["SELECT '", "/* a ", "a\r\nd", None]


ANY_TEXT = st.lists(
    st.text(alphabet=st.sampled_from(list("ab-/*\n\r\t   \x85\x1f'\"é😀")), max_size=40), min_size=5, max_size=20
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ANY_TEXT)
def test_rules_agree_with_python_on_any_text(spark, texts):
    assert col(spark, texts, tx.strip_sql_comments) == [plain_strip_comments(t) for t in texts]
    assert col(spark, texts, tx.collapse_ws) == [re.sub(r"\s+", " ", t) for t in texts]
    assert col(spark, texts, strip) == [t.strip() for t in texts]
    assert col(spark, texts, is_blank) == [not t.strip() for t in texts]
    assert col(spark, texts, tx.estimate_tokens) == [int(len(t) / 3.4) for t in texts]
    again = col(spark, col(spark, texts, tx.collapse_ws), tx.collapse_ws)
    assert again == col(spark, texts, tx.collapse_ws)


def test_white_space_class_matches_its_characters(spark):
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    blank = col(spark, every, lambda v: tx.collapse_ws(v) == " ")
    assert {ch for ch, b in zip(every, blank, strict=True) if b} == set(WS_CHARS)


def test_token_estimate_edges(spark):
    assert col(spark, ["", "abc", "a" * 7, "a" * 34, "😀" * 7, None], tx.estimate_tokens) == [0, 0, 2, 10, 2, None]


def test_counter_choice():
    assert tokens.choose_counter(endpoint="My-CLAUDE-x").kind == "claude"
    assert tokens.choose_counter(endpoint="llama", bpe=len).kind == "openai"
    assert tokens.choose_counter().kind == "claude"
    assert tokens.choose_counter("OpenAI", "my-claude", bpe=len).kind == "openai"
    assert tokens.choose_counter("claude", "llama").kind == "claude"
    with pytest.raises(ValueError, match="Supported types"):
        tokens.choose_counter("other")


def test_exact_counter_and_generic_format(spark):
    df = spark.createDataFrame([("a -- b",), (None,)], "input_file_content string")
    counter = tokens.choose_counter("openai", model="chars", bpe=len)
    got = tokens.with_token_columns(df, counter=counter).collect()
    assert [(r.input_file_token_count, r.input_file_token_count_preprocessed) for r in got] == [(6, 2), (None, None)]
    same = tokens.with_token_columns(df, source_format="generic").first()
    assert same.input_file_content_preprocessed == "a -- b" and same.input_file_token_count == 1


def test_expand_ranges(spark):
    got = col(spark, ["1, 3-5,8", "", "5-3", None, "7,7"], tx.expand_ranges)
    assert got == [[1, 3, 4, 5, 8], [], [], None, [7, 7]]


def test_clean_code_fence(spark):
    cases = {
        "```python\nx=1\n```": "x=1\n",
        "  ```python\nx=1```tail": "x=1\n",
        "Here:\n```python\nx=1\n```": "Here:\n\nx=1\n```",
        "```python\nx=1": "\nx=1",
        "```sql\nx```": "```sql\nx```",
        "```python```": "",
        "```python\n\nx\n```": "\nx\n",
    }
    assert col(spark, list(cases), tx.clean_code_fence) == list(cases.values())
    assert col(spark, [None], tx.clean_code_fence) == [None]


def test_post_clean_sql(spark):
    got = col(spark, ["```sql\nCREATE t (a DEFAULT UUID( ), b default NewId(), c DEFAULT\tSYSDATE)\n```"], tx.post_clean_sql)
    assert got == ["CREATE t (a , b , c )"]


def test_previews(spark):
    long = "a" * 1500 + "b" * 1500
    assert col(spark, [long], tx.truncate_middle) == ["a" * 1000 + " ... [truncated 1000 chars] ... " + "b" * 1000]
    assert col(spark, ["abcdefg"], lambda v: tx.truncate_middle(v, 5)) == ["ab ... [truncated 2 chars] ... efg"]
    assert col(spark, ["short", None], tx.truncate_middle) == ["short", None]
    assert col(spark, ["xyz"], lambda v: tx.preview(v, 2, 1)) == ["xy... [truncated] ...z"]
    doc = '{"a": ["12345678", {"b": "1234567"}], "n": 1}'
    short = tx.truncate_json_leaves
    assert col(spark, [doc, "no json", None], lambda v: short(v, 6)) == [
        '{"a": ["123 ... [truncated 2 chars] ... 678", {"b": "123 ... [truncated 1 chars] ... 567"}], "n": 1}',
        "no json",
        None,
    ]


def test_extract_json(spark):
    texts = [
        '{"overall_score": 0.5}',
        'So: {"overall_score": 1, "critical_errors": ["a"]} end',
        "{'overall_score': 0.25, 'critical_errors': None}",
        "x {broken} y {",
        "[1, 2]",
        None,
        "none",
    ]
    got = col(spark, texts, lambda v: tx.extract_json(v, VERDICT_SCHEMA, literals=True))
    assert [g and g.overall_score for g in got] == [0.5, 1.0, 0.25, None, None, None, None]
    assert got[1].critical_errors == ["a"]


def test_base64(spark):
    assert col(spark, ["a" * 100], lambda v: F.length(tx.to_base64(v))) == [136]
    texts = ["", "a", "ab", "abc", "é😀", "a" * 100]
    assert col(spark, texts, tx.base64_size) == col(spark, texts, lambda v: F.length(tx.to_base64(v)).cast("long"))
    assert col(spark, texts, lambda v: tx.from_base64(tx.to_base64(v))) == texts
    assert col(spark, ["plain text!", "gICA"], tx.from_base64) == ["plain text!", "gICA"]


def test_paths(spark):
    import os

    names = ["/a/upload_1_q.sql", "/a/query.sql", None, "/a.b/c", "/a/.hidden", "/a/x.tar.gz", "/a/b.", "..a", "a..b"]
    assert col(spark, names, tx.display_name)[:3] == ["1_q.sql", "query.sql", ""]
    expected = [n and os.path.splitext(os.path.basename(n))[0] for n in names]
    assert col(spark, names, tx.stem) == expected
    assert col(spark, ["a<b>:c?"], tx.sanitize_name) == ["a_b__c_"]
    assert col(spark, ["/base/x/y.sql", "/other/z.sql"], lambda v: tx.relative_path(v, "/base/")) == ["x/y.sql", "/other/z.sql"]
    assert col(spark, ["/in/a?b.v1.sql"], lambda v: tx.output_file_path(v, "/out/", "py")) == ["/out/a_b.v1.py"]


def test_is_notebook_looks_at_the_first_500_characters(spark):
    texts = ["x" * 493 + "# MAGIC", "x" * 494 + "# MAGIC", "# COMMAND ----------", "# Databricks notebook source", "# command"]
    assert col(spark, texts, tx.is_notebook) == [True, False, True, True, False]


def test_classify_object(spark):
    texts = [
        "CREATE MULTISET TABLE a", "CREATE VOLATILE TABLE a", "create  view v", "MERGE INTO t", "REPLACE PROCEDURE p",
        "REPLACE VIEW v", "Create Or Replace\nFunction f", "create sequence s; create table t", "CREATE SET TABLE t",
        "REPLACE MACRO m", "CREATE TYPE t", "CREATE OR REPLACE PROC p",
    ]
    assert col(spark, texts, sc.classify_object) == [
        "TABLE", "UNKNOWN", "VIEW", "UNKNOWN", "PROCEDURE", "UNKNOWN", "FUNCTION", "SEQUENCE", "TABLE", "MACRO", "TYPE",
        "PROCEDURE",
    ]


def test_flatten_sql(spark):
    assert col(spark, ["SELECT {a}\nFROM t ", " { x} ", "a -- b\nc"], sc.flatten_sql) == ["SELECT a FROM t", " x", "a -- b c"]
    assert col(spark, ["a -- b\nc"], lambda v: sc.flatten_sql(v, strip_comments_first=True)) == ["a  c"]


def test_lint(spark):
    got = col(spark, ["CREATE TABLE t (a INT CHECK (a>0))", "CREATE TABLE t (a INT) USING DELTA", None],
              lambda v: sc.lint_sql(v, F.lit("TABLE")))
    assert got == [["table_check_or_unique", "table_missing_delta"], [], []]
