import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.messages import KEYS, MESSAGES
from dialoom.operators import pyscripts
from dialoom.operators import scripts as ops
from dialoom.schema import with_result_columns


def frame(spark, codes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, code string")


def test_extract_sql_literals(spark):
    codes = [
        't = "a"\nspark.sql(f"SELECT * FROM {t} WHERE d = {x}")',
        'spark.sql("x", args={})\nspark.sql("x", "y")\ns.sql("x")',
        'spark.sql("SELECT " + "1")\nspark.sql("a" + 1 + f())',
        'def f():\n    spark.sql(q)\nq = "late"\nq = "last"',
        "spark.sql('')\nspark.sql(g())",
        "def (",
        None,
        'a, b = 1, 2\nspark.sql(f"{a} {1 + x} {f()}")',
    ]
    rows = ops.syntax_check_python(frame(spark, codes), "code").orderBy("id").collect()
    assert [r.result_extracted_sqls for r in rows] == [
        ["SELECT * FROM a WHERE d = _placeholder_"],
        ["x"],
        ["SELECT 1"],
        ["last"],
        [],
        [],
        [],
        ["_placeholder_ 1_placeholder_ _placeholder_"],
    ]
    assert rows[5].result_python_parse_error.startswith("Python syntax error: ")
    assert all(r.result_python_parse_error is None for i, r in enumerate(rows) if i != 5)


def test_statement_checks(spark):
    faults = {
        "SELECT 1": None,
        "SELECT 'it''s (' AS a": None,
        "SELECT 'a\\'b'": None,
        "SELECT `a(`, \"b'\" -- (": None,
        "(SELECT 1) UNION (SELECT 2)": None,
        "SELECT 'a": "unclosed quote",
        "SELECT /* a": "unclosed comment",
        "SELECT (1": "unclosed bracket",
        "SELECT 1)(": "closing bracket without an opening one",
        "SELEC 1": "unknown statement: SELEC",
        " -- only": "empty statement",
    }
    rows = frame(spark, list(faults)).select("id", ops.statement_error("code")).orderBy("id").collect()
    assert [r[1] for r in rows] == list(faults.values())


def test_statement_checks_survive_long_strings(spark):
    long = "SELECT '" + "x\\'" * 200_000 + "'"
    assert frame(spark, [long]).select(ops.statement_error("code")).first()[0] is None


def test_attach_checks_messages(spark):
    df = spark.createDataFrame([(1, ["SELECT 1", "SELEC"]), (2, []), (3, None)], "id int, result_extracted_sqls array<string>")
    got = {r.id: r.result_sql_parse_errors for r in ops.attach_sql_checks(df).collect()}
    assert got == {1: ["Error in query 1: unknown statement: SELEC"], 2: [], 3: None}
    custom = ops.attach_sql_checks(df, lambda s: "bad JVM stacktrace:\n x" if s == "SELEC" else None)
    assert {r.id: r.result_sql_parse_errors for r in custom.collect()}[1] == ["Error in query 1: bad"]


def test_cells(spark):
    codes = ["import os\n\n# load\ndf = 1\nx = 2\n\n\ny = 3", None, "  \n", "def (", "# only", "a = 1\n\n# end\n# of file"]
    df = frame(spark, codes)
    got = [(r.id, r.start_line, r.end_line) for r in ops.split_cells(df, "id", "code").orderBy("id", "cell_no").collect()]
    assert got == [(0, 1, 2), (0, 3, 7), (0, 8, 8), (3, 1, 1), (4, 1, 1), (5, 1, 4)]
    joined = ops.with_cells(df, "code").select("id", F.when(F.col("cells").isNotNull(), ops.join_cells("cells"))).orderBy("id")
    mark = "# COMMAND ----------\n"
    texts = [r[1] for r in joined.collect()]
    assert texts[0] == f"{mark}import os\n\n{mark}# load\ndf = 1\nx = 2\n\n\n{mark}y = 3"
    assert texts[1] is None and texts[2] is None and texts[3] == mark + "def ("


def test_doubled_markers_become_one(spark):
    df = frame(spark, ["# COMMAND ----------\na = 1\n\n# COMMAND ----------\nb = 2"])
    text = ops.with_cells(df, "code").select(ops.join_cells("cells")).first()[0]
    assert text == "# COMMAND ----------\na = 1\n\n# COMMAND ----------\nb = 2"


STATEMENTS = ["x = 1", "# note", "", "   ", "def f():\n    return 1", "@dec\ndef g(): pass", "s = '''a\n\n# b'''", "x = 1; y = 2"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(STATEMENTS), max_size=12))
def test_cells_cover_every_line(parts):
    code = "\n".join(parts)
    starts = pyscripts.cell_starts(code)
    if not code.strip():
        assert starts is None
        return
    assert starts[0] == 1 and starts == sorted(set(starts))
    lines = code.split("\n")
    ends = [s - 1 for s in starts[1:]] + [len(lines)]
    cells = ["\n".join(lines[s - 1 : e]) for s, e in zip(starts, ends, strict=True)]
    assert "\n".join(cells) == code
    for cell in cells:
        ast.parse(cell)
    assert sum(len(ast.parse(c).body) for c in cells) == len(ast.parse(code).body)


def greedy(stems):
    seen, out = set(), []
    for s in stems:
        name, k = s, 0
        while name in seen:
            k += 1
            name = f"{s}_{k}"
        seen.add(name)
        out.append(name)
    return out


STEM_LISTS = [
    ["a", "a", "a_1"],
    ["a_1", "a", "a", "a", "a_1", "a_2", "a_2"],
    ["a", "a", "a", "a_1_1", "a_1", "a_1", "a_01", "a_0", "b"],
    ["q_3", "q", "q", "q", "q", "q_3", "q_1", "q_3_1", "q_3"],
]


@pytest.mark.parametrize("stems", STEM_LISTS)
def test_unique_paths_equal_handing_out_one_by_one(spark, stems):
    rows = [(i, f"/in/{i}/{s}.sql") for i, s in enumerate(stems)]
    df = spark.createDataFrame(rows, "input_file_number int, input_file_path string")
    got = ops.unique_output_paths(df, "/out/").orderBy("input_file_number").collect()
    assert [r.output_path for r in got] == ["/out/" + n for n in greedy(stems)]


def test_unique_paths_on_random_lists(spark):
    import random

    rng = random.Random(5)
    for pool in (["a", "a_1", "a_2", "a_1_1", "b", "b_1", "a_10"], ["a", "a", "a_1", "a_2", "a_3", "a_4", "a_2_1", "a_2_1_1"]):
        stems = [rng.choice(pool) for _ in range(60)]
        df = spark.createDataFrame([(i, f"{s}.x") for i, s in enumerate(stems)], "input_file_number int, input_file_path string")
        got = ops.unique_output_paths(df, "/o").orderBy("input_file_number").collect()
        assert [r.output_path for r in got] == ["/o/" + n for n in greedy(stems)]


def test_stretches_of_numbers_compose():
    rng = random.Random(3)
    for _ in range(200):
        limits = [rng.randint(-3, 30) for _ in range(rng.randint(0, 40))]
        passing = ops._Passing()
        for limit in limits:
            passing.add(limit)
        for count in range(45):
            walked = count
            for limit in limits:
                walked += walked < limit
            assert walked == count + sum(step > count for step in passing.steps)


def test_one_stem_with_many_namesakes_spreads_over_tasks(spark):
    """200,000 real files a_k beside the files of a, in eight slices, against a plain walk."""
    n = 200_000
    before = [(k * 7919) % n for k in range(n)]
    rows = spark.range(n).select(
        F.lit("a").alias("parent"), (F.col("id") + 1).alias("k"), F.concat(F.lit("a_"), (F.col("id") + 1).cast("string")).alias("child"),
        (F.col("id") * 7919 % n).alias("before"),
    )
    few = spark.createDataFrame([("b", 1, "b_1", 0), ("b", 2, "b_2", 5), ("Z", 1, "Z_1", 3)], rows.schema)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        done = ops._settle_blocks(rows.unionByName(few)).withColumn("task", F.spark_partition_id())
        got = done.collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    passed, want = 0, {"b_1": (0, 1), "b_2": (1, None), "Z_1": (1, None)}
    for k in range(1, n + 1):
        turn = k - passed
        if turn > before[k - 1]:
            passed += 1
            want[f"a_{k}"] = (0, turn)
        else:
            want[f"a_{k}"] = (1, None)
    assert {r.child: (r.displaced, r.threshold) for r in got} == want
    assert len({r.task for r in got if r.parent == "a"}) >= 4


def test_split_marked_files(spark):
    text = "x\n# === a.yml ===\nk: 1\n# === b/c.sql ===  \nSELECT 1\n# === empty ==="
    rows = ops.split_marked_files(frame(spark, [text, "none", None]), "id", "code").orderBy("file_no").collect()
    assert [(r.id, r.file_no, r.name, r.content) for r in rows] == [
        (0, 1, "a.yml", "k: 1\n"), (0, 2, "b/c.sql", "SELECT 1\n"), (0, 3, "empty", ""),
    ]


def test_catalogue_is_complete():
    assert len(MESSAGES) == 9
    assert all(len(texts) == len(KEYS) and all(texts) for texts in MESSAGES.values())


def test_compose_document(spark):
    rows = spark.createDataFrame(
        [(1, "/in/a.sql", "x = 1", None, []), (2, "/in/b.sql", "y", "bad line", ["e1", "e2"])],
        "input_file_number int, input_file_path string, result_content string, result_python_parse_error string, "
        "result_sql_parse_errors array<string>",
    )
    df = with_result_columns(rows).withColumn("export_output_path", F.lit("/out/n"))
    got = {r.input_file_number: r for r in ops.compose_document(df).collect()}
    assert got[1].document.startswith("# Databricks notebook source\n# MAGIC %md\n# MAGIC # n\n# MAGIC This notebook was")
    assert "\n# COMMAND ----------\nx = 1\n# COMMAND ----------\n# MAGIC %md\n# MAGIC ## Static Syntax Check Results\n" in got[1].document
    assert got[1].document.endswith("during runtime.\n") and got[1].parse_error_count == 0
    assert got[2].document.endswith(
        "# MAGIC ### Python Syntax Errors\n# MAGIC ```\n# MAGIC bad line\n# MAGIC ```\n"
        "# MAGIC ### Spark SQL Syntax Errors\n# MAGIC ```\n# MAGIC e1\n# MAGIC e2\n# MAGIC ```\n"
    )
    assert got[2].parse_error_count == 3


def test_line_ends_of_all_kinds(spark):
    """Lines as the parser counts them; no text may end the job."""
    texts = {
        "x=1\r\r\ry=2": [(1, 3, "x=1\r\r"), (4, 4, "y=2")],
        "s='''x\ry\rz'''\na=1\n\nb=2\nc=3\nd=4": [(1, 5, "s='''x\ry\rz'''\na=1\n"), (6, 8, "b=2\nc=3\nd=4")],
        "a=1\r\n\r\nb=2\r\n": [(1, 2, "a=1\r\n"), (3, 4, "b=2\r\n")],
        "a=1\x0c\n\x0b": None,
        "\r": None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "k int, result_content string")
    got = {r.k: r.cells for r in ops.with_cells(df).collect()}
    for k, expected in enumerate(texts.values()):
        if expected is not None:
            assert [tuple(c) for c in got[k]] == expected
