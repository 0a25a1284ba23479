import io
import os
import random
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.operators import inference as inf
from dialoom.operators import merges, reports
from dialoom.operators import scripts as ops
from dialoom.plans import corpus_run, warehouse
from dialoom.plans.registry import load_all
from dialoom.schema import EXPORT_SCHEMA, RESPONSE_SCHEMA, with_result_columns
from dialoom.session import materialize
from dialoom.sources import scripts as src
from dialoom.sources import versions as ver
from dialoom.sources.writers import write_text_files


@pytest.fixture
def tree(tmp_path):
    for name in ("a.sql", "b.txt", "x/c.sql", "x/y/d.sql", "x/y/e.SQL", "z [1]/f.sql", "odd.sql/g.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    return str(tmp_path)


def names(df, root):
    return sorted(r.path.split(root + "/")[1] for r in df.select("path").collect())


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("{r}", ["a.sql", "b.txt", "odd.sql/g.txt", "x/c.sql", "x/y/d.sql", "x/y/e.SQL", "z [1]/f.sql"]),
        ("{r}/x, {r}/a.sql,{r}/x/y", ["a.sql", "x/c.sql", "x/y/d.sql", "x/y/e.SQL"]),
        ("{r}/*.sql", ["a.sql", "odd.sql/g.txt"]),
        ("{r}/x/*.sql", ["x/c.sql"]),
        ("{r}/x/**/*.sql", ["x/c.sql", "x/y/d.sql"]),
        ("{r}/*/y", ["x/y/d.sql", "x/y/e.SQL"]),
        ("{r}/x/y/[de].sql,{r}/x/?/d.sql", ["x/y/d.sql"]),
        ("{r}/x/**", ["x/c.sql", "x/y/d.sql", "x/y/e.SQL"]),
    ],
)
def test_paths(spark, tree, given, expected):
    assert names(src.read_scripts(spark, given.format(r=tree)), tree) == expected


def test_folders_are_listed_by_tasks_as_by_the_reader(spark, tree):
    """Same rows as Spark's reader, hidden names and empty files left out, without a file of the driver's listing in the plan."""
    for name in ("_b.sql", ".c.sql", "_k=1/d.sql", "_h/e.sql", ".y/g.sql", "empty.sql", "x._COPYING_", "_metadata", "é %20.sql"):
        os.makedirs(os.path.dirname(f"{tree}/{name}"), exist_ok=True)
        with open(f"{tree}/{name}", "w") as file:
            file.write("" if name == "empty.sql" else name)
    for given in (tree, f"file:{tree}", f"{tree}/x/"):
        got, told = src.read_scripts(spark, given), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given)
        assert got.columns == told.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, told.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan(got) and "ArrowEvalPython" in plan(got)
    assert "Python" not in plan(got.select("path"))


@pytest.mark.parametrize("given", ["file:{r}", "file://{r}/", "file:{r}/**/*.sql", "file:{r}, file://{r}/*.sql", "file:{r}/x/*.sql,file:{r}/x/y"])
def test_folders_are_listed_by_tasks_on_every_cluster(spark, tree, monkeypatch, given):
    """A folder given with its scheme is no work for the driver's listing, whatever the master is called."""
    here = src.read_scripts(spark, given.format(r=tree).replace("file://", "").replace("file:", ""))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    got = src.read_scripts(spark, given.format(r=tree))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "ArrowEvalPython" in plan
    assert sorted(map(repr, got.collect())) == sorted(map(repr, here.collect())) and not got.isEmpty()


def test_reading_files_is_dealt_by_bytes(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k}.sql").write_text("x" * 1000)
    monkeypatch.setattr(src, "READ_BYTES", 4000)
    files = src.read_scripts(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 11 and {len(r.content) for r in files.collect()} == {1000}


def test_files_are_made_aside_in_a_folder_of_the_task(spark, tmp_path):
    rows = spark.range(20).selectExpr("concat('/in/d', id % 3, '/', id, '.sql') AS input_file_path", "'x' AS result_content")
    out = tmp_path / "out"
    done = write_text_files(rows, str(out), "sql").collect()
    assert {r.export_status for r in done} == {"exported"} and all(os.path.isfile(r.export_output_path) for r in done)
    assert not [n for at, folders, files in os.walk(out) for n in folders + files if n.startswith(".")]


def test_no_path_is_an_error(spark):
    with pytest.raises(ValueError, match="no input path"):
        src.read_scripts(spark, " , ")


def test_numbers_follow_the_path_and_contents_are_kept(spark, tree):
    files = src.read_scripts(spark, f"{tree}/x").select("path", "content")
    got = src.number_files(files).orderBy("input_file_number").collect()
    assert [(r.input_file_number, bytes(r.content).decode()) for r in got] == [(1, "x/c.sql"), (2, "x/y/d.sql"), (3, "x/y/e.SQL")]


def test_decoding(spark):
    raw = ["é".encode(), "é".encode("utf-8-sig"), "é".encode("utf-16"), "é".encode("latin-1"), b"", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "i int, content binary")
    got = [(r.input_file_content, r.input_file_encoding) for r in src.decode_content(df).orderBy("i").collect()]
    assert got == [("é", "utf-8"), ("é", "utf-8-sig"), ("é", "utf-16"), ("é", "iso-8859-1"), ("", "utf-8"), (None, None)]
    bad = spark.createDataFrame([(b"a\xffb\x80",)], "content binary")
    assert src.decode_content(bad, encoding="utf-8").first().input_file_content == "a�b�"
    assert src.decode_content(bad, encoding="windows-1252").first().input_file_content == "aÿb€"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        for name in ("d/a.sql", "b.bteq", "c.SQL", "e.txt"):
            archive.writestr(name, name)
        archive.writestr("empty.sql", "")
        archive.writestr("packed.sql", "select " * 5000, zipfile.ZIP_DEFLATED)
        archive.writestr("other.sql", "x" * 100, zipfile.ZIP_BZIP2)
    (tmp_path / "x.zip").write_bytes(b"no zip")
    whole = (tmp_path / "z.zip").read_bytes()
    at = whole.index(b"d/a.sql") + len("d/a.sql")
    (tmp_path / "torn.zip").write_bytes(whole[:at] + b"D" + whole[at + 1 :])  # one changed byte in one member
    (tmp_path / "half.zip").write_bytes(whole[: len(whole) // 2])
    df = spark.createDataFrame([(str(tmp_path / f"{n}.zip"),) for n in ("z", "x", "torn", "half", "gone")], "path string")
    rows = src.read_archive_members(df).collect()
    got = {(os.path.basename(r.archive), r.member): r for r in rows}
    assert {k: bytes(r.content) for k, r in got.items() if r.error is None and k[0] == "z.zip"} == {
        ("z.zip", "d/a.sql"): b"d/a.sql", ("z.zip", "b.bteq"): b"b.bteq", ("z.zip", "empty.sql"): b"", ("z.zip", "packed.sql"): b"select " * 5000,
    }
    assert got["z.zip", "d/a.sql"].name == "d_a.sql"
    assert "compression method 12" in got["z.zip", "other.sql"].error
    assert got["torn.zip", "d/a.sql"].content is None and "checksum" in got["torn.zip", "d/a.sql"].error
    assert got["torn.zip", "packed.sql"].error is None
    assert all(got[f"{n}.zip", None].error for n in ("x", "half", "gone")) and len(rows) == 13


def test_members_of_one_archive_spread_and_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(2)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as archive:
        for k in range(40):
            archive.writestr(f"{k}.sql", rng.randbytes(300_000))
    log = tmp_path / "log"
    log.mkdir()

    def opened(path):
        import uuid

        class Counted(io.FileIO):
            seen = 0

            def read(self, n=-1):
                data = super().read(n)
                Counted.seen += len(data)
                return data

            def close(self):
                if not self.closed:
                    (log / uuid.uuid4().hex).write_text(str(Counted.seen))
                    Counted.seen = 0
                super().close()

        return Counted(path)

    paths = spark.createDataFrame([(str(tmp_path / "big.zip"),)], "path string")
    before = src.MEMBER_BATCH_BYTES
    try:
        src.MEMBER_BATCH_BYTES = 1_000_000
        members = src.read_archive_members(paths, opened=opened)
        tasks = members.withColumn("task", F.spark_partition_id()).select("task", "member").collect()
    finally:
        src.MEMBER_BATCH_BYTES = before
    assert len(tasks) == 40 and len({r.task for r in tasks}) > 1
    read = [int(p.read_text()) for p in log.iterdir()]
    assert sum(read) < 2 * 40 * 300_000 and max(read) < 0.9 * 40 * 300_000


def test_external_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1,click\nx,view\n")
    rows = src.read_external_csv(spark, str(tmp_path), "event_id INT, event_type STRING").collect()
    assert [tuple(r) for r in rows] == [(1, "click"), (None, "view")]


def test_write_text_files(spark, tmp_path):
    rows = [("/in/a.sql", "é"), ("/in/b:c.sql", ""), ("/in/none.sql", None)]
    df = spark.createDataFrame(rows, "input_file_path string, result_content string")
    got = {r.input_file_path: r for r in write_text_files(df, str(tmp_path / "out"), "py").collect()}
    assert len(got) == 2 and got["/in/a.sql"].export_content_size_bytes == 2 and got["/in/a.sql"].export_status == "exported"
    assert sorted(os.listdir(tmp_path / "out")) == ["a.py", "b_c.py"]
    (tmp_path / "file").write_text("")
    bad = write_text_files(df.limit(1), str(tmp_path / "file"), "py").first()
    assert bad.export_status == "export_failed" and bad.export_output_path is None and bad.export_error
    for folder in ("dbfs:/out", "abc://out/x"):
        assert {r.export_status for r in write_text_files(df, folder, "py").collect()} == {"export_failed"}


def test_latest_table(spark):
    rows = [("p_20240101000000_ab",), ("p_20240301000000_zz",), ("p_old",), ("q_20250101000000_a",)]
    df = spark.createDataFrame(rows, "name string")
    assert ver.latest_table(df, "p_").first()[0] == "p_20240301000000_zz"
    assert ver.latest_table(df, "none").first()[0] is None
    end = spark.createDataFrame([("p_20240301000000_zz",), ("p_20990101000000",)], "name string")
    assert ver.latest_table(end, "p_").first()[0] == "p_20240301000000_zz"
    assert ver.latest_table(end, "p_", stamp=ver.STAMP_ANYWHERE).first()[0] == "p_20990101000000"


def test_written_tables_stay(spark, tmp_path):
    first = ver.written(spark.range(3), str(tmp_path))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        ver.written(first.withColumn("x", F.expr("id / (id - 1)")), str(tmp_path))
    second = ver.written(first.unionByName(first), str(tmp_path))
    assert first.count() == 3 and second.count() == 6


def test_restore_takes_the_newest_finished_version(spark, tmp_path):
    base = str(tmp_path)
    assert ver.restore(spark, base, "t") is None
    for day in (1, 2, 3, 4):
        ver.write_result_version(spark.range(day), base, f"t_2024010{day}000000_x", "t")
    ver.write_result_version(spark.range(50), base, "other_20250101000000_x", "other")
    (tmp_path / "t_20240104000000_x" / "_SUCCESS").unlink()  # as a write that has not ended
    (tmp_path / "t_20240105000000_x").mkdir()
    (tmp_path / "t_20240105000000_x" / "part-0.parquet").write_bytes(b"torn")
    assert sorted(r.name for r in ver.versions(spark, base, "t").collect()) == [f"t_2024010{d}000000_x" for d in (1, 2, 3, 4, 5)]
    assert sorted(r.id for r in ver.restore(spark, base, "t").collect()) == [0, 1, 2]


def test_insert_returning_gives_its_own_rows(spark):
    name = ver.version_name("returned")
    spark.sql(f"CREATE TABLE {name} (k BIGINT, v DECIMAL(5,1), w STRING DEFAULT 'none', insert_id STRING) USING PARQUET PARTITIONED BY (insert_id)")
    try:
        first = ver.insert_returning(spark, name, spark.createDataFrame([(1, 2.25), (2, None)], "k int, v double"))
        second = ver.insert_returning(spark, name, spark.createDataFrame([(1, "x")], "k int, w string"))
        assert sorted((r.k, None if r.v is None else str(r.v), r.w) for r in first.collect()) == [(1, "2.3", "none"), (2, None, "none")]
        assert [tuple(r) for r in second.collect()] == [(1, None, "x")]
        plan = second._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(insert_id" in plan
        assert spark.table(name).count() == 3
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_stage_is_dropped(spark):
    with ver.stage(spark.range(3)) as temp:
        assert temp.count() == 3
        name = [t.name for t in spark.catalog.listTables() if t.name.startswith("stage_")]
        assert len(name) == 1
    assert not spark.catalog.tableExists(name[0])


def test_result_versions_are_reused(spark, tmp_path):
    first = ver.write_result_version(spark.range(2), str(tmp_path), "t")
    assert ver.write_result_version(spark.range(5), str(tmp_path), "t") == first
    assert spark.read.parquet(first).count() == 2
    assert ver.version_name().startswith("conversion_result_2")


def test_catalog_statements(spark, tmp_path):
    """Drop, truncate and rename are Spark SQL as they are."""
    spark.sql(f"CREATE TABLE sales_ddl (id INT COMMENT 'key') USING PARQUET LOCATION '{tmp_path}/s' COMMENT 'Sales table'")
    spark.sql("INSERT INTO sales_ddl VALUES (1)")
    spark.sql("ALTER TABLE sales_ddl ADD COLUMN discount DECIMAL(5,2)")
    spark.sql("ALTER TABLE sales_ddl RENAME TO sales_archive")
    assert spark.table("sales_archive").collect()[0].discount is None
    spark.sql("DROP TABLE IF EXISTS sales_archive")
    spark.sql("DROP TABLE IF EXISTS sales_archive")
    spark.sql("CREATE TABLE sales_managed (id INT) USING PARQUET")
    try:
        spark.sql("INSERT INTO sales_managed VALUES (1)")
        spark.sql("TRUNCATE TABLE sales_managed")
        assert spark.table("sales_managed").count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS sales_managed")


def test_refresh_logs_failure_and_keeps_the_summary(spark, sf, tmp_path):
    base = str(tmp_path)
    sales, people, products = warehouse.silver_tables(spark, sf)
    good = warehouse.refresh_layers(sales, people, products, base)
    rows = good.count()
    broken = sales.withColumn("sale_amount", F.raise_error(F.lit("boom")).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="boom"):
        warehouse.refresh_layers(broken, people, products, base)
    audit = spark.read.parquet(f"{base}/{warehouse.AUDIT_LOG}").orderBy("ts").collect()
    assert [r.status for r in audit] == ["SUCCESS", "FAILED"]
    assert good.count() == rows > 0


def test_update_if_exists(spark):
    parts = spark.createDataFrame([(1, 2.0)], "id int, price double")
    assert warehouse.update_if_exists(parts, "id", 7, price=1.0) is None
    table, row = warehouse.update_if_exists(parts, "id", 1, price=1.0)
    assert row.first().price == 1.0 and table.count() == 1


def test_files_are_numbered_before_they_are_read_by_tasks_of_their_own(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.sql").write_text(str(i))
    numbered = src.read_scripts(spark, str(tmp_path), number="n").select("path", "n", "content")
    assert numbered.rdd.getNumPartitions() == 4
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("ArrowEvalPython")[0] and "ArrowEvalPython" in plan
    want = src.number_files(src.read_scripts(spark, str(tmp_path)).select("path", "content"), name="n")
    assert sorted(numbered.collect()) == sorted(want.select("path", "n", "content").collect())


def test_exported_files_are_dealt_by_rows(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id AS int) AS input_file_number", "'/in/' || id || '.sql' AS input_file_path", "'x = 1' AS result_content")
    cfg = corpus_run.RunConfig("", str(tmp_path), "")
    statuses = corpus_run.export_documents(materialize(with_result_columns(rows)), cfg)
    assert statuses.rdd.getNumPartitions() == 8  # the written ones and the refused


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def model(messages):
    text = messages[-1]["content"]
    if "fail" in text:
        raise inf.CallError(400, "Bad Request", '{"message": "invalid parameter"}')
    if messages[0]["role"] == "system" and "Errors to fix" in messages[0]["content"]:
        return "spark.sql('SELECT 2')"
    return "```python\nimport os\n\n\nspark.sql('SELEC 1')\n```" if "repair" in text else "```python\nx = 1\n```"


def inputs(tmp_path):
    for name, text in {"a.sql": "SELECT 1 -- c", "d/a.sql": "repair", "big.sql": "x" * 500, "f.sql": "fail"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_run_to_documents(spark, tmp_path):
    inputs(tmp_path)
    cfg = corpus_run.RunConfig(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/t/result", token_count_threshold=20,
                               system_message="Convert.", endpoint="my-claude", partitions=2)
    done = {r.input_file_path.split("/in/")[1]: r for r in corpus_run.run_corpus(spark, cfg, model).collect()}
    assert [done[n].input_file_number for n in ("a.sql", "big.sql", "d/a.sql", "f.sql")] == [1, 2, 3, 4]
    assert not done["big.sql"].is_conversion_target and done["big.sql"].result_content is None
    assert done["f.sql"].result_error.startswith("Bad Request\nResponse details: ") and done["f.sql"].accuracy_percent == 0.0
    assert done["d/a.sql"].result_content == "# COMMAND ----------\nspark.sql('SELECT 2')"
    assert done["a.sql"].export_status == done["d/a.sql"].export_status == "exported"
    assert done["a.sql"].model_serving_endpoint_for_conversion == "my-claude"
    assert sorted(os.listdir(tmp_path / "out")) == ["a.py", "a_1.py"]
    text = (tmp_path / "out" / "a.py").read_text()
    assert text.startswith("# Databricks notebook source") and "x = 1" in text
    assert len(text.encode()) == done["a.sql"].export_content_size_bytes


def test_run_to_files(spark, tmp_path):
    inputs(tmp_path)
    cfg = corpus_run.RunConfig(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/result", target_type="file", output_extension="py")
    table = corpus_run.run_corpus(spark, cfg, model)
    summary = reports.conversion_summary(table).first()
    assert tuple(summary) == (4, 3, 3, 0)
    assert sorted(os.listdir(tmp_path / "out")) == ["a.py", "big.py"]
    cfg.output_extension = None
    with pytest.raises(ValueError, match="output_extension"):
        corpus_run.run_corpus(spark, cfg, model)


def test_run_without_targets_is_an_error(spark, tmp_path):
    inputs(tmp_path)
    cfg = corpus_run.RunConfig(f"{tmp_path}/in/big.sql", f"{tmp_path}/out", f"{tmp_path}/result", token_count_threshold=1)
    with pytest.raises(ValueError, match="no file"):
        corpus_run.run_corpus(spark, cfg, model)


def broadcasts(df):
    """The plan's broadcast joins, but those of the tables with a row per slice."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_slice" not in line]


def test_sides_with_a_row_per_file_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Written, such tables are a few bytes per row; the driver took some hundred for each row."""
    files = spark.range(30).selectExpr("cast(id AS int) AS input_file_number", "'/in/f' || id % 9 || '.sql' AS input_file_path")
    state = materialize(with_result_columns(files))
    answers = materialize(spark.createDataFrame([(k, f"a{k}", None, None, None, None, None, None) for k in range(30)], RESPONSE_SCHEMA))
    exports = materialize(spark.createDataFrame([(f"/in/f{k}.sql", f"/out/f{k}", "exported", None, None, 1) for k in range(9)], EXPORT_SCHEMA))
    merged = merges.merge_responses(state, answers)
    assert not broadcasts(merged) and {r.input_file_number: r.result_content for r in merged.collect()} == {k: f"a{k}" for k in range(30)}
    exported = merges.merge_exports(state, exports)
    assert not broadcasts(exported) and {(r.input_file_number % 9, r.export_output_path) for r in exported.collect()} == {(k, f"/out/f{k}") for k in range(9)}
    named = ops.unique_output_paths(files, "/out")
    want = {k: f"/out/f{k % 9}" + (f"_{k // 9}" if k >= 9 else "") for k in range(30)}
    assert not broadcasts(named) and {r.input_file_number: r.output_path for r in named.collect()} == want
    monkeypatch.setattr(inf, "FEW_ANSWERS", 8)
    requests = files.select("input_file_number", inf.build_messages("input_file_path").alias("messages"))
    asked = inf.infer_distinct(requests, lambda r, key: materialize(inf.batch_infer(r, lambda m: m[-1]["content"], key=key)))
    assert not broadcasts(asked) and {r.input_file_number: r.result_content for r in asked.collect()} == {k: f"/in/f{k % 9}.sql" for k in range(30)}
    for k in range(9):
        (tmp_path / f"{k}.sql").write_text(str(k))
    numbered = src.read_scripts(spark, str(tmp_path), number="n")
    assert not broadcasts(numbered) and sorted((r.n, bytes(r.content)) for r in numbered.collect()) == [(k + 1, b"%d" % k) for k in range(9)]


def test_archives_are_listed_by_tasks_on_every_cluster(spark, tmp_path, monkeypatch):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as archive:
            archive.writestr("a.sql", str(k))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    paths = src.read_scripts(spark, f"file:{tmp_path}").select("path")
    assert "binaryFile" not in paths._jdf.queryExecution().executedPlan().toString()
    got = src.read_archive_members(paths).collect()
    assert sorted((os.path.basename(r.archive), r.name, bytes(r.content)) for r in got) == [(f"{k}.zip", "a.sql", b"%d" % k) for k in range(3)]


@pytest.mark.parametrize("name", ["corpus_run_documents", "corpus_run_sql_files"])
def test_the_whole_run_joins_its_tables_in_tasks(spark, sf, name):
    assert not broadcasts(load_all()[name].run(spark, sf))
