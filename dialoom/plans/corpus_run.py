"""The whole run over a folder of scripts: every stage writes a new table that the next one reads."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.rules import EXPORT_FAILED, EXPORTED
from dialoom.functions.text import post_clean_sql
from dialoom.messages import DEFAULT_LANGUAGE
from dialoom.operators import inference, merges, reports, rounds, scripts, selection, tokens
from dialoom.schema import with_result_columns
from dialoom.session import materialize, met, parallelism
from dialoom.sources.scripts import decode_content, plain_path, read_scripts
from dialoom.sources.versions import written
from dialoom.sources.writers import write_text_files


@dataclass
class RunConfig:
    """Settings of a run, with the usual defaults.

    ``table_path`` is the folder below which the stages write. ``existing_table`` names the result
    table of an earlier run to go on from: no file is read anew, and files with a result are not
    asked again. ``prompt`` holds the custom and the common prompt parts (key, text); the part
    ``system_message`` of the rendered prompt then replaces ``system_message``. ``sql_output_dir``
    adds the stage that asks for the SQL of each exported document and writes it as a file.
    ``answers_dir`` keeps the answers of calls while the run goes on; a run that is started again
    with the same folder asks for the missing ones only.
    """

    input_paths: str
    output_dir: str
    table_path: str
    target_type: str = "notebook"
    source_format: str = "sql"
    comment_lang: str = DEFAULT_LANGUAGE
    token_count_threshold: int = 20000
    partitions: int | None = None
    threads: int = 4
    max_fix_attempts: int = 1
    output_extension: str | None = None
    system_message: str = ""
    prompt: tuple[DataFrame, DataFrame] | None = None
    few_shots: list = field(default_factory=list)
    endpoint: str | None = None
    endpoint_for_fix: str | None = None
    request_params: dict | None = None
    tokenizer_type: str | None = None
    encoding: str | None = None
    existing_table: str | None = None
    sql_output_dir: str | None = None
    answers_dir: str | None = None
    retry: inference.RetryPolicy = field(
        default_factory=lambda: inference.RetryPolicy(max_backpressure=10, max_other=3)
    )

    def labels(self, step: str) -> dict[str, str]:
        """What the result table notes about the calls of a step, ``conversion`` or ``fix``."""
        endpoint = self.endpoint if step == "conversion" else self.endpoint_for_fix or self.endpoint
        params = None if self.request_params is None else json.dumps(self.request_params, sort_keys=True)
        noted = {f"model_serving_endpoint_for_{step}": endpoint, f"request_params_for_{step}": params}
        return {name: value for name, value in noted.items() if value}


def ingest(spark: SparkSession, cfg: RunConfig, bpe: Callable[[str], int] | None = None) -> DataFrame:
    """Files -> result table with token counts and the target flag."""
    files = read_scripts(spark, cfg.input_paths, number="input_file_number").select("path", "input_file_number", "content")
    numbered = files.withColumnRenamed("path", "input_file_path")
    texts = decode_content(numbered, "content", cfg.encoding)
    texts = texts.withColumn("input_file_path", plain_path("input_file_path"))
    counter = tokens.choose_counter(cfg.tokenizer_type, cfg.endpoint, bpe=bpe)
    counted = tokens.with_token_columns(texts, "input_file_content", counter, cfg.source_format)
    chosen = selection.select_targets(counted, cfg.token_count_threshold)
    # Many small files would become many small parts in every later version.
    return with_result_columns(chosen).hint("rebalance")


def system_message(cfg: RunConfig) -> str:
    if cfg.prompt is None:
        return cfg.system_message
    parts = inference.render_prompt(*cfg.prompt, {"comment_lang": cfg.comment_lang})
    row = parts.filter(F.col("key") == "system_message").first()
    if row is None:
        raise ValueError("the prompt has no part system_message")
    return row["text"]


def _ask(requests: DataFrame, cfg: RunConfig, predict: Callable, key: str = "input_file_number") -> DataFrame:
    """One answer per row; equal requests are asked once, and the answers written before they are used."""

    def infer(unique: DataFrame, by: str) -> DataFrame:
        return materialize(
            inference.batch_infer(unique, predict, cfg.partitions, cfg.threads, cfg.retry, key=by, answers=cfg.answers_dir)
        )

    return inference.infer_distinct(requests, infer, key)


def convert(df: DataFrame, cfg: RunConfig, predict: Callable) -> DataFrame:
    """Responses for the open target rows, asked with their preprocessed text.

    An error when no row is a target; rows that already have a result are left alone.
    """
    chosen = selection.require_targets(df).filter(F.col("result_content").isNull())
    messages = inference.build_messages("input_file_content_preprocessed", system_message(cfg), cfg.few_shots)
    return _ask(chosen.select("input_file_number", messages.alias("messages")), cfg, predict)


def export_documents(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Composed documents under unique names, written unless too large: status rows."""
    with_code = selection.without_empty_code(df)
    # Only paths and numbers take part in naming; the texts join the names once.
    named = scripts.unique_output_paths(with_code.select("input_file_number", "input_file_path"), cfg.output_dir)
    # Dealt by rows: each is a file to write, and small ones would be joined into few tasks by their bytes.
    dealt = with_code.repartition(parallelism(df.sparkSession), "input_file_number")
    placed = dealt.drop("export_output_path").join(
        met(named.select("input_file_number", F.concat("output_path", F.lit(".py")).alias("export_output_path"))),
        "input_file_number",
    )
    composed = scripts.compose_document(placed, cfg.comment_lang).drop("export_error", "export_status")
    gated = reports.export_gate(composed)
    passed = F.when(F.col("export_status") == EXPORTED, F.col("document"))
    writable = gated.withColumn("_write", passed)
    written = write_text_files(writable, cfg.output_dir, ".py", content="_write", output="export_output_path")
    refused = gated.filter(F.col("export_status") == EXPORT_FAILED).select(
        "input_file_path",
        F.lit(None).cast("string").alias("export_output_path"),
        "export_status",
        "export_error",
        F.col("encoded_size").alias("export_content_size_bytes"),
    )
    return written.unionByName(refused)


def convert_to_sql_files(spark: SparkSession, cfg: RunConfig, predict: Callable) -> DataFrame:
    """Ask for the SQL of every exported document and write it: one status row per document.

    Columns as ``reports.export_detail`` reads them. Texts that are unreadable, no document or
    empty are not asked; they, and failed calls, come with their reason.
    """
    files = read_scripts(spark, f"{cfg.output_dir.rstrip('/')}/*.py").select("path", "content")
    texts = decode_content(files, "content", "utf-8")
    judged = selection.with_skip_reason(
        texts.select(
            plain_path("path").alias("python_notebook_path"), F.col("input_file_content").alias("content")
        )
    )
    judged = materialize(judged)
    asked = judged.filter(F.col("skip_reason").isNull())
    messages = inference.build_messages("content", system_message(cfg), cfg.few_shots)
    answers = _ask(asked.select("python_notebook_path", messages.alias("messages")), cfg, predict, "python_notebook_path")
    answers = materialize(
        answers.select(
            F.col("input_file_number").alias("python_notebook_path"), post_clean_sql("result_content").alias("sql"), "result_error"
        )
    )
    stored = write_text_files(answers, cfg.sql_output_dir, "sql", "python_notebook_path", "sql").select(
        F.col("input_file_path").alias("python_notebook_path"),
        (F.col("export_status") == EXPORTED).alias("success"),
        F.col("export_output_path").alias("sql_output_path"),
        (F.col("export_content_size_bytes") / F.lit(1024 * 1024)).alias("size_mb"),
        F.col("export_error").alias("error"),
    )

    def missing(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(
            "python_notebook_path", F.lit(False).alias("success"), F.lit(None).cast("string").alias("sql_output_path"),
            F.lit(None).cast("double").alias("size_mb"), F.col(reason).alias("error"),
        )

    unanswered = missing(answers.filter(F.col("sql").isNull()), "result_error")
    skipped = missing(judged.filter(F.col("skip_reason").isNotNull()), "skip_reason")
    return stored.unionByName(unanswered).unionByName(skipped)


def status_of_all(df: DataFrame) -> DataFrame:
    """``reports.status_detail``, and a line for every file over the token limit."""
    left_out = df.filter(
        ~F.coalesce("is_conversion_target", F.lit(False)) & F.col("result_content").isNull() & F.col("result_error").isNull()
    ).select(
        "input_file_number", "input_file_path", F.lit("Skipped").alias("conversion_status"),
        F.lit("Not exported").alias("export_status"), "export_output_path",
        F.lit(0).cast("long").alias("content_size_bytes"),
        F.concat(
            F.lit("Over the token limit: "), F.col("input_file_token_count_preprocessed").cast("string"), F.lit(" tokens")
        ).alias("error_details"),
    )
    return reports.status_detail(df).unionByName(left_out)


def run_corpus(
    spark: SparkSession, cfg: RunConfig, predict: Callable, check_fn: Callable | None = None,
    bpe: Callable[[str], int] | None = None, predict_sql: Callable | None = None,
) -> DataFrame:
    """Ingest, convert, clean, then for documents check, repair, split and export; for files export.

    The source texts are written when they are read and once more in the result; the stages between
    write tables without them and join on the file number at the end.

    Returns the result table as written; ``reports.conversion_summary`` and ``status_of_all`` read
    it. With ``sql_output_dir`` the SQL files follow, and their status rows are written below
    ``table_path`` as ``sql_files``.
    """
    if cfg.target_type not in selection.TARGET_TYPES:
        raise ValueError(f"unknown target type: {cfg.target_type}")
    if cfg.target_type == "file" and not cfg.output_extension:
        raise ValueError("output_extension is required when target_type='file'")
    base = cfg.table_path.rstrip("/")
    if cfg.existing_table:
        table = spark.read.parquet(cfg.existing_table)
    else:
        table = written(ingest(spark, cfg, bpe), base)

    answers = written(convert(table, cfg, predict), base, "responses")
    state = table.drop(*SOURCE_TEXTS)
    merged = merges.merge_responses(state, _numbered_as_int(answers), cfg.labels("conversion"))
    state = merges.clean_results(merged, F.current_timestamp())

    if cfg.target_type == "notebook":
        checked = rounds.check_and_fix(
            state, predict, check_fn, cfg.max_fix_attempts, cfg.labels("fix"),
            partitions=cfg.partitions, threads=cfg.threads, policy=cfg.retry,
        )
        cells = scripts.with_cells(checked)
        split = F.when(F.col("cells").isNotNull(), scripts.join_cells("cells"))
        state = written(cells.withColumn("result_content", split).drop("cells"), base, "state")
        statuses = export_documents(state, cfg)
    else:
        state = written(state, base, "state")
        statuses = write_text_files(state, cfg.output_dir, cfg.output_extension)
    exports = written(statuses.withColumn("export_timestamp", F.current_timestamp()), base, "exports")
    done = reports.with_accuracy(merges.merge_exports(state, exports))
    texts = table.select("input_file_number", *SOURCE_TEXTS)
    table = written(done.join(met(texts), "input_file_number").select(*table.columns), base)
    if cfg.sql_output_dir and cfg.target_type == "notebook":
        convert_to_sql_files(spark, cfg, predict_sql or predict).write.mode("overwrite").parquet(f"{base}/sql_files")
    return table


#: Columns that no stage after the first call reads.
SOURCE_TEXTS = ("input_file_content", "input_file_content_preprocessed")


def _numbered_as_int(responses: DataFrame) -> DataFrame:
    return responses.withColumn("input_file_number", F.col("input_file_number").cast("int"))
