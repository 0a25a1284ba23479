"""Fixed schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The result table, one row per input file, column order kept.
RESULT_COLUMNS = (
    ("input_file_number", T.IntegerType()),
    ("input_file_path", T.StringType()),
    ("input_file_encoding", T.StringType()),
    ("tokenizer_type", T.StringType()),
    ("tokenizer_model", T.StringType()),
    ("input_file_token_count", T.IntegerType()),
    ("input_file_token_count_preprocessed", T.IntegerType()),
    ("input_file_content", T.StringType()),
    ("input_file_content_preprocessed", T.StringType()),
    ("is_conversion_target", T.BooleanType()),
    ("model_serving_endpoint_for_conversion", T.StringType()),
    ("model_serving_endpoint_for_fix", T.StringType()),
    ("request_params_for_conversion", T.StringType()),
    ("request_params_for_fix", T.StringType()),
    ("result_content", T.StringType()),
    ("result_prompt_tokens", T.IntegerType()),
    ("result_completion_tokens", T.IntegerType()),
    ("result_total_tokens", T.IntegerType()),
    ("result_processing_time_seconds", T.FloatType()),
    ("result_timestamp", T.TimestampType()),
    ("result_error", T.StringType()),
    ("result_python_parse_error", T.StringType()),
    ("result_extracted_sqls", T.ArrayType(T.StringType())),
    ("result_sql_parse_errors", T.ArrayType(T.StringType())),
    ("export_output_path", T.StringType()),
    ("export_status", T.StringType()),
    ("export_error", T.StringType()),
    ("export_timestamp", T.TimestampType()),
    ("export_content_size_bytes", T.LongType()),
    ("accuracy_percent", T.DoubleType()),
)
RESULT_SCHEMA = T.StructType([T.StructField(name, dtype, True) for name, dtype in RESULT_COLUMNS])

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("input_file_number", T.LongType()),
        T.StructField("result_content", T.StringType()),
        T.StructField("result_prompt_tokens", T.IntegerType()),
        T.StructField("result_completion_tokens", T.IntegerType()),
        T.StructField("result_total_tokens", T.IntegerType()),
        T.StructField("result_processing_time_seconds", T.FloatType()),
        T.StructField("result_timestamp", T.TimestampType()),
        T.StructField("result_error", T.StringType()),
    ]
)

EXPORT_SCHEMA = T.StructType(
    [
        T.StructField("input_file_path", T.StringType()),
        T.StructField("export_output_path", T.StringType()),
        T.StructField("export_status", T.StringType()),
        T.StructField("export_error", T.StringType()),
        T.StructField("export_timestamp", T.TimestampType()),
        T.StructField("export_content_size_bytes", T.LongType()),
    ]
)

MESSAGE_TYPE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

VERDICT_SCHEMA = T.StructType(
    [
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("summary_reasoning", T.StringType()),
        T.StructField("critical_errors", T.ArrayType(T.StringType())),
        T.StructField("improvements_required", T.ArrayType(T.StringType())),
    ]
)


def with_result_columns(df):
    """Add the result-table columns ``df`` lacks as typed NULLs, in the fixed order."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in RESULT_COLUMNS],
        *[c for c in df.columns if c not in RESULT_SCHEMA.names],
    )
