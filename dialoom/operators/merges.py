"""Merging responses, exports and changes into a table, and before/after comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.rules import normalize_export_status
from dialoom.functions.text import clean_code_fence
from dialoom.session import materialize, met

LABELS = (
    "model_serving_endpoint_for_conversion",
    "model_serving_endpoint_for_fix",
    "request_params_for_conversion",
    "request_params_for_fix",
)
MEASURES = (
    "result_prompt_tokens",
    "result_completion_tokens",
    "result_total_tokens",
    "result_processing_time_seconds",
    "result_timestamp",
)
ANALYSIS = ("result_python_parse_error", "result_extracted_sqls", "result_sql_parse_errors")
EXPORT_VALUES = (
    "export_output_path",
    "export_status",
    "export_error",
    "export_timestamp",
    "export_content_size_bytes",
)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def merge_responses(
    source: DataFrame, result: DataFrame, labels: dict[str, str] | None = None, reset_all: bool = True
) -> DataFrame:
    """LEFT join of model responses on the file number.

    New values win where there are any. Success clears the target flag and the old error, failure
    sets the new error. The analysis columns are reset on every row, or with ``reset_all=False``
    only on the rows that got a response.
    """
    labels = labels or {}
    key = "input_file_number"
    new = _prefixed(result, "_n_")
    joined = source.join(met(new), F.col(key) == F.col("_n_" + key), "left")
    ok = F.col("_n_result_content").isNotNull() & F.col("_n_result_error").isNull()
    matched = F.col("_n_" + key).isNotNull()
    changed: dict[str, Column] = {
        "is_conversion_target": F.when(ok, F.lit(False)).otherwise(F.col("is_conversion_target")),
        "result_content": F.coalesce("_n_result_content", "result_content"),
        "result_error": F.when(ok, F.lit(None)).otherwise(F.coalesce("_n_result_error", "result_error")),
    }
    for name in MEASURES:
        changed[name] = F.coalesce("_n_" + name, name)
    for name in ANALYSIS:
        dtype = source.schema[name].dataType
        nothing = F.lit(None).cast(dtype)
        changed[name] = nothing if reset_all else F.when(matched, nothing).otherwise(F.col(name))
    for name in LABELS:
        changed[name] = F.coalesce(F.lit(labels.get(name)).cast("string"), F.col(name))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in source.columns])


def merge_exports(source: DataFrame, export: DataFrame) -> DataFrame:
    """LEFT join of export results on the path; both status flavours end as exported / export_failed."""
    new = _prefixed(export, "_n_")
    joined = source.join(met(new), F.col("input_file_path") == F.col("_n_input_file_path"), "left")
    changed = {c: F.coalesce("_n_" + c, c) for c in EXPORT_VALUES if c != "export_status"}
    changed["export_status"] = F.coalesce(normalize_export_status("_n_export_status"), F.col("export_status"))
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in source.columns])


def attach(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """LEFT join ``cols`` on ``key`` after dropping their old values; key types are made equal."""
    dtype = df.schema[key].dataType
    right = other.select(F.col(key).cast(dtype).alias(key), *cols)
    return df.drop(*cols).join(right, key, "left")


def compare(df_a: DataFrame, df_b: DataFrame, key: str, col: str) -> DataFrame:
    """Inner join on ``key`` with both versions of ``col``."""
    return df_a.select(key, F.col(col).alias("before")).join(df_b.select(key, F.col(col).alias("after")), key)


SHRINK_COLUMNS = ("input_file_number", "input_file_path")


def _shrink(df: DataFrame, before: Column, after: Column, threshold: float, keep: Sequence[str]) -> DataFrame:
    return (
        df.select(
            *keep,
            F.coalesce(F.length(before), F.lit(0)).alias("original_content_size"),
            F.coalesce(F.length(after), F.lit(0)).alias("cleaned_content_size"),
        )
        .withColumn("size_ratio", F.try_divide("cleaned_content_size", "original_content_size"))
        .filter(F.col("size_ratio") < threshold)
    )


def content_shrink_report(
    before: DataFrame, after: DataFrame, threshold: float = 0.9, col: str = "result_content"
) -> DataFrame:
    """Rows whose text came out shorter than ``threshold`` times its old length."""
    key = "input_file_number"
    sizes = after.select(F.col(key), F.col(col).alias("_after"))
    joined = before.select(*SHRINK_COLUMNS, F.col(col).alias("_before")).join(sizes, key)
    return _shrink(joined, F.col("_before"), F.col("_after"), threshold, SHRINK_COLUMNS)


def touch_changed(new: Column, old: Column, stamp: Column, old_stamp: Column) -> Column:
    """``stamp`` where the text changed, else the old stamp; a NULL on either side is no change."""
    return F.when(new != old, stamp).otherwise(old_stamp)


def clean_results(df: DataFrame, stamp: Column, content: str = "result_content") -> DataFrame:
    """Clean the fences and move the time stamp of changed rows, in one projection."""
    cleaned = clean_code_fence(content)
    return df.withColumns(
        {
            content: cleaned,
            "result_timestamp": touch_changed(cleaned, F.col(content), stamp, F.col("result_timestamp")),
        }
    )


def clean_shrink_report(df: DataFrame, threshold: float = 0.9, content: str = "result_content") -> DataFrame:
    """``content_shrink_report`` of the fence clean-up without a join: both texts are in the row."""
    return _shrink(df, F.col(content), clean_code_fence(content), threshold, SHRINK_COLUMNS)


def one_per_key(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source with a run-time check that no key occurs twice; the check costs no extra pass."""
    keys = list(keys)
    rest = [c for c in source.columns if c not in keys]
    grouped = source.groupBy(*keys).agg(F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row"),
                                        F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("duplicate source key: "), text)).cast(grouped.schema["_row"].dataType)
    )
    out = grouped.select(*keys, checked.alias("_row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in source.columns])


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    set_cols: Sequence[str] | None = None,
    insert: bool = True,
    update: bool = True,
) -> DataFrame:
    """MERGE: matched rows take ``set_cols`` from the source, unmatched source rows are inserted.

    Two joins in place of one full outer join: the updating LEFT join may broadcast a small
    source and lets the adaptive skew split work on the target; the inserting ANTI join sees only
    the target's distinct keys. The checked source is written once before both, so both see the
    same rows even if it would not come out alike twice. A NULL key matches nothing. Duplicate
    source keys raise.
    """
    keys = list(keys)
    set_cols = [c for c in source.columns if c not in keys] if set_cols is None else list(set_cols)
    source = one_per_key(source, keys)
    if update and insert:
        source = materialize(source)
    out = target
    if update:
        new = source.select(*[F.col(k).alias("_k_" + k) for k in keys], *[F.col(c).alias("_n_" + c) for c in set_cols])
        new = new.withColumn("_hit", F.lit(True))
        joined = target.join(new, [F.col(k) == F.col("_k_" + k) for k in keys], "left")
        hit = F.col("_hit").isNotNull()
        out = joined.select(
            *[F.when(hit, F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
              for c in target.columns]
        )
    if insert:
        fresh = source.join(target.select(*keys).distinct(), keys, "left_anti")
        filled = [F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c)
                  for c in target.columns]
        out = out.unionByName(fresh.select(*filled))
    return out


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], set_cols: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: matched rows take the source's values."""
    return upsert(target, source.select(*keys, *set_cols), keys, set_cols, insert=False)


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DELETE ... JOIN / USING: target rows without a partner remain."""
    keys = list(keys)
    return target.join(source.select(*keys).distinct(), keys, "left_anti")


def put_rows(target: DataFrame, key: str, rows: Sequence[dict]) -> DataFrame:
    """Update the rows with these keys, or insert them: two scans of the target, however many rows.

    A later row of the same key wins. Columns that a row does not name stay, or are NULL in a new
    row. A count per key tells which are new, so there is nothing to join.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    given: dict = {}
    for row in rows:
        given[row[key]] = {**given.get(row[key], {}), **row}
    if not given:
        return target
    here = {k: F.col(key) == F.lit(k).cast(types[key]) for k in given}

    def changed(name: str) -> Column:
        out = F.col(name)
        for k, row in given.items():
            if name in row:
                out = F.when(here[k], F.lit(row[name]).cast(types[name])).otherwise(out)
        return out.alias(name)

    updated = target.select(*[changed(c) for c in types])
    some = target.filter(F.col(key).isin([F.lit(k).cast(types[key]) for k in given]))
    counts = some.agg(*[F.count_if(here[k]).alias(f"n{i}") for i, k in enumerate(given)])
    new = [
        F.when(F.col(f"n{i}") == 0, F.struct(*[F.lit(row.get(c)).cast(t).alias(c) for c, t in types.items()]))
        for i, row in enumerate(given.values())
    ]
    return updated.unionByName(counts.select(F.inline(F.array_compact(F.array(*new)))))


def put_row(target: DataFrame, key: str, row: dict) -> DataFrame:
    """Update the rows with this key, or insert one."""
    return put_rows(target, key, [row])
