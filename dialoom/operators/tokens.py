"""Preprocessing and token counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.base import as_col
from dialoom.functions.text import CHARS_PER_TOKEN, estimate_tokens, expand_ranges, preprocess_sql
from dialoom.operators.relational import apply_explode

# Tokenizer kinds, the endpoint name that means the ratio, the default vocabulary name.
RATIO_KIND, BPE_KIND = "claude", "openai"
KINDS = (BPE_KIND, RATIO_KIND)
DEFAULT_BPE_MODEL = "o200k_base"


@dataclass(frozen=True)
class Counter:
    """How to count tokens: a kind, a model label and, for exact counts, ``text -> int``."""

    kind: str = RATIO_KIND
    model: str = RATIO_KIND
    count: Callable[[str], int] | None = None
    ratio: float = CHARS_PER_TOKEN

    def column(self, text: Column | str) -> Column:
        if self.count is None:
            return estimate_tokens(text, self.ratio)
        count = self.count

        @F.pandas_udf(T.IntegerType())
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else count(v)).astype("Int32")

        return run.asNondeterministic()(as_col(text))


def choose_counter(
    tokenizer_type: str | None = None,
    endpoint: str | None = None,
    model: str = "",
    bpe: Callable[[str], int] | None = None,
) -> Counter:
    """An explicit kind wins; else the endpoint's name decides; with neither, the ratio.

    ``bpe`` supplies the exact counter; no vocabulary is shipped.
    """
    if tokenizer_type:
        kind = tokenizer_type.lower()
        if kind not in KINDS:
            raise ValueError(f"Unsupported tokenizer type: {tokenizer_type}. Supported types: {list(KINDS)}")
    elif endpoint:
        kind = RATIO_KIND if "claude" in endpoint.lower() else BPE_KIND
    else:
        kind = RATIO_KIND
    if kind == RATIO_KIND:
        return Counter()
    if bpe is None:
        raise ValueError("an exact token count needs a counter function (bpe=...)")
    return Counter(BPE_KIND, model or DEFAULT_BPE_MODEL, bpe)


def preprocess(df: DataFrame, source_format: str = "sql", text: str = "input_file_content") -> DataFrame:
    """``sql``: comments go and white space collapses; ``generic``: content as it is."""
    if source_format not in ("sql", "generic"):
        raise ValueError(f"unknown source format: {source_format}")
    out = preprocess_sql(text) if source_format == "sql" else F.col(text)
    return df.withColumn("input_file_content_preprocessed", out)


def with_token_columns(
    df: DataFrame, text: str = "input_file_content", counter: Counter | None = None, source_format: str = "sql"
) -> DataFrame:
    """Token counts of raw and preprocessed text, with the tokenizer's labels."""
    counter = counter or Counter()
    df = preprocess(df, source_format, text)
    raw = counter.column(text)
    return df.withColumns(
        {
            "tokenizer_type": F.lit(counter.kind),
            "tokenizer_model": F.lit(counter.model),
            "input_file_token_count": raw,
            "input_file_token_count_preprocessed": (
                counter.column("input_file_content_preprocessed") if source_format == "sql" else raw
            ),
        }
    )


def explode_ranges(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """One row per number of a range text such as ``1,5-8``."""
    return apply_explode(df, expand_ranges(column), name)
