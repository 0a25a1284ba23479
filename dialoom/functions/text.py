"""Text columns: comment stripping, token estimates, code fences, JSON spans, base64 and paths."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions.base import WS, as_col, strip

# Estimate ratio, code fence markers, notebook markers and file-name characters.
CHARS_PER_TOKEN = 3.4
PYTHON_FENCE = "```python"
SQL_FENCE = "```sql"
FENCE = "```"
NOTEBOOK_MARKERS = ("# Databricks notebook source", "# MAGIC", "# COMMAND ----------")
CELL_MARKER = "# COMMAND ----------"
UNSAFE_NAME_CHARS = '<>:"/\\|?*'


def strip_sql_comments(text: Column | str) -> Column:
    """Drop line comments, then block comments, then squeeze runs of blank lines.

    String literals are not protected and line comments go first, so ``/* a -- b */`` loses
    its end mark. Both follow from the order of the three rules.
    """
    no_line = F.regexp_replace(as_col(text), r"(?d)--.*", "")
    no_block = F.regexp_replace(no_line, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(no_block, rf"\n{WS}*\n", "\n\n")


def collapse_ws(text: Column | str) -> Column:
    """Every run of white space becomes one space; the ends are not trimmed."""
    return F.regexp_replace(as_col(text), rf"{WS}+", " ")


def preprocess_sql(text: Column | str) -> Column:
    return collapse_ws(strip_sql_comments(text))


def estimate_tokens(text: Column | str, ratio: float = CHARS_PER_TOKEN) -> Column:
    """Code points divided by ``ratio``, truncated."""
    return (F.length(as_col(text)) / F.lit(float(ratio))).cast("int")


def expand_ranges(text: Column | str) -> Column:
    """``"1,5-8"`` -> ``[1, 5, 6, 7, 8]``; a falling range gives nothing, ``""`` gives ``[]``."""
    text = as_col(text)

    def numbers(part: Column) -> Column:
        ends = F.split(part, "-")
        first, last = F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return (
        F.when(text.isNull(), F.lit(None).cast("array<int>"))
        .when(text == "", F.array().cast("array<int>"))
        .otherwise(F.flatten(F.transform(F.split(text, ","), numbers)))
    )


def clean_code_fence(text: Column | str) -> Column:
    """Take the code out of a leading python fence; elsewhere only remove the fence mark."""
    text = as_col(text)
    body = F.substr(text, F.instr(text, PYTHON_FENCE) + F.lit(len(PYTHON_FENCE)))
    code = F.regexp_replace(F.substring_index(body, FENCE, 1), r"\A\n", "")
    code = F.when((code != "") & ~code.endswith("\n"), F.concat(code, F.lit("\n"))).otherwise(code)
    opens = text.rlike(rf"\A{WS}*{PYTHON_FENCE}") & (F.instr(body, FENCE) > 0)
    return (
        F.when(~text.contains(PYTHON_FENCE), text)
        .when(opens, code)
        .otherwise(F.replace(text, F.lit(PYTHON_FENCE), F.lit("")))
    )


# Column defaults that cannot be kept, in the order they are dropped.
DROPPED_DEFAULTS = (
    r"(?iU)DEFAULT\s+UUID\s*\(\s*\)",
    r"(?iU)DEFAULT\s+NEWID\s*\(\s*\)",
    r"(?iU)DEFAULT\s+SYSDATE",
)


def post_clean_sql(text: Column | str) -> Column:
    """Remove fences, trim, then drop non-deterministic column defaults."""
    out = F.replace(as_col(text), F.lit(SQL_FENCE), F.lit(""))
    out = strip(F.replace(out, F.lit(FENCE), F.lit("")))
    for pattern in DROPPED_DEFAULTS:
        out = F.regexp_replace(out, pattern, "")
    return out


def preview(text: Column | str, head: int = 200, tail: int = 100) -> Column:
    """First ``head`` and last ``tail`` characters around a truncation mark."""
    text = as_col(text)
    return F.concat(F.left(text, F.lit(head)), F.lit("... [truncated] ..."), F.right(text, F.lit(tail)))


def truncate_middle(text: Column | str, max_length: int = 2000) -> Column:
    """Cut the middle out of strings longer than ``max_length`` and say how much went."""
    text = as_col(text)
    cut = F.concat(
        F.left(text, F.lit(max_length // 2)),
        F.lit(" ... [truncated "),
        (F.length(text) - F.lit(max_length)).cast("string"),
        F.lit(" chars] ... "),
        F.right(text, F.lit((max_length + 1) // 2)),
    )
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def truncate_json_leaves(text: Column | str, max_length: int = 2000) -> Column:
    """``truncate_middle`` on every string leaf of a JSON document; other text is unchanged."""

    def shorten(node):
        if isinstance(node, dict):
            return {key: shorten(child) for key, child in node.items()}
        if isinstance(node, list):
            return [shorten(child) for child in node]
        if isinstance(node, str) and len(node) > max_length:
            gone = len(node) - max_length
            return f"{node[: max_length // 2]} ... [truncated {gone} chars] ... {node[-((max_length + 1) // 2):]}"
        return node

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            try:
                return json.dumps(shorten(json.loads(value)), ensure_ascii=False)
            except ValueError:
                return value

        return values.map(one)

    return run.asNondeterministic()(as_col(text))


def json_span(text: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span."""
    return F.nullif(F.regexp_extract(as_col(text), r"(?s)\{.*\}", 0), F.lit(""))


def parse_object(text: Column | str, schema: T.StructType) -> Column:
    """Parse a JSON object strictly as a whole: NULL where the text is not one."""
    text = as_col(text)
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(text, marked, {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "true"})

    def fields(read: Column) -> Column:
        whole = F.struct(*[read[f.name].alias(f.name) for f in schema.fields])
        return F.when(read["_bad"].isNull(), whole)

    # Through a one-element array the text is parsed once, not once per field.
    once = F.get(F.transform(F.array(parsed), fields), F.lit(0))
    return F.when(text.rlike(rf"\A{WS}*\{{"), once)


@F.pandas_udf(T.StringType())
def _literal_to_json(values: pd.Series) -> pd.Series:
    import ast

    def one(value):
        if value is None:
            return None
        try:
            found = ast.literal_eval(value)
            return json.dumps(found) if isinstance(found, dict) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def extract_json(text: Column | str, schema: T.StructType, literals: bool = False) -> Column:
    """Whole text as JSON, else its outermost braces; ``literals`` adds Python-literal dicts.

    The literal attempt needs a Python worker, so it is off unless asked for, and it sees only
    the rows the JSON attempts could not read.
    """
    text = as_col(text)
    found = F.coalesce(parse_object(text, schema), parse_object(json_span(text), schema))
    if literals:
        rest = F.when(found.isNull(), json_span(text))
        found = F.coalesce(found, parse_object(_literal_to_json.asNondeterministic()(rest), schema))
    return found


def to_base64(text: Column | str) -> Column:
    """Base64 of the UTF-8 bytes on one line."""
    return F.regexp_replace(F.base64(F.encode(as_col(text), "UTF-8")), r"[\r\n]", "")


def base64_size(text: Column | str) -> Column:
    """Length of ``to_base64`` without building it: four characters per three bytes, rounded up."""
    return (F.floor((F.octet_length(as_col(text)) + F.lit(2)) / F.lit(3)) * F.lit(4)).cast("long")


def from_base64(text: Column | str) -> Column:
    """Decoded text, or the input as it is when it is not base64 of UTF-8 text."""
    text = as_col(text)
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), text)


def basename(path: Column | str) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """File name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(basename(path), r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def relative_path(path: Column | str, base: str) -> Column:
    """Path below ``base``; paths that do not start with it stay whole."""
    path = F.rtrim(as_col(path), F.lit("/"))
    base = base.rstrip("/")
    rest = F.ltrim(F.substr(path, F.lit(len(base) + 1)), F.lit("/"))
    return F.when(path.startswith(base), rest).otherwise(path)


def display_name(path: Column | str) -> Column:
    """Base name after its first underscore (whole when there is none); NULL becomes ''."""
    name = basename(path)
    after = F.substr(name, F.instr(name, "_") + F.lit(1))
    return F.coalesce(F.when(name.contains("_"), after).otherwise(name), F.lit(""))


def sanitize_name(name: Column | str) -> Column:
    return F.translate(as_col(name), UNSAFE_NAME_CHARS, "_" * len(UNSAFE_NAME_CHARS))


def output_file_path(path: Column | str, directory: str, extension: str) -> Column:
    """``directory/<clean stem>.<extension>``."""
    extension = extension if extension.startswith(".") else "." + extension
    return F.concat(F.lit(directory.rstrip("/") + "/"), sanitize_name(stem(path)), F.lit(extension))


def is_notebook(text: Column | str) -> Column:
    """Any notebook marker within the first 500 characters."""
    head = F.left(as_col(text), F.lit(500))
    found = head.contains(NOTEBOOK_MARKERS[0])
    for marker in NOTEBOOK_MARKERS[1:]:
        found = found | head.contains(marker)
    return found
