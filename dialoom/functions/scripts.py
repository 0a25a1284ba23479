"""Columns that look at SQL script text: object kind, flattening, residual source syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.base import WS, as_col, strip

# Object patterns, first match wins, upper and lower case alike.
OBJECT_PATTERNS = (
    (r"(CREATE|REPLACE)\s+(OR\s+REPLACE\s+)?(PROC|PROCEDURE)", "PROCEDURE"),
    (r"CREATE\s+(OR\s+REPLACE\s+)?FUNCTION", "FUNCTION"),
    (r"CREATE\s+(OR\s+REPLACE\s+)?VIEW", "VIEW"),
    (r"CREATE\s+TYPE", "TYPE"),
    (r"CREATE\s+SEQUENCE", "SEQUENCE"),
    (r"CREATE\s+(OR\s+REPLACE\s+)?TABLE", "TABLE"),
    (r"(CREATE|REPLACE)\s+MACRO", "MACRO"),
    (r"CREATE\s+(OR\s+REPLACE\s+)?(SET\s+|MULTISET\s+)?TABLE", "TABLE"),
)
UNKNOWN_OBJECT = "UNKNOWN"

# Residual-syntax rules per object kind. ``absent`` rules fire when nothing matches.
LINT_RULES = (
    # (rule id, object kind, pattern, fires when)
    ("table_check_or_unique", "TABLE", r"(?i)\b(CHECK\s*\(|UNIQUE\b)", "present"),
    ("table_default_expression", "TABLE", r"(?i)\bDEFAULT\b", "present"),
    ("table_volatile_default", "TABLE", r"(?i)\bDEFAULT\s+(UUID|NEWID|RANDOM|SYSDATE)\b", "present"),
    ("table_index_keyword", "TABLE", r"(?i)\b(CLUSTERED|NONCLUSTERED|ORGANIZATION\s+INDEX)\b", "present"),
    ("table_key_direction", "TABLE", r"(?i)\bPRIMARY\s+KEY\b[^()]*\([^)]*\b(ASC|DESC)\b", "present"),
    ("table_missing_delta", "TABLE", r"(?i)\bUSING\s+DELTA\b", "absent"),
    ("view_not_create_or_replace", "VIEW", r"(?i)\bCREATE\s+OR\s+REPLACE\s+VIEW\b", "absent"),
    ("view_outer_join_mark", "VIEW", r"\(\+\)", "present"),
    ("view_schemabinding", "VIEW", r"(?i)\bSCHEMABINDING\b", "present"),
    ("view_double_colon_cast", "VIEW", r"::", "present"),
    ("procedure_transaction", "PROCEDURE", r"(?i)\b(COMMIT|ROLLBACK|PRAGMA)\b", "present"),
    ("function_block", "FUNCTION", r"(?is)\bBEGIN\b.*\bEND\b", "present"),
)


def classify_object(text: Column | str) -> Column:
    """Kind of the first listed object a script creates."""
    text = as_col(text)
    kind = None
    for pattern, label in OBJECT_PATTERNS:
        hit = text.rlike("(?iu)" + pattern.replace(r"\s", WS))
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return kind.otherwise(UNKNOWN_OBJECT)


def flatten_sql(text: Column | str, strip_comments_first: bool = False) -> Column:
    """One line: line ends become spaces, then trim, then braces go.

    A ``--`` comment swallows the rest of a flattened statement; ``strip_comments_first``
    removes comments while the lines are still there.
    """
    from dialoom.functions.text import strip_sql_comments

    text = strip_sql_comments(text) if strip_comments_first else as_col(text)
    return F.translate(strip(F.translate(text, "\n\r", "  ")), "{}", "")


def lint_sql(text: Column | str, object_type: Column | str) -> Column:
    """Ids of the residual-syntax rules that fire, in rule order."""
    text, object_type = as_col(text), as_col(object_type)
    fired = []
    for rule, kind, pattern, when in LINT_RULES:
        hit = text.rlike(pattern)
        hit = hit if when == "present" else ~hit
        fired.append(F.when((object_type == kind) & hit, F.lit(rule)))
    return F.array_compact(F.array(*fired))
