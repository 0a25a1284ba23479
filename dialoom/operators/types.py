"""Declared source types to Spark types."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spark type per source type. ``{p}`` takes over the declared precision and scale.
# COMMON holds for every dialect; a dialect's own list goes first.
COMMON = {
    "BIGINT": "bigint", "INT": "int", "INTEGER": "int", "SMALLINT": "smallint", "TINYINT": "tinyint",
    "BOOLEAN": "boolean", "DECIMAL": "decimal({p})", "NUMERIC": "decimal({p})",
    "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double",
    "CHAR": "string", "CHARACTER": "string", "VARCHAR": "string", "NCHAR": "string", "NVARCHAR": "string",
    "TEXT": "string", "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp", "TIME": "string",
    "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary",
}
DIALECT_TYPES = {
    "mssql": {
        "BIT": "boolean", "TINYINT": "smallint", "MONEY": "decimal(19,4)", "SMALLMONEY": "decimal(10,4)",
        "NTEXT": "string", "IMAGE": "binary", "ROWVERSION": "binary", "GEOGRAPHY": "string", "GEOMETRY": "string",
        "SQL_VARIANT": "string", "UNIQUEIDENTIFIER": "string", "DATETIME": "timestamp", "DATETIME2": "timestamp",
    },
    "oracle": {
        "CLOB": "string", "NCLOB": "string", "NUMBER": "decimal({p})", "VARCHAR2": "string", "NVARCHAR2": "string",
    },
    "snowflake": {
        "VARCHAR2": "string", "DATETIME": "timestamp", "TIMESTAMP_NTZ": "timestamp_ntz",
        "TIMESTAMP_LTZ": "timestamp", "TIMESTAMP_TZ": "timestamp", "FLOAT4": "double", "FLOAT8": "double",
        "INT": "bigint", "INTEGER": "bigint", "NUMBER": "decimal({p})",
    },
    "teradata": {"VARBYTE": "binary", "BYTEINT": "tinyint", "ST_GEOMETRY": "string"},
    "postgresql": {
        "BYTEA": "binary", "SERIAL": "int", "BIGSERIAL": "bigint", "SMALLSERIAL": "smallint", "UUID": "string",
    },
    "mysql": {
        "BIGINT UNSIGNED": "decimal(20,0)", "INT UNSIGNED": "bigint", "MEDIUMINT": "int", "TINYINT": "smallint",
        "TINYBLOB": "binary", "MEDIUMBLOB": "binary", "LONGBLOB": "binary", "TINYTEXT": "string",
        "MEDIUMTEXT": "string", "LONGTEXT": "string", "YEAR": "int", "DATETIME": "timestamp",
    },
    "redshift": {
        "BYTEINT": "tinyint", "SUPER": "string", "HLLSKETCH": "string", "TIMESTAMPTZ": "timestamp",
        "TIMETZ": "string", "VARBYTE": "binary",
    },
    "netezza": {
        "BYTEINT": "tinyint", "CHARACTER VARYING": "string", "DATETIME": "timestamp",
        "TIME WITH TIME ZONE": "string",
    },
}
ALIASES = {"synapse": "mssql", "tsql": "mssql", "postgres": "postgresql"}
DEFAULT_PRECISION = {"NUMBER": "38,0", "DECIMAL": "18,0", "NUMERIC": "18,0"}
# Source types that lose something on the way: zone, ordering, structure or a distinct kind.
LOSSY = (
    "GEOGRAPHY", "GEOMETRY", "ST_GEOMETRY", "SQL_VARIANT", "ROWVERSION", "SUPER", "HLLSKETCH", "TIMETZ", "TIME",
    "TIME WITH TIME ZONE", "TIMESTAMPTZ", "TIMESTAMP_TZ", "SERIAL", "BIGSERIAL", "SMALLSERIAL",
)


def dialect_name(dialect: str) -> str:
    name = ALIASES.get(dialect.lower(), dialect.lower())
    if name not in DIALECT_TYPES:
        raise ValueError(f"unknown dialect: {dialect}")
    return name


def type_table(dialect: str) -> dict[str, str]:
    return {**COMMON, **DIALECT_TYPES[dialect_name(dialect)]}


def _split(fields: str) -> list[str]:
    """Parts between commas that stand in no bracket."""
    out, depth, begin = [], 0, 0
    for at, ch in enumerate(fields):
        depth += (ch in "(<[") - (ch in ")>]")
        if ch == "," and not depth:
            out.append(fields[begin:at])
            begin = at + 1
    return [part.strip() for part in [*out, fields[begin:]] if part.strip()]


COMPOSITE = re.compile(r"(?is)^(?:ROW|STRUCT|COMPOSITE)?\s*[(<](.*)[)>]$")


def describe_type(declared: str, dialect: str) -> tuple[str, bool]:
    """Spark type of a declared source type, and whether something is lost on the way.

    ``NUMBER(10,2)``, ``INTEGER[]`` (an array), ``BIGINT UNSIGNED``, ``TIMESTAMP(6) WITH TIME ZONE``
    and composites such as ``ROW(street TEXT, zip INT)`` (a struct). An unknown type raises.
    """
    text = re.sub(r"\s+", " ", declared.strip())
    if text.endswith("[]"):
        inner, lossy = describe_type(text[:-2], dialect)
        return f"array<{inner}>", lossy
    if composite := COMPOSITE.match(text):
        fields = [part.split(" ", 1) for part in _split(composite.group(1))]
        if not fields or any(len(f) < 2 for f in fields):
            raise ValueError(f"no mapping for {dialect} type {declared}")
        found = [(name, *describe_type(kind, dialect)) for name, kind in fields]
        return f"struct<{','.join(f'{n}:{t}' for n, t, _ in found)}>", any(lossy for *_, lossy in found)
    args = re.search(r"\(([^)]*)\)", text)
    name = re.sub(r"\s*\([^)]*\)", "", text).strip().upper()
    types = type_table(dialect)
    base = name if name in types else re.sub(r" (WITH|WITHOUT) .*| ZEROFILL$", "", name)
    base = base if base in types else re.sub(r" UNSIGNED$", "", base)
    if base not in types:
        raise ValueError(f"no mapping for {dialect} type {declared}")
    found = types[base]
    if "{p}" in found:
        given = re.sub(r"\s", "", args.group(1)) if args else DEFAULT_PRECISION.get(base, "38,0")
        found = found.replace("{p}", given if "," in given else given + ",0")
    return found, base in LOSSY or " WITH TIME ZONE" in name


def spark_type(declared: str, dialect: str) -> str:
    """Spark type of a declared source type."""
    return describe_type(declared, dialect)[0]


def map_schema(df: DataFrame, dialect: str, declared: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast each declared column to its Spark type; other columns stay.

    ``strict`` raises on a value that does not fit; otherwise such values become NULL and
    ``_cast_failures`` lists the columns concerned.
    """
    targets = {name: spark_type(source, dialect) for name, source in declared.items()}
    nested = {c: t for c, t in targets.items() if "<" in t and df.schema[c].dataType.typeName() == "string"}

    def converted(c: str) -> Column:
        # Text of an array or a composite is read as JSON; a cast knows no way from text to those.
        if c in nested:
            return F.from_json(F.col(c), targets[c], {"mode": "FAILFAST" if strict else "PERMISSIVE"})
        return F.col(c).cast(targets[c]) if strict else F.col(c).try_cast(targets[c])

    if strict:
        return df.select(*[converted(c).alias(c) if c in targets else F.col(c) for c in df.columns])
    tried: dict[str, Column] = {c: converted(c) for c in df.columns if c in targets}
    lost = [F.when(F.col(c).isNotNull() & new.isNull(), F.lit(c)) for c, new in tried.items()]
    return df.select(
        *[tried[c].alias(c) if c in tried else F.col(c) for c in df.columns],
        F.array_compact(F.array(*lost)).alias("_cast_failures"),
    )


def type_report(declarations: DataFrame) -> DataFrame:
    """(dialect, column_name, declared_type) -> Spark type and whether something is lost.

    The rule is that of ``map_schema``; unknown types and dialects give NULL and count as lossy.
    """

    @F.pandas_udf("spark_type string, lossy boolean")
    def described(dialects: pd.Series, types: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}

        def look(pair: tuple) -> tuple:
            if pair not in known:
                try:
                    known[pair] = describe_type(pair[1], pair[0])
                except (ValueError, AttributeError):
                    known[pair] = None, True
            return known[pair]

        return pd.DataFrame([look(p) for p in zip(dialects, types, strict=True)], columns=["spark_type", "lossy"])

    found = described.asNondeterministic()("dialect", "declared_type")
    return declarations.select("dialect", "column_name", "declared_type", found.alias("_t")).select(
        "dialect", "column_name", "declared_type", "_t.spark_type", "_t.lossy"
    )
