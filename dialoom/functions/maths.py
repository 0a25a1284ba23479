"""Number, NULL and cast functions with the semantics of the source dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.base import as_col


def isnull(value: Column | str, replacement) -> Column:
    """ISNULL / NVL / IFNULL."""
    return F.coalesce(as_col(value), replacement if isinstance(replacement, Column) else F.lit(replacement))


def zeroifnull(value: Column | str) -> Column:
    return F.zeroifnull(as_col(value))


def nullifzero(value: Column | str) -> Column:
    return F.nullifzero(as_col(value))


def div0(a: Column | str, b: Column | str) -> Column:
    """0 for a zero divisor (NULL dividend included), else a / b with NULL passed on; never raises."""
    a, b = as_col(a), as_col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def decode(value: Column | str, *pairs, default=None) -> Column:
    """DECODE(e, v1, r1, ...): the first equal value wins and NULL equals NULL."""
    value = as_col(value)
    out = None
    for match, result in zip(pairs[0::2], pairs[1::2], strict=True):
        hit = value.eqNullSafe(F.lit(match))
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(default))


def iff(condition: Column, yes, no) -> Column:
    """IF(c, a, b): a NULL condition takes ``b``."""
    return F.when(condition, yes).otherwise(no)


def square(value: Column | str) -> Column:
    value = as_col(value)
    return value * value


def convert(value: Column | str, dtype: str, strict: bool = True) -> Column:
    """CONVERT / CAST / TO_NUMBER / INT8; ``strict=False`` gives NULL instead of an error."""
    value = as_col(value)
    return value.cast(dtype) if strict else value.try_cast(dtype)


def to_number(text: Column | str, precision: int = 38, scale: int = 0, strict: bool = True) -> Column:
    return convert(F.trim(as_col(text)), f"decimal({precision},{scale})", strict)


def int8(value: Column | str, strict: bool = True) -> Column:
    return convert(value, "bigint", strict)


def to_text(value: Column | str) -> Column:
    """TO_CHAR(e) without a format, CAST(e AS CHAR)."""
    return as_col(value).cast("string")


def bitshiftleft(value: Column | str, n: int) -> Column:
    return F.shiftleft(as_col(value), n)


def bitshiftright(value: Column | str, n: int) -> Column:
    return F.shiftright(as_col(value), n)


def bitxor(a: Column | str, b: Column | str) -> Column:
    return as_col(a).bitwiseXOR(as_col(b))


def boolxor(a: Column | str, b: Column | str) -> Column:
    """Exactly one is true; NULL when either is NULL."""
    return as_col(a) != as_col(b)
