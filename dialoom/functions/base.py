"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python treats as white space: the Unicode set plus the four separators U+001C..U+001F.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _outside(chars: str) -> list[tuple[int, int]]:
    """Code point ranges between the given characters, the one with the letters first, then by size."""
    points = [-1, *map(ord, chars), 0x110000]
    gaps = [(a + 1, b - 1) for a, b in zip(points, points[1:], strict=False) if b - a > 1]
    return sorted(gaps, key=lambda g: (not g[0] <= ord("a") <= g[1], g[0] - g[1]))


# The class as "none of the other ranges": a letter fails at the first range it is compared with,
# which makes it about twice as fast in the JVM as a list of the white space itself.
WS = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _outside(WS_CHARS)) + "]"


def as_col(value: Column | str) -> Column:
    """A column name becomes a column; a column stays as it is."""
    return value if isinstance(value, Column) else F.col(value)


def strip(value: Column | str) -> Column:
    """Trim every kind of white space at both ends (``trim`` alone drops spaces only)."""
    return F.btrim(as_col(value), F.lit(WS_CHARS))


def is_blank(value: Column | str) -> Column:
    """True for NULL, the empty string and white space only."""
    value = as_col(value)
    return value.isNull() | (F.btrim(value, F.lit(WS_CHARS)) == "")


def size0(value: Column | str) -> Column:
    """Array size with NULL counted as 0."""
    return F.coalesce(F.size(as_col(value)), F.lit(0))
