"""String functions with the semantics of the source dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.base import as_col


def concat(*parts: Column | str, dialect: str = "tsql") -> Column:
    """``+`` / ``||`` / CONCAT. NULL makes the whole NULL, except in Oracle where NULL is ''."""
    cols = [as_col(p).cast("string") for p in parts]
    if dialect == "oracle":
        joined = F.concat_ws("", *cols)
        return F.when(F.length(joined) > 0, joined)
    return F.concat(*cols)


def length(text: Column | str, dialect: str = "snowflake") -> Column:
    """LEN / LENGTH; T-SQL does not count trailing spaces."""
    text = as_col(text)
    return F.length(F.rtrim(text)) if dialect in ("tsql", "mssql", "synapse") else F.length(text)


def substr(text: Column | str, start: int, count: int | None = None) -> Column:
    text = as_col(text)
    return F.substr(text, F.lit(start)) if count is None else F.substr(text, F.lit(start), F.lit(count))


def left(text: Column | str, count: int) -> Column:
    return F.left(as_col(text), F.lit(count))


def position(part: Column | str, text: Column | str) -> Column:
    """POSITION(part IN text) / INDEX / INSTR: 1-based, 0 when absent. ``part`` as str is a literal."""
    part = part if isinstance(part, Column) else F.lit(part)
    return F.position(part, as_col(text))


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in chars) + "]"


def strtok(text: Column | str, delimiters: str, n: int) -> Column:
    """n-th token; ``delimiters`` is a set of characters and empty tokens do not count."""
    tokens = F.filter(F.split(as_col(text), _char_class(delimiters)), lambda x: x != "")
    return F.try_element_at(tokens, F.lit(n))


def split_to_array(text: Column | str, delimiter: str) -> Column:
    """SPLIT_TO_ARRAY: the delimiter is plain text."""
    return F.split(as_col(text), re.escape(delimiter))


def trim(text: Column | str, side: str = "both", chars: str = " ") -> Column:
    """TRIM(LEADING | TRAILING | BOTH chars FROM text)."""
    text, chars = as_col(text), F.lit(chars)
    return {"leading": F.ltrim, "trailing": F.rtrim, "both": F.trim}[side.lower()](text, chars)


def _with_flags(pattern: str, flags: str) -> str:
    kept = "".join(f for f in flags if f in "imsx")
    return f"(?{kept})" + pattern if kept else pattern


def regexp_replace(text: Column | str, pattern: str, replacement: str, flags: str = "g") -> Column:
    """REGEXP_REPLACE with PostgreSQL flags: without ``g`` only the first match is replaced."""
    text, pattern = as_col(text), _with_flags(pattern, flags)
    if "g" in flags:
        return F.regexp_replace(text, pattern, replacement)
    # The lazy lead-in stops at the first match; the rest of the text is carried over whole.
    groups = re.compile(re.sub(r"\(\?[imsx]+\)", "", pattern)).groups
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m.group(1)) + 1}", replacement)
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?-s:{pattern})(.*)\z", f"$1{shifted}${groups + 2}")


def regexp_like(text: Column | str, pattern: str, flags: str = "") -> Column:
    """RLIKE / REGEXP_LIKE / REGEXP_ILIKE (``flags="i"``)."""
    return as_col(text).rlike(_with_flags(pattern, flags))


def regexp_extract(text: Column | str, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract(as_col(text), _with_flags(pattern, flags), group)


def regexp_extract_all(text: Column | str, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(_with_flags(pattern, flags)), F.lit(group))


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(as_col(a), as_col(b))


def oreplace(text: Column | str, old: str, new: str = "") -> Column:
    return F.replace(as_col(text), F.lit(old), F.lit(new))


def otranslate(text: Column | str, old: str, new: str) -> Column:
    """Character by character; characters of ``old`` without a partner in ``new`` are dropped."""
    return F.translate(as_col(text), old, new)


def hashbytes(algorithm: str, text: Column | str) -> Column:
    """HASHBYTES('MD5' | 'SHA1' | 'SHA2_256' | 'SHA2_512', x) as lower-case hex."""
    text = as_col(text)
    name = algorithm.upper()
    if name == "MD5":
        return F.md5(text)
    if name in ("SHA", "SHA1"):
        return F.sha1(text)
    return F.sha2(text, {"SHA2_256": 256, "SHA2_512": 512}[name])


def normalize_name(name: str) -> str:
    """Plain identifier: brackets and quotes go, ``@ # $`` go."""
    name = name.strip()
    if len(name) > 1 and name[0] + name[-1] in ("[]", '""', "``"):
        name = name[1:-1]
    return re.sub(r"[@#$]", "", name)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Clean every column name; two names that become equal (case aside) are an error."""
    names = [normalize_name(c) for c in df.columns]
    lowered = [n.lower() for n in names]
    clash = sorted({n for n in lowered if lowered.count(n) > 1})
    if clash:
        raise ValueError(f"columns become equal after clean-up: {', '.join(clash)}")
    return df.toDF(*names)
