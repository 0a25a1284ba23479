"""Array, map, struct and JSON functions with the semantics of the source dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.base import as_col


def array_construct(*values: Column | str) -> Column:
    return F.array(*[as_col(v) for v in values])


def object_construct(**entries: Column | str) -> Column:
    """OBJECT_CONSTRUCT: keys whose value is NULL are left out; values become text."""
    pairs = []
    for key, value in entries.items():
        pairs += [F.lit(key), as_col(value).cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _path(keys: str | list[str]) -> str:
    """``a`` / ``["a", "0"]`` / ``{a,b,c}`` -> ``$['a']['b']``; digits are array positions."""
    if isinstance(keys, str):
        keys = keys[1:-1].split(",") if keys.startswith("{") else [keys]
    return "$" + "".join(f"[{k.strip()}]" if k.strip().isdigit() else f"['{k.strip()}']" for k in keys)


def json_get(doc: Column | str, keys: str | list[str]) -> Column:
    """PostgreSQL ``->``, ``->>``, ``#>`` and ``#>>``."""
    return F.get_json_object(as_col(doc), _path(keys))


def _is_container(found: Column) -> Column:
    return found.rlike(r"\A\s*[\{\[]")


def json_value(doc: Column | str, path: str) -> Column:
    """JSON_VALUE: scalars only, NULL for objects and arrays."""
    found = F.get_json_object(as_col(doc), path)
    return F.when(~_is_container(found), found)


def json_query(doc: Column | str, path: str) -> Column:
    """JSON_QUERY: objects and arrays only, NULL for scalars."""
    found = F.get_json_object(as_col(doc), path)
    return F.when(_is_container(found), found)


def errors_text(errors: Column | str, separator: str = "; ") -> Column:
    """Messages joined to one text; NULL stays NULL."""
    return F.array_join(as_col(errors), separator)


def errors_text_or_empty(errors: Column | str, separator: str = ", ") -> Column:
    """Messages joined to one text; NULL becomes ''."""
    return F.coalesce(F.array_join(as_col(errors), separator), F.lit(""))
