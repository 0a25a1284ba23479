"""Per-row helpers over Python source text, run inside tasks."""

from __future__ import annotations

import ast
import re
import warnings

PLACEHOLDER = "_placeholder_"


def parse(code: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(code)


def text_of(node: ast.expr, names: dict[str, str]) -> str | None:
    """The text an expression stands for, as far as constants and known names tell."""
    match node:
        case ast.Constant(value=value):
            return str(value)
        case ast.Name(id=name):
            return names.get(name, PLACEHOLDER)
        case ast.JoinedStr(values=parts):
            return "".join(text_of(part, names) or "" for part in parts)
        case ast.FormattedValue(value=inner):
            return text_of(inner, names) or PLACEHOLDER
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            both = text_of(left, names), text_of(right, names)
            return "".join(both) if all(both) else None
    return None


def sql_calls(code: str) -> list[str]:
    """Texts passed to ``spark.sql`` as the only positional argument.

    Nodes come level by level, so a name stands for the last assignment met on the way.
    """
    names: dict[str, str] = {}
    found = []
    for node in ast.walk(parse(code)):
        match node:
            case ast.Assign(targets=[ast.Name(id=name), *_], value=value):
                if text := text_of(value, names):
                    names[name] = text
            case ast.Call(func=ast.Attribute(attr="sql", value=ast.Name(id="spark")), args=[argument]):
                found.append(text_of(argument, names))
    return [text for text in found if text]


def check_python(code: str | None) -> tuple[str | None, list[str]]:
    """(error, statements): the error text of code that does not parse, else its SQL statements."""
    if not isinstance(code, str):
        return None, []
    try:
        return None, sql_calls(code)
    except SyntaxError as error:
        return f"Python syntax error: {error}", []
    except TypeError as error:
        return f"Type error during parsing: {error}", []
    except Exception as error:  # noqa: BLE001 - any failure becomes the row's message
        return f"Unexpected error: {error}", []


def cell_starts(code: str | None) -> list[int] | None:
    """1-based first lines of the cells of a script; cells run to the line before the next start.

    Statements on neighbouring lines form one cell. Between two cells, the blank lines right
    after the first belong to it and everything from the first comment on to the second.
    """
    if not isinstance(code, str) or not code.strip():
        return None
    try:
        return _starts(parse(code).body, LINE_END.split(code))
    except Exception:  # noqa: BLE001 - unreadable code is one cell
        return [1]


# The ends of lines as the parser counts them.
LINE_END = re.compile(r"\r\n|\r|\n")


def _starts(body: list[ast.stmt], lines: list[str]) -> list[int]:
    starts, last_end = [1], None
    for node in body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])
        if last_end is not None and first > last_end + 1:
            begin = last_end + 1
            while begin < first and not lines[begin - 1].strip():
                begin += 1
            starts.append(begin)
        last_end = max(last_end or 0, node.end_lineno)
    return starts
