"""Expressions as SQL text.

A Column costs several calls into the JVM to build. For hundreds of generated columns
that outweighs the job, while Spark parses their text in one call.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value: str | int | float | dt.date) -> str:
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def named(expression: str, column: str) -> str:
    return f"{expression} AS {name(column)}"


def total(terms: Sequence[str]) -> str:
    """The terms added in pairs: hundreds of them stay a shallow expression."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [
            f"({' + '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)
        ]
    return terms[0]


def struct(**fields: str) -> str:
    """A row of named expressions."""
    inside = ", ".join(f"{literal(field)}, {value}" for field, value in fields.items())
    return f"named_struct({inside})"
