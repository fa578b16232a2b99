"""Small helpers shared by the column functions."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII blanks plus the Unicode ones that also count as white space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"


def ship(module: str) -> None:
    """Send a module's Python functions with the job, so executors need no install of it."""
    register_pickle_by_value(sys.modules[module])


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.btrim(col(value), F.lit(BLANKS))


def _sql_literal(value: str | int | bool) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a fixed table, null when absent.

    The table is one literal expression, so a plan costs the same to build
    whatever the number of entries.
    """
    entries = ", ".join(f"{_sql_literal(k)}, {_sql_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def blank(value: Column | str) -> Column:
    """Null, empty or white space only."""
    text = col(value).cast("string")
    return text.isNull() | (strip(text) == "")


def squeeze(value: Column) -> Column:
    """Collapse runs of white space, then trim."""
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))
