"""Column names and text that may hold dots, quotes or back quotes, as CSV headers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """Text for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    """The top-level column of this very name."""
    return F.col(quoted(name))
