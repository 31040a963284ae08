"""Escaping, in the JVM: chained replacements, the ampersand first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.render import ATTRIBUTE_ESCAPES, TEXT_ESCAPES


def _escaped(col: Column, table: dict[str, str]) -> Column:
    for raw, reference in table.items():
        col = F.replace(col, F.lit(raw), F.lit(reference))
    return col


def escape_text(col: Column | str) -> Column:
    return _escaped(F.col(col) if isinstance(col, str) else col, TEXT_ESCAPES)


def escape_attribute(col: Column | str) -> Column:
    return _escaped(F.col(col) if isinstance(col, str) else col, ATTRIBUTE_ESCAPES)
