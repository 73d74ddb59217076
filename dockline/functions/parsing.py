"""Reason-coded parsing of dirty text columns.

Every parsed value comes with a reason: ``parsed``, ``structural`` (the value
never existed), ``missing``, ``cross_reference`` (it lives on another row) or
``unparseable``. Structural absence is never imputed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal texts found in date and number columns and their meaning.
DATE_STRUCTURAL = ("Pre-PQ Process", "N/A - From RDC")
DATE_MISSING = ("Date Not Captured",)
NUMBER_STRUCTURAL = (
    "Freight Included in Commodity Cost",
    "Invoiced Separately",
    "Weight Captured Separately",
)
CROSS_REFERENCE = r"(?i)^See\s+\S+"
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
REASONS = ("parsed", "structural", "missing", "cross_reference", "unparseable")

MONTH_FIRST = "M/d/yy"
DAY_FIRST = "d-MMM-yy"


def parsed_date(text: Column, pattern: str) -> Column:
    """Date in one pinned two-digit-year pattern; null where the text is not one.

    Two-digit years pivot at 69, so 69-99 belong to the last century.
    """
    day = F.try_to_date(F.trim(text), pattern)
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def date_reason(text: Column, day: Column) -> Column:
    clean = F.trim(text)
    return (
        F.when(text.isNull(), "missing")
        .when(day.isNotNull(), "parsed")
        .when(clean.isin(*DATE_STRUCTURAL), "structural")
        .when(clean.isin(*DATE_MISSING), "missing")
        .otherwise("unparseable")
    )


def parsed_number(text: Column) -> Column:
    """Double from text that may carry thousands commas and dollar signs.

    The shape guard keeps texts such as ``5d``, ``nan`` or ``Infinity``, which a
    plain cast would accept, out of the numbers.
    """
    clean = F.regexp_replace(F.trim(text), "[,$]", "")
    return F.when(clean.rlike(NUMBER_SHAPE), clean.try_cast("double"))


def number_reason(text: Column, value: Column) -> Column:
    clean = F.trim(text)
    return (
        F.when(text.isNull(), "missing")
        .when(value.isNotNull(), "parsed")
        .when(clean.isin(*NUMBER_STRUCTURAL), "structural")
        .when(clean.rlike(CROSS_REFERENCE), "cross_reference")
        .otherwise("missing")
    )
