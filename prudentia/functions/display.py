"""Values as the text shown in reports.

``format_number`` rounds half to even on the exact binary value; ``printf``
style formatting in the JVM would round the decimal text half up instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/D"


def _number(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def amount_text(value: Column) -> Column:
    """Reais scaled to thousands, millions or billions: ``R$ 1.5 mi``."""
    size = F.abs(value)
    scaled = F.when(size >= 1e9, F.concat(_number(value / F.lit(1e9), "#,##0.0"), F.lit(" bi")))
    scaled = scaled.when(
        size >= 1e6, F.concat(_number(value / F.lit(1e6), "#,##0.0"), F.lit(" mi"))
    )
    scaled = scaled.when(
        size >= 1e3, F.concat(_number(value / F.lit(1e3), "#,##0.0"), F.lit(" mil"))
    )
    scaled = scaled.otherwise(_number(value, "#,##0"))
    return F.coalesce(F.concat(F.lit("R$ "), scaled), F.lit(MISSING))


def percent_text(fraction: Column) -> Column:
    """0.3601 to ``36.01%``."""
    return F.coalesce(F.concat(_number(fraction * 100, "#,##0.00"), F.lit("%")), F.lit(MISSING))


def cell_text(value: Column, is_percent: Column) -> Column:
    """Report cell: two decimals and a sign for fractions, else whole numbers."""
    percent = F.concat(_number(value * 100, "0.00"), F.lit("%"))
    text = F.when(is_percent, percent).otherwise(_number(value, "#,##0"))
    return F.coalesce(text, F.lit(""))


def change_text(value: Column) -> Column:
    """Signed change with one decimal: ``+3.2``."""
    return F.coalesce(_number(value, "+0.0;-0.0"), F.lit(""))


def ratio_text(value: Column, unit: Column) -> Column:
    """Ratio in its unit: ``1.5x``, ``+4.50 ppts`` or ``30.00%``."""
    text = (
        F.when(unit == "x", F.concat(_number(value, "0.0"), F.lit("x")))
        .when(unit == "ppts", F.concat(_number(value, "+0.00;-0.00"), F.lit(" ppts")))
        .otherwise(F.concat(_number(value, "0.00"), F.lit("%")))
    )
    return F.coalesce(text, F.lit(MISSING))


def code_text(code: Column, missing: str = "-") -> Column:
    """Group code as ``C0000123``."""
    return F.coalesce(
        F.when(code.isNotNull(), F.format_string("C%07d", code)), F.lit(missing)
    )
