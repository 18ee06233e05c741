"""Selecting report lines by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.constants import PEER_GROUPS
from prudentia.functions.text import like_sql


def line_like_sql(include: str, exclude: str | None = None) -> str:
    """Line name matching one LIKE pattern and not another, as SQL text."""
    test = like_sql("nome_linha", include)
    return f"{test} and nome_linha not like '{exclude}'" if exclude else test


def line_like(include: str, exclude: str | None = None) -> Column:
    return F.expr(line_like_sql(include, exclude))


def line_regex(include: str, exclude: str | None = None) -> Column:
    """Line name found by one regex and not by another; use ``(?iu)`` for
    case-insensitive accents."""
    name = F.col("nome_linha")
    test = name.rlike(include)
    return test & ~name.rlike(exclude) if exclude else test


def max_where(condition: Column, value: str = "valor_a") -> Column:
    return F.max(F.when(condition, F.col(value)))


def in_peer_group(rows: DataFrame, group: str) -> DataFrame:
    """Rows of one peer group; ``ALL`` and unknown groups keep everything."""
    codes: Sequence[int] = PEER_GROUPS.get(group, ())
    return rows.where(F.col("cod_conglomerado").isin(*codes)) if codes else rows
