"""Key and not-null rules, checked as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.schemas import TableSpec


def key_violations(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def null_counts(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: number of NULLs in each required column."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])


def is_valid(required: Sequence[str]) -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in required), F.lit(True))


def split_valid(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and rows for quarantine."""
    good = is_valid(required)
    return rows.where(good), rows.where(~good)


class Incomplete(ValueError):
    """Some ``periods`` were left out of a load; ``rows`` were stored all the same."""

    def __init__(self, message: str, rows: int = 0, periods: Iterable[int] | None = None) -> None:
        super().__init__(message)
        self.rows = rows
        self.periods = None if periods is None else tuple(sorted(periods))


class KeyViolation(Incomplete):
    """A table would get the same key twice."""


def require_unique(rows: DataFrame, spec: TableSpec) -> None:
    """Raise with up to five examples when the key of ``spec`` repeats."""
    if not spec.key:
        return
    examples = key_violations(rows, spec.key).limit(5).collect()
    if examples:
        raise KeyViolation(f"{spec.name}: key {spec.key} repeats, e.g. {examples}")
