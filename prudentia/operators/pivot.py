"""Long to wide: one column for each known value, or all cells of a row as one array.

Columns are SQL text: a table of a hundred columns is then a hundred short
strings parsed by the JVM instead of several hundred calls into it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cell = Callable[[str], str]  # condition to aggregate

CELLS = "celulas"


def first_by_order(value: str, order: str = "ordenacao") -> Cell:
    """First value in filing order; both buffers are numbers, so hash-aggregated."""
    return lambda keep: f"min_by({value}, if({keep}, {order}, null))"


def only(value: str) -> Cell:
    """The single value of a cell, for rows unique per key and column."""
    return lambda keep: f"max(if({keep}, {value}, null))"


def pivot(
    rows: DataFrame, keys: Sequence[str], on: str, values: Sequence[int], cell: Cell, prefix: str
) -> DataFrame:
    """One row per ``keys``, one column per entry of ``values``.

    Conditional aggregates need a single shuffle on ``keys``; the built-in
    pivot first groups by ``keys`` and ``on`` and shuffles twice.
    """
    cells = [F.expr(f"{cell(f'{on} = {v}')} as {prefix}{v}") for v in values]
    return rows.groupBy(*keys).agg(*cells) if cells else rows.select(*keys).distinct()


def folded(
    rows: DataFrame, keys: Sequence[str], on: str, value: str, order: str | None = None
) -> DataFrame:
    """One row per ``keys`` with all of its cells in ``celulas``, by ``on``.

    The schema does not depend on the data, so nothing is looked up while the query is
    built. A cell holds ``on`` and ``valor``: the only value, or the first by ``order``.
    Cells are reduced to one per key and calendar column before they are collected, so an
    array is bounded by the calendar however many rows a key has; rows without ``on``
    give no cell.
    """
    found = F.max(value) if order is None else F.min_by(value, order)
    single = rows.groupBy(*keys, on).agg(found.alias("valor"))
    cell = F.when(F.col(on).isNotNull(), F.struct(on, "valor"))
    return single.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias(CELLS))


def cell_at(on: str, value: int) -> Column:
    """The value of one cell of a folded row, NULL where there is none."""
    matching = F.filter(CELLS, lambda cell: cell[on] == value)
    return F.get(matching, F.lit(0))["valor"]


def unfolded(table: DataFrame) -> DataFrame:
    """The cells of a folded table as rows, numbered from 1 in ``ordem``."""
    keys = [c for c in table.columns if c != CELLS]
    return table.select(*keys, F.posexplode(CELLS).alias("ordem", "cell")).select(
        *keys, (F.col("ordem") + 1).alias("ordem"), "cell.*"
    )
