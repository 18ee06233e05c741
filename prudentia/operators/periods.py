"""Latest and closest periods.

A period is a calendar month, so the set of distinct periods is bounded by the
calendar (a few hundred) whatever the size of the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_period(table: DataFrame) -> Column:
    """Newest period anywhere in ``table``, as a scalar subquery.

    On a table partitioned by period the comparison becomes a partition filter.
    """
    return table.select(F.max("ano_mes")).scalar()


def at_period(rows: DataFrame, ano_mes: int | None, of: DataFrame) -> DataFrame:
    """Rows of one period; None means the newest period of the table ``of``."""
    wanted = latest_period(of) if ano_mes is None else F.lit(ano_mes)
    return rows.where(F.col("ano_mes") == wanted)


#: Parts that rows are dealt into before their newest period is known.
PARTS = 64


def newest_rows(rows: DataFrame) -> DataFrame:
    """The rows of the newest period that ``rows`` have; none for no rows.

    ``rows`` are computed once. Every task passes on only what is newest in a part, so that
    few rows are shuffled, dealt evenly however many a key has. The newest period of all and
    the rows come from that one shuffle: the period is taken from whole rows, which makes
    both sides the same plan up to the exchange.
    """
    part = Window.partitionBy("newest_part").orderBy(F.desc("ano_mes"))
    kept = (
        rows.withColumn("newest_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)))
        .withColumn("newest_rank", F.rank().over(part))
        .where(F.col("newest_rank") == 1)
    )
    columns = ["ano_mes", *[c for c in rows.columns if c != "ano_mes"]]
    newest = kept.select(F.max(F.struct(*columns))["ano_mes"]).scalar()
    return kept.where(F.col("ano_mes") == newest).select(*rows.columns)


def distinct_periods(table: DataFrame) -> DataFrame:
    """Periods present, newest first."""
    return table.select("ano_mes").distinct().orderBy(F.desc("ano_mes"))


def with_closest_period(rows: DataFrame, among: DataFrame, out: str) -> DataFrame:
    """Add the newest period of ``among`` that is not after the row's period.

    The candidates travel as one array from a scalar subquery: no range join.
    """
    known = "known_periods"
    return (
        rows.withColumn(known, among.select(F.collect_set("ano_mes")).scalar())
        .withColumn(out, F.array_max(F.filter(known, lambda q: q <= F.col("ano_mes"))))
        .drop(known)
    )
