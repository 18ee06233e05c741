"""Arithmetic on periods written as AAAAMM integers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import MONTH_NAMES


def year(period: Column) -> Column:
    return F.floor(period / F.lit(100.0)).cast("int")


def month(period: Column) -> Column:
    return period % 100


def months_into_semester(period: Column) -> Column:
    """1 for January and July up to 6 for June and December."""
    return (month(period) - 1) % 6 + 1


def annualisation_factor(period: Column) -> Column:
    """12 / months elapsed in the fiscal semester, as a double.

    The literal must be a double: a decimal literal would give a decimal(8,6).
    """
    return F.try_divide(F.lit(12.0), months_into_semester(period))


# The same factor of a column named ano_mes, for formulas written as SQL text.
ANNUALISATION_SQL = "try_divide(12.0D, (ano_mes % 100 - 1) % 6 + 1)"


def semester(period: Column) -> Column:
    """Running number of the fiscal semester a period belongs to."""
    return year(period) * 2 + (month(period) >= 7).cast("int")


def _quarter_name(period: Column) -> Column:
    is_quarter_end = month(period).isin(3, 6, 9, 12)
    quarter = F.concat(F.lit("Q"), F.floor(month(period) / F.lit(3.0)))
    return F.when(is_quarter_end, quarter).otherwise(F.concat(F.lit("M"), month(period)))


def quarter_label(period: Column) -> Column:
    """``2024 Q3``; months that end no quarter read ``2024 M2``."""
    return F.concat_ws(" ", year(period), _quarter_name(period))


def quarter_heading(period: Column) -> Column:
    """``Q3/2024``."""
    return F.concat_ws("/", _quarter_name(period), year(period))


def month_label(period: Column) -> Column:
    """``Mar/24``."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat_ws(
        "/",
        F.try_element_at(names, month(period).cast("int")),
        F.right(year(period).cast("string"), F.lit(2)),
    )


def _count_back(
    spark: SparkSession, newest: int, step: int, n: int
) -> DataFrame:
    """``n`` periods, newest first; ``newest`` counts months since year 0."""
    ordinal = F.lit(newest) - F.col("id") * step - 1
    return spark.range(n).select(
        (F.floor(ordinal / F.lit(12.0)) * 100 + ordinal % 12 + 1).cast("int").alias("ano_mes")
    ).orderBy(F.desc("ano_mes"))


def monthly_periods(
    spark: SparkSession, n: int, today: date | None = None, lag_days: int = 60
) -> DataFrame:
    """Last ``n`` months published by ``today``, newest first.

    Consolidated balances appear after about 60 days, individual ones after 180.
    """
    seen = (today or date.today()) - timedelta(days=lag_days)
    return _count_back(spark, seen.year * 12 + seen.month, 1, n)


def quarterly_periods(
    spark: SparkSession, n: int, today: date | None = None, lag_days: int = 75
) -> DataFrame:
    """Last ``n`` quarter ends published by ``today``, newest first."""
    seen = (today or date.today()) - timedelta(days=lag_days)
    ordinal = seen.year * 12 + seen.month
    return _count_back(spark, ordinal - ordinal % 3, 3, n)
