"""Period-over-period arithmetic on time series.

Every window here is partitioned by one series whose rows were aggregated to
one per period before, so a partition never exceeds the number of periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudentia.functions import periods


def change_percent(now: Column, before: Column) -> Column:
    """Change in percent of the earlier size; NULL where that is 0 or missing."""
    return F.try_divide(now - before, F.abs(before)) * 100


def deaccumulate(rows: DataFrame, keys: Sequence[str], value: str = "saldo") -> DataFrame:
    """Turn balances that add up within a fiscal semester into monthly amounts.

    The previous balance is the last one filed in the same semester; a month
    that was not filed is not made up.
    """
    window = Window.partitionBy(*keys, periods.semester(F.col("ano_mes"))).orderBy("ano_mes")
    before = F.coalesce(F.lag(value).over(window), F.lit(0.0))
    return rows.withColumn(value, F.col(value) - before)


def change_on_previous_period(
    rows: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Change against the previous period present in the series."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("ano_mes"))
    return rows.withColumn(out, change_percent(F.col(value), before))


def change_on_previous_year(
    grid: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Change of each column of a year grid against the previous year present.

    Working on the grid keeps absent quarters as NULL cells, which a plain lag
    over the filed periods would skip.
    """
    window = Window.partitionBy(*keys).orderBy("ano")
    changed = {c: change_percent(F.col(c), F.lag(c).over(window)) for c in columns}
    return grid.withColumns(changed)


def recent_period_rank(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """1 for the newest period of each key, 2 for the one before, and so on."""
    window = Window.partitionBy(*keys).orderBy(F.desc("ano_mes"))
    return rows.withColumn(out, F.dense_rank().over(window))
