"""Top rows per group and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_period(
    rows: DataFrame, order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """Number the rows of each period and keep the first ``n``.

    Spark limits every map task to its own first ``n`` rows of a period before
    the shuffle, so even a period holding most rows sends few of them.
    """
    window = Window.partitionBy("ano_mes").orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


#: Parts that a period is dealt into before its rows are ranked.
BUCKETS = 64


def top_share_per_period(
    rows: DataFrame, value: str, order: Sequence[Column], n: int, share: str, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each period with their percentage of the period's total.

    One pass over ``rows``: each part of a period gives its total and its first ``n`` rows, and
    a period is then a step over those few. Its rows never meet in one task, and ``rows``
    is not evaluated a second time for the total.
    """
    part = Window.partitionBy("ano_mes", "share_part")
    period = Window.partitionBy("ano_mes")
    first = F.col("part_rank") == 1
    return (
        rows.withColumn("share_part", F.pmod(F.xxhash64(*rows.columns), F.lit(BUCKETS)))
        .withColumns({
            "part_total": F.sum(value).over(part),
            "part_rank": F.row_number().over(part.orderBy(*order)),
        })
        .where(F.col("part_rank") <= n)
        .withColumns({
            share: F.try_divide(
                F.col(value), F.sum(F.when(first, F.col("part_total"))).over(period)
            ) * 100,
            rank: F.row_number().over(period.orderBy(*order)),
        })
        .where(F.col(rank) <= n)
        .drop("share_part", "part_total", "part_rank")
    )


def share_of_period(rows: DataFrame, value: str, share: str) -> DataFrame:
    """Percentage of each row in its period's total.

    Totals are aggregated apart and joined back: a window over the period would
    bring all of its rows to one task. One total per calendar month is small
    enough to broadcast at any scale.
    """
    totals = rows.groupBy("ano_mes").agg(F.sum(value).alias("period_total"))
    return (
        rows.join(F.broadcast(totals), "ano_mes")
        .withColumn(share, F.try_divide(F.col(value), F.col("period_total")) * 100)
        .drop("period_total")
    )
