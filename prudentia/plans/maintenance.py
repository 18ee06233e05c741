"""Queries behind loading: what is missing, what breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.operators.accounts import digit_repair_map, repair_accounts
from prudentia.sources.base import Filings


def pending(wanted: DataFrame, fetch_log: DataFrame, force: bool = False) -> DataFrame:
    """Wanted (period, report) pairs not loaded yet; ``force`` keeps them all."""
    if force:
        return wanted
    return wanted.join(fetch_log, ["ano_mes", "relatorio"], "left_anti")


def repaired_balances(filings: Filings) -> DataFrame:
    """All balances with zero check digits repaired."""
    balances = filings.balances()
    return repair_accounts(balances, digit_repair_map(filings.spark, balances))


def stored_row_counts(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows per partition; on partition columns this reads file footers only."""
    return table.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("row_count"))
