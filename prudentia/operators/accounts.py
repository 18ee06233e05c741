"""Repair of accounts whose check digit was filed as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import CREDIT, DEPOSITS, EQUITY, EXPENSES, REVENUE, TOTAL_ASSETS
from prudentia.functions import text

FALLBACK_ACCOUNTS = (EQUITY, TOTAL_ASSETS, REVENUE, EXPENSES, CREDIT, DEPOSITS)


def has_zero_digit(account: Column) -> Column:
    return account.endswith("-0")


def digit_repair_map(spark: SparkSession, balances: DataFrame) -> DataFrame:
    """Zero-digit account to account, learned from the balances.

    Accounts seen with a real digit win; six known accounts fill the gaps. Two
    digits for one account resolve to the larger one.
    """
    seen = (
        balances.where(~has_zero_digit(F.col("conta")))
        .select("conta").distinct()
        .groupBy(text.zero_digit_account(F.col("conta")).alias("zero_conta"))
        .agg(F.max("conta").alias("standard_conta"))
    )
    fallback = spark.createDataFrame(
        [(account,) for account in FALLBACK_ACCOUNTS], "standard_conta string"
    ).select(
        text.zero_digit_account(F.col("standard_conta")).alias("zero_conta"), "standard_conta"
    )
    missing = fallback.join(seen, "zero_conta", "left_anti")
    return seen.unionByName(missing)


def repair_accounts(balances: DataFrame, repair_map: DataFrame) -> DataFrame:
    """Replace zero-digit accounts found in the map; leave the rest unchanged.

    A lazy left join: the map has one row per account, and whether it is
    broadcast or the balances are shuffled, hot accounts split at run time, is
    left to Spark.
    """
    return (
        balances.join(repair_map, F.col("conta") == F.col("zero_conta"), "left")
        .withColumn("conta", F.coalesce("standard_conta", "conta"))
        .select(*balances.columns)
    )
