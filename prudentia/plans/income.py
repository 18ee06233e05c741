"""Income statements from individual balances (accounts of groups 7 and 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudentia.constants import SUBTOTAL_GROSS, SUBTOTAL_OPERATING, SUBTOTAL_PRETAX
from prudentia.functions import text
from prudentia.operators.series import deaccumulate, recent_period_rank
from prudentia.sources.base import Filings

INDIVIDUAL = "4010"
GROUP = "cod_conglomerado"
COLUMNS = (GROUP, "ano_mes", "conta", "nome_conta", "saldo")


def _is_income(account: Column) -> Column:
    return account.startswith("7.") | account.startswith("8.")


def _is_level2(account: Column) -> Column:
    return account.like("_._.0.00.00-%") & ~account.like("_.0.0.00.00-%")


def _income(
    filings: Filings, cod_conglomerado: int | None, wanted: Column, spread_by: list[str]
) -> DataFrame:
    """Balances summed over a group's institutions, under each account's newest name.

    The name is part of the first grouping, which therefore hash-aggregates and
    combines in the map tasks. What is left is at most one row per account,
    period and spelling; only that is spread by ``spread_by`` for the later
    steps, which then need no further shuffle.
    """
    rows = filings.balances(INDIVIDUAL).where(wanted)
    members = filings.institution_mapping.select("cnpj8", GROUP)
    if cod_conglomerado is not None:
        members = members.where(F.col(GROUP) == cod_conglomerado)
    sums = (
        rows.select("cnpj8", "ano_mes", "nome_conta", "saldo",
                    text.account_stem(F.col("conta")).alias("conta"))
        .join(members, "cnpj8")
        .groupBy(GROUP, "ano_mes", "conta", "nome_conta")
        .agg(F.sum("saldo").alias("saldo"))
        .repartition(*spread_by)
        .groupBy(GROUP, "conta", "ano_mes")
        .agg(F.sum("saldo").alias("saldo"), F.max("nome_conta").alias("nome_conta"))
    )
    by_age = Window.partitionBy(GROUP, "conta").orderBy("ano_mes").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return sums.withColumn("nome_conta", F.last("nome_conta").over(by_age)).select(*COLUMNS)


def detailed_income(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Accumulated balance of every income account."""
    rows = _income(filings, cod_conglomerado, _is_income(F.col("conta")), [GROUP, "conta"])
    return rows if cod_conglomerado is None else rows.orderBy("ano_mes", "conta")


def level2_income(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Accumulated balance of the second-level income accounts.

    There are a few dozen of these per group and period, so one group's whole
    statement stays together.
    """
    account = F.col("conta")
    rows = _income(
        filings, cod_conglomerado, _is_income(account) & _is_level2(account), [GROUP]
    )
    return rows if cod_conglomerado is None else rows.orderBy("ano_mes", "conta")


def monthly_income(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Second-level income of each month alone."""
    rows = deaccumulate(level2_income(filings, cod_conglomerado), [GROUP, "conta"])
    return rows if cod_conglomerado is None else rows.orderBy("conta", "ano_mes")


def add_subtotals(income: DataFrame) -> DataFrame:
    """Add gross, operating and pre-tax results per group and period.

    Each row is sent to its own line and to the three subtotals (as zero where
    it does not count), then summed: one aggregation instead of a union that
    would compute the statement twice.
    """
    account, amount = F.col("conta"), F.col("saldo")
    is_gross = account.startswith("7.1") | account.startswith("8.1")
    is_operating = ~account.startswith("7.9")

    def part(label: tuple[str, str], counts: Column) -> Column:
        return F.struct(
            F.lit(label[0]).alias("conta"),
            F.lit(label[1]).alias("nome_conta"),
            F.when(counts, amount).otherwise(F.lit(0.0)).alias("saldo"),
        )

    own = F.struct(account.alias("conta"), F.col("nome_conta"), amount.alias("saldo"))
    parts = F.array(
        own,
        part(SUBTOTAL_GROSS, is_gross),
        part(SUBTOTAL_OPERATING, is_operating),
        part(SUBTOTAL_PRETAX, F.lit(True)),
    )
    return (
        income.select(GROUP, "ano_mes", F.inline(parts))
        .groupBy(GROUP, "ano_mes", "conta", "nome_conta")
        .agg(F.sum("saldo").alias("saldo"))
        .withColumn("ordering", text.income_order(F.col("conta")))
    )


def income_with_subtotals(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Monthly second-level income with its three subtotals, in display order."""
    rows = add_subtotals(monthly_income(filings, cod_conglomerado))
    return rows if cod_conglomerado is None else rows.orderBy("ano_mes", "ordering", "conta")


def recent_income(
    filings: Filings, cod_conglomerado: int | None = None, months: int = 13
) -> DataFrame:
    """The last ``months`` filed periods, each row numbered from the newest."""
    ranked = recent_period_rank(
        income_with_subtotals(filings, cod_conglomerado), [GROUP], "recencia"
    )
    return ranked.where(F.col("recencia") <= months)


def trailing_income(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Sum of each line over the last twelve filed periods.

    A line seen only in the thirteenth period, or before, still appears, with 0.
    """
    ranked = recent_period_rank(
        income_with_subtotals(filings, cod_conglomerado), [GROUP], "recencia"
    )
    sums = ranked.groupBy(GROUP, "conta", "nome_conta", "ordering").agg(
        F.coalesce(
            F.sum(F.when(F.col("recencia") <= 12, F.col("saldo"))), F.lit(0.0)
        ).alias("acum_12m")
    )
    return sums if cod_conglomerado is None else sums.orderBy("ordering", "conta")
