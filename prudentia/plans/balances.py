"""Account balances over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.constants import EQUITY, EXPENSES, REVENUE, TOTAL_ASSETS
from prudentia.functions import periods
from prudentia.sources.base import Filings


def account_trend(
    filings: Filings, conta: str | None = None, cnpj8: str | None = None
) -> DataFrame:
    """Summed balance of each account, institution and period."""
    rows = filings.balances()
    if conta is not None:
        rows = rows.where(F.col("conta") == conta)
    if cnpj8 is not None:
        rows = rows.where(F.col("cnpj8") == cnpj8)
    trend = rows.groupBy("cnpj8", "conta", "ano_mes").agg(F.sum("saldo").alias("valor"))
    return trend if cnpj8 is None else trend.orderBy("ano_mes")


def balance_ratios(filings: Filings, cnpj8: str | None = None) -> DataFrame:
    """Returns and leverage from balances, as fractions.

    The result is revenue plus (negative) expenses, brought to twelve months.
    """
    account = F.col("conta")
    rows = filings.balances().where(account.isin(EQUITY, TOTAL_ASSETS, REVENUE, EXPENSES))
    if cnpj8 is not None:
        rows = rows.where(F.col("cnpj8") == cnpj8)
    sums = rows.groupBy("cnpj8", "ano_mes").agg(
        F.sum(F.when(account == EQUITY, F.col("saldo"))).alias("patrimonio_liquido"),
        F.sum(F.when(account == TOTAL_ASSETS, F.col("saldo"))).alias("ativo_total"),
        F.sum(F.when(account.isin(REVENUE, EXPENSES), F.col("saldo"))).alias("resultado_liquido"),
    )
    yearly = F.col("resultado_liquido") * periods.annualisation_factor(F.col("ano_mes"))
    ratios = sums.withColumns(
        {
            "roe": F.try_divide(yearly, F.col("patrimonio_liquido")),
            "roa": F.try_divide(yearly, F.col("ativo_total")),
            "alavancagem": F.try_divide(F.col("ativo_total"), F.col("patrimonio_liquido")),
        }
    )
    return ratios if cnpj8 is None else ratios.orderBy("ano_mes")
