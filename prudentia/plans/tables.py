"""Report tables: lines by period, accounts by period and year grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.functions import periods, text
from prudentia.functions.display import cell_text, change_text
from prudentia.operators.pivot import first_by_order, folded, only, pivot
from prudentia.operators.series import (
    change_on_previous_period,
    change_on_previous_year,
    recent_period_rank,
)
from prudentia.plans.income import GROUP, detailed_income, income_with_subtotals
from prudentia.plans.report_lines import LINES_OF_REPORT, first_per_period
from prudentia.sources.base import Filings

QUARTER_COLUMNS = ("q3", "q6", "q9", "q12")
QUARTERS = (3, 6, 9, 12)
COMPARISONS = ("abs", "yoy", "qoq")


def report_table(
    filings: Filings, relatorio: str, periods_shown: list[int] | None = None,
    cod_conglomerado: int | None = None,
) -> DataFrame:
    """Lines of a report by period, first value in filing order.

    A column for each of ``periods_shown``, or all periods filed as one array (``folded``).
    """
    lines = LINES_OF_REPORT[relatorio](filings, cod_conglomerado)
    keys = ["cod_conglomerado", "nome_linha"]
    if periods_shown is None:
        return folded(lines, keys, "ano_mes", "valor_a", order="ordenacao")
    return pivot(lines, keys, "ano_mes", periods_shown, first_by_order("valor_a"), "p")


def report_cells(
    filings: Filings, relatorio: str, cod_conglomerado: int | None = None
) -> DataFrame:
    """Cells of the report table as displayed text."""
    lines = first_per_period(LINES_OF_REPORT[relatorio](filings, cod_conglomerado))
    return lines.select(
        "cod_conglomerado", "nome_linha", "ano_mes",
        cell_text(F.col("valor_a"), text.is_percent_line(F.col("nome_linha"))).alias("texto"),
    )


def detailed_income_table(
    filings: Filings, periods_shown: list[int] | None = None, cod_conglomerado: int | None = None
) -> DataFrame:
    """All income accounts by period: a column for each of ``periods_shown``, or all as one array."""
    rows = detailed_income(filings, cod_conglomerado)
    keys = [GROUP, "conta", "nome_conta"]
    table = (
        folded(rows, keys, "ano_mes", "saldo") if periods_shown is None
        else pivot(rows, keys, "ano_mes", periods_shown, only("saldo"), "p")
    )
    label = F.concat_ws(" - ", "conta", "nome_conta").alias("indicador")
    shown = table.select(GROUP, label, *[c for c in table.columns if c not in keys])
    return shown if cod_conglomerado is None else shown.orderBy("indicador")


def income_table(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Second-level income with subtotals: the last 13 periods and a 12-period sum.

    Columns run from ``m1`` (each group's newest period) to ``m13``, because
    groups end in different periods; ``ultimo`` names the newest. Every line of
    the statement keeps its row, also one not seen in those periods.
    """
    ranked = recent_period_rank(
        income_with_subtotals(filings, cod_conglomerado), [GROUP], "recencia"
    )
    months = [F.expr(f"max(if(recencia = {i}, saldo, null)) as m{i}") for i in range(1, 14)]
    trailing = F.expr("sum(if(recencia <= 12, saldo, null))")
    is_subtotal = F.col("conta").startswith("RESULTADO")
    label = F.when(is_subtotal, F.col("nome_conta")).otherwise(
        F.concat_ws(" - ", "conta", "nome_conta")
    )
    table = (
        ranked.groupBy(GROUP, "conta", "nome_conta", "ordering")
        .agg(*months, F.coalesce(trailing, F.lit(0.0)).alias("acum_12m"))
        .select(
            GROUP, "ordering", label.alias("indicador"),
            *[f"m{i}" for i in range(1, 14)], "acum_12m",
        )
    )
    return table if cod_conglomerado is None else table.orderBy("ordering", "indicador")


def _year_grid(series: DataFrame, value: str) -> DataFrame:
    """Years by quarter end; a year has a row when it has any period."""
    period = F.col("ano_mes")
    dated = series.withColumns({"ano": periods.year(period), "mes": periods.month(period)})
    return pivot(
        dated, ["cod_conglomerado", "nome_linha", "ano"], "mes", QUARTERS, only(value), "q"
    )


def year_quarter_table(
    filings: Filings,
    relatorio: str,
    comparison: str = "abs",
    line: str | None = None,
    cod_conglomerado: int | None = None,
) -> DataFrame:
    """Lines by year and quarter: values, year-on-year or quarter-on-quarter.

    Fractions are shown as percentages in the value form only. Quarters absent
    from the filings are NULL columns of the grid.
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"comparison must be one of {COMPARISONS}, not {comparison!r}")
    lines = LINES_OF_REPORT[relatorio](filings, cod_conglomerado)
    if line is not None:
        lines = lines.where(F.col("nome_linha") == line)
    keys = ["cod_conglomerado", "nome_linha"]
    series = first_per_period(lines)
    if comparison == "abs":
        factor = F.when(text.is_percent_line(F.col("nome_linha")), 100.0).otherwise(1.0)
        grid = _year_grid(series.withColumn("valor_a", F.col("valor_a") * factor), "valor_a")
    elif comparison == "qoq":
        changes = change_on_previous_period(series, keys, "valor_a", "variacao")
        grid = _year_grid(changes, "variacao")
    else:
        grid = change_on_previous_year(_year_grid(series, "valor_a"), keys, QUARTER_COLUMNS)
    return grid if cod_conglomerado is None else grid.orderBy("nome_linha", "ano")


def quarter_changes(
    filings: Filings, relatorio: str, cod_conglomerado: int | None = None
) -> DataFrame:
    """Each line against the previous period filed, in percent and as text."""
    series = first_per_period(LINES_OF_REPORT[relatorio](filings, cod_conglomerado))
    keys = ["cod_conglomerado", "nome_linha"]
    return change_on_previous_period(series, keys, "valor_a", "qoq_pct").withColumn(
        "texto", change_text(F.col("qoq_pct"))
    )
