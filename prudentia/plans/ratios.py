"""Financial ratios from report lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.constants import CAPITAL, INCOME, SUMMARY
from prudentia.functions import periods
from prudentia.functions.display import ratio_text
from prudentia.operators.lines import line_like_sql
from prudentia.operators.pivot import CELLS, only, pivot
from prudentia.sources.base import Filings

# Input name: (report, LIKE pattern of the line, LIKE pattern to leave out).
# The patterns are fixed values: they match line names with and without accents.
INPUTS: dict[str, tuple[str, str, str | None]] = {
    "lucro": (SUMMARY, "%ucro L%", None),
    "pl": (SUMMARY, "%atrim%nio L%", "%efer%"),
    "ativo": (SUMMARY, "Ativo Total", None),
    "carteira": (SUMMARY, "%arteira de Cr%", "%lass%"),
    "captacoes": (SUMMARY, "%apta%", None),
    "tvm": (SUMMARY, "%tulos e Valores%", None),
    "passivo": (SUMMARY, "%assivo Exig%", "%irculante%"),
    "pr": (SUMMARY, "%efer%ncia para Compara%", None),
    "basileia_linha": (CAPITAL, "%asileia%", None),
    "principal_linha": (CAPITAL, "%ndice de Capital Principal", None),
    "nivel1_linha": (CAPITAL, "%apital N%vel I", None),
    "razao_linha": (CAPITAL, "%az%o de Alavancagem%", None),
    "antes_trib": (INCOME, "%esultado antes%", None),
    "ir": (INCOME, "%mposto de Renda%", None),
}


YEARLY_PROFIT = f"lucro * {periods.ANNUALISATION_SQL}"


def _share(top: str, bottom: str) -> str:
    """Percentage; NULL for a zero or missing divisor."""
    return f"try_divide({top}, {bottom}) * 100"


@dataclass(frozen=True)
class Ratio:
    """A named formula over the inputs, as SQL text."""

    name: str
    label: str
    unit: str
    group: str
    inputs: tuple[str, ...]
    formula: str

    @property
    def report(self) -> str:
        return INPUTS[self.inputs[0]][0]

    @property
    def column(self) -> Column:
        return F.expr(f"{self.formula} as {self.name}")


CATALOGUE = (
    Ratio("roe", "ROE", "%", "Rentabilidade", ("lucro", "pl"), _share(YEARLY_PROFIT, "pl")),
    Ratio("roa", "ROA", "%", "Rentabilidade", ("lucro", "ativo"),
          _share(YEARLY_PROFIT, "ativo")),
    Ratio("loan_to_deposit", "Loan-to-Deposit", "%", "Estrutura", ("carteira", "captacoes"),
          _share("carteira", "captacoes")),
    Ratio("credit_intensity", "Credit Intensity", "%", "Estrutura", ("carteira", "ativo"),
          _share("carteira", "ativo")),
    Ratio("securities_share", "Securities Share", "%", "Estrutura", ("tvm", "ativo"),
          _share("tvm", "ativo")),
    Ratio("leverage", "Alavancagem", "x", "Estrutura", ("ativo", "pl"),
          "try_divide(ativo, pl)"),
    Ratio("debt_equity", "Debt/Equity", "x", "Estrutura", ("passivo", "pl"),
          "try_divide(passivo, pl)"),
    Ratio("funding_dependency", "Funding Dependency", "%", "Estrutura", ("captacoes", "ativo"),
          _share("captacoes", "ativo")),
    Ratio("pr_coverage", "PR / Ativo", "%", "Capital", ("pr", "ativo"), _share("pr", "ativo")),
    Ratio("basileia", "Basileia", "%", "Capital", ("basileia_linha",), "basileia_linha * 100"),
    Ratio("capital_principal", "Capital Principal (CET1)", "%", "Capital", ("principal_linha",),
          "principal_linha * 100"),
    Ratio("capital_nivel1", "Capital Nível I", "%", "Capital", ("nivel1_linha",),
          "nivel1_linha * 100"),
    Ratio("capital_excess", "Capital Excess", "ppts", "Capital", ("basileia_linha",),
          "(basileia_linha - 0.105D) * 100"),
    Ratio("razao_alavancagem", "Razão de Alavancagem", "%", "Capital", ("razao_linha",),
          "razao_linha * 100"),
    Ratio("tax_rate", "Taxa Efetiva IR", "%", "DRE", ("ir", "antes_trib"),
          _share("ir", "antes_trib")),
)
RATIOS = {ratio.name: ratio for ratio in CATALOGUE}
HEADLINE_RATIOS = (
    "roe", "roa", "loan_to_deposit", "basileia", "capital_principal", "leverage",
)


def input_aggregates(names: tuple[str, ...]) -> list[Column]:
    """Largest matching line per input, to be used inside one aggregation."""
    cells = []
    for name in names:
        report, include, exclude = INPUTS[name]
        test = f"relatorio = '{report}' and {line_like_sql(include, exclude)}"
        cells.append(F.expr(f"max(if({test}, valor_a, null)) as {name}"))
    return cells


def financial_ratios(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Fifteen ratios per entity and period.

    One pass over the lines and one shuffle: an entity-period appears when any
    of the three reports has a line for it, as joining three aggregates would.
    """
    lines = filings.report_lines(SUMMARY, INCOME, CAPITAL)
    if cod_conglomerado is not None:
        lines = lines.where(F.col("cod_conglomerado") == cod_conglomerado)
    inputs = lines.groupBy("cod_conglomerado", "ano_mes").agg(*input_aggregates(tuple(INPUTS)))
    ratios = inputs.select(
        "cod_conglomerado", "ano_mes",
        *[ratio.column for ratio in CATALOGUE],
    )
    return ratios if cod_conglomerado is None else ratios.orderBy("ano_mes")


def latest_ratios(
    filings: Filings, cod_conglomerado: int | None = None,
    names: tuple[str, ...] = HEADLINE_RATIOS,
) -> DataFrame:
    """Headline ratios of each entity's newest period."""
    ratios = financial_ratios(filings, cod_conglomerado)
    return ratios.groupBy("cod_conglomerado").agg(
        F.max("ano_mes").alias("ano_mes"), *[F.max_by(n, "ano_mes").alias(n) for n in names]
    )


def ratio_series(filings: Filings, name: str, cod_conglomerado: int | None = None) -> DataFrame:
    """One ratio over time without its missing points."""
    series = financial_ratios(filings, cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", F.col(name).alias("valor")
    ).na.drop(subset=["valor"])
    return series if cod_conglomerado is None else series.orderBy("ano_mes")


def _long_ratios(filings: Filings, cod_conglomerado: int | None) -> DataFrame:
    """Ratios as rows, with label, unit and group beside each value."""
    entries = ", ".join(
        f"struct({position} as posicao, '{r.group}' as grupo, "
        f"'{r.label} ({r.unit})' as indicador, '{r.unit}' as unidade, {r.name} as valor)"
        for position, r in enumerate(CATALOGUE, start=1)
    )
    ratios = financial_ratios(filings, cod_conglomerado)
    return ratios.selectExpr("cod_conglomerado", "ano_mes", f"inline(array({entries}))")


def _folded_ratios(filings: Filings, cod_conglomerado: int | None) -> DataFrame:
    """The ratio table with its cells as one array: an entity's periods are gathered once
    and then expanded to its ratios, instead of shuffling a row for each ratio and period."""
    names = [ratio.name for ratio in CATALOGUE]
    history = financial_ratios(filings, cod_conglomerado).groupBy("cod_conglomerado").agg(
        F.array_sort(F.collect_list(F.struct("ano_mes", *names))).alias("history")
    )
    entries = ", ".join(
        f"struct({position} as posicao, '{r.group}' as grupo, '{r.label} ({r.unit})' as indicador, "
        f"transform(history, p -> struct(p.ano_mes as ano_mes, p.{r.name} as valor)) as {CELLS})"
        for position, r in enumerate(CATALOGUE, start=1)
    )
    return history.selectExpr("cod_conglomerado", f"inline(array({entries}))")


def ratio_table(
    filings: Filings, periods_shown: list[int] | None = None, cod_conglomerado: int | None = None
) -> DataFrame:
    """Ratios by period, one row per entity and ratio.

    A column for each of ``periods_shown``, or all periods that the entity filed as one array.
    """
    table = (
        _folded_ratios(filings, cod_conglomerado) if periods_shown is None
        else pivot(
            _long_ratios(filings, cod_conglomerado),
            ["cod_conglomerado", "posicao", "grupo", "indicador"], "ano_mes", periods_shown,
            only("valor"), "p",
        )
    )
    return table if cod_conglomerado is None else table.orderBy("posicao")


def ratio_texts(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Every ratio as displayed text with its period heading."""
    return _long_ratios(filings, cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", "grupo", "indicador",
        periods.quarter_heading(F.col("ano_mes")).alias("periodo"),
        ratio_text(F.col("valor"), F.col("unidade")).alias("texto"),
    )
