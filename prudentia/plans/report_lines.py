"""Queries over the quarterly report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.constants import CAPITAL, INCOME, INCOME_RENAMES, LINE_ASSETS, SUMMARY
from prudentia.operators.lines import line_regex
from prudentia.operators.periods import distinct_periods, newest_rows
from prudentia.schemas import REPORT_VALUES
from prudentia.sources.base import Filings

ORDER = ("ano_mes", "ordenacao")


def _for_entity(lines: DataFrame, cod_conglomerado: int | None) -> DataFrame:
    if cod_conglomerado is None:
        return lines
    return lines.where(F.col("cod_conglomerado") == cod_conglomerado).orderBy(*ORDER)


def institution_lines(
    filings: Filings, cod_conglomerado: int | None = None, relatorio: str | None = None
) -> DataFrame:
    """All lines over time, of one entity or of all."""
    lines = filings.report_lines(relatorio) if relatorio else filings.report_lines()
    return _for_entity(lines, cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", "relatorio", "nome_linha", "nome_coluna",
        "valor_a", "ordenacao",
    )


def capital_lines(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Capital lines over time."""
    return _for_entity(filings.report_lines(CAPITAL), cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", "nome_linha", "valor_a", "ordenacao"
    )


def summary_lines(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Summary lines over time."""
    return _for_entity(filings.report_lines(SUMMARY), cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", "nome_linha", "valor_a", "ordenacao"
    )


def _income_name() -> Column:
    """Today's name of an income line."""
    name = F.col("nome_linha")
    renamed = name
    for old, new in INCOME_RENAMES.items():
        renamed = F.when(name == old, new).otherwise(renamed)
    return renamed


def income_lines(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Income lines under today's names, without the repeated total assets."""
    lines = filings.report_lines(INCOME).where(F.col("nome_linha") != LINE_ASSETS)
    return _for_entity(lines, cod_conglomerado).select(
        "cod_conglomerado", "ano_mes", _income_name().alias("nome_linha"), "valor_a", "ordenacao"
    )


# The three report queries by report code, as pivots address them.
LINES_OF_REPORT = {CAPITAL: capital_lines, SUMMARY: summary_lines, INCOME: income_lines}


def _compared(
    filings: Filings, codes: Sequence[int] | None, line: str, relatorio: str
) -> DataFrame:
    columns = ("ano_mes", "cod_conglomerado", "nome_conglomerado", "valor_a")
    if codes is not None and not codes:
        fields = [REPORT_VALUES.schema[c] for c in columns]
        return filings.spark.createDataFrame([], schema=type(REPORT_VALUES.schema)(fields))
    rows = filings.report_lines(relatorio).where(F.col("nome_linha") == line)
    if codes is None:
        return rows.select(*columns)
    return rows.where(F.col("cod_conglomerado").isin(*codes)).select(*columns)


def compare_institutions(
    filings: Filings, codes: Sequence[int] | None, line: str, relatorio: str
) -> DataFrame:
    """One line over time for several entities (None: for all)."""
    rows = _compared(filings, codes, line, relatorio)
    return rows if codes is None else rows.orderBy("ano_mes", "nome_conglomerado")


def latest_comparison(
    filings: Filings, codes: Sequence[int] | None, line: str, relatorio: str
) -> DataFrame:
    """The compared entities in their newest common table period, by value."""
    rows = _compared(filings, codes, line, relatorio)
    return newest_rows(rows).orderBy(F.asc_nulls_last("valor_a"), "cod_conglomerado")


def report_periods(filings: Filings) -> DataFrame:
    """Periods with report lines, newest first."""
    return distinct_periods(filings.report_periods)


def report_line_names(filings: Filings, relatorio: str) -> DataFrame:
    """Distinct line names of a report, in order."""
    return (
        filings.report_lines(relatorio).select("nome_linha").distinct().orderBy("nome_linha")
    )


def line_options(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Selectable lines: capital first, then summary, then income."""
    choices = [(CAPITAL, "Capital"), (SUMMARY, "Resumo"), (INCOME, "DRE")]
    report, is_income = F.col("relatorio"), F.col("relatorio") == INCOME
    lines = filings.report_lines(*[code for code, _ in choices])
    if cod_conglomerado is not None:
        lines = lines.where(F.col("cod_conglomerado") == cod_conglomerado)
    names = lines.where(~is_income | (F.col("nome_linha") != LINE_ASSETS)).select(
        "cod_conglomerado", "relatorio",
        F.when(is_income, _income_name()).otherwise(F.col("nome_linha")).alias("nome_linha"),
    ).distinct()
    priority, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for number, (code, short) in enumerate(choices, start=1):
        priority = F.when(report == code, number).otherwise(priority)
        label = F.when(report == code, short).otherwise(label)
    options = names.select(
        "cod_conglomerado",
        priority.alias("priority"),
        F.concat(F.lit("["), label, F.lit("] "), "nome_linha").alias("label"),
        F.concat(report, F.lit("|"), "nome_linha").alias("value"),
    )
    if cod_conglomerado is None:
        return options
    return options.orderBy("priority", "label")


def matching_lines(
    filings: Filings,
    relatorio: str,
    include: str,
    exclude: str | None = None,
    cod_conglomerado: int | None = None,
) -> DataFrame:
    """Lines whose name is found by one regex and not by another."""
    rows = LINES_OF_REPORT[relatorio](filings, cod_conglomerado)
    return rows.where(line_regex(include, exclude))


def line_series(
    filings: Filings,
    relatorio: str,
    include: str,
    exclude: str | None = None,
    cod_conglomerado: int | None = None,
) -> DataFrame:
    """Largest matching line per period, also as a percentage."""
    series = (
        matching_lines(filings, relatorio, include, exclude, cod_conglomerado)
        .groupBy("cod_conglomerado", "ano_mes")
        .agg(F.max("valor_a").alias("valor_a"))
        .withColumn("valor_pct", F.col("valor_a") * 100)
    )
    return series if cod_conglomerado is None else series.orderBy("ano_mes")


# Headline name: (report, line to find, line to leave out).
HEADLINES = {
    "lucro_liquido": (SUMMARY, "(?iu)lucro l", None),
    "patrimonio_liquido": (SUMMARY, "(?iu)patrim.nio l", None),
    "indice_basileia": (CAPITAL, "(?iu)basileia", "(?iu)amplo"),
    "ativo_total": (SUMMARY, "(?iu)ativo total", None),
    "captacoes": (SUMMARY, "(?iu)capta", None),
    "carteira_credito": (SUMMARY, "(?iu)carteira de cr", None),
}


def latest_values(
    lines: DataFrame, wanted: dict[str, tuple[str, str, str | None]]
) -> DataFrame:
    """First matching line of each entity's newest period of the value's report.

    The newest period counts over all lines of a report: when it lacks the wanted
    one, the value is NULL rather than an older value. Both steps keep numeric
    buffers, so they hash-aggregate and combine before the shuffle.
    """
    report_is = {report: F.col("relatorio") == report for report, _, _ in wanted.values()}
    cells = [
        F.min_by(
            "valor_a",
            F.when(report_is[report] & line_regex(include, exclude), F.col("ordenacao")),
        ).alias(name)
        for name, (report, include, exclude) in wanted.items()
    ]
    per_period = lines.groupBy("cod_conglomerado", "relatorio", "ano_mes").agg(*cells)
    newest = [
        F.max_by(name, F.when(report_is[report], F.col("ano_mes"))).alias(name)
        for name, (report, _, _) in wanted.items()
    ]
    return per_period.groupBy("cod_conglomerado").agg(*newest)


def headline_values(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Six headline values per entity; both reports are read at once."""
    lines = filings.report_lines(SUMMARY, CAPITAL)
    if cod_conglomerado is not None:
        lines = lines.where(F.col("cod_conglomerado") == cod_conglomerado)
    return latest_values(lines, HEADLINES)


def first_per_period(lines: DataFrame) -> DataFrame:
    """One value per entity, line and period: the first in filing order."""
    return lines.groupBy("cod_conglomerado", "nome_linha", "ano_mes").agg(
        F.min_by("valor_a", "ordenacao").alias("valor_a")
    )
