"""Rankings, market shares and the top-50 table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.constants import (
    CAPITAL,
    EQUITY,
    INCOME,
    LINE_ASSETS,
    LINE_CREDIT,
    LINE_FUNDING,
    LINE_PROFIT,
    SUMMARY,
)
from prudentia.functions import periods, text
from prudentia.functions.display import code_text
from prudentia.operators.lines import line_like, max_where
from prudentia.operators.periods import (
    at_period,
    distinct_periods,
    latest_period,
    with_closest_period,
)
from prudentia.operators.ranking import share_of_period, top_per_period, top_share_per_period
from prudentia.plans.ratios import RATIOS, input_aggregates
from prudentia.schemas import BALANCETES_TOP50
from prudentia.sources.base import Filings

ALL_PERIODS = "all"
Period = int | str | None  # a period, "all", or None for the newest


def _in_period(rows: DataFrame, period: Period, of: DataFrame) -> DataFrame:
    return rows if period == ALL_PERIODS else at_period(rows, period, of)


def _with_segment(filings: Filings, rows: DataFrame) -> DataFrame:
    """Registry rows of the same entity and period beside each row.

    Entities with several registered institutions repeat, once per institution.
    """
    registry = filings.cadastro.select("cod_conglomerado", "ano_mes", "segmento")
    return rows.join(registry, ["cod_conglomerado", "ano_mes"], "left")


def _ranked(
    rows: DataFrame, order: Sequence[Column], ano_mes: Period, top_n: int | None
) -> DataFrame:
    """Rows in order, or the top n. All entities of all periods stay unnumbered:
    numbering them would bring each period to one task."""
    if ano_mes == ALL_PERIODS:
        return rows if top_n is None else top_per_period(rows, order, top_n)
    return rows.orderBy(*order) if top_n is None else rows.orderBy(*order).limit(top_n)


def _segment_or_blank() -> Column:
    return F.coalesce("segmento", F.lit(""))


def segment_ranking(
    filings: Filings,
    line: str,
    relatorio: str,
    ano_mes: Period = None,
    segmento: str | None = None,
    top_n: int | None = None,
) -> DataFrame:
    """Entities by one line, largest first.

    The newest period is that of all reports, so the ranking is empty when that
    period lacks this report. With ``ano_mes="all"`` all periods are answered.
    """
    lines = filings.report_lines(relatorio).where(
        (F.col("nome_linha") == line) & F.col("valor_a").isNotNull()
    )
    rows = _with_segment(filings, _in_period(lines, ano_mes, of=filings.report_periods))
    if segmento and segmento != "ALL":
        rows = rows.where(F.col("segmento") == segmento)
    rows = rows.select(
        "ano_mes", "cod_conglomerado", "nome_conglomerado",
        _segment_or_blank().alias("segmento"), "valor_a",
    )
    order = [F.desc("valor_a"), F.asc("cod_conglomerado")]
    return _ranked(rows, order, ano_mes, top_n)


def ratio_ranking(
    filings: Filings, name: str, ano_mes: Period = None, top_n: int | None = None
) -> DataFrame:
    """Entities by one ratio, largest first; an unknown ratio gives no rows.

    The ratio is aggregated before the registry is joined: the aggregate is one
    row per entity and period, and the registry only adds the segment.
    """
    if name not in RATIOS:
        return filings.spark.createDataFrame(
            [], "ano_mes int, cod_conglomerado int, nome_conglomerado string, "
            "segmento string, valor double"
        )
    wanted = RATIOS[name]
    lines = _in_period(
        filings.report_lines(wanted.report), ano_mes, of=filings.report_periods
    )
    values = (
        lines.groupBy("ano_mes", "cod_conglomerado", "nome_conglomerado")
        .agg(*input_aggregates(wanted.inputs))
        .withColumn("valor", F.expr(wanted.formula))
        .where(F.col("valor").isNotNull())
    )
    segments = filings.cadastro.select("cod_conglomerado", "ano_mes", "segmento").distinct()
    rows = values.join(segments, ["cod_conglomerado", "ano_mes"], "left").select(
        "ano_mes", "cod_conglomerado", "nome_conglomerado",
        _segment_or_blank().alias("segmento"), "valor",
    )
    order = [F.desc("valor"), F.asc("cod_conglomerado"), F.asc("segmento")]
    return _ranked(rows, order, ano_mes, top_n)


def market_share(
    filings: Filings, ano_mes: Period = None, top_n: int | None = 20
) -> DataFrame:
    """Equity share of the largest entities in the total of all of them."""
    lines = filings.report_lines(SUMMARY).where(
        line_like("%atrim%nio L%", "%efer%") & F.col("valor_a").isNotNull()
    )
    rows = _with_segment(filings, _in_period(lines, ano_mes, of=filings.report_periods)).select(
        "ano_mes", "cod_conglomerado", "nome_conglomerado",
        _segment_or_blank().alias("segmento"), F.col("valor_a").alias("pl_value"),
    )
    order = [F.desc("pl_value"), F.asc("cod_conglomerado"), F.asc("segmento")]
    if top_n is None:
        return _ranked(share_of_period(rows, "pl_value", "market_share_pct"), order, ano_mes, None)
    top = top_share_per_period(rows, "pl_value", order, top_n, "market_share_pct")
    return top if ano_mes == ALL_PERIODS else top.orderBy("rank").drop("rank")


# --- the top-50 table ---


def top_by_balances(
    filings: Filings, n: int = 50, documento: str | None = None,
    balances: DataFrame | None = None,
) -> DataFrame:
    """Largest institutions of every period by summed equity account.

    All documents are added up unless one is named. The newest registry turns
    tax-id roots into group codes before ranking, so a root registered twice
    ranks twice; ``bridge_duplicates`` lists those.
    """
    rows = filings.balances(documento) if balances is None else balances
    equity = (
        rows.where(F.col("conta") == EQUITY)
        .groupBy("ano_mes", "cnpj8", "nome_inst")
        .agg(F.sum("saldo").alias("patrimonio_liquido"))
    )
    return _top(equity.join(registry_bridge(filings), "cnpj8", "left"), n)


def registry_bridge(filings: Filings) -> DataFrame:
    """Tax-id root to group code, from the newest registry."""
    registry = at_period(filings.cadastro, None, of=filings.registry_periods)
    return (
        registry.select("cnpj", "cod_conglomerado", "nome_conglomerado")
        .distinct()
        .select(
            text.cnpj8(F.col("cnpj")).alias("cnpj8"), "cod_conglomerado", "nome_conglomerado"
        )
    )


def bridge_duplicates(filings: Filings) -> DataFrame:
    """Tax-id roots that lead to more than one registry entry."""
    return (
        registry_bridge(filings).groupBy("cnpj8")
        .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    )


def top_by_reports(
    filings: Filings, n: int = 50, lines: DataFrame | None = None
) -> DataFrame:
    """Largest entities of every period by the reported equity line."""
    rows = filings.report_lines(SUMMARY) if lines is None else lines
    name = F.col("nome_conglomerado")
    equity = rows.where(
        line_like("%atrim%nio L%quido") & F.col("valor_a").isNotNull()
    ).select(
        "ano_mes", F.col("cod_conglomerado").cast("string").alias("cnpj8"),
        name.alias("nome_inst"), "cod_conglomerado", name,
        F.col("valor_a").alias("patrimonio_liquido"),
    )
    return _top(equity, n)


def _top(equity: DataFrame, n: int) -> DataFrame:
    order = [
        F.desc("patrimonio_liquido"), F.asc("cnpj8"), F.asc("nome_inst"),
        F.asc_nulls_last("cod_conglomerado"),
    ]
    return top_per_period(equity, order, n).select(*BALANCETES_TOP50.schema.names)


def top50(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """The stored top 50 of a period."""
    rows = _in_period(filings.balancetes_top50, ano_mes, of=filings.top50_periods)
    return rows.orderBy("ano_mes", "rank")


def top50_periods(filings: Filings) -> DataFrame:
    """Periods of the top-50 table, newest first."""
    return distinct_periods(filings.top50_periods)


def equity_trend(filings: Filings, cnpj8: Sequence[str] | str | None = None) -> DataFrame:
    """Equity over time of institutions in the top 50 (None: of all)."""
    columns = ("ano_mes", "cnpj8", "nome_inst", "patrimonio_liquido")
    rows = filings.balancetes_top50.select(*columns)
    if cnpj8 is None:
        return rows
    roots = [cnpj8] if isinstance(cnpj8, str) else list(cnpj8)
    if not roots:
        fields = [BALANCETES_TOP50.schema[c] for c in columns]
        return filings.spark.createDataFrame([], schema=type(BALANCETES_TOP50.schema)(fields))
    return rows.where(F.col("cnpj8").isin(*roots)).orderBy("ano_mes", "cnpj8")


KPI_LINES = {
    "ativo_total": LINE_ASSETS,
    "operacoes_credito": LINE_CREDIT,
    "depositos": LINE_FUNDING,
    "resultado_liquido": LINE_PROFIT,
}


def top50_kpis(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """Top 50 with four summary lines of the same period."""
    top = _in_period(filings.balancetes_top50, ano_mes, of=filings.top50_periods)
    lines = filings.report_lines(SUMMARY).where(F.col("nome_linha").isin(*KPI_LINES.values()))
    lines = _in_period(lines, ano_mes, of=filings.top50_periods)
    kpis = lines.groupBy("cod_conglomerado", "ano_mes").agg(
        *[max_where(F.col("nome_linha") == line).alias(k) for k, line in KPI_LINES.items()]
    )
    return (
        top.join(kpis, ["cod_conglomerado", "ano_mes"], "left")
        .select(
            "ano_mes", "rank", "cnpj8", "nome_inst", "cod_conglomerado",
            "nome_conglomerado", "patrimonio_liquido", *KPI_LINES,
        )
        .orderBy("ano_mes", "rank")
    )


def top50_kpi_table(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """Top 50 with annualised returns and leverage, times 100, one decimal."""
    yearly = F.col("resultado_liquido") * periods.annualisation_factor(F.col("ano_mes"))

    def shown(ratio_value: Column) -> Column:
        return F.round(ratio_value * 100, 1)

    equity, assets = F.col("patrimonio_liquido"), F.col("ativo_total")
    return top50_kpis(filings, ano_mes).select(
        "ano_mes", "rank", "nome_inst", "cnpj8",
        code_text(F.col("cod_conglomerado")).alias("cod_display"),
        "nome_conglomerado", "patrimonio_liquido", *KPI_LINES,
        shown(F.try_divide(yearly, equity)).alias("roe"),
        shown(F.try_divide(yearly, assets)).alias("roa"),
        shown(F.try_divide(assets, equity)).alias("alavancagem"),
    )


# Output column: (report, LIKE pattern of the line).
ENRICHMENTS = {
    "basileia": (CAPITAL, "%asileia%"),
    "ativo_total": (SUMMARY, "%tivo Total%"),
    "lucro_liquido": (INCOME, "%ucro%"),
}


def top50_enriched(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """Top 50 with report lines of the closest quarter not after the period."""
    top = with_closest_period(
        _in_period(filings.balancetes_top50, ano_mes, of=filings.top50_periods),
        filings.report_periods, "ifdata_periodo",
    )
    matches = {
        name: (F.col("relatorio") == report) & line_like(pattern)
        for name, (report, pattern) in ENRICHMENTS.items()
    }
    lines = filings.report_lines(SUMMARY, INCOME, CAPITAL).where(reduce(or_, matches.values()))
    if ano_mes != ALL_PERIODS:
        # One quarter is enough; as a scalar subquery it filters partitions.
        wanted = latest_period(filings.top50_periods) if ano_mes is None else F.lit(ano_mes)
        lines = at_period(
            lines, None, of=filings.report_periods.where(F.col("ano_mes") <= wanted)
        )
    indicators = (
        lines.groupBy("cod_conglomerado", F.col("ano_mes").alias("ifdata_periodo"))
        .agg(*[max_where(test).alias(name) for name, test in matches.items()])
    )
    return (
        top.join(indicators, ["cod_conglomerado", "ifdata_periodo"], "left")
        .select(
            "ano_mes", "rank", "cnpj8", "nome_inst", "cod_conglomerado", "nome_conglomerado",
            "patrimonio_liquido", *ENRICHMENTS, "ifdata_periodo",
        )
        .orderBy("ano_mes", "rank")
    )


def top50_enriched_table(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """The enriched top 50 rounded to two decimals."""
    amounts = ("patrimonio_liquido", *ENRICHMENTS)
    return top50_enriched(filings, ano_mes).withColumns(
        {name: F.round(F.col(name), 2) for name in amounts}
    )


def bridged_institutions(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """Top-50 institutions that have a group code: code, root and label."""
    return (
        top50(filings, ano_mes)
        .na.drop(subset=["cod_conglomerado"])
        .select(
            "ano_mes", "rank", F.col("cod_conglomerado").cast("string").alias("value"), "cnpj8",
            F.concat(
                F.col("rank"), F.lit(". "), "nome_inst",
                F.lit(" ("), "nome_conglomerado", F.lit(")"),
            ).alias("label"),
        )
    )


def top50_options(filings: Filings, ano_mes: Period = None) -> DataFrame:
    """Top-50 institutions to choose from: root and ``1. NAME (C0000001)``."""
    label = F.concat(
        F.col("rank"), F.lit(". "), "nome_inst",
        F.lit(" ("), code_text(F.col("cod_conglomerado")), F.lit(")"),
    )
    return top50(filings, ano_mes).select(
        "ano_mes", "rank", F.col("cnpj8").alias("value"), label.alias("label")
    )
