"""Known answers on small filings."""

from __future__ import annotations

import pytest

from prudentia.constants import DEPOSITS, KPI_ACCOUNTS, TOTAL_ASSETS
from prudentia.operators.lines import in_peer_group
from prudentia.operators.quality import key_violations, null_counts
from prudentia.plans import balances, income, institutions, rankings, ratios, report_lines, tables
from prudentia.plans.rankings import ALL_PERIODS
from tests.builders import (
    A, B, C, SmallFilings, balance, capital_ratio_lines, combined_filings, income_filings,
    institution, kpi_filings, line, mapping, ratio_lines, tax_lines, two_entities,
)


# --- registry ---


def test_institutions(spark):
    f = two_entities(spark)
    assert [r.cod_conglomerado for r in institutions.list_institutions(f).collect()] == [1, 2]
    only = institutions.list_institutions(f, "S1").collect()
    assert [r.nome_conglomerado for r in only] == ["BANCO 1"]
    assert institutions.list_institutions(f, "ALL", []).count() == 2
    assert institutions.list_institutions(f, "S5").count() == 0
    assert institutions.list_institutions(f, codes=[2]).count() == 1


def test_details(spark):
    f = two_entities(spark)
    row = institutions.institution_details(f, 1).first()
    assert (row.nome_conglomerado, row.segmento, row.cidade, row.uf) == ("BANCO 1", "S1", "SP", "SP")
    assert institutions.institution_details(f, 99999).count() == 0
    assert institutions.institution_details(f).count() == 2


def test_options_and_cards(spark):
    f = two_entities(spark)
    labels = [r.label for r in institutions.institution_options(f, "S1", "ALL").collect()]
    assert labels == ["BANCO 1 (C0000001)"]
    assert institutions.institution_options(f, peer_group="PEERS").count() == 0
    card = institutions.institution_card(f, 1).first()
    assert (card.nome_comercial, card.localizacao) == ("BANCO 1", "SP/SP")
    nowhere = SmallFilings(spark, [institution(1, 10, 202403) | {"uf": ""}])
    assert institutions.institution_card(nowhere, 1).first().localizacao == "N/D"
    top = [r.label for r in rankings.top50_options(combined_filings(spark)).collect()]
    assert top[0] == "1. BANCO 11111111 (C0000001)" and top[2] == "3. BANCO 33333333 (-)"


def test_peer_group(spark):
    rows = spark.createDataFrame([(1000085317,), (1,)], "cod_conglomerado int")
    assert in_peer_group(rows, "PEERS").count() == 1
    assert in_peer_group(rows, "ALL").count() == 2


# --- report lines ---


def test_lines(spark):
    f = two_entities(spark)
    assert report_lines.institution_lines(f, 1).count() == 5
    assert report_lines.institution_lines(f, 1, "1").count() == 1
    assert [r.nome_linha for r in report_lines.summary_lines(f, 1).collect()] == ["Ativo Total"]
    ordered = [(r.ano_mes, r.ordenacao) for r in report_lines.capital_lines(f, 1).collect()]
    assert ordered == [(202403, 1), (202403, 2), (202406, 1), (202406, 2)]


def test_income_lines_use_todays_names(spark):
    names = ["Resultado antes da Tributação, Lucro e Participação", "Participação nos Lucros",
             "Ativo Total", "Outras"]
    f = SmallFilings(spark, lines=[line(1, 1.0, n, 202403, "4", i) for i, n in enumerate(names)])
    assert [r.nome_linha for r in report_lines.income_lines(f, 1).collect()] == [
        "Resultado antes da Tributação e Participações", "Participações no Lucro", "Outras"]


def test_comparison(spark):
    f = two_entities(spark)
    rows = report_lines.compare_institutions(f, [1, 2], "Indice de Basileia", "5")
    assert rows.count() == 4
    none = report_lines.compare_institutions(f, [], "X", "5")
    assert none.count() == 0 and none.dtypes == rows.dtypes
    assert report_lines.compare_institutions(f, [1], "Indice de Basileia", "5").count() == 2
    latest = report_lines.latest_comparison(f, [1, 2], "Indice de Basileia", "5").collect()
    assert [(r.ano_mes, r.valor_a) for r in latest] == [(202406, 12.3), (202406, 14.5)]


def test_periods_and_names(spark):
    f, nothing = two_entities(spark), SmallFilings(spark)
    assert [r.ano_mes for r in report_lines.report_periods(f).collect()] == [202406, 202403]
    assert report_lines.report_periods(nothing).count() == 0
    names = [r.nome_linha for r in report_lines.report_line_names(f, "5").collect()]
    assert names == ["Indice de Basileia", "Patrimonio de Referencia"]
    options = [r.value for r in report_lines.line_options(f, 1).collect()]
    assert options == ["5|Indice de Basileia", "5|Patrimonio de Referencia", "1|Ativo Total"]


def test_headlines_come_from_the_newest_period(spark):
    lines = [
        line(1, 1.0, "Lucro Líquido", 202403, "1"), line(1, 5.0, "Captações", 202403, "1"),
        line(1, None, "Lucro Líquido", 202406, "1", 1), line(1, 9.0, "LUCRO LÍQUIDO", 202406, "1", 2),
        line(1, 7.0, "Patrimônio Líquido", 202406, "1", 3),
        line(1, 0.2, "Basileia Amplo", 202403, "5", 1), line(1, 0.1, "Índice de BASILEIA", 202403, "5", 2),
    ]
    row = report_lines.headline_values(SmallFilings(spark, lines=lines), 1).first()
    assert row.lucro_liquido is None  # the first matching line, although empty
    assert row.captacoes is None  # not filed in the newest period
    assert (row.patrimonio_liquido, row.indice_basileia) == (7.0, 0.1)


def test_capital_series(spark):
    lines = [line(1, 0.10, "Basileia", 202403, "5"), line(1, 0.12, "basileia II", 202403, "5"),
             line(1, 0.20, "Basileia AMPLO", 202403, "5")]
    row = report_lines.line_series(
        SmallFilings(spark, lines=lines), "5", "(?iu)basileia", "(?iu)amplo", 1).first()
    assert (row.valor_a, row.valor_pct) == (0.12, 12.0)


# --- rankings ---


def test_segment_ranking(spark):
    f = two_entities(spark)
    rows = rankings.segment_ranking(f, "Indice de Basileia", "5").collect()
    assert [(r.ano_mes, r.valor_a, r.segmento) for r in rows] == [(202406, 14.5, "S1"), (202406, 12.3, "S2")]
    assert rankings.segment_ranking(f, "Indice de Basileia", "5", segmento="S1").count() == 1
    # the newest period is that of all reports, even when this report lacks it
    assert rankings.segment_ranking(f, "Ativo Total", "1", 202403).count() == 0
    every = rankings.segment_ranking(f, "Indice de Basileia", "5", ALL_PERIODS, top_n=1)
    assert {(r.ano_mes, r.cod_conglomerado) for r in every.collect()} == {(202403, 1), (202406, 1)}


def test_unregistered_entities_keep_a_blank_segment(spark):
    f = SmallFilings(spark, lines=[line(7, 1.0, "X", 202403, "5")])
    assert rankings.segment_ranking(f, "X", "5").first().segmento == ""


def test_registered_twice_repeats_in_rankings_and_totals(spark):
    registry = [institution(1, 10, 202406, "S1"), institution(1, 11, 202406, "S1")]
    f = SmallFilings(spark, registry, ratio_lines(1, 202406, pl=100.0) + ratio_lines(2, 202406, pl=100.0))
    assert rankings.segment_ranking(f, "Ativo Total", "1").count() == 3
    shares = rankings.market_share(f).collect()
    assert len(shares) == 3 and sum(r.market_share_pct for r in shares) == pytest.approx(100.0)
    assert rankings.ratio_ranking(f, "roe").count() == 2


def test_ratio_ranking(spark):
    registry = [institution(c, c * 10, p) for c in (1, 2, 3) for p in (202403, 202406)]
    lines = []
    for cod, lucro in ((1, 300.0), (2, 100.0), (3, 200.0)):
        lines += ratio_lines(cod, 202406, lucro=lucro)
    lines += ratio_lines(4, 202406, pl=0.0) + ratio_lines(1, 202403, lucro=100.0)
    f = SmallFilings(spark, registry, lines)
    rows = rankings.ratio_ranking(f, "roe").collect()
    assert [(r.cod_conglomerado, r.valor) for r in rows] == [(1, 60.0), (3, 40.0), (2, 20.0)]
    assert rankings.ratio_ranking(f, "roe", 202403).first().valor == 40.0
    assert rankings.ratio_ranking(f, "invalid_ratio").count() == 0
    assert rankings.ratio_ranking(f, "invalid_ratio").columns == rankings.ratio_ranking(f, "roe").columns


def test_market_share(spark):
    lines = []
    for cod, equity in ((1, 5000.0), (2, 3000.0), (3, 2000.0)):
        lines += ratio_lines(cod, 202406, pl=equity)
    f = SmallFilings(spark, lines=lines)
    rows = rankings.market_share(f, 202406).collect()
    assert [r.pl_value for r in rows] == [5000.0, 3000.0, 2000.0]
    assert [r.market_share_pct for r in rows] == [50.0, 30.0, 20.0]
    top = rankings.market_share(f, top_n=1).collect()
    assert [r.market_share_pct for r in top] == [50.0]  # still of the whole total
    every = {(r.ano_mes, r.cod_conglomerado): r.market_share_pct for r in rankings.market_share(f, ALL_PERIODS, None).collect()}
    ranked = rankings.market_share(f, ALL_PERIODS, 2).collect()
    assert all(every[r.ano_mes, r.cod_conglomerado] == r.market_share_pct for r in ranked)
    assert {r.rank for r in ranked} == {1, 2} and rankings.market_share(f, 202406, None).count() == 3
    assert rankings.market_share(f, 209901).count() == 0


# --- top 50 ---


def test_top50(spark):
    rows = [balance(c, v, p) for p in (202501, 202502) for c, v in ((A, 5e6), (B, 3e6), (C, 1e6))]
    f = SmallFilings(spark, balances=rows)
    assert [r.patrimonio_liquido for r in rankings.top50(f, 202501).collect()] == [5e6, 3e6, 1e6]
    assert {r.ano_mes for r in rankings.top50(f).collect()} == {202502}
    assert rankings.top50(f, 209901).count() == 0
    assert [r.ano_mes for r in rankings.top50_periods(f).collect()] == [202502, 202501]
    assert rankings.equity_trend(f, "11111111").count() == 2
    assert rankings.equity_trend(f, ["11111111", "22222222"]).count() == 4
    assert rankings.equity_trend(f, "99999999").count() == 0
    none = rankings.equity_trend(f, [])
    assert none.count() == 0 and none.columns == ["ano_mes", "cnpj8", "nome_inst", "patrimonio_liquido"]


def test_equity_adds_documents_unless_one_is_named(spark):
    rows = [balance(A, 5.0), balance(A, 2.0, documento="4010")]
    f = SmallFilings(spark, balances=rows)
    assert rankings.top_by_balances(f).first().patrimonio_liquido == 7.0
    assert rankings.top_by_balances(f, documento="4040").first().patrimonio_liquido == 5.0


def test_ties_at_the_limit_are_stable(spark):
    rows = [balance(f"{i:08d}000100", 1.0) for i in range(60)]
    top = rankings.top_by_balances(SmallFilings(spark, balances=rows)).collect()
    assert [r.cnpj8 for r in sorted(top, key=lambda r: r["rank"])] == [f"{i:08d}" for i in range(50)]


def test_root_registered_twice_ranks_twice(spark):
    registry = [institution(1, 10, 202501, cnpj=A), institution(2, 20, 202501, cnpj=A)]
    f = SmallFilings(spark, registry, balances=[balance(A, 5e6), balance(B, 3e6)])
    top = [(r["rank"], r.cnpj8, r.cod_conglomerado) for r in rankings.top50(f).collect()]
    assert top == [(1, "11111111", 1), (2, "11111111", 2), (3, "22222222", None)]
    assert [(r.cnpj8, r.n_rows) for r in rankings.bridge_duplicates(f).collect()] == [("11111111", 2)]


def test_kpis(spark):
    f = kpi_filings(spark)
    first, second = rankings.top50_kpis(f, 202501).collect()
    assert (first.ativo_total, first.operacoes_credito, first.depositos, first.resultado_liquido) == (
        20e6, 8e6, 12e6, 5e5)
    assert second.operacoes_credito is None and second.depositos is None
    assert rankings.top50_kpis(f).count() == 2
    table = rankings.top50_kpi_table(f, 202501).first()
    assert (table.roe, table.roa, table.alavancagem, table.cod_display) == (120.0, 30.0, 400.0, "C0000001")
    assert rankings.top50_kpis(SmallFilings(spark), 202501).count() == 0


def test_enriched(spark):
    f = combined_filings(spark)
    rows = {r.cnpj8: r for r in rankings.top50_enriched(f, 202501).collect()}
    assert set(rows["11111111"].asDict()) == {
        "ano_mes", "rank", "cnpj8", "nome_inst", "cod_conglomerado", "nome_conglomerado",
        "patrimonio_liquido", "basileia", "ativo_total", "lucro_liquido", "ifdata_periodo"}
    one = rows["11111111"]
    assert (one.basileia, one.ativo_total, one.lucro_liquido, one.ifdata_periodo) == (14.5, 5e5, 8e4, 202412)
    other = rows["33333333"]
    assert (other.basileia, other.ativo_total, other.lucro_liquido) == (None, None, None)
    assert rankings.top50_enriched(f).first().ano_mes == 202501
    assert rankings.top50_enriched(f, 209901).count() == 0
    labels = [r.label for r in rankings.bridged_institutions(f).collect()]
    assert labels == ["1. BANCO 11111111 (BANCO 1)", "2. BANCO 22222222 (BANCO 2)"]


# --- balances ---


def test_account_trend(spark):
    f = kpi_filings(spark)
    assert [r.valor for r in balances.account_trend(f, TOTAL_ASSETS, "11111111").collect()] == [20e6, 20e6]
    assert balances.account_trend(f, DEPOSITS, "22222222").count() == 0
    assert KPI_ACCOUNTS["Depósitos"] == DEPOSITS


def test_balance_ratios(spark):
    f = kpi_filings(spark)
    rows = balances.balance_ratios(f, "11111111").collect()
    assert [r.ano_mes for r in rows] == [202501, 202502]
    assert (rows[0].roe, rows[0].roa, rows[0].alavancagem) == pytest.approx((1.2, 0.3, 4.0))
    partial = balances.balance_ratios(f, "22222222").first()
    assert (partial.resultado_liquido, partial.roe, partial.roa) == (None, None, None)
    none = balances.balance_ratios(f, "99999999")
    assert none.count() == 0 and {"roe", "roa", "alavancagem"} <= set(none.columns)


# --- ratios ---


def _ratio_row(spark, lines):
    return ratios.financial_ratios(SmallFilings(spark, lines=lines), 1).first()


def test_ratios(spark):
    row = _ratio_row(spark, ratio_lines(1, 202406) + capital_ratio_lines(1, 202406) + tax_lines(1, 202406))
    got = {n: row[n] for n in ratios.RATIOS}
    assert got == pytest.approx({
        "roe": 30.0, "roa": 3.0, "loan_to_deposit": 60.0, "credit_intensity": 6.0,
        "securities_share": 20.0, "leverage": 10.0, "debt_equity": 9.0, "funding_dependency": 10.0,
        "pr_coverage": 5.0, "basileia": 15.0, "capital_principal": 10.0, "capital_nivel1": 12.0,
        "capital_excess": 4.5, "razao_alavancagem": 8.0, "tax_rate": -30.0})


def test_zero_and_missing_divisors_give_null(spark):
    row = _ratio_row(spark, ratio_lines(1, 202406, pl=0.0))
    assert (row.roe, row.leverage, row.debt_equity) == (None, None, None)
    assert row.roa == 3.0
    assert (row.basileia, row.capital_principal, row.capital_excess, row.tax_rate) == (None,) * 4
    assert _ratio_row(spark, []) is None


def test_any_report_makes_a_period(spark):
    lines = ratio_lines(1, 202403) + capital_ratio_lines(1, 202406) + tax_lines(1, 202409)
    f = SmallFilings(spark, lines=lines)
    rows = ratios.financial_ratios(f, 1).collect()
    assert [(r.ano_mes, r.roe is None, r.basileia is None, r.tax_rate is None) for r in rows] == [
        (202403, False, True, True), (202406, True, False, True), (202409, True, True, False)]
    assert ratios.latest_ratios(f, 1).first().ano_mes == 202409
    assert ratios.latest_ratios(f, 1).first().roe is None
    assert [r.ano_mes for r in ratios.ratio_series(f, "roe", 1).collect()] == [202403]
    table = ratios.ratio_table(f, [202403, 202406], 1).collect()
    assert [r.indicador for r in table][:2] == ["ROE (%)", "ROA (%)"]
    assert (table[0].p202403, table[0].p202406) == (60.0, None)
    texts = {(r.indicador, r.periodo): r.texto for r in ratios.ratio_texts(f, 1).collect()}
    assert texts[("Alavancagem (x)", "Q1/2024")] == "10.0x"
    assert texts[("Capital Excess (ppts)", "Q2/2024")] == "+4.50 ppts"


# --- income statements ---


def test_level2_income(spark):
    f = income_filings(spark)
    rows = income.level2_income(f, 1).collect()
    assert len({r.conta for r in rows}) == 7 and "7.1.1.00.00" not in {r.conta for r in rows}
    assert {r.ano_mes for r in rows} == {202411, 202412, 202501, 202502}
    assert income.level2_income(f, 999).count() == 0
    assert "7.1.1.00.00" in {r.conta for r in income.detailed_income(f, 1).collect()}


def test_income_adds_institutions_under_the_newest_name(spark):
    rows = [
        balance(A, 1.0, 202411, "7.1.0.00.00-8", "4010", "NOME ANTIGO"),
        balance(A, 2.0, 202412, "7.1.0.00.00-8", "4010", "NOME NOVO"),
        balance(B, 3.0, 202412, "7.1.0.00.00-0", "4010", "NOME NOVO"),
        balance(C, 9.0, 202412, "7.1.0.00.00-8", "4010", "SEM GRUPO"),
        balance(A, 9.0, 202412, "7.1.0.00.00-8", "4040", "OUTRO DOCUMENTO"),
    ]
    f = SmallFilings(spark, balances=rows, mappings=[mapping("11111111", 1), mapping("22222222", 1)])
    found = [(r.ano_mes, r.conta, r.nome_conta, r.saldo) for r in income.detailed_income(f, 1).collect()]
    assert found == [(202411, "7.1.0.00.00", "NOME NOVO", 1.0), (202412, "7.1.0.00.00", "NOME NOVO", 5.0)]


def test_monthly_income(spark):
    rows = {(r.conta[:3], r.ano_mes): r.saldo for r in income.monthly_income(income_filings(spark), 1).collect()}
    assert rows[("7.1", 202412)] == 10000.0
    assert rows[("7.1", 202501)] == 10000.0
    assert rows[("7.1", 202502)] == 12000.0
    assert rows[("8.1", 202412)] == -6000.0
    assert rows[("7.3", 202502)] == 2500.0


def test_month_missing_inside_a_semester(spark):
    rows = [balance(A, v, p, "7.1.0.00.00-8", "4010") for p, v in ((202401, 10.0), (202403, 40.0), (202407, 5.0))]
    f = SmallFilings(spark, balances=rows, mappings=[mapping("11111111", 1)])
    assert [(r.ano_mes, r.saldo) for r in income.monthly_income(f, 1).collect()] == [
        (202401, 10.0), (202403, 30.0), (202407, 5.0)]


def test_subtotals(spark):
    rows = income.income_with_subtotals(income_filings(spark), 1).where("ano_mes = 202501").collect()
    amounts = {r.conta: r.saldo for r in rows}
    assert amounts["RESULTADO BRUTO"] == 4000.0
    assert amounts["RESULTADO OPERACIONAL"] == 4200.0
    assert amounts["RESULTADO ANTES TRIBUTAÇÃO"] == 4500.0
    assert [r.ordering for r in rows] == sorted(r.ordering for r in rows)
    assert [r.conta[:12] for r in rows][:3] == ["7.1.0.00.00", "8.1.0.00.00", "RESULTADO BR"]


def test_subtotal_without_accounts_is_zero(spark):
    f = SmallFilings(spark, balances=[balance(A, 3.0, 202401, "7.9.0.00.00-0", "4010")],
                     mappings=[mapping("11111111", 1)])
    amounts = {r.conta: r.saldo for r in income.income_with_subtotals(f, 1).collect()}
    assert (amounts["RESULTADO BRUTO"], amounts["RESULTADO OPERACIONAL"]) == (0.0, 0.0)
    assert amounts["RESULTADO ANTES TRIBUTAÇÃO"] == 3.0
    empty = income.income_with_subtotals(SmallFilings(spark), 1)
    assert empty.count() == 0 and "ordering" in empty.columns


def test_trailing_sum_and_recent_periods(spark):
    periods = [202301 + i for i in range(12)] + [202401, 202402]
    rows = [balance(A, 1.0, p, "7.1.0.00.00-8", "4010") for p in periods]
    rows.append(balance(A, 5.0, 202301, "7.3.0.00.00-6", "4010"))
    f = SmallFilings(spark, balances=rows, mappings=[mapping("11111111", 1)])
    sums = {r.conta: r.acum_12m for r in income.trailing_income(f, 1).collect()}
    # accumulated balances of 1.0: only the first month of a semester counts
    assert sums["7.1.0.00.00"] == 2.0
    assert sums["7.3.0.00.00"] == 0.0
    assert income.recent_income(f, 1).select("ano_mes").distinct().count() == 13
    table = {r.indicador[:3]: r for r in tables.income_table(f, 1).collect()}
    assert (table["7.1"].m1, table["7.1"].m2, table["7.1"].acum_12m) == (0.0, 1.0, 2.0)
    assert (table["7.3"].m13, table["7.3"].acum_12m) == (None, 0.0)


# --- tables ---


def _series(spark, values, name="Ativo Total", report="1"):
    return SmallFilings(spark, lines=[line(1, v, name, p, report) for p, v in values.items()])


def test_report_table(spark):
    row = tables.report_table(two_entities(spark), "5", [202403, 202406], 1).where(
        "nome_linha = 'Indice de Basileia'").first()
    assert (row.p202403, row.p202406) == (14.5, 14.5)
    texts = {r.nome_linha: r.texto for r in tables.report_cells(two_entities(spark), "5", 1).collect()}
    assert texts == {"Indice de Basileia": "1450.00%", "Patrimonio de Referencia": "1,000"}


def test_first_line_of_a_period_counts(spark):
    lines = [line(1, 2.0, "X", 202403, "1", 2), line(1, None, "X", 202403, "1", 1)]
    f = SmallFilings(spark, lines=lines)
    assert tables.report_table(f, "1", [202403], 1).first().p202403 is None


def test_year_grid_changes(spark):
    f = _series(spark, {202303: 100.0, 202306: 50.0, 202403: 110.0, 202503: 0.0, 202506: 75.0, 202509: None})
    absolute = {r.ano: (r.q3, r.q6, r.q9, r.q12) for r in tables.year_quarter_table(f, "1").collect()}
    assert absolute[2023] == (100.0, 50.0, None, None)
    yoy = {r.ano: (r.q3, r.q6) for r in tables.year_quarter_table(f, "1", "yoy").collect()}
    # 2024 has no June, so June 2025 has nothing to compare with
    assert yoy == {2023: (None, None), 2024: (10.0, None), 2025: (-100.0, None)}
    qoq = {r.ano: (r.q3, r.q6, r.q9) for r in tables.year_quarter_table(f, "1", "qoq").collect()}
    assert qoq == {2023: (None, -50.0, None), 2024: (120.0, None, None), 2025: (-100.0, None, None)}
    with pytest.raises(ValueError, match="comparison"):
        tables.year_quarter_table(f, "1", "mom")


def test_year_before_is_the_previous_one_present(spark):
    f = _series(spark, {202203: 100.0, 202403: 150.0})
    yoy = {r.ano: r.q3 for r in tables.year_quarter_table(f, "1", "yoy").collect()}
    assert yoy == {2022: None, 2024: 50.0}


def test_fractions_become_percentages_only_as_values(spark):
    f = _series(spark, {202303: 0.10, 202306: 0.15}, "Índice de Basileia", "5")
    assert tables.year_quarter_table(f, "5", "abs", "Índice de Basileia", 1).first().q3 == 10.0
    assert tables.year_quarter_table(f, "5", "qoq").first().q6 == pytest.approx(50.0)


# --- rules ---


def test_rules(spark):
    rows = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "k int, v string")
    assert [(r.k, r.n_rows) for r in key_violations(rows, ["k"]).collect()] == [(1, 2)]
    assert null_counts(rows, ["k", "v"]).first().asDict() == {"k": 0, "v": 1}
