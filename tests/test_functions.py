"""Periods, text and display."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from prudentia.functions import display, periods, text
from prudentia.operators.lines import line_regex


def one(spark, value, column, kind: str):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("period,factor", [
    (202501, 12.0), (202503, 4.0), (202506, 2.0), (202507, 12.0), (202509, 4.0), (202512, 2.0),
])
def test_annualisation_factor(spark, period, factor):
    assert one(spark, period, periods.annualisation_factor, "int") == factor


def test_period_parts_and_labels(spark):
    rows = spark.createDataFrame([(202409,), (202502,)], "p int").select(
        periods.year(F.col("p")), periods.month(F.col("p")), periods.semester(F.col("p")),
        periods.quarter_label(F.col("p")), periods.quarter_heading(F.col("p")),
        periods.month_label(F.col("p")),
    ).collect()
    assert tuple(rows[0]) == (2024, 9, 4049, "2024 Q3", "Q3/2024", "Set/24")
    assert tuple(rows[1]) == (2025, 2, 4050, "2025 M2", "M2/2025", "Fev/25")


def test_periods_count_back(spark):
    def listed(frame):
        return [r.ano_mes for r in frame.collect()]

    assert listed(periods.monthly_periods(spark, 3, date(2025, 3, 20))) == [202501, 202412, 202411]
    assert listed(periods.monthly_periods(spark, 2, date(2025, 7, 20), 180)) == [202501, 202412]
    assert listed(periods.quarterly_periods(spark, 5, date(2025, 3, 20))) == [
        202412, 202409, 202406, 202403, 202312]
    assert listed(periods.quarterly_periods(spark, 1, date(2025, 6, 30))) == [202503]


@pytest.mark.parametrize("written,number", [
    ("7.043.370,57", 7043370.57), ("-1,5", -1.5), ("0,00", 0.0), ("x", None), ("", None),
])
def test_numbers(spark, written, number):
    assert one(spark, written, text.parse_number, "string") == number


def test_accounts(spark):
    assert one(spark, "71100001", text.dotted_account, "string") == "7.1.1.00.00-1"
    assert one(spark, "6.0.0.00.00-2", text.account_stem, "string") == "6.0.0.00.00"
    assert one(spark, "6.0.0.00.00-2", text.zero_digit_account, "string") == "6.0.0.00.00-0"
    assert one(spark, "12345678000199", text.cnpj8, "string") == "12345678"


@pytest.mark.parametrize("name,short", [
    ("ITAU S.A. - PRUDENCIAL", "ITAU"), ("Banco Ltda. - Prudencial", "Banco"), ("X S/A", "X"),
    ("BANCO LTDA S.A.", "BANCO LTDA"), ("S.A. BANCO", "S.A. BANCO"), (" A - FINANCEIRO ", "A - FINANCEIRO"),
])
def test_commercial_names(spark, name, short):
    assert one(spark, name, text.commercial_name, "string") == short


@pytest.mark.parametrize("name,percent", [
    ("Índice de Basileia", True), ("ÍNDICE", True), ("Razão de Alavancagem", True),
    ("Adicional de Capital", True), ("Ativo Total", False),
])
def test_percent_lines(spark, name, percent):
    assert one(spark, name, text.is_percent_line, "string") is percent


@pytest.mark.parametrize("account,position", [
    ("7.1.0.00.00", 10), ("RESULTADO OPERACIONAL", 110), ("7.9.0.00.00", 120), ("7.2.0.00.00", 999),
])
def test_income_order(spark, account, position):
    assert one(spark, account, text.income_order, "string") == position


def test_strip_knows_every_blank(spark):
    assert one(spark, "\t\xa0 a b \r\n\x85", text.strip, "string") == "a b"


@pytest.mark.parametrize("value,shown", [
    (1.5e9, "R$ 1.5 bi"), (-2.25e6, "R$ -2.2 mi"), (1234.0, "R$ 1.2 mil"), (12.5, "R$ 12"),
    (2.5e12, "R$ 2,500.0 bi"), (None, "N/D"),
])
def test_amount_text(spark, value, shown):
    assert one(spark, value, display.amount_text, "double") == shown


@pytest.mark.parametrize("value,unit,shown", [
    (1.25, "x", "1.2x"), (4.5, "ppts", "+4.50 ppts"), (-4.5, "ppts", "-4.50 ppts"),
    (30.0, "%", "30.00%"), (None, "%", "N/D"),
])
def test_ratio_text(spark, value, unit, shown):
    assert one(spark, value, lambda c: display.ratio_text(c, F.lit(unit)), "double") == shown


def test_other_texts(spark):
    assert one(spark, 0.3601, display.percent_text, "double") == "36.01%"
    assert one(spark, -3.25, display.change_text, "double") == "-3.2"
    assert one(spark, None, display.change_text, "double") == ""
    assert one(spark, 123, display.code_text, "int") == "C0000123"
    assert one(spark, None, display.code_text, "int") == "-"
    assert one(spark, 0.145, lambda c: display.cell_text(c, F.lit(True)), "double") == "14.50%"
    assert one(spark, 1234.5, lambda c: display.cell_text(c, F.lit(False)), "double") == "1,234"


def test_line_selection_ignores_case_of_accents(spark):
    names = spark.createDataFrame([("ÍNDICE DE BASILEIA",), ("Basileia Amplo",), ("x",)], "nome_linha string")
    kept = names.where(line_regex("(?iu)índice|basileia", "(?iu)amplo")).collect()
    assert [r.nome_linha for r in kept] == ["ÍNDICE DE BASILEIA"]


@pytest.mark.parametrize("pattern,hits", [
    ("%atrim%nio L%", {"Patrimônio Líquido", "Patrimonio L"}), ("%apital N%vel I", {"Capital Nível I"}),
    ("Ativo Total", {"Ativo Total"}), ("%asileia%", {"Basileia"}),
])
def test_guarded_like_is_like(spark, pattern, hits):
    names = ["Patrimônio Líquido", "Patrimonio L", "nio L atrim", "Capital Nível I", "Capital Nível II",
             "Ativo Total", "Ativo Total X", "Basileia"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r.n for r in frame.where(text.like_sql("n", pattern)).collect()}
    assert found == {r.n for r in frame.where(F.col("n").like(pattern)).collect()} == hits
