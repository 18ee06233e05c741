"""Physical plans: what is scanned, shuffled and broadcast."""

from __future__ import annotations

import re

import pytest

from prudentia import schemas
from prudentia.plans import income, institutions, rankings, ratios, report_lines, tables
from prudentia.operators.pivot import cell_at, unfolded
from prudentia.sinks import load
from prudentia.sources.lineitem import LineitemFilings
from registered import plans as registered
from tests.builders import A, balance, frame, institution, line, mapping

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(query(spark, SF_DIR)) for name, query in registered.registered().items() if name not in LOADS}


def test_no_nested_loops_and_no_python(plans):
    for name, text in plans.items():
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas"):
            assert unwanted not in text, name


def test_windows_are_partitioned(plans):
    """A window without keys would bring its whole input to one task."""
    for name, text in plans.items():
        for window in re.findall(r"Window \[.*", text):
            assert not re.search(r"\], \[[^\]]*(ASC|DESC)[^\]]*\]$", window) or window.count("], [") == 2, name


def test_top_n_is_limited_before_the_shuffle(plans):
    for name in ("top50_balances", "top50_reports", "segment_ranking_by_period",
                 "ratio_ranking_by_period"):
        assert plans[name].count("WindowGroupLimit") >= 2, name


def test_shares_read_lines_and_registry_once(plans):
    text = plans["market_share_by_period"]
    # order lines stand for the report lines and for the registry's periods
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_", text)) == 2
    assert "share_part" in text and "share_part" in plans["market_share"]


def test_listings_read_the_registry_once(plans, stored):
    for name in ("list_institutions", "entity_details", "institution_cards"):
        assert plans[name].count("nation.parquet") == 1, name
    text = plan(institutions.list_institutions(stored))
    scans = re.findall(r"FileScan parquet .*", text)
    assert sum("/cadastro" in scan for scan in scans) == 1
    assert re.search(r"PartitionFilters: \[[^\]]*ano_mes[^\]]*[Ss]ubquery", text)


def test_latest_comparison_computes_lines_once(spark):
    found = report_lines.latest_comparison(LineitemFilings(spark, SF_DIR), None, "Índice de Basileia", "5")
    rows = found.collect()
    assert rows and len({r.ano_mes for r in rows}) == 1
    final = plan(found).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_ratios_take_one_scan_and_one_shuffle_of_lines(plans):
    text = plans["financial_ratios"]
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 2  # one of them derives the lines


def test_income_chain_shuffles_twice(plans):
    for name in ("cosif_dre_level2", "dre_monthly", "dre_subtotals", "dre_12m", "dre_table"):
        assert plans[name].count("Exchange hashpartitioning") == 2, name


def test_scans_read_needed_columns_only(plans):
    schema = re.search(r"ReadSchema: (.*)", plans["key_violations"]).group(1)
    assert "l_extendedprice" not in schema and "l_suppkey" in schema
    schema = re.search(r"FileScan parquet \[([^\]]*)", plans["parsed_individual"]).group(1)
    assert "l_returnflag" not in schema and "l_suppkey" in schema


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from prudentia.sinks.warehouse import Warehouse

    store = Warehouse(spark, str(tmp_path_factory.mktemp("plans")))
    registry = [institution(1, 10, p, cnpj=A) for p in (202403, 202406)]
    load.load_registry(store, frame(spark, schemas.CADASTRO, registry))
    lines = [line(1, 1.0, "Ativo Total", p, r) for p in (202403, 202406) for r in ("1", "4", "5")]
    load.load_report_values(store, frame(spark, schemas.REPORT_VALUES, lines))
    rows = [balance(A, 1.0, 202406), balance(A, 1.0, 202406, "7.1.0.00.00-8", "4010")]
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, rows))
    load.load_mapping(store, frame(spark, schemas.INSTITUTION_MAPPING, [mapping("11111111", 1)]))
    return store


def test_reports_and_documents_become_partition_filters(stored):
    text = plan(report_lines.capital_lines(stored, 1))
    partition = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "relatorio" in partition
    assert "EqualTo(cod_conglomerado,1)" in text
    text = plan(income.level2_income(stored, 1))
    assert re.search(r"PartitionFilters: \[[^\]]*documento[^\]]*4010", text)
    assert "BroadcastHashJoin" in text


def test_newest_period_is_a_partition_filter(stored):
    text = plan(rankings.top50(stored))
    assert re.search(r"PartitionFilters: \[[^\]]*ano_mes[^\]]*[Ss]ubquery", text)
    assert rankings.ratio_ranking(stored, "roe").count() == 0
    assert ratios.financial_ratios(stored, 1).count() == 2


LOADS = {"repaired_store", *(n for n in registered.QUERIES if n.startswith("loaded_"))}


def test_building_queries_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "planning only")
    try:
        for name, query in registered.registered().items():
            if name not in LOADS:
                query(spark, SF_DIR)
        assert not tracker.getJobIdsForGroup("built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_wide_tables_hold_the_periods_present(spark, store):
    filed = [line(1, v, "Ativo Total", p, "1", n) for p, v, n in (
        (202406, 3.0, 1), (198903, 1.0, 2), (198903, 2.0, 1), (202403, None, 1))]
    load.load_report_values(store, frame(spark, schemas.REPORT_VALUES, filed))
    table = tables.report_table(store, "1")
    assert [tuple(c) for c in table.first().celulas] == [(198903, 2.0), (202403, None), (202406, 3.0)]
    assert table.select(cell_at("ano_mes", 202406), cell_at("ano_mes", 202412)).first()[:] == (3.0, None)
    rows = [tuple(r) for r in unfolded(table).collect()]
    assert rows[0] == (1, "Ativo Total", 1, 198903, 2.0) and [r[2] for r in rows] == [1, 2, 3]
    shown = ratios.ratio_table(store)
    assert shown.schema == ratios.ratio_table(entry_filings(spark)).schema
    assert shown.count() == 15 and [c.ano_mes for c in shown.first().celulas] == [198903, 202403, 202406]
    assert tables.report_table(store, "5").count() == 0
    assert tables.report_table(store, "5", [202406]).columns == ["cod_conglomerado", "nome_linha", "p202406"]


def entry_filings(spark):
    return LineitemFilings(spark, SF_DIR)
