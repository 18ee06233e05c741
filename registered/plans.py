"""Registered queries: library calls over the filings of one data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import CAPITAL, INCOME, KPI_ACCOUNTS, PEER_GROUPS, SUMMARY
from prudentia.functions import display, periods, text
from prudentia.operators.accounts import digit_repair_map
from prudentia.operators.lines import in_peer_group
from prudentia.operators.pivot import unfolded
from prudentia.operators.quality import key_violations, null_counts, split_valid
from prudentia.plans import balances, income, institutions, maintenance, rankings
from prudentia.plans import ratios, report_lines, tables
from prudentia.plans.rankings import ALL_PERIODS
from prudentia.schemas import BALANCETES_RAW, REPORT_VALUES
from prudentia.sinks import load
from prudentia.sinks.bucketed import BucketedWarehouse
from prudentia.sinks.shared import new_path
from prudentia.sinks.warehouse import Warehouse
from prudentia.sources import balance_files, registry_files, report_files
from prudentia.sources.lineitem import LineitemFilings

Query = Callable[[LineitemFilings], DataFrame]


# --- columns and checks over derived data ---


def scalar_columns(f: LineitemFilings) -> DataFrame:
    """Text functions over the balance rows."""
    rows = f.balances()
    amount = F.translate(F.format_number(F.col("saldo") / F.lit(100.0), 2), ",.", ".,")
    code = F.regexp_replace("conta", "[.-]", "")
    return rows.select(
        "cnpj", "conta", "ano_mes",
        text.parse_number(amount).alias("valor"),
        text.dotted_account(code).alias("conta_pontuada"),
        text.cnpj8(F.col("cnpj")).alias("raiz"),
        text.account_stem(F.col("conta")).alias("conta_base"),
        text.zero_digit_account(F.col("conta")).alias("conta_zero"),
        text.income_order(F.col("conta")).alias("ordem"),
    )


def period_columns(f: LineitemFilings) -> DataFrame:
    """Period functions over every balance month."""
    p = F.col("ano_mes")
    return f.balances().select("ano_mes").distinct().select(
        "ano_mes",
        periods.year(p).alias("ano"),
        periods.month(p).alias("mes"),
        periods.semester(p).alias("semestre"),
        periods.annualisation_factor(p).alias("fator"),
        periods.quarter_label(p).alias("rotulo"),
        periods.quarter_heading(p).alias("titulo"),
        periods.month_label(p).alias("rotulo_mes"),
    )


def name_columns(f: LineitemFilings) -> DataFrame:
    """Commercial names and code texts of every registry entry."""
    return f.cadastro.select(
        "ano_mes", "cod_conglomerado",
        text.commercial_name(F.col("nome_conglomerado")).alias("nome_comercial"),
        display.code_text(F.col("cod_conglomerado")).alias("codigo"),
    )


def display_columns(f: LineitemFilings) -> DataFrame:
    """Display texts of every report line."""
    value = F.col("valor_a")
    return f.report_lines().select(
        "ano_mes", "relatorio", "cod_conglomerado", "nome_linha",
        text.is_percent_line(F.col("nome_linha")).alias("percentual"),
        display.amount_text(value / F.lit(100.0)).alias("valor_texto"),
        display.percent_text(value).alias("percentual_texto"),
    )


def pending_periods(f: LineitemFilings) -> DataFrame:
    """Every balance month and report without loaded lines."""
    reports = F.explode(F.array(F.lit(SUMMARY), F.lit(INCOME), F.lit(CAPITAL)))
    wanted = f.balances().select("ano_mes").distinct().select(
        "ano_mes", reports.alias("relatorio")
    )
    return maintenance.pending(wanted, f.fetch_log)


def rejected_lines(f: LineitemFilings) -> DataFrame:
    """Lines that a table requiring a value would send to quarantine."""
    _, bad = split_valid(f.report_lines(), [*REPORT_VALUES.required, "valor_a"])
    return bad


# --- files derived from order lines ---


def _as_lines(rows: DataFrame, path: Column, line_no: Column, line: Column) -> DataFrame:
    """Lines as readers give them: generated, so that each is written once."""
    return rows.select(
        path.alias("path"), line_no.alias("line_no"), F.explode(F.array(line)).alias("line"),
        F.lit(None).cast("string").alias("error"),
    )


def _individual_text(f: LineitemFilings) -> DataFrame:
    """Lines of individual files; short, commented and empty ones included."""
    rows = f.source("lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5))
    amount = F.translate(F.format_number(cents / F.lit(100.0), 2), ",.", ".,")
    period = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    root = F.lpad(F.col("l_suppkey").cast("string"), 8, "0")
    code = F.concat(F.lit("71"), F.col("l_linenumber"), F.lit("0000"), F.lit("5"))
    fields = [
        F.lit("#BASE"), F.lit("4010"), F.concat(F.lit(" "), root, F.lit("0001 ")), F.lit("1"),
        F.lit("BANCO "), F.lit("1"), F.lit("GRUPO"), F.lit("T"),
        F.when(F.col("l_tax") == 0, F.left(code, F.lit(7))).otherwise(code),
        F.concat(F.lit("CONTA "), F.col("l_linenumber")),
        F.when(F.col("l_discount") == 0, F.lit(" ")).otherwise(amount),
    ]
    # Closed lines and those of 50 units are commented out, those of 49 lose their last field.
    comment = (F.col("l_linestatus") != "O") | (F.col("l_quantity") == 50)
    first = F.when(comment, fields[0]).otherwise(F.lit("BASE"))
    complete = F.concat_ws(";", first, *fields[1:])
    short = F.concat_ws(";", first, *fields[1:-1])
    return _as_lines(
        rows,
        F.concat(F.lit("/landing/"), period, F.lit("-4010-"), root, F.lit(".csv")),
        F.col("l_linenumber"),
        F.when(F.col("l_quantity") == 49, short).otherwise(complete),
    )


def parsed_individual(f: LineitemFilings) -> DataFrame:
    return balance_files.parse_individual(_individual_text(f))


def parsed_consolidated(f: LineitemFilings) -> DataFrame:
    """Consolidated file lines written from all balances and read back."""
    rows = f.balances()
    amount = F.translate(F.format_number(F.col("saldo") / F.lit(100.0), 2), ",.", ".,")
    lines = _as_lines(
        rows, F.concat(F.lit("/landing/b"), "ano_mes", F.lit(".csv")), F.lit(1),
        F.concat_ws(
            ";", "cnpj", F.concat(F.lit('"BANCO; '), "nome_inst", F.lit('"')), "atributo",
            "documento", "conta", "nome_conta", amount, F.lit("extra"),
        ),
    )
    return balance_files.parse_consolidated(balance_files.consolidated_fields(lines))


def parsed_mapping(f: LineitemFilings) -> DataFrame:
    """Individual registry of customers, many per nation: the first one stays."""
    balance = F.col("c_acctbal")
    entries = f.source("customer").select(
        F.col("c_nationkey").cast("string").alias("c0"),
        F.col("c_name").alias("c2"),
        F.when(balance < 0, F.lit(" ")).otherwise((F.col("c_custkey") % 7).cast("string"))
        .alias("c15"),
        F.when(balance < 5000, F.col("c_name")).alias("c16"),
        F.col("c_custkey").alias("pos"),
    )
    return registry_files.institution_mapping(entries)


def assembled_reports(f: LineitemFilings) -> DataFrame:
    """Entity values as filed (arrays per group) joined with a small layout.

    Entity 0 is the aggregate and skipped; group 2 overwrites indicator 101.
    """
    quantity = F.col("l_quantity").cast("long")
    sums = f.source("lineitem").groupBy(
        (F.year("l_shipdate") * 100 + F.quarter("l_shipdate") * 3).alias("ano_mes"),
        F.col("l_suppkey").cast("int").alias("e"),
    ).agg(
        F.sum(quantity).cast("double").alias("total"),
        F.sum(F.when(F.col("l_returnflag") == "R", quantity)).cast("double").alias("returned"),
        F.max(quantity).cast("double").alias("largest"),
    )

    def entry(indicator: int, value: str) -> Column:
        return F.struct(F.lit(indicator).cast("long").alias("i"), F.col(value).alias("v"))

    first = F.array(entry(101, "total"), entry(102, "returned"))
    second = F.when(F.col("largest") >= 48, F.array(entry(101, "largest"))).otherwise(
        F.array(entry(201, "largest"))
    )
    parts = F.array(
        F.struct(F.lit(1).alias("grupo"), F.lit(0).alias("pos"), first.alias("v")),
        F.struct(F.lit(2).alias("grupo"), F.lit(0).alias("pos"), second.alias("v")),
    )
    values = sums.where(F.col("e") != 0).select("ano_mes", "e", F.inline(parts))
    layout = F.array(*[
        F.struct(
            F.lit(report).alias("relatorio"), F.lit(pos).alias("pos"), F.lit(name).alias("nome"),
            F.lit(lid).cast("long").alias("lid"), F.lit(group).alias("grupo"),
            F.lit(order).alias("ordenacao"),
        )
        for report, pos, name, lid, group, order in (
            ("1", 0, "Ativo Total", 101, 1, 9),
            ("1", 1, "Captações", 102, 1, 14),
            ("5", 0, "Ativo Total", 101, 1, 1),
            ("5", 1, "Índice", 201, 2, 2),
        )
    ])
    columns = sums.select("ano_mes").distinct().select("ano_mes", F.inline(layout))
    return report_files.assemble_reports(columns, values, f.cadastro)


# --- published indexes, layouts and registries derived from orders ---


def _index(f: LineitemFilings) -> DataFrame:
    """Two indexes, of the quarters of shipping and of ordering, merged: the second wins."""
    quarter = F.col("dt")
    selector, layout = "array<struct<id: int>>", "struct<id: int, n: string, s: array<struct<id: int>>>"

    def file(*name: Column | str, trel: Column | None = None) -> Column:
        parts = [F.lit(x) if isinstance(x, str) else x for x in name]
        return F.struct(
            F.concat(*parts).alias("f"),
            (F.lit(None) if trel is None else trel).cast(layout).alias("trel"),
        )

    def offered(number: int, name: str, *kinds: int) -> Column:
        ids = F.array(*[F.struct(F.lit(k).alias("id")) for k in kinds]).cast(selector)
        return F.struct(F.lit(number).alias("id"), F.lit(name).alias("n"), ids.alias("s"))

    def entries(table: str, day: str, folder: str) -> DataFrame:
        # Capital is offered to the other type at the end of the year.
        capital = F.when(quarter % 100 == 12, offered(106, "Informações de Capital", 1006)).otherwise(
            offered(106, "Informações de Capital 4966", 1006, 1009))
        files = F.array(
            file(folder, "/cadastro", quarter, "_1009.json"),
            file("copy/cadastro", quarter, "_1009.json"),
            file(folder, "/trel", quarter, "_104.json", trel=offered(104, " Resumo ", 1009)),
            file(folder, "/trel", quarter, "_105.json", trel=offered(105, "Resumo 2", 1009)),
            file(folder, "/trel", quarter, "_106.json", trel=capital),
        )
        rows = f.source(table).select((F.year(day) * 100 + F.quarter(day) * 3).alias("dt"))
        return rows.distinct().select("dt", files.alias("files"))

    return report_files.merge_indexes(
        [entries("lineitem", "l_shipdate", "old"), entries("orders", "o_orderdate", "new")]
    )


def published_periods(f: LineitemFilings) -> DataFrame:
    """Every period of the merged index with its number of files and the first one."""
    return _index(f).select(
        "ano_mes", F.size("files").alias("n_files"), F.get("files", F.lit(0))["f"].alias("first_file")
    )


def period_files(f: LineitemFilings) -> DataFrame:
    """The registry file of every period."""
    suffix = F.concat(F.lit("cadastro"), F.col("ano_mes"), F.lit("_1009.json"))
    return report_files.find_files(_index(f), suffix)


def layout_columns(f: LineitemFilings) -> DataFrame:
    """Layouts of every quarter, a column for each line number, with their indicators."""
    number = F.col("l_linenumber")
    quarter = F.year("l_shipdate") * 100 + F.quarter("l_shipdate") * 3
    found = f.source("lineitem").groupBy(quarter.alias("ano_mes"), number.cast("int").alias("pos")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("o"))
    layouts = found.select("ano_mes", F.lit(104).alias("trel_id"), "pos", F.col("pos").cast("long").alias("ifd"), "o")
    name = F.when(F.col("pos") == 7, " \nsem nome").otherwise(F.concat(F.lit(" LINHA "), "pos", F.lit(" \nR$")))
    indicators = found.select(
        "ano_mes", F.col("pos").cast("long").alias("id"), name.alias("n"),
        F.when(F.col("pos") != 6, F.col("pos") % 3).alias("a"), (F.col("pos") + 98).cast("long").alias("lid"),
    )
    return report_files.layout_columns(layouts, indicators)


def parsed_registry(f: LineitemFilings) -> DataFrame:
    """Registry entries of suppliers: codes that are no numbers, missing cities and file names."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    entries = f.source("supplier").select(
        F.when(key % 10 == 0, F.concat(F.lit("C"), key)).otherwise(key.cast("string")).alias("c0"),
        F.col("s_name").alias("c2"),
        F.when(nation % 2 == 0, F.lit("SP")).alias("c10"),
        F.when(key % 3 > 0, F.concat(F.lit("CIDADE "), nation)).alias("c11"),
        F.when(nation % 5 > 0, F.concat(F.lit("S"), nation % 5)).alias("c12"),
        F.when(nation == 24, F.lit("/landing/cadastro.json")).otherwise(
            F.concat(F.lit("/landing/cadastro"), F.lit(202401) + nation % 12, F.lit("_1009.json"))).alias("path"),
    )
    return registry_files.registry(entries)


def peer_balances(f: LineitemFilings) -> DataFrame:
    """Customers dealt to the codes of one peer group and one code outside it."""
    codes = [*PEER_GROUPS["PEERS"], 1]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("c_custkey") % len(codes) + 1).cast("int"))
    return in_peer_group(f.source("customer").select("c_custkey", code.alias("cod_conglomerado")), "PEERS")


def target_members(f: LineitemFilings) -> DataFrame:
    """Institutions whose group has customers with a negative balance."""
    codes = f.source("customer").where(F.col("c_acctbal") < 0).select(
        (F.lit(1_000_000_000) + F.col("c_nationkey")).alias("cod_conglomerado")
    )
    return registry_files.of_groups(f.institution_mapping, codes)


# --- stored tables: loaded into the shared folder and read back ---


def _store(f: LineitemFilings) -> Warehouse:
    return Warehouse(f.spark, new_path(f.spark, "tables"))


def loaded_registry(f: LineitemFilings) -> DataFrame:
    """The registry, loaded over one that had other names and rows; with the log's row counts."""
    store = _store(f)
    load.load_registry(store, f.cadastro.where("segmento = 'S1'").withColumn("nome_inst", F.lit("OLD")))
    load.load_registry(store, f.cadastro)
    log = store.fetch_log.select("ano_mes", "row_count")
    return store.cadastro.join(log, "ano_mes")


def loaded_reports(f: LineitemFilings) -> DataFrame:
    """Report lines; report 5 was loaded before with other values and is replaced."""
    store = _store(f)
    load.load_report_values(store, f.report_lines(CAPITAL, INCOME).withColumn("valor_a", F.lit(-1.0)))
    load.load_report_values(store, f.report_lines(CAPITAL, SUMMARY))
    load.load_report_values(store, f.report_lines(INCOME))
    return store.report_lines()


def _with_balances(f: LineitemFilings) -> Warehouse:
    """Consolidated balances with their top 50, then the individual ones, which leave it alone."""
    store = _store(f)
    load.load_registry(store, f.cadastro)
    load.load_balances(store, f.balances().withColumn("saldo", F.lit(0.0)))
    load.load_balances(store, f.balances("4040"))
    load.load_individual_balances(store, f.balances("4010"))
    return store


def loaded_balances(f: LineitemFilings) -> DataFrame:
    return _with_balances(f).balances()


def loaded_top50(f: LineitemFilings) -> DataFrame:
    return _with_balances(f).balancetes_top50


def loaded_log(f: LineitemFilings) -> DataFrame:
    """What the load log has of balances, by period and kind."""
    return _with_balances(f).fetch_log.where(F.col("relatorio") != load.REGISTRY_LOG).select(
        "ano_mes", "relatorio", "row_count")


def loaded_mapping(f: LineitemFilings) -> DataFrame:
    store = _store(f)
    load.load_mapping(store, f.institution_mapping.withColumn("nome_inst", F.lit("OLD")))
    load.load_mapping(store, f.institution_mapping)
    return store.institution_mapping


def loaded_ratios(f: LineitemFilings) -> DataFrame:
    """Ratios of report lines that were loaded into buckets of their entity: read without a shuffle."""
    store = BucketedWarehouse(f.spark, new_path(f.spark, "tables"), 8)
    load.load_report_values(store, f.report_lines(CAPITAL).withColumn("valor_a", F.lit(-1.0)))
    load.load_report_values(store, f.report_lines(CAPITAL, SUMMARY, INCOME))
    return ratios.financial_ratios(store)


def repaired_store(f: LineitemFilings) -> DataFrame:
    """Balances stored as they came, with zero check digits, and then repaired where they stand."""
    store = _store(f)
    load.replace_partitions(store, BALANCETES_RAW, f.balances())
    load.repair_stored_accounts(store)
    return store.balances()


def _asset_trend(f: LineitemFilings) -> DataFrame:
    return balances.account_trend(f, conta=KPI_ACCOUNTS["Ativo Total"])


QUERIES: dict[str, Query] = {
    # registry
    "list_institutions": institutions.list_institutions,
    "list_institutions_segment": lambda f: institutions.list_institutions(f, segmento="S1"),
    "entity_details": institutions.institution_details,
    "institution_options": institutions.institution_options,
    "institution_cards": institutions.institution_card,
    "target_members": target_members,
    # report lines
    "institution_lines": report_lines.institution_lines,
    "capital_lines": report_lines.capital_lines,
    "summary_lines": report_lines.summary_lines,
    "dre_lines": report_lines.income_lines,
    "compare_entities": lambda f: report_lines.compare_institutions(
        f, None, "Ativo Total", SUMMARY
    ),
    "latest_comparison": lambda f: report_lines.latest_comparison(
        f, None, "Índice de Basileia", CAPITAL
    ),
    "report_periods": report_lines.report_periods,
    "report_lines": lambda f: report_lines.report_line_names(f, CAPITAL),
    "line_options": report_lines.line_options,
    "matching_lines": lambda f: report_lines.matching_lines(f, SUMMARY, "(?iu)ATIVO TOTAL|crédito"),
    "capital_series": lambda f: report_lines.line_series(
        f, CAPITAL, "(?iu)basileia", "(?iu)amplo"
    ),
    "headline_values": report_lines.headline_values,
    # rankings
    "segment_ranking": lambda f: rankings.segment_ranking(f, "Índice de Basileia", CAPITAL),
    "segment_ranking_s2": lambda f: rankings.segment_ranking(
        f, "Ativo Total", SUMMARY, ano_mes=200006, segmento="S2"
    ),
    "segment_ranking_by_period": lambda f: rankings.segment_ranking(
        f, "Ativo Total", SUMMARY, ALL_PERIODS, top_n=20
    ),
    "ratio_ranking": lambda f: rankings.ratio_ranking(f, "roe"),
    "ratio_ranking_by_period": lambda f: rankings.ratio_ranking(
        f, "leverage", ALL_PERIODS, top_n=20
    ),
    "ratio_ranking_capital": lambda f: rankings.ratio_ranking(f, "capital_excess", ALL_PERIODS),
    "ratio_ranking_tax": lambda f: rankings.ratio_ranking(f, "tax_rate", 199909, top_n=20),
    "market_share": rankings.market_share,
    "market_share_by_period": lambda f: rankings.market_share(f, ALL_PERIODS),
    # top 50
    "top50_balances": rankings.top_by_balances,
    "top50_reports": rankings.top_by_reports,
    "top50_latest": rankings.top50,
    "top50_periods": rankings.top50_periods,
    "equity_trend": rankings.equity_trend,
    "top50_kpis": lambda f: rankings.top50_kpis(f, ALL_PERIODS),
    "top50_kpi_table": lambda f: rankings.top50_kpi_table(f, ALL_PERIODS),
    "top50_enriched": lambda f: rankings.top50_enriched(f, ALL_PERIODS),
    "top50_enriched_table": rankings.top50_enriched_table,
    "bridged_institutions": lambda f: rankings.bridged_institutions(f, ALL_PERIODS),
    "top50_options": lambda f: rankings.top50_options(f, ALL_PERIODS),
    # balances
    "account_trend": balances.account_trend,
    "asset_trend": _asset_trend,
    "balance_ratios": balances.balance_ratios,
    # ratios
    "financial_ratios": ratios.financial_ratios,
    "latest_ratios": ratios.latest_ratios,
    "ratio_series": lambda f: ratios.ratio_series(f, "roe"),
    "ratios_pivot": lambda f: unfolded(ratios.ratio_table(f)),
    "ratio_texts": ratios.ratio_texts,
    # income statements
    "cosif_dre": income.detailed_income,
    "cosif_dre_level2": income.level2_income,
    "dre_monthly": income.monthly_income,
    "dre_subtotals": income.income_with_subtotals,
    "dre_12m": income.trailing_income,
    "dre_recent": income.recent_income,
    # tables
    "report_pivot": lambda f: unfolded(tables.report_table(f, CAPITAL)),
    "report_cells": lambda f: tables.report_cells(f, CAPITAL),
    "dre_pivot": lambda f: unfolded(tables.detailed_income_table(f)),
    "dre_table": tables.income_table,
    "year_quarter_pivot": lambda f: tables.year_quarter_table(f, CAPITAL, "abs"),
    "yoy": lambda f: tables.year_quarter_table(f, SUMMARY, "yoy"),
    "qoq": lambda f: tables.year_quarter_table(f, SUMMARY, "qoq"),
    "quarter_changes": lambda f: tables.quarter_changes(f, INCOME),
    # loading
    "repaired_accounts": maintenance.repaired_balances,
    "digit_repair_map": lambda f: digit_repair_map(f.spark, f.balances()),
    "pending_periods": pending_periods,
    "stored_row_counts": lambda f: maintenance.stored_row_counts(
        f.balances(), ["ano_mes", "documento"]
    ),
    "key_violations": lambda f: key_violations(f.balances(), ["ano_mes", "cnpj8", "conta"]),
    "null_counts": lambda f: null_counts(f.report_lines(), REPORT_VALUES.schema.names),
    "rejected_lines": rejected_lines,
    # stored tables
    "loaded_registry": loaded_registry,
    "loaded_reports": loaded_reports,
    "loaded_balances": loaded_balances,
    "loaded_top50": loaded_top50,
    "loaded_log": loaded_log,
    "loaded_mapping": loaded_mapping,
    "loaded_ratios": loaded_ratios,
    "repaired_store": repaired_store,
    # files
    "parsed_consolidated": parsed_consolidated,
    "parsed_individual": parsed_individual,
    "parsed_mapping": parsed_mapping,
    "assembled_reports": assembled_reports,
    "parsed_registry": parsed_registry,
    "published_periods": published_periods,
    "period_files": period_files,
    "report_layouts": lambda f: report_files.layout_files(_index(f)),
    "layout_columns": layout_columns,
    "peer_balances": peer_balances,
    # scalar functions
    "scalar_columns": scalar_columns,
    "period_columns": period_columns,
    "name_columns": name_columns,
    "display_columns": display_columns,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(LineitemFilings(spark, sf_dir))

    return {name: bind(query) for name, query in QUERIES.items()}
