"""Filings derived from the order tables.

A supplier is an institution, a ship month a balance period and a ship quarter
a report period. Amounts stay integer-valued doubles (cents times percent), so
that sums are exact in any order and both engines give the same bits.

Gaps come from the data itself: a quarter without a discount-free line files no
report 1, one without a line of 48 or more units files no report 5, and one
without a ten-percent discount files no report 4. Suppliers with a negative
balance are missing from the registry of the first and third quarters.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import CAPITAL, EQUITY, INCOME, SUMMARY

# Given schemas spare a job per read that would open a file to infer them.
SCHEMAS = {
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
        "c_mktsegment STRING"
    ),
    "orders": "o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
}

# Account by line number, for closed (consolidated) and open (individual) lines.
CONSOLIDATED_ACCOUNTS = (
    "6.0.0.00.00-2", "1.0.0.00.00-7", "7.0.0.00.00-9", "8.0.0.00.00-6",
    "1.6.0.00.00-1", "4.1.0.00.00-7", "6.0.0.00.00-0",
)
INDIVIDUAL_ACCOUNTS = (
    "7.1.0.00.00-8", "7.3.0.00.00-6", "7.7.0.00.00-2", "7.9.0.00.00-0",
    "8.1.0.00.00-5", "8.3.0.00.00-3", "7.1.1.00.00-5",
)

# Integer building blocks in SQL: cents, and discount and tax in percent.
CENTS = "floor(l_extendedprice * 100 + 0.5D)"
DISCOUNT = "floor(l_discount * 100 + 0.5D)"
TAX = "floor(l_tax * 100 + 0.5D)"
QUANTITY = "cast(l_quantity as bigint)"
MONTH = "year(l_shipdate) * 100 + month(l_shipdate)"
QUARTER = "year(l_shipdate) * 100 + quarter(l_shipdate) * 3"

SUMS = {
    "price": f"sum({CENTS})",
    "profit": f"sum({CENTS} * ({DISCOUNT} - 4))",
    "equity": f"sum(if(l_returnflag = 'A' and {TAX} >= 7, {CENTS} * {TAX}, 0))",
    "credit": f"sum(if(l_returnflag = 'A', {CENTS}, null))",
    "funding": f"sum(if(l_returnflag = 'R', {CENTS}, null))",
    "securities": f"sum(if(l_returnflag = 'N', {CENTS}, null))",
    "liabilities": f"sum(if(l_linestatus = 'F', {CENTS}, 0))",
    "quantity": f"sum({QUANTITY})",
    "lines": "count(1)",
    "pretax": f"sum({CENTS} * (5 - {TAX}))",
    "tax": f"sum(if({TAX} >= 3, -{CENTS} * {DISCOUNT}, null))",
    "files_1": f"max(if({DISCOUNT} = 0, 1, 0))",
    "files_4": f"max(if({DISCOUNT} = 10, 1, 0))",
    "files_5": f"max(if({QUANTITY} >= 48, 1, 0))",
}
MEAN = "cast(quantity as double) / cast(lines as double)"

# Report: (indicator, line name, value) in filing order.
LAYOUT = {
    SUMMARY: [
        (101, "Ativo Total", "price"),
        (102, "Lucro Líquido", "profit"),
        (103, "Patrimônio Líquido", "equity"),
        (104, "Carteira de Crédito", "credit"),
        (105, "Captações", "funding"),
        (106, "Títulos e Valores Mobiliários", "securities"),
        (107, "Passivo Exigível", "liabilities"),
        (108, "Patrimônio de Referência para Comparação", "quantity"),
    ],
    INCOME: [
        (401, "Resultado antes da Tributação, Lucro e Participação", "pretax"),
        (402, "Imposto de Renda e CSLL", "tax"),
        (403, "Participação nos Lucros", "profit"),
        (404, "Ativo Total", "price"),
    ],
    CAPITAL: [
        (501, "Índice de Basileia", f"{MEAN} * 0.005D"),
        (502, "Índice de Basileia Amplo", f"{MEAN} * 0.004D"),
        (503, "Índice de Capital Principal", f"{MEAN} * 0.003D"),
        (504, "Capital Nível I", f"{MEAN} * 0.0035D"),
        (505, "Razão de Alavancagem", f"{MEAN} * 0.002D"),
    ],
}


def _root(key: str) -> str:
    return f"lpad(cast({key} as string), 8, '0')"


def _supplier_name(key: str) -> str:
    return f"concat('Supplier#', lpad(cast({key} as string), 9, '0'))"


def _group_name(key: str) -> str:
    """Supplier name under one of five legal forms, as a regulatory group."""
    form = f"get(array(' S.A.', ' S/A', ' Ltda.', ' LTDA', ''), cast({key} % 5 as int))"
    return f"concat({_supplier_name(key)}, {form}, ' - PRUDENCIAL')"


def _pick(names: tuple[str, ...], position: str) -> str:
    listed = ", ".join(f"'{name}'" for name in names)
    return f"get(array({listed}), {position} - 1)"


def _cell(report: str, position: int, code: int, name: str, value: str) -> str:
    return (
        f"if(files_{report} = 1, named_struct('relatorio', '{report}', "
        f"'codigo_coluna', '{code}', 'nome_linha', '{name}', "
        f"'valor_a', cast({value} as double), 'ordenacao', {position}), null)"
    )


#: The registry lacks a supplier with a negative balance in the first and third quarter.
REGISTERED = "s_acctbal >= 0 or ano_mes % 100 in (6, 12)"


class LineitemFilings:
    """The six tables, computed from ``{sf_dir}/*.parquet`` on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self._dir = sf_dir

    def source(self, name: str) -> DataFrame:
        """One of the given tables."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.source("lineitem")

    def _active(self) -> DataFrame:
        """Suppliers and the quarters in which they have order lines."""
        return self._lines.selectExpr("l_suppkey as s_suppkey", f"{QUARTER} as ano_mes").distinct()

    @cached_property
    def registry_periods(self) -> DataFrame:
        """Quarters of the registry; places, which every supplier has, are left out."""
        both = self._active().join(self.source("supplier"), "s_suppkey")
        return both.where(REGISTERED).select("ano_mes").distinct()

    @cached_property
    def cadastro(self) -> DataFrame:
        registered = (
            self.source("supplier")
            .join(self.source("nation").withColumnRenamed("n_nationkey", "s_nationkey"),
                  "s_nationkey")
            .join(self.source("region").withColumnRenamed("r_regionkey", "n_regionkey"),
                  "n_regionkey")
        )
        both = self._active().join(registered, "s_suppkey").where(REGISTERED)
        return both.selectExpr(
            "ano_mes",
            "cast(s_suppkey as int) as cod_conglomerado",
            f"{_group_name('s_suppkey')} as nome_conglomerado",
            "cast(s_suppkey as int) as cod_inst",
            "s_name as nome_inst",
            f"concat({_root('s_suppkey')}, '000100') as cnpj",
            "concat('S', s_nationkey % 5 + 1) as segmento",
            "1009 as tipo_instituicao",
            "n_name as cidade",
            "left(r_name, 2) as uf",
        )

    @cached_property
    def institution_mapping(self) -> DataFrame:
        nations = self.source("nation").withColumnRenamed("n_nationkey", "s_nationkey")
        return self.source("supplier").join(nations, "s_nationkey").selectExpr(
            f"{_root('s_suppkey')} as cnpj8",
            "s_name as nome_inst",
            "1000000000 + s_nationkey as cod_conglomerado",
            "n_name as nome_conglomerado",
        )

    @cached_property
    def report_periods(self) -> DataFrame:
        files_any = f"{DISCOUNT} in (0, 10) or {QUANTITY} >= 48"
        return self._lines.where(files_any).selectExpr(f"{QUARTER} as ano_mes").distinct()

    @cached_property
    def top50_periods(self) -> DataFrame:
        return self.balances().where(F.col("conta") == EQUITY).select("ano_mes").distinct()

    def report_lines(self, *reports: str) -> DataFrame:
        """Report lines; naming reports computes only the sums those need."""
        sums = self._lines.groupBy("l_suppkey", F.expr(QUARTER).alias("ano_mes")).agg(
            *[F.expr(f"{total} as {name}") for name, total in SUMS.items()]
        )
        cells = ", ".join(
            _cell(report, position, *line)
            for report in (reports or tuple(LAYOUT))
            for position, line in enumerate(LAYOUT[report], start=1)
        )
        return (
            sums.selectExpr("l_suppkey", "ano_mes", f"explode(array({cells})) as c")
            .where("c is not null")
            .selectExpr(
                "ano_mes",
                "c.relatorio",
                "cast(l_suppkey as int) as cod_conglomerado",
                f"{_group_name('l_suppkey')} as nome_conglomerado",
                "c.codigo_coluna",
                "c.nome_linha as nome_coluna",
                "c.valor_a",
                "c.nome_linha",
                "c.ordenacao",
            )
        )

    def balances(self, documento: str | None = None) -> DataFrame:
        """One balance row per order line; several rows per account are summed
        by the queries, as they are for multi-branch filings."""
        lines = self._lines
        if documento is not None:
            lines = lines.where(f"l_linestatus {'=' if documento == '4040' else '<>'} 'F'")
        rows = lines.selectExpr(
            f"{MONTH} as ano_mes",
            f"{_root('l_suppkey')} as cnpj8",
            f"{_supplier_name('l_suppkey')} as nome_inst",
            "if(l_linestatus = 'F', '4040', '4010') as documento",
            f"if(l_linestatus = 'F', {_pick(CONSOLIDATED_ACCOUNTS, 'l_linenumber')}, "
            f"{_pick(INDIVIDUAL_ACCOUNTS, 'l_linenumber')}) as conta",
            "year(l_shipdate) as ano",
            f"cast({CENTS} * (100 - {DISCOUNT}) as double) as amount",
        )
        return rows.selectExpr(
            "ano_mes", "concat(cnpj8, '000100') as cnpj", "cnpj8", "nome_inst",
            "'A' as atributo", "documento", "conta",
            # The name carries the year, so that "latest name" is not any name.
            "concat_ws(' ', 'CONTA', left(conta, length(conta) - 2), ano) as nome_conta",
            "if(startswith(conta, '8.'), -amount, amount) as saldo",
        )

    @cached_property
    def balancetes_top50(self) -> DataFrame:
        from prudentia.plans.rankings import top_by_balances

        return top_by_balances(self)

    @cached_property
    def fetch_log(self) -> DataFrame:
        return self.report_lines().groupBy("ano_mes", "relatorio").agg(
            F.count(F.lit(1)).cast("int").alias("row_count")
        ).selectExpr("ano_mes", "relatorio", "cast(null as timestamp) as fetched_at", "row_count")
