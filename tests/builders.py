"""Small filings for tests with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prudentia import schemas
from prudentia.plans.rankings import top_by_balances
from prudentia.schemas import TableSpec


def frame(spark: SparkSession, spec: TableSpec, rows: list[dict]) -> DataFrame:
    names = spec.schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], spec.schema)


def institution(cod: int, inst: int, ano_mes: int, segmento: str = "S1", cnpj: str | None = None):
    return {
        "ano_mes": ano_mes, "cod_conglomerado": cod, "nome_conglomerado": f"BANCO {cod}",
        "cod_inst": inst, "nome_inst": f"BANCO {inst} SA", "cnpj": cnpj or f"{inst:014d}",
        "segmento": segmento, "tipo_instituicao": 1, "cidade": "SP", "uf": "SP",
    }


def line(cod: int, valor: float | None, nome: str, ano_mes: int, relatorio: str, ordem: int = 1):
    return {
        "ano_mes": ano_mes, "relatorio": relatorio, "cod_conglomerado": cod,
        "nome_conglomerado": f"BANCO {cod}", "codigo_coluna": "c1", "nome_coluna": "Coluna 1",
        "valor_a": valor, "nome_linha": nome, "ordenacao": ordem,
    }


def balance(
    cnpj: str, saldo: float, ano_mes: int = 202501, conta: str = "6.0.0.00.00-2",
    documento: str = "4040", nome_conta: str = "Patrimonio Liquido",
):
    return {
        "ano_mes": ano_mes, "cnpj": cnpj, "cnpj8": cnpj[:8], "nome_inst": f"BANCO {cnpj[:8]}",
        "atributo": "A", "documento": documento, "conta": conta, "nome_conta": nome_conta,
        "saldo": saldo,
    }


def mapping(cnpj8: str, cod: int, nome: str = "CONGLOM A"):
    return {"cnpj8": cnpj8, "nome_inst": "BANCO A", "cod_conglomerado": cod,
            "nome_conglomerado": nome}


class SmallFilings:
    """Filings over lists of rows; the top 50 comes from the balances."""

    def __init__(self, spark, registry=(), lines=(), balances=(), mappings=()) -> None:
        self.spark = spark
        self.cadastro = frame(spark, schemas.CADASTRO, list(registry))
        self._lines = frame(spark, schemas.REPORT_VALUES, list(lines))
        self._balances = frame(spark, schemas.BALANCETES_RAW, list(balances))
        self.institution_mapping = frame(spark, schemas.INSTITUTION_MAPPING, list(mappings))
        self.fetch_log = frame(spark, schemas.FETCH_LOG, [])

    @property
    def registry_periods(self):
        return self.cadastro.select("ano_mes").distinct()

    @property
    def report_periods(self):
        return self._lines.select("ano_mes").distinct()

    @property
    def top50_periods(self):
        return self.balancetes_top50.select("ano_mes").distinct()

    @property
    def balancetes_top50(self):
        return top_by_balances(self)

    def report_lines(self, *reports):
        return self._lines.where(self._lines.relatorio.isin(*reports)) if reports else self._lines

    def balances(self, documento=None):
        rows = self._balances
        return rows if documento is None else rows.where(rows.documento == documento)


# --- the filings whose answers are known ---


def two_entities(spark) -> SmallFilings:
    """Two entities in two quarters: capital in both, assets in the second."""
    registry = [institution(c, i, p, s) for p in (202403, 202406)
                for c, i, s in ((1, 10, "S1"), (2, 20, "S2"))]
    lines = []
    for p in (202403, 202406):
        lines += [
            line(1, 14.5, "Indice de Basileia", p, "5"), line(2, 12.3, "Indice de Basileia", p, "5"),
            line(1, 1000.0, "Patrimonio de Referencia", p, "5", 2),
            line(2, 800.0, "Patrimonio de Referencia", p, "5", 2),
        ]
    lines += [line(1, 500000.0, "Ativo Total", 202406, "1"),
              line(2, 300000.0, "Ativo Total", 202406, "1")]
    return SmallFilings(spark, registry, lines)


A, B, C = "11111111000100", "22222222000100", "33333333000100"


def kpi_filings(spark) -> SmallFilings:
    """Two bridged institutions, the first with all accounts and lines."""
    registry = [institution(1, 10, 202501, cnpj=A), institution(2, 20, 202501, "S2", cnpj=B)]
    balances, lines = [], []
    for p in (202501, 202502):
        balances += [
            balance(A, 5e6, p), balance(B, 3e6, p),
            balance(A, 20e6, p, "1.0.0.00.00-7"), balance(B, 15e6, p, "1.0.0.00.00-7"),
            balance(A, 8e6, p, "1.6.0.00.00-1"), balance(A, 12e6, p, "4.1.0.00.00-7"),
            balance(A, 8e5, p, "7.0.0.00.00-9"), balance(A, -3e5, p, "8.0.0.00.00-6"),
        ]
        lines += [
            line(1, 20e6, "Ativo Total", p, "1"), line(1, 8e6, "Carteira de Crédito", p, "1"),
            line(1, 12e6, "Captações", p, "1"), line(1, 5e5, "Lucro Líquido", p, "1"),
        ]
    return SmallFilings(spark, registry, lines, balances)


def combined_filings(spark) -> SmallFilings:
    """Balances in 202412 and 202501, reports only in 202412, one unbridged."""
    registry = [institution(1, 10, 202412, cnpj=A), institution(2, 20, 202412, "S2", cnpj=B)]
    balances = [balance(c, v, p) for p in (202412, 202501)
                for c, v in ((A, 5e6), (B, 3e6), (C, 1e6))]
    lines = []
    for cod, basileia, ativo, lucro in ((1, 14.5, 5e5, 8e4), (2, 12.3, 3e5, 5e4)):
        lines += [
            line(cod, basileia, "Indice de Basileia", 202412, "5"),
            line(cod, ativo, "Ativo Total", 202412, "1"),
            line(cod, lucro, "Lucro Liquido", 202412, "4"),
        ]
    return SmallFilings(spark, registry, lines, balances)


def income_filings(spark) -> SmallFilings:
    """Four months over two semesters, accumulated, seven accounts of level 2."""
    accounts = [
        ("7.1.0.00.00-8", (50000.0, 60000.0, 10000.0, 22000.0)),
        ("7.3.0.00.00-6", (10000.0, 12000.0, 2000.0, 4500.0)),
        ("7.7.0.00.00-2", (2500.0, 3000.0, 500.0, 1100.0)),
        ("7.9.0.00.00-0", (1500.0, 1800.0, 300.0, 650.0)),
        ("8.1.0.00.00-5", (-30000.0, -36000.0, -6000.0, -13000.0)),
        ("8.3.0.00.00-3", (-7500.0, -9000.0, -1500.0, -3200.0)),
        ("8.7.0.00.00-9", (-4000.0, -4800.0, -800.0, -1700.0)),
        ("7.1.1.00.00-5", (5000.0, 5000.0, 5000.0, 5000.0)),
    ]
    balances = [
        balance(A, amounts[i], p, conta, "4010", f"CONTA {conta[:3]}")
        for i, p in enumerate((202411, 202412, 202501, 202502)) for conta, amounts in accounts
    ]
    return SmallFilings(spark, balances=balances, mappings=[mapping("11111111", 1)])


def ratio_lines(cod: int, ano_mes: int, **changed: float) -> list[dict]:
    values = {"ativo": 10000.0, "lucro": 150.0, "pl": 1000.0, "carteira": 600.0,
              "captacoes": 1000.0, "tvm": 2000.0, "passivo": 9000.0, "pr": 500.0} | changed
    names = {
        "ativo": "Ativo Total", "lucro": "Lucro Liquido", "pl": "Patrimonio Liquido",
        "carteira": "Carteira de Credito", "captacoes": "Captacoes",
        "tvm": "Titulos e Valores Mobiliarios", "passivo": "Passivo Exigivel",
        "pr": "Referencia para Comparacao",
    }
    return [line(cod, values[k], n, ano_mes, "1") for k, n in names.items()]


def capital_ratio_lines(cod: int, ano_mes: int) -> list[dict]:
    names = {"Indice de Basileia": 0.15, "Indice de Capital Principal": 0.10,
             "Capital Nivel I": 0.12, "Razao de Alavancagem": 0.08}
    return [line(cod, v, n, ano_mes, "5") for n, v in names.items()]


def tax_lines(cod: int, ano_mes: int) -> list[dict]:
    return [line(cod, 1000.0, "Resultado antes da Tributacao", ano_mes, "4"),
            line(cod, -300.0, "Imposto de Renda e CSLL", ano_mes, "4")]
