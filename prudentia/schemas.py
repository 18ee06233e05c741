"""Table contracts: columns, keys, required columns and physical layout.

Schemas are always passed to readers: ``relatorio`` and ``documento`` are
digit-only strings that partition inference would turn into integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "INT": T.IntegerType(), "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """``name TYPE, …`` as a schema; unlike ``fromDDL`` it needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


@dataclass(frozen=True)
class TableSpec:
    """One stored table: ``partition_by`` become folders, ``sort_by`` orders
    rows inside files so that row-group statistics skip most of them, and
    ``lookup_by`` columns get Bloom filters, for lookups of single values."""

    name: str
    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    lookup_by: tuple[str, ...] = ()


CADASTRO = TableSpec(
    "cadastro",
    _struct(
        "ano_mes INT, cod_conglomerado INT, nome_conglomerado STRING, cod_inst INT, "
        "nome_inst STRING, cnpj STRING, segmento STRING, tipo_instituicao INT, "
        "cidade STRING, uf STRING"
    ),
    partition_by=("ano_mes",),
    sort_by=("segmento", "cod_conglomerado"),
    key=("ano_mes", "cod_inst"),
    required=(
        "ano_mes", "cod_conglomerado", "nome_conglomerado", "cod_inst", "nome_inst",
        "cnpj", "segmento", "tipo_instituicao",
    ),
)

REPORT_VALUES = TableSpec(
    "report_values",
    _struct(
        "ano_mes INT, relatorio STRING, cod_conglomerado INT, nome_conglomerado STRING, "
        "codigo_coluna STRING, nome_coluna STRING, valor_a DOUBLE, nome_linha STRING, "
        "ordenacao INT"
    ),
    partition_by=("ano_mes", "relatorio"),
    sort_by=("cod_conglomerado", "ordenacao"),
    required=(
        "ano_mes", "relatorio", "cod_conglomerado", "nome_conglomerado",
        "codigo_coluna", "nome_coluna", "nome_linha", "ordenacao",
    ),
    lookup_by=("cod_conglomerado",),
)

FETCH_LOG = TableSpec(
    "fetch_log",
    _struct("ano_mes INT, relatorio STRING, fetched_at TIMESTAMP, row_count INT"),
    partition_by=("ano_mes", "relatorio"),
    key=("ano_mes", "relatorio"),
    required=("ano_mes", "relatorio", "row_count"),
)

BALANCETES_RAW = TableSpec(
    "balancetes_raw",
    _struct(
        "ano_mes INT, cnpj STRING, cnpj8 STRING, nome_inst STRING, atributo STRING, "
        "documento STRING, conta STRING, nome_conta STRING, saldo DOUBLE"
    ),
    partition_by=("ano_mes", "documento"),
    sort_by=("conta", "cnpj8"),
    required=(
        "ano_mes", "cnpj", "cnpj8", "nome_inst", "atributo", "documento",
        "conta", "nome_conta", "saldo",
    ),
    lookup_by=("cnpj8",),
)

INSTITUTION_MAPPING = TableSpec(
    "institution_mapping",
    _struct(
        "cnpj8 STRING, nome_inst STRING, cod_conglomerado INT, nome_conglomerado STRING"
    ),
    sort_by=("cnpj8",),
    key=("cnpj8",),
    required=("cnpj8", "nome_inst"),
)

BALANCETES_TOP50 = TableSpec(
    "balancetes_top50",
    _struct(
        "ano_mes INT, rank INT, cnpj8 STRING, nome_inst STRING, cod_conglomerado INT, "
        "nome_conglomerado STRING, patrimonio_liquido DOUBLE"
    ),
    partition_by=("ano_mes",),
    sort_by=("rank",),
    key=("ano_mes", "rank"),
    required=("ano_mes", "rank", "cnpj8", "nome_inst", "patrimonio_liquido"),
)

# Distinct accounts of every stored balance partition, kept by the loads: what
# they need to know about the whole history without reading it.
ACCOUNT_INDEX = TableSpec(
    "account_index",
    _struct("ano_mes INT, documento STRING, conta STRING"),
    partition_by=("ano_mes", "documento"),
    sort_by=("conta",),
    required=("ano_mes", "documento", "conta"),
)

# What a stream could not load and waits for: periods, or index files.
DEAD_LETTERS = TableSpec(
    "dead_letters",
    _struct("source STRING, item STRING, error STRING, noted_at TIMESTAMP"),
    partition_by=("source", "item"),
    key=("source", "item"),
    required=("source", "item", "error"),
)

TABLES = {
    spec.name: spec
    for spec in (
        CADASTRO, REPORT_VALUES, FETCH_LOG, BALANCETES_RAW,
        INSTITUTION_MAPPING, BALANCETES_TOP50, ACCOUNT_INDEX, DEAD_LETTERS,
    )
}

# Field names of the published records and the columns they become.
RECORD_ALIASES = {
    "CodConglomerado": "cod_conglomerado",
    "NomeConglomerado": "nome_conglomerado",
    "CodInst": "cod_inst",
    "NomeInst": "nome_inst",
    "CNPJ": "cnpj",
    "Segmento": "segmento",
    "TipoInstituicao": "tipo_instituicao",
    "Cidade": "cidade",
    "UF": "uf",
    "CodigoColuna": "codigo_coluna",
    "NomeColuna": "nome_coluna",
    "ValorA": "valor_a",
    "NomeLinha": "nome_linha",
    "Ordenacao": "ordenacao",
}
# Optional record fields and what an absent one becomes.
RECORD_DEFAULTS = {"cidade": "", "uf": ""}
