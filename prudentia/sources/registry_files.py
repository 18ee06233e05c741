"""Registry files: institutions of a period and the individual mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import GROUP_CODE_BASE
from prudentia.functions import text
from prudentia.schemas import CADASTRO, INSTITUTION_MAPPING

REGISTRY_DDL = "c0 STRING, c2 STRING, c10 STRING, c11 STRING, c12 STRING"
INDIVIDUAL_DDL = "c0 STRING, c2 STRING, c15 STRING, c16 STRING"


def period_and_type(path: Column) -> tuple[Column, Column]:
    """``cadastro202412_1009.json`` names period 202412 and type 1009."""
    pattern = r"(\d{6})_(\d+)\.json$"
    return (
        F.regexp_extract(path, pattern, 1).try_cast("int"),
        F.regexp_extract(path, pattern, 2).try_cast("int"),
    )


def read_json_array(spark: SparkSession, paths: list[str] | str, ddl: str) -> DataFrame:
    """Elements of JSON arrays, with the file they came from and their order."""
    return (
        spark.read.schema(ddl).option("multiLine", True).json(paths)
        .select(
            "*", F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("pos"),
        )
    )


def registry(entries: DataFrame) -> DataFrame:
    """Registry rows; the group code stands in for institution and tax id."""
    period, kind = period_and_type(F.col("path"))
    code = F.col("c0").try_cast("int")

    def optional(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    return entries.select(
        period.alias("ano_mes"),
        code.alias("cod_conglomerado"),
        F.col("c2").alias("nome_conglomerado"),
        code.alias("cod_inst"),
        F.col("c2").alias("nome_inst"),
        F.col("c0").alias("cnpj"),
        optional("c12").alias("segmento"),
        kind.alias("tipo_instituicao"),
        optional("c11").alias("cidade"),
        optional("c10").alias("uf"),
    ).select(*CADASTRO.schema.names)


def read_registry(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return registry(read_json_array(spark, paths, REGISTRY_DDL))


def institution_mapping(entries: DataFrame) -> DataFrame:
    """Tax-id root to group, first entry of each root by ``pos``.

    Institutions outside any group are their own group under their tax id.
    """
    group = text.strip(F.col("c15"))
    code = F.when(group != "", group).otherwise(F.col("c0")).try_cast("int")
    row = F.struct(
        F.coalesce("c2", F.lit("")).alias("nome_inst"),
        (F.lit(GROUP_CODE_BASE) + code).alias("cod_conglomerado"),
        F.coalesce("c16", "c2", F.lit("")).alias("nome_conglomerado"),
    )
    return (
        entries.groupBy(F.lpad(F.coalesce("c0", F.lit("")), 8, "0").alias("cnpj8"))
        .agg(F.min_by(row, "pos").alias("m"))
        .select("cnpj8", "m.*")
        .select(*INSTITUTION_MAPPING.schema.names)
    )


def read_institution_mapping(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return institution_mapping(read_json_array(spark, paths, INDIVIDUAL_DDL))


def of_groups(mapping: DataFrame, codes: DataFrame) -> DataFrame:
    """Institutions of the wanted groups (``codes`` has ``cod_conglomerado``)."""
    return mapping.join(codes, "cod_conglomerado", "left_semi").select(*mapping.columns)
