"""Registry queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.constants import PEER_GROUPS
from prudentia.functions.display import MISSING, code_text
from prudentia.functions.text import commercial_name
from prudentia.operators.periods import at_period
from prudentia.sources.base import Filings

DETAILS = ("nome_conglomerado", "cnpj", "segmento", "cidade", "uf")


def list_institutions(
    filings: Filings, segmento: str | None = None, codes: Sequence[int] | None = None
) -> DataFrame:
    """Distinct institutions of the newest registry, by name.

    A segment of ``ALL`` and an empty code list mean no filter.
    """
    registry = at_period(filings.cadastro, None, of=filings.registry_periods)
    if segmento and segmento != "ALL":
        registry = registry.where(F.col("segmento") == segmento)
    if codes:
        registry = registry.where(F.col("cod_conglomerado").isin(*codes))
    return (
        registry.select("cod_conglomerado", "nome_conglomerado", "segmento")
        .distinct()
        .orderBy("nome_conglomerado", "cod_conglomerado")
    )


def institution_details(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """One row of registry details per institution, newest registry."""
    registry = at_period(filings.cadastro, None, of=filings.registry_periods)
    if cod_conglomerado is not None:
        registry = registry.where(F.col("cod_conglomerado") == cod_conglomerado)
    return (
        registry.groupBy("cod_conglomerado")
        .agg(F.min(F.struct(*DETAILS)).alias("details"))
        .select("cod_conglomerado", "details.*")
    )


def institution_options(
    filings: Filings, segmento: str | None = None, peer_group: str | None = None
) -> DataFrame:
    """Institutions to choose from: code and ``NAME (C0000001)``."""
    listed = list_institutions(filings, segmento, PEER_GROUPS.get(peer_group or "ALL"))
    label = F.concat(
        "nome_conglomerado", F.lit(" ("), code_text(F.col("cod_conglomerado")), F.lit(")")
    )
    return listed.select(F.col("cod_conglomerado").alias("value"), label.alias("label"))


def institution_card(filings: Filings, cod_conglomerado: int | None = None) -> DataFrame:
    """Registry details with the commercial name and the place as text."""
    city, state = F.col("cidade"), F.col("uf")
    place = F.when((city != "") & (state != ""), F.concat(city, F.lit("/"), state))
    return institution_details(filings, cod_conglomerado).select(
        "cod_conglomerado",
        commercial_name(F.col("nome_conglomerado")).alias("nome_comercial"),
        F.col("nome_conglomerado").alias("razao_social"), "segmento", "cnpj",
        F.coalesce(place, F.lit(MISSING)).alias("localizacao"),
    )
