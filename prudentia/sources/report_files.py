"""Quarterly report files: period index, layouts, indicators and values.

All periods are assembled in one job. Layout and indicator files hold a few
dozen rows per period; only the entity values grow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import FIRST_DATA_INDICATOR, PRUDENTIAL_TYPE, REPORT_NAMES
from prudentia.functions.text import strip
from prudentia.schemas import REPORT_VALUES
from prudentia.sources.registry_files import read_json_array

INDEX_DDL = (
    "dt INT, files ARRAY<STRUCT<f: STRING, "
    "trel: STRUCT<id: INT, n: STRING, s: ARRAY<STRUCT<id: INT>>>>>"
)
LAYOUT_DDL = "id INT, n STRING, c ARRAY<STRUCT<ifd: BIGINT, o: INT>>"
INDICATOR_DDL = "id BIGINT, n STRING, a INT, lid BIGINT"
VALUES_DDL = "id INT, values ARRAY<STRUCT<e: INT, v: ARRAY<STRUCT<i: BIGINT, v: DOUBLE>>>>"


# --- period index ---


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one index file: dt, files."""
    return spark.read.schema(INDEX_DDL).option("multiLine", True).json(path)


def merge_indexes(indexes: Sequence[DataFrame]) -> DataFrame:
    """Files of each period; a period in several indexes takes the last one's."""
    parts = [
        index.where(F.col("dt").isNotNull()).select("dt", "files", F.lit(order).alias("source"))
        for order, index in enumerate(indexes)
    ]
    return (
        reduce(DataFrame.unionByName, parts).groupBy(F.col("dt").alias("ano_mes"))
        .agg(F.max_by("files", "source").alias("files"))
    )


def period_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The merged index of several files."""
    return merge_indexes([read_index(spark, path) for path in paths])


def index_periods(index: DataFrame) -> DataFrame:
    """Published periods, newest first."""
    return index.select("ano_mes").orderBy(F.desc("ano_mes"))


def _files(index: DataFrame) -> DataFrame:
    return index.select("ano_mes", F.posexplode("files").alias("pos", "file"))


def find_files(index: DataFrame, suffix: Column) -> DataFrame:
    """First file of each period whose path ends with ``suffix``."""
    return (
        _files(index).where(F.col("file.f").endswith(suffix))
        .groupBy("ano_mes").agg(F.min_by("file.f", "pos").alias("f"))
    )


def find_layouts(index: DataFrame, tipo: int = PRUDENTIAL_TYPE) -> DataFrame:
    """First layout of each period and report offered for an institution type."""
    names = F.array(*[
        F.struct(F.lit(code).alias("relatorio"), F.lit(name).alias("report_name"))
        for code, name in REPORT_NAMES.items()
    ])
    layout = F.col("file.trel")
    offered = F.exists(layout["s"], lambda selector: selector["id"] == tipo)
    return (
        _files(index).where(offered)
        .select("ano_mes", "pos", layout.alias("trel"), F.inline(names))
        .where(strip(F.col("trel.n")).startswith(F.col("report_name")))
        .groupBy("ano_mes", "relatorio").agg(F.min_by("trel.id", "pos").alias("trel_id"))
    )


def layout_files(index: DataFrame, tipo: int = PRUDENTIAL_TYPE) -> DataFrame:
    """Layout file of each period and report."""
    name = F.concat(
        F.lit("trel"), F.col("ano_mes"), F.lit("_"), F.col("trel_id"), F.lit(".json")
    )
    layouts = find_layouts(index, tipo).withColumn("suffix", name)
    return (
        _files(index).join(layouts, "ano_mes")
        .where(F.col("file.f").endswith(F.col("suffix")))
        .groupBy("ano_mes", "relatorio", "trel_id")
        .agg(F.min_by("file.f", "pos").alias("f"))
    )


# --- layout and indicators ---


def read_layouts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Columns of layout files named ``trel{period}_{layout}.json``."""
    pattern = r"(\d{6})_(\d+)\.json$"
    path = F.col("path")
    return (
        read_json_array(spark, paths, LAYOUT_DDL)
        .select(
            F.regexp_extract(path, pattern, 1).cast("int").alias("ano_mes"),
            F.regexp_extract(path, pattern, 2).cast("int").alias("trel_id"),
            F.posexplode("c").alias("pos", "c"),
        )
        .select("ano_mes", "trel_id", "pos", "c.ifd", F.coalesce("c.o", F.lit(0)).alias("o"))
    )


def read_indicators(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Indicators of files named ``info{period}.json``; a repeated id takes the last."""
    period = F.regexp_extract("path", r"(\d{6})\.json$", 1).cast("int")
    return (
        read_json_array(spark, paths, INDICATOR_DDL)
        .groupBy(period.alias("ano_mes"), "id")
        .agg(F.max_by(F.struct("n", "a", "lid"), "pos").alias("info"))
        .select("ano_mes", "id", "info.*")
    )


def layout_columns(layouts: DataFrame, indicators: DataFrame) -> DataFrame:
    """Data columns of each layout: name, indicator, value group and order.

    Metadata indicators, composite columns and unnamed ones are left out.
    """
    name = strip(F.get(F.split("n", "\n"), F.lit(0)))
    return (
        layouts.join(indicators.withColumnRenamed("id", "ifd"), ["ano_mes", "ifd"])
        .where(F.col("lid") >= FIRST_DATA_INDICATOR)
        .select(
            *[c for c in layouts.columns if c not in ("ifd", "o")],
            name.alias("nome"), "lid", F.coalesce("a", F.lit(1)).alias("grupo"),
            F.col("o").alias("ordenacao"),
        )
        .where(F.col("nome") != "")
    )


# --- values ---


def read_values(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entities of files named ``dados{period}_{group}.json``, values as an array."""
    pattern = r"(\d{6})_(\d+)\.json$"
    path = F.col("path")
    return (
        read_json_array(spark, paths, VALUES_DDL)
        .select(
            F.regexp_extract(path, pattern, 1).cast("int").alias("ano_mes"),
            F.regexp_extract(path, pattern, 2).cast("int").alias("grupo"),
            F.posexplode("values").alias("pos", "entity"),
        )
        .select("ano_mes", "grupo", "pos", "entity.e", "entity.v")
        .where(F.col("e") != 0)
    )


def entity_values(values: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per period and entity: its last value of each group and indicator.

    Indicators no report shows are folded into one NULL entry per group, which
    still tells that the entity filed the group. So what is collected is bounded
    by the layouts, however often a file repeats an entity.
    """
    shown = columns.select("ano_mes", F.col("lid").alias("i")).distinct().withColumn(
        "is_shown", F.lit(True)
    )
    entries = values.select(
        "ano_mes", "grupo", "e", "pos", F.posexplode_outer("v").alias("at", "entry")
    ).select(
        "ano_mes", "grupo", "e", "entry.i", "entry.v",
        (F.col("pos").cast("long") * F.lit(2**32) + F.coalesce("at", F.lit(0))).alias("turn"),
    )
    return (
        # A few dozen indicators per calendar month.
        entries.join(F.broadcast(shown), ["ano_mes", "i"], "left")
        .groupBy("ano_mes", "e", "grupo", F.when(F.col("is_shown"), F.col("i")).alias("i"))
        .agg(F.max_by("v", "turn").alias("v"))
        .groupBy("ano_mes", "e")
        .agg(F.array_sort(F.collect_list(F.struct("grupo", "i", "v"))).alias("parts"))
    )


def assemble_reports(columns: DataFrame, values: DataFrame, registry: DataFrame) -> DataFrame:
    """Every registered entity with every column of its reports.

    ``columns`` comes with ``relatorio``. Columns travel as one array per period
    and report and are expanded beside each entity, so nothing is cross-joined;
    a column without a value stays as NULL, and a later group overwrites an
    earlier one. A period without a registry keeps all entities, named by their
    code.
    """
    layouts = columns.groupBy("ano_mes", "relatorio").agg(
        F.array_sort(F.collect_list(F.struct("pos", "nome", "lid", "ordenacao"))).alias("cells"),
        F.collect_set("grupo").alias("groups"),
    )
    names = registry.groupBy("ano_mes", F.col("cod_conglomerado").alias("e")).agg(
        F.max("nome_conglomerado").alias("nome_registro")
    )
    registered = registry.select("ano_mes").distinct().withColumn("has_registry", F.lit(True))
    entities = (
        entity_values(values, columns)
        .join(names, ["ano_mes", "e"], "left")
        .join(F.broadcast(registered), "ano_mes", "left")  # one row per calendar month
        .where(F.col("nome_registro").isNotNull() | F.col("has_registry").isNull())
        # At most three layouts of a few dozen columns per calendar month; a
        # shuffle on the period alone would send a whole period to one task.
        .join(F.broadcast(layouts), "ano_mes")
        .withColumn(
            "used",
            F.filter("parts", lambda part: F.array_contains(F.col("groups"), part["grupo"])),
        )
        .where(F.size("used") > 0)
        .select(
            "ano_mes", "relatorio", "e", "nome_registro", "used", F.explode("cells").alias("cell")
        )
    )
    matching = F.filter("used", lambda part: part["i"] == F.col("cell.lid"))
    cell = F.col("cell")
    return entities.select(
        "ano_mes", "relatorio", F.col("e").alias("cod_conglomerado"),
        F.coalesce("nome_registro", F.col("e").cast("string")).alias("nome_conglomerado"),
        cell["lid"].cast("string").alias("codigo_coluna"),
        cell["nome"].alias("nome_coluna"),
        F.try_element_at(matching, F.lit(-1))["v"].alias("valor_a"),
        cell["nome"].alias("nome_linha"),
        cell["ordenacao"].alias("ordenacao"),
    ).select(*REPORT_VALUES.schema.names)
