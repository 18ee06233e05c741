"""The stored tables as Parquet folders under one root."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.schemas import TABLES, TableSpec

# Names in the load log that are not report codes.
BALANCES_LOG, INDIVIDUAL_LOG, REGISTRY_LOG = "balancetes", "4010", "cadastro"
#: Behind the path of a table that is replaced as a whole: the one before, while it is replaced.
ASIDE = "_before"
OTHER_LOADS = (BALANCES_LOG, INDIVIDUAL_LOG, REGISTRY_LOG)


def write_options(spec: TableSpec) -> dict[str, str]:
    """Only partitions that are written are replaced; Bloom filters for lookups of entities.

    Files are sorted by the first of the lookup columns, so its row groups are found by their
    range; the filters let a lookup by any of them skip the row groups that lack the value.
    """
    filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in spec.lookup_by}
    return {"partitionOverwriteMode": "dynamic"} | filters


class Warehouse:
    """Filings backed by stored tables.

    Reports, documents and periods are folders, so the filters that queries
    put on them become partition filters. Tables are looked up on every use:
    a load in between is seen by the next query.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.name}"

    def file(self, path: str) -> tuple[Any, Any]:
        """The file system of a path and the path on it, for steps that need no job."""
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(context._jsc.hadoopConfiguration()), found

    def read(self, name: str) -> DataFrame:
        """A table in declared column order; empty when nothing was stored yet.

        A table that a failed load has put aside is read from there.
        """
        spec = TABLES[name]
        for path in (self.path(spec), self.path(spec) + ASIDE):
            try:
                stored = self.spark.read.schema(spec.schema).parquet(path)
            except AnalysisException as problem:
                if problem.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                return stored.select(*spec.schema.names)
        return self.spark.createDataFrame([], spec.schema)

    def replace(self, spec: TableSpec, rows: DataFrame) -> None:
        """Write ``rows`` in place of the partitions that they have.

        Rebalancing gathers a partition's rows into well-sized files and, unlike a
        hash repartition, lets Spark split a partition that holds most of the rows.
        """
        (
            rows.hint("rebalance", *spec.partition_by)
            .sortWithinPartitions(*spec.partition_by, *spec.sort_by)
            .write.mode("overwrite").options(**write_options(spec))
            .partitionBy(*spec.partition_by).parquet(self.path(spec))
        )

    @property
    def cadastro(self) -> DataFrame:
        return self.read("cadastro")

    @property
    def institution_mapping(self) -> DataFrame:
        return self.read("institution_mapping")

    @property
    def balancetes_top50(self) -> DataFrame:
        return self.read("balancetes_top50")

    @property
    def fetch_log(self) -> DataFrame:
        return self.read("fetch_log")

    @property
    def dead_letters(self) -> DataFrame:
        return self.read("dead_letters")

    @property
    def registry_periods(self) -> DataFrame:
        """Periods with a registry, from the load log."""
        loaded = (F.col("relatorio") == REGISTRY_LOG) & (F.col("row_count") > 0)
        return self.fetch_log.where(loaded).select("ano_mes").distinct()

    @property
    def report_periods(self) -> DataFrame:
        """Periods with lines of any report, from the load log: a few rows, not the facts."""
        loaded = ~F.col("relatorio").isin(*OTHER_LOADS) & (F.col("row_count") > 0)
        return self.fetch_log.where(loaded).select("ano_mes").distinct()

    @property
    def top50_periods(self) -> DataFrame:
        return self.balancetes_top50.select("ano_mes").distinct()

    def report_lines(self, *reports: str) -> DataFrame:
        lines = self.read("report_values")
        return lines.where(F.col("relatorio").isin(*reports)) if reports else lines

    def balances(self, documento: str | None = None) -> DataFrame:
        rows = self.read("balancetes_raw")
        return rows if documento is None else rows.where(F.col("documento") == documento)

    def create_views(self) -> None:
        """All tables as temporary views, for use from SQL."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
