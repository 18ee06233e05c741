"""Stored tables whose rows lie in buckets of their entity.

Grouping, joining or ranking by entity (and anything else beside it) then needs no shuffle,
over all periods and reports: a bucket holds all rows of its entities. It suits tables in
which an entity has few rows a period, as report lines are bounded by the layouts; rows of
one entity are read by one task. Balances, whose number of lines per institution nothing
bounds, stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from prudentia.schemas import REPORT_VALUES, TABLES, TableSpec
from prudentia.sinks.warehouse import Warehouse, write_options

#: What rows are dealt by, for each table that may lie in buckets.
BUCKET_BY = {REPORT_VALUES.name: "cod_conglomerado"}
PARTITIONS_NOTED = "spark.sql.hive.manageFilesourcePartitions"


class BucketedWarehouse(Warehouse):
    """A warehouse that keeps the tables in ``buckets`` by entity, in so many buckets each.

    The number of buckets is part of a table's folder: another number starts another table.
    It bounds the tasks that read the table, and each partition has up to so many files.
    A table is declared in the session's catalog, where Spark looks for buckets; the files
    alone hold its rows, and any session that names the same root and number reads them.
    """

    def __init__(
        self, spark: SparkSession, root: str, buckets: Mapping[str, int] | int = 64
    ) -> None:
        super().__init__(spark, root)
        wanted = dict.fromkeys(BUCKET_BY, buckets) if isinstance(buckets, int) else dict(buckets)
        if unknown := wanted.keys() - BUCKET_BY.keys():
            raise ValueError(f"no bucket column for {sorted(unknown)}")
        self.buckets = wanted

    def path(self, spec: TableSpec) -> str:
        number = self.buckets.get(spec.name)
        return super().path(spec) + (f"_in_{number}" if number else "")

    def read(self, name: str) -> DataFrame:
        if name not in self.buckets:
            return super().read(name)
        table = self._declared(TABLES[name])
        self.spark.catalog.refreshTable(table)  # another session may have loaded since
        return self.spark.table(table).select(*TABLES[name].schema.names)

    def replace(self, spec: TableSpec, rows: DataFrame) -> None:
        if spec.name not in self.buckets:
            super().replace(spec, rows)
            return
        table, by = self._declared(spec), BUCKET_BY[spec.name]
        # As many tasks as buckets: each writes one file per partition.
        (
            rows.repartition(self.buckets[spec.name], by)
            .sortWithinPartitions(*spec.partition_by, *spec.sort_by)
            .select(*self.spark.table(table).columns)
            .write.insertInto(table, overwrite=True)
        )

    def _declared(self, spec: TableSpec) -> str:
        """The name of a table in the session's catalog; declaring it starts no job."""
        path = self.path(spec)
        name = f"{spec.name}_{zlib.crc32(path.encode()):08x}"
        if self.spark.catalog.tableExists(name):
            return name
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema)
        options = ", ".join(f"'{k}' '{v}'" for k, v in write_options(spec).items())
        # Partitions are found in the folder rather than noted in this session's catalog.
        noted = self.spark.conf.get(PARTITIONS_NOTED)
        self.spark.conf.set(PARTITIONS_NOTED, "false")
        try:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS ({options}) "
                f"PARTITIONED BY ({', '.join(spec.partition_by)}) CLUSTERED BY ({BUCKET_BY[spec.name]}) "
                f"INTO {self.buckets[spec.name]} BUCKETS LOCATION '{self.path(spec)}'"
            )
        finally:
            self.spark.conf.set(PARTITIONS_NOTED, noted)
        return name
