"""Shared folder, stored intermediate tables and small column helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.sinks.shared import new_path

#: What separates words: the six ASCII white-space characters.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(docs: DataFrame, *without: str) -> Column:
    """The columns of ``docs`` as one struct, whatever their names; beside it operators name columns as they like."""
    names = [c for c in docs.columns if c not in without]
    return F.struct(*[F.col(f"`{c}`") for c in names], *([] if names else [F.lit(0).alias("none")])).alias("own")


def text_of(column: str = "text") -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Per Arrow batch the named columns as Python lists, batches without rows left out."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
