"""File streams on the landing folder.

The stream only notices which periods got new files; each batch then reloads
those periods from the folder. Batches that are replayed after a failure, and
institutions that arrive late, therefore give the same table as one full load.

Progress is kept per period: a period that cannot be loaded is noted in the table of
dead letters, and its batch is finished. It is tried again when a file of it, or an
index, arrives. Only a failure that names no period fails the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prudentia.refresh import Step, refresh_balances, refresh_individual, refresh_reports
from prudentia.sinks import load
from prudentia.sinks.warehouse import Warehouse
from prudentia.sources.balance_files import FILE_COLUMNS, period_of_file

CONSOLIDATED_NAMES = "{??????.zip,??????.ZIP,b??????.zip,b??????.ZIP}"
REPORT_FILE_NAMES = "{relatorios,cadastro,info,trel,dados}*.json"
INDIVIDUAL_NAMES = "{*-4010-*.zip,*-4010-*.ZIP}"


def new_files(spark: SparkSession, landing: str, names: str) -> DataFrame:
    """Stream of file paths; contents are not read."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_COLUMNS)
        .option("pathGlobFilter", names).load(landing)
        .select("path", period_of_file(F.col("path")).alias("ano_mes"))
        .where(F.col("ano_mes").isNotNull())
    )


def failures_of(steps: Sequence[Step]) -> dict[str, str]:
    """What the steps left out, by period, or by the step's name if it names no period."""
    failures: dict[str, list[str]] = {}
    for step in steps:
        if step.error:
            for item in [str(p) for p in step.periods or ()] or [step.name]:
                failures.setdefault(item, []).append(step.error)
    return {item: "; ".join(errors) for item, errors in failures.items()}


def noted(store: Warehouse, source: str) -> set[str]:
    """Items of the stream that wait in the table of dead letters."""
    waiting = store.dead_letters.where(F.col("source") == source)
    return {r.item for r in waiting.select("item").collect()}  # periods and index files


def _watch(
    files: DataFrame, checkpoint: str, store: Warehouse, source: str,
    reload: Callable[[list, list[int]], list[Step]],
) -> StreamingQuery:
    """``reload`` gets the periods with new files (None: of an index) and those that wait."""

    def on_batch(batch: DataFrame, _: int) -> None:
        touched = [r.ano_mes for r in batch.select("ano_mes").distinct().collect()]
        if not touched:
            return
        before = noted(store, source)
        waiting = sorted(int(item) for item in before if item.isdigit())
        steps = reload(touched, waiting)
        unclear = [step for step in steps if step.error and step.periods is None]
        if unclear:
            raise RuntimeError(f"batch not loaded: {unclear}")  # the batch is retried
        failures = failures_of(steps)
        load.note_failures(store, source, failures)
        tried = {str(p) for p in touched if p is not None}
        if None in touched:  # everything that waited was tried again
            tried |= before
        load.clear_failures(store, source, sorted((tried & before) - set(failures)))

    return (
        files.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def watch_balances(
    spark: SparkSession, landing: str, store: Warehouse, checkpoint: str
) -> StreamingQuery:
    """Load consolidated archives not seen before, then stop."""
    files = new_files(spark, landing, CONSOLIDATED_NAMES)
    return _watch(
        files, checkpoint, store, "balances",
        lambda periods, _: refresh_balances(spark, landing, store, only=periods),
    )


def watch_reports(
    spark: SparkSession, landing: str, store: Warehouse, checkpoint: str
) -> StreamingQuery:
    """Load the quarterly files not seen before, then stop.

    Periods with a new file are loaded again. One that is incomplete, or in no index yet,
    is noted and loaded when its next file arrives. A new index also loads periods whose
    files came before it, and tries all that wait; one of the indexes may be missing.
    A file counts as new by its path, so an index that is replaced should come before
    the files that it names.
    """
    period = F.regexp_extract("path", r"(\d{6})(?:_\d+)?\.json$", 1).try_cast("int")
    files = (
        spark.readStream.format("binaryFile").schema(FILE_COLUMNS)
        .option("pathGlobFilter", REPORT_FILE_NAMES).option("recursiveFileLookup", True)
        .load(landing).select("path", period.alias("ano_mes"))
    )

    def reload(periods: list[int | None], waiting: list[int]) -> list[Step]:
        touched = {p for p in periods if p is not None}
        if None in periods:
            touched |= set(waiting)
        steps = refresh_reports(spark, landing, store, only=sorted(touched)) if touched else []
        if None in periods:
            steps += refresh_reports(spark, landing, store)
        return steps

    return _watch(files, checkpoint, store, "reports", reload)


def watch_individual(
    spark: SparkSession, landing: str, store: Warehouse, checkpoint: str,
    every_institution: bool = False,
) -> StreamingQuery:
    """Load individual archives not seen before, then stop."""
    files = new_files(spark, landing, INDIVIDUAL_NAMES)
    return _watch(
        files, checkpoint, store, "individual",
        lambda periods, _: refresh_individual(
            spark, landing, store, only=periods, every_institution=every_institution
        ),
    )
