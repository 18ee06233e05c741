"""Replacing partitions of the stored tables.

Every load replaces whole partitions, so running it again gives the same table.
New files are staged and moved when the job commits; a lost executor only
repeats its tasks, and a load may read the table it is about to change.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from prudentia.operators.accounts import digit_repair_map, has_zero_digit, repair_accounts
from prudentia.operators.quality import KeyViolation, is_valid, key_violations, require_unique
from prudentia.plans.rankings import top_by_balances, top_by_reports
from prudentia.schemas import (
    ACCOUNT_INDEX,
    BALANCETES_RAW,
    BALANCETES_TOP50,
    CADASTRO,
    DEAD_LETTERS,
    FETCH_LOG,
    INSTITUTION_MAPPING,
    RECORD_ALIASES,
    RECORD_DEFAULTS,
    REPORT_VALUES,
    TableSpec,
)
from prudentia.sinks.warehouse import (
    ASIDE,
    BALANCES_LOG,
    INDIVIDUAL_LOG,
    REGISTRY_LOG,
    Warehouse,
)

INDIVIDUAL = "4010"
FIRST_ZERO_DIGIT_PERIOD = 202501


@dataclass(frozen=True)
class Loaded:
    """Rows stored and the partitions they went to."""

    rows: int
    partitions: tuple[tuple, ...]

    @property
    def periods(self) -> list[int]:
        return sorted({partition[0] for partition in self.partitions})


NOTHING = Loaded(0, ())


def from_records(records: DataFrame, spec: TableSpec) -> DataFrame:
    """Published field names to table columns, with defaults for optional ones."""
    named = records.withColumnsRenamed(
        {old: new for old, new in RECORD_ALIASES.items() if old in records.columns}
    )
    columns = []
    for field in spec.schema.fields:
        default = RECORD_DEFAULTS.get(field.name)
        value = F.col(field.name) if field.name in named.columns else F.lit(None)
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        columns.append(value.cast(field.dataType).alias(field.name))
    return named.select(*columns)


# --- partitions ---


def replace_partitions(store: Warehouse, spec: TableSpec, rows: DataFrame) -> list[Row]:
    """Replace the partitions present in ``rows``; return their keys.

    Rows that break a not-null rule go to the quarantine instead; when there are
    some, the input is read once more for them.
    """
    seen, checked = Observation(), Observation()
    typed = rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields]
    )
    valid = is_valid(spec.required)
    # Counting the rejects on the way costs nothing; they are computed again
    # only when there are some.
    counted = typed.observe(checked, F.count_if(~valid).alias("rejected"))
    keys = F.collect_set(F.struct(*spec.partition_by)).alias("partitions")
    store.replace(spec, counted.where(valid).observe(seen, keys))
    if observed(checked, "rejected"):
        quarantine(store, spec.name, typed.where(~valid), spec.partition_by, "not null")
    return observed(seen, "partitions") or []


def observed(observation: Observation, name: str) -> Any:
    """A metric of a finished write; None when the write had no task to run,
    in which case Spark reports no metrics at all."""
    try:
        return observation.get[name]
    except (KeyError, Py4JJavaError):
        return None


def clear_partitions(store: Warehouse, spec: TableSpec, keys: Sequence[tuple]) -> None:
    """Empty some partitions by deleting their folders; no job is run for it."""
    for key in keys:
        folder = "/".join(f"{c}={v}" for c, v in zip(spec.partition_by, key, strict=True))
        system, path = store.file(f"{store.path(spec)}/{folder}")
        system.delete(path, True)


def _in_partitions(spec: TableSpec, keys: Sequence[Row]) -> Column:
    """Rows of some (period, code) partitions, as one period list per code."""
    period, code = spec.partition_by
    periods_of: dict[str, list[int]] = {}
    for key in keys:
        periods_of.setdefault(key[code], []).append(key[period])
    tests = [
        (F.col(code) == value) & F.col(period).isin(*periods)
        for value, periods in periods_of.items()
    ]
    return reduce(or_, tests, F.lit(False))


def quarantine(
    store: Warehouse, name: str, rows: DataFrame, partition_by: Sequence[str], reason: str
) -> None:
    """Keep rejected rows beside the tables for inspection.

    Like the tables, rejects are replaced by partition and reason, so a repeated load
    keeps them once. Those of a partition that is clean by now stay until removed.
    """
    (
        rows.withColumns({"rejected_at": F.current_timestamp(), "reason": F.lit(reason)})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("reason", *partition_by).parquet(f"{store.root}/_quarantine/{name}")
    )


def _stored_counts(store: Warehouse, spec: TableSpec, periods: Sequence[int]) -> DataFrame:
    """Rows per stored partition of some periods; reads file footers only."""
    return (
        store.read(spec.name).where(F.col("ano_mes").isin(*periods))
        .groupBy(*spec.partition_by).agg(F.count(F.lit(1)).alias("row_count"))
    )


def _log(store: Warehouse, counts: DataFrame) -> int:
    """Record (period, report, rows) loads; returns the rows recorded."""
    recorded = counts.select(
        "ano_mes", "relatorio", F.col("row_count").cast("int"),
        F.current_timestamp().alias("fetched_at"),
    ).collect()  # one row per loaded partition
    if recorded:
        replace_partitions(
            store, FETCH_LOG,
            store.spark.createDataFrame(
                recorded, "ano_mes int, relatorio string, row_count int, fetched_at timestamp"
            ),
        )
    return sum(r.row_count for r in recorded)


def is_loaded(store: Warehouse, ano_mes: int, relatorio: str) -> bool:
    """Whether a period's report was loaded before."""
    hit = store.fetch_log.where(
        (F.col("ano_mes") == ano_mes) & (F.col("relatorio") == relatorio)
    )
    return not hit.isEmpty()


def note_failures(store: Warehouse, source: str, failures: dict[str, str]) -> None:
    """Record what a stream could not load, by item; a repeated failure is kept once."""
    if failures:
        rows = [(source, item, error) for item, error in sorted(failures.items())]
        replace_partitions(
            store, DEAD_LETTERS,
            store.spark.createDataFrame(rows, "source string, item string, error string")
            .withColumn("noted_at", F.current_timestamp()),
        )


def clear_failures(store: Warehouse, source: str, items: Iterable[str]) -> None:
    """Drop the notes of items that were loaded since."""
    clear_partitions(store, DEAD_LETTERS, [(source, item) for item in items])


# --- loads ---


def load_registry(store: Warehouse, rows: DataFrame) -> Loaded:
    """Replace the registry of the periods in ``rows``.

    A period in which a key repeats goes to the quarantine as a whole; the others are
    loaded before ``KeyViolation`` is raised. The input, a registry, is read once for
    the keys and once for the rows.
    """
    repeated = (
        key_violations(rows, CADASTRO.key).where(F.col("ano_mes").isNotNull())
        .groupBy("ano_mes").agg(F.min(F.struct(*CADASTRO.key)).alias("example"))
        .orderBy("ano_mes").collect()  # one row per calendar month
    )
    good = rows
    if repeated:
        bad = F.coalesce(F.col("ano_mes").isin(*[r.ano_mes for r in repeated]), F.lit(False))
        quarantine(store, CADASTRO.name, rows.where(bad), CADASTRO.partition_by, "key repeats")
        good = rows.where(~bad)
    keys = replace_partitions(store, CADASTRO, good)
    loaded = NOTHING
    if keys:
        counts = _stored_counts(store, CADASTRO, [k.ano_mes for k in keys])
        stored = _log(store, counts.withColumn("relatorio", F.lit(REGISTRY_LOG)))
        loaded = Loaded(stored, tuple(tuple(k) for k in keys))
    if repeated:
        examples = [tuple(r.example) for r in repeated]
        raise KeyViolation(
            f"{CADASTRO.name}: key {CADASTRO.key} repeats, e.g. {examples}", loaded.rows,
            [r.ano_mes for r in repeated],
        )
    return loaded


def load_report_values(store: Warehouse, rows: DataFrame) -> Loaded:
    """Replace the (period, report) pairs in ``rows``."""
    keys = replace_partitions(store, REPORT_VALUES, rows)
    if not keys:
        return NOTHING
    counts = _stored_counts(store, REPORT_VALUES, [k.ano_mes for k in keys]).where(
        _in_partitions(REPORT_VALUES, keys)
    )
    return Loaded(_log(store, counts), tuple(tuple(k) for k in keys))


def _index_accounts(store: Warehouse, balances: DataFrame) -> None:
    """Record the accounts of some partitions, given with all their rows."""
    accounts = balances.select(*ACCOUNT_INDEX.schema.names).distinct()
    replace_partitions(store, ACCOUNT_INDEX, accounts)


def _known_accounts(store: Warehouse) -> DataFrame:
    """Accounts seen in any stored balance. The index is built from the balances
    when there is none yet; afterwards no load reads the history again."""
    if store.read(ACCOUNT_INDEX.name).isEmpty():
        _index_accounts(store, store.balances())
    return store.read(ACCOUNT_INDEX.name)


@contextmanager
def _learned_repairs(store: Warehouse, balances: DataFrame) -> Iterator[DataFrame]:
    """The repair map of some balances, stored beside the tables while a load needs it.

    Read back, its size is known from the files before the join is planned: where the map
    is small, the balances are not shuffled by account, of which there are few.
    """
    folder = f"{store.root}/_digit_repairs-{uuid.uuid4().hex}"
    learned = digit_repair_map(store.spark, balances)
    try:
        learned.write.parquet(folder)
        yield store.spark.read.schema(learned.schema).parquet(folder)
    finally:
        system, path = store.file(folder)
        system.delete(path, True)


def _replace_balances(store: Warehouse, rows: DataFrame) -> list[Row]:
    """Repair accounts, replace the partitions and index their accounts."""
    with _learned_repairs(store, _known_accounts(store)) as repairs:
        keys = replace_partitions(store, BALANCETES_RAW, repair_accounts(rows, repairs))
    if keys:
        _index_accounts(store, store.balances().where(_in_partitions(BALANCETES_RAW, keys)))
    return keys


def load_balances(store: Warehouse, rows: DataFrame, scope: str = "period") -> Loaded:
    """Replace balances, repair their accounts and rebuild the top 50.

    With ``scope="period"`` a load replaces everything filed for its periods,
    also documents it does not bring; ``"document"`` leaves those alone.
    """
    if scope not in ("period", "document"):
        raise ValueError(f"scope must be 'period' or 'document', not {scope!r}")
    keys = _replace_balances(store, rows)
    if not keys:
        return NOTHING
    periods = sorted({k.ano_mes for k in keys})
    counts = _stored_counts(store, BALANCETES_RAW, periods)
    if scope == "period":
        present = {(r.ano_mes, r.documento) for r in counts.collect()}
        brought = {(k.ano_mes, k.documento) for k in keys}
        for spec in (BALANCETES_RAW, ACCOUNT_INDEX):
            clear_partitions(store, spec, sorted(present - brought))
        counts = _stored_counts(store, BALANCETES_RAW, periods)
    rebuild_top50(store, periods)
    stored = _log(
        store,
        counts.groupBy("ano_mes").agg(F.sum("row_count").alias("row_count"))
        .withColumn("relatorio", F.lit(BALANCES_LOG)),
    )
    return Loaded(stored, tuple(tuple(k) for k in keys))


def load_individual_balances(store: Warehouse, rows: DataFrame) -> Loaded:
    """Replace the individual balances of the periods; the top 50 stays."""
    individual = rows.where(F.col("documento") == INDIVIDUAL)
    keys = _replace_balances(store, individual)
    if not keys:
        return NOTHING
    counts = _stored_counts(store, BALANCETES_RAW, [k.ano_mes for k in keys]).where(
        F.col("documento") == INDIVIDUAL
    )
    stored = _log(store, counts.withColumn("relatorio", F.lit(INDIVIDUAL_LOG)))
    return Loaded(stored, tuple(tuple(k) for k in keys))


def load_mapping(store: Warehouse, rows: DataFrame) -> int:
    """Replace the whole mapping; an empty one is ignored.

    It is written beside the old one and then takes its place. The old one stays aside
    until then, and is read while there is no new one (see ``Warehouse.read``), so a
    load that fails at any step leaves a mapping. The input is also read for its keys.
    """
    if rows.isEmpty():
        return 0
    require_unique(rows, INSTITUTION_MAPPING)
    path = store.path(INSTITUTION_MAPPING)
    system, now = store.file(path)
    aside, after = store.file(path + ASIDE)[1], store.file(f"{path}_next")[1]
    rows.select(*INSTITUTION_MAPPING.schema.names).write.mode("overwrite").parquet(f"{path}_next")
    if system.exists(now):
        system.delete(aside, True)
        system.rename(now, aside)
    system.rename(after, now)
    system.delete(aside, True)
    return store.institution_mapping.count()


def rebuild_top50(
    store: Warehouse, periods: Sequence[int], source: str = "balances", n: int = 50
) -> int:
    """Recompute the top 50 of some periods from balances or from reports.

    Both sources fill the same table, so the last one to run for a period wins.
    """
    wanted = F.col("ano_mes").isin(*periods)
    if source == "balances":
        top = top_by_balances(store, n, balances=store.balances().where(wanted))
    elif source == "reports":
        top = top_by_reports(store, n, lines=store.report_lines("1").where(wanted))
    else:
        raise ValueError(f"source must be 'balances' or 'reports', not {source!r}")
    filled = {k.ano_mes for k in replace_partitions(store, BALANCETES_TOP50, top)}
    stored = _stored_counts(store, BALANCETES_TOP50, periods).collect()
    clear_partitions(
        store, BALANCETES_TOP50, [(r.ano_mes,) for r in stored if r.ano_mes not in filled]
    )
    return sum(r.row_count for r in stored if r.ano_mes in filled)


def repair_stored_accounts(store: Warehouse) -> int:
    """Repair zero check digits in everything stored; returns the rows changed.

    Only partitions with such rows are written and indexed again. Afterwards the top 50 of all periods since the digits were dropped is
    rebuilt in one job.
    """
    balances = store.balances()
    with _learned_repairs(store, balances) as repairs:
        changed = (
            balances.where(has_zero_digit(F.col("conta")))
            .join(repairs, F.col("conta") == F.col("zero_conta"), "left_semi")
            .groupBy("ano_mes", "documento").agg(F.count(F.lit(1)).alias("row_count"))
            .collect()  # one row per partition
        )
        if changed:
            affected = balances.where(_in_partitions(BALANCETES_RAW, changed))
            replace_partitions(store, BALANCETES_RAW, repair_accounts(affected, repairs))
    if changed:
        _index_accounts(store, store.balances().where(_in_partitions(BALANCETES_RAW, changed)))
    since = store.balances().where(F.col("ano_mes") >= FIRST_ZERO_DIGIT_PERIOD)
    periods = [r.ano_mes for r in since.select("ano_mes").distinct().collect()]
    if periods:
        rebuild_top50(store, periods)
    return sum(r.row_count for r in changed)
