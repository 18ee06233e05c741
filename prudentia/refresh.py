"""Loading published files from a landing folder.

    python -m prudentia.refresh reports    --landing L --warehouse W [--quarters N] [--force]
    python -m prudentia.refresh balances   --landing L --warehouse W [--months N] [--force]
    python -m prudentia.refresh individual --landing L --warehouse W [--months N] [--all] [--force]

A refresh reads what the load log does not have yet. Steps are independent: one
that fails is reported and the next one runs. Periods are, too: what a period lacks
or repeats is reported, and the others are loaded.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from prudentia.constants import INDIVIDUAL_TYPE, PEER_GROUPS, PRUDENTIAL_TYPE, REPORT_NAMES
from prudentia.functions.periods import monthly_periods
from prudentia.operators.quality import Incomplete, KeyViolation
from prudentia.plans.maintenance import pending
from prudentia.session import build_session
from prudentia.sinks import load
from prudentia.sinks.warehouse import Warehouse
from prudentia.sources import balance_files, registry_files, report_files

logger = logging.getLogger(__name__)

DEFAULT_QUARTERS, DEFAULT_MONTHS = 20, 24
BALANCES_LAG, INDIVIDUAL_LAG = 60, 180
INDEX_FILES = ("relatorios2000a2024.json", "relatorios2025a2030.json")


@dataclass(frozen=True)
class Step:
    """What one step did: rows loaded, what failed, and the periods that did.

    Without periods (None) it is not known what the failure left out.
    """

    name: str
    rows: int = 0
    error: str | None = None
    periods: tuple[int, ...] | None = ()


def _run(name: str, step: Callable[[], int]) -> Step:
    try:
        done = Step(name, step())
    except Exception as problem:  # whatever it was, the next step runs
        logger.exception("%s failed", name)
        periods = getattr(problem, "periods", None)
        return Step(name, getattr(problem, "rows", 0), str(problem), periods)
    logger.info("%s loaded %d rows", name, done.rows)
    return done


def _pending(
    store: Warehouse, periods: DataFrame, reports: Sequence[str], force: bool
) -> list[Row]:
    """Wanted pairs not in the load log; as many as periods asked for."""
    names = F.explode(F.array(*[F.lit(r) for r in reports]))
    wanted = periods.select("ano_mes", names.alias("relatorio"))
    return pending(wanted, store.fetch_log, force).collect()


# --- quarterly reports ---


def _paths(landing: str, store: Warehouse, found: DataFrame) -> tuple[list[str], dict[int, str]]:
    """Paths of the files found, a handful per period, and by period one that is not there."""
    paths, absent = [], {}
    for ano_mes, name in found.select("ano_mes", "f").distinct().orderBy("ano_mes", "f").collect():
        system, path = store.file(f"{landing}/{name}")
        if system.exists(path):
            paths.append(f"{landing}/{name}")
        else:
            absent[ano_mes] = name
    return paths, absent


def _without(rows: DataFrame, periods: Iterable[int]) -> DataFrame:
    return rows.where(~F.col("ano_mes").isin(*periods))


def _report_indexes(spark: SparkSession, landing: str) -> tuple[list[DataFrame], list[Step]]:
    """The index files that can be read, and a failed step for each other one."""
    indexes: list[DataFrame] = []
    failed = []
    for name in INDEX_FILES:
        def read(path: str = f"{landing}/{name}") -> int:
            indexes.append(report_files.read_index(spark, path))
            return 0

        step = _run(f"index {name}", read)
        if step.error:
            failed.append(replace(step, periods=()))  # periods are left out by name, if at all
    return indexes, failed


def refresh_reports(
    spark: SparkSession, landing: str, store: Warehouse,
    quarters: int = DEFAULT_QUARTERS, force: bool = False, tipo: int = PRUDENTIAL_TYPE,
    only: Sequence[int] | None = None,
) -> list[Step]:
    """Registry and the three reports of the newest periods in the index.

    ``only`` names the periods, which are then loaded again. A period with a missing
    file, a repeated key or no line of an offered report is named in the step's error and
    periods, as is one of ``only`` that no index has; the others are loaded in the same job.
    """
    indexes, failed = _report_indexes(spark, landing)
    if not indexes:
        return failed + ([Step("index", 0, "no index can be read", tuple(only))] if only else [])
    index = report_files.merge_indexes(indexes)
    newest = report_files.index_periods(index)
    newest = newest.limit(quarters) if only is None else newest.where(F.col("ano_mes").isin(*only))
    force = force or only is not None
    periods: list[int] = []

    def listed() -> int:
        periods.extend(r.ano_mes for r in newest.collect())
        if unlisted := set(only or ()) - set(periods):
            raise Incomplete(f"not in an index: {sorted(unlisted)}", len(periods), unlisted)
        return len(periods)

    listing = _run("index", listed)
    if listing.error:
        failed.append(listing)
        if not periods:
            return failed
    wanted_files = index.where(F.col("ano_mes").isin(*periods))

    def of_period(before: str, after: str) -> Column:
        return F.concat(F.lit(before), F.col("ano_mes"), F.lit(after))

    registry_files_found = report_files.find_files(
        wanted_files, of_period("cadastro", f"_{tipo}.json")
    )

    def registry() -> int:
        missing = [r.ano_mes for r in _pending(store, newest, [load.REGISTRY_LOG], force)]
        paths, absent = _paths(
            landing, store, registry_files_found.where(F.col("ano_mes").isin(*missing))
        )
        problems, rows, left_out = [f"{name} is missing" for name in absent.values()], 0, set(absent)
        if paths:
            try:
                rows = load.load_registry(store, registry_files.read_registry(spark, paths)).rows
            except KeyViolation as problem:
                problems, rows = [*problems, str(problem)], problem.rows
                left_out |= set(problem.periods or ())
        if problems:
            raise Incomplete("; ".join(problems), rows, left_out)
        return rows

    def reports() -> int:
        missing = _pending(store, newest, list(REPORT_NAMES), force)
        if not missing:
            return 0
        pairs = spark.createDataFrame(
            [(r.ano_mes, r.relatorio) for r in missing], "ano_mes int, relatorio string"
        )
        layouts = report_files.layout_files(wanted_files, tipo).join(
            pairs, ["ano_mes", "relatorio"], "left_semi"
        )
        offered = {(r.ano_mes, r.relatorio) for r in layouts.collect()}  # three a period
        layout_paths, absent = _paths(landing, store, layouts)
        due = wanted_files.where(F.col("ano_mes").isin(*{r.ano_mes for r in missing}))
        info_paths, without_info = _paths(
            landing, store, report_files.find_files(due, of_period("info", ".json"))
        )
        absent |= without_info
        if not layout_paths or not info_paths:
            _complain(absent, set(), 0)
            return 0
        columns = report_files.layout_columns(
            report_files.read_layouts(spark, layout_paths).join(
                layouts.drop("f"), ["ano_mes", "trel_id"]
            ),
            report_files.read_indicators(spark, info_paths),
        )
        groups = [r.grupo for r in columns.select("grupo").distinct().collect()]
        value_paths: list[str] = []
        for group in sorted(groups):
            found, without_values = _paths(
                landing, store,
                report_files.find_files(due, of_period("dados", f"_{group}.json")),
            )
            value_paths += found
            absent |= without_values
        columns = _without(columns, absent)
        registry_paths, _ = _paths(landing, store, registry_files_found)
        if not value_paths:
            _complain(absent, set(), 0)
            return 0
        registered = (
            registry_files.read_registry(spark, registry_paths) if registry_paths
            else store.cadastro.limit(0)
        )
        lines = report_files.assemble_reports(
            columns, report_files.read_values(spark, value_paths), registered
        )
        loaded = load.load_report_values(store, lines)
        empty = {pair for pair in offered - set(loaded.partitions) if pair[0] not in absent}
        _complain(absent, empty, loaded.rows)
        return loaded.rows

    def top50() -> int:
        return load.rebuild_top50(store, periods, source="reports")

    return [
        *failed, _run("registry", registry), _run("reports", reports), _run("top50", top50)
    ]


def _complain(absent: dict[int, str], empty: set[tuple[int, str]], rows: int) -> None:
    """Raise if periods lack a file, or reports have no line."""
    problems = [f"{name} is missing" for _, name in sorted(absent.items())]
    problems += [f"no lines of report {report} in {ano_mes}" for ano_mes, report in sorted(empty)]
    if problems:
        raise Incomplete("; ".join(problems), rows, {*absent, *(period for period, _ in empty)})


# --- monthly balances ---


def _archives(spark: SparkSession, landing: str, names: Sequence[str]) -> DataFrame:
    """Archives whose file name is one of ``names`` (``*`` allowed)."""
    pattern = "{" + ",".join(names) + "}"
    return balance_files.archives(
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(landing), landing
    )


def _load_archives(
    store: Warehouse, archives: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    into: Callable[[Warehouse, DataFrame], load.Loaded],
) -> int:
    """Unpack, parse and load; archives are opened again only if some failed."""
    lines, unreadable = balance_files.unpack_lines(archives), Observation()
    watched = lines.observe(unreadable, F.count("error").alias("archives"))
    rows = into(store, parse(watched)).rows
    if load.observed(unreadable, "archives"):
        errors = balance_files.archive_errors(lines).withColumn(
            "archive", F.substring_index("path", "/", -1)
        )
        load.quarantine(store, "archives", errors, ["archive"], "unreadable")
    return rows


def _consolidated(lines: DataFrame) -> DataFrame:
    return balance_files.parse_consolidated(balance_files.consolidated_fields(lines))


def refresh_balances(
    spark: SparkSession, landing: str, store: Warehouse,
    months: int = DEFAULT_MONTHS, force: bool = False, today: date | None = None,
    only: Sequence[int] | None = None,
) -> list[Step]:
    """Consolidated balances of the last months, from ``{period}.zip`` archives.

    ``only`` names the periods instead of counting months back.
    """
    missing = _wanted(spark, store, load.BALANCES_LOG, months, BALANCES_LAG, force, today, only)

    def balances() -> int:
        if not missing:
            return 0
        names = [f"{prefix}{p}.{ext}" for p in missing for prefix in ("", "b")
                 for ext in ("zip", "ZIP")]
        archives = _archives(spark, landing, names)
        return _load_archives(store, archives, _consolidated, load.load_balances)

    return [_run("balances", balances)]


def refresh_individual(
    spark: SparkSession, landing: str, store: Warehouse,
    months: int = DEFAULT_MONTHS, every_institution: bool = False, force: bool = False,
    today: date | None = None, only: Sequence[int] | None = None, peer_group: str = "PEERS",
) -> list[Step]:
    """Individual balances, from ``{period}-4010-{root}.ZIP`` archives.

    Institutions are those of the peer group's groups, or every mapped one.
    """
    missing = _wanted(
        spark, store, load.INDIVIDUAL_LOG, months, INDIVIDUAL_LAG, force, today, only
    )

    def mapping() -> int:
        names = f"{landing}/cadastro*_{INDIVIDUAL_TYPE}.json"
        entries = registry_files.read_json_array(spark, names, registry_files.INDIVIDUAL_DDL)
        newest = entries.select(F.max("path")).scalar()  # file names sort by period
        of_newest = entries.where(F.col("path") == newest)
        return load.load_mapping(store, registry_files.institution_mapping(of_newest))

    def balances() -> int:
        if not missing:
            return 0
        members = store.institution_mapping
        if not every_institution:
            members = members.where(F.col("cod_conglomerado").isin(*PEER_GROUPS[peer_group]))
        names = [f"{p}-4010-*.{ext}" for p in missing for ext in ("zip", "ZIP")]
        root = F.regexp_extract("path", r"-4010-(\w+)\.[^.]+$", 1)
        # Paths are joined, and the archives opened behind the join: of one that nobody
        # wants no byte is read, and no list of them comes to the driver.
        wanted = _archives(spark, landing, names).withColumn("cnpj8", root).join(
            members.select("cnpj8"), "cnpj8", "left_semi"
        ).drop("cnpj8")
        return _load_archives(
            store, wanted, balance_files.parse_individual, load.load_individual_balances
        )

    return [_run("mapping", mapping), _run("individual balances", balances)]


def _wanted(
    spark: SparkSession, store: Warehouse, log_name: str, months: int, lag: int,
    force: bool, today: date | None, only: Sequence[int] | None,
) -> list[int]:
    if only is not None:
        return sorted(only)
    periods = monthly_periods(spark, months, today, lag)
    return sorted(r.ano_mes for r in _pending(store, periods, [log_name], force))


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Load published files into the tables")
    parser.add_argument("kind", choices=("reports", "balances", "individual"))
    parser.add_argument("--landing", required=True)
    parser.add_argument("--warehouse", required=True)
    parser.add_argument("--quarters", type=int, default=DEFAULT_QUARTERS)
    parser.add_argument("--months", type=int, default=DEFAULT_MONTHS)
    parser.add_argument("--all", action="store_true", dest="every_institution")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)

    spark = build_session("prudentia-refresh")
    store = Warehouse(spark, args.warehouse)
    if args.kind == "reports":
        steps = refresh_reports(spark, args.landing, store, args.quarters, args.force)
    elif args.kind == "balances":
        steps = refresh_balances(spark, args.landing, store, args.months, args.force)
    else:
        steps = refresh_individual(
            spark, args.landing, store, args.months, args.every_institution, args.force
        )
    return int(any(step.error for step in steps))


if __name__ == "__main__":
    raise SystemExit(main())
