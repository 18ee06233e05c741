"""What every query reads: six lazily built tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Filings(Protocol):
    """The tables behind the queries.

    ``report_lines`` and ``balances`` are methods so that a query names the
    reports or documents it needs and only those are read. ``registry_periods``,
    ``report_periods`` and ``top50_periods`` answer "which periods exist" without the
    tables' rows.
    """

    spark: SparkSession

    @property
    def cadastro(self) -> DataFrame: ...

    @property
    def institution_mapping(self) -> DataFrame: ...

    @property
    def balancetes_top50(self) -> DataFrame: ...

    @property
    def fetch_log(self) -> DataFrame: ...

    @property
    def registry_periods(self) -> DataFrame: ...

    @property
    def report_periods(self) -> DataFrame: ...

    @property
    def top50_periods(self) -> DataFrame: ...

    def report_lines(self, *reports: str) -> DataFrame: ...

    def balances(self, documento: str | None = None) -> DataFrame: ...
