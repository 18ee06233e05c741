"""Monthly balance files: consolidated (4040) and individual (4010).

Parsing works on plain DataFrames of lines or fields, so that files, archives
and streams share it. Numbers that cannot be read become NULL and are left to
the not-null rules of the table instead of failing the whole job.
"""

from __future__ import annotations

import io
import itertools
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.functions import text
from prudentia.schemas import BALANCETES_RAW

FIELDS = ("cnpj", "nome_inst", "atributo", "documento", "conta", "nome_conta", "saldo_txt")
FIELDS_DDL = ", ".join(f"{name} STRING" for name in FIELDS)
LINES_DDL = "path STRING, line_no INT, line STRING, error STRING"
FILE_COLUMNS = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

CONSOLIDATED, INDIVIDUAL = "4040", "4010"
METADATA_LINES = 3
LINES_PER_BATCH = 20_000
#: File systems that tasks open by path, for reads of parts of a file.
OPENED_BY_PATH = ("file", "hdfs", "viewfs", "s3", "s3a", "gs")
#: Members up to this size are unpacked in memory; larger ones in pieces.
HELD_BYTES, READ_BYTES = 64 << 20, 1 << 20

# --- fixed values: field positions in the individual file ---
CNPJ_AT, NAME_AT, ACCOUNT_AT, ACCOUNT_NAME_AT, BALANCE_AT = 2, 4, 8, 9, 10


def period_of_file(path: Column) -> Column:
    """Period in the file name: ``202501.zip``, ``b202501.zip``, ``202501-4010-…``."""
    name = F.substring_index(path, "/", -1)
    return F.left(F.ltrim(name, F.lit("b")), F.lit(6)).try_cast("int")


# --- lines ---


def stripped(text_lines: Iterable[str]) -> Iterator[str]:
    """Lines of a text without its outer white space, a line at a time.

    Blank lines are held back until another one follows. The further line ends that
    a published line may hold end lines, too.
    """
    last, blank = None, 0
    for line in (part for text_line in text_lines for part in text_line.splitlines()):
        if not line.strip():
            blank += last is not None
            continue
        if last is None:
            line = line.lstrip()
        else:
            yield last
            yield from itertools.repeat("", blank)
        last, blank = line, 0
    if last is not None:
        yield last.rstrip()


def _opened(path: str, content: bytes | None) -> BinaryIO:
    """An archive to seek in: through its file system, or in memory where it came as content."""
    if content is not None:
        return io.BytesIO(content)
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return system.open_input_file(inner)


def member_lines(file: BinaryIO) -> Iterator[str]:
    """Lines of the first CSV member of an archive.

    The directory and the member are read where they stand, piece by piece; the archive is
    never held. A damaged member fails before its first line: one of moderate size is
    unpacked once and checked, a larger one is read to its end first.
    """
    with zipfile.ZipFile(file) as archive:
        members = [m for m in archive.infolist() if m.filename.lower().endswith(".csv")]
        if not members:
            raise ValueError("no CSV file in the archive")
        if members[0].file_size <= HELD_BYTES:
            member: BinaryIO = io.BytesIO(archive.read(members[0]))
        else:
            with archive.open(members[0]) as checked:
                while checked.read(READ_BYTES):
                    pass
            member = archive.open(members[0])
        with member:
            yield from stripped(io.TextIOWrapper(member, "latin1"))


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of each archive; a bad archive gives one row with its error."""
    for batch in batches:
        contents = batch["content"] if "content" in batch else itertools.repeat(None, len(batch))
        for path, content in zip(batch["path"], contents, strict=True):
            try:
                with _opened(path, content) as file:
                    numbered = enumerate(member_lines(file))
                    while part := list(itertools.islice(numbered, LINES_PER_BATCH)):
                        yield pd.DataFrame({
                            "path": path, "line_no": [n for n, _ in part],
                            "line": [line for _, line in part], "error": None,
                        })
            except (ValueError, zipfile.BadZipFile, zlib.error, EOFError) as problem:
                yield pd.DataFrame(
                    {"path": [path], "line_no": [-1], "line": [None], "error": [str(problem)]}
                )


def archives(files: DataFrame, landing: str) -> DataFrame:
    """Archives of a ``binaryFile`` listing, by path where tasks can open their file system.

    Elsewhere each comes with its content, which Spark limits to 2 GB a file.
    """
    scheme = landing.partition("://")[0] if "://" in landing else "file"
    return files.select("path") if scheme in OPENED_BY_PATH else files.select("path", "content")


def unpack_lines(listed: DataFrame) -> DataFrame:
    """Numbered lines of archives given by ``path``, or by ``path`` and ``content``.

    The only Python step of the package: Spark has no reader for ZIP members.
    Each archive is one row, so archives spread over all tasks.
    """
    return listed.mapInPandas(_unpack, LINES_DDL)


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    return unpack_lines(archives(spark.read.format("binaryFile").load(path), path))


def archive_errors(lines: DataFrame) -> DataFrame:
    """Archives that could not be read, for the quarantine."""
    return lines.where(F.col("error").isNotNull()).select("path", "error")


# --- consolidated balances ---


def consolidated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fields of unpacked consolidated files: the first seven by position."""
    return (
        spark.read.schema(FIELDS_DDL)
        .options(sep=";", header=True, encoding="ISO-8859-1", enforceSchema=True)
        .csv(path)
        .select("*", period_of_file(F.col("_metadata.file_path")).alias("ano_mes"))
    )


def consolidated_fields(lines: DataFrame) -> DataFrame:
    """Fields of consolidated lines; the first line of a file is its header.

    Generated, not projected, for the same reason as in ``parse_individual``.
    """
    fields = F.from_csv("line", F.lit(FIELDS_DDL), {"sep": ";"})
    return lines.where(F.col("error").isNull() & (F.col("line_no") > 0)).select(
        period_of_file(F.col("path")).alias("ano_mes"), F.inline(F.array(fields))
    )


def parse_consolidated(fields: DataFrame) -> DataFrame:
    """Balance rows of document 4040."""
    return (
        fields.where(F.col("documento") == CONSOLIDATED)
        .withColumns(
            {
                "saldo": text.parse_number(F.col("saldo_txt")),
                "cnpj8": text.cnpj8(F.col("cnpj")),
            }
        )
        .select(*BALANCETES_RAW.schema.names)
    )


# --- individual balances ---


def parse_individual(lines: DataFrame) -> DataFrame:
    """Balance rows of document 4010.

    Drops the metadata lines, blank and ``#`` lines, lines with too few fields,
    accounts that are not eight characters long and rows without a balance.
    """
    line = F.col("line")
    data = lines.where(
        F.col("error").isNull()
        & (F.col("line_no") >= METADATA_LINES)
        & (text.strip(line) != "")
        & ~line.startswith("#")
    ).select(
        period_of_file(F.col("path")).alias("ano_mes"),
        # As a generated column the fields are split once; filters on a projected
        # one would be pushed below it and split the line again for each test.
        F.explode(F.array(F.split(line, ";"))).alias("f"),
    )

    def field(position: int) -> Column:
        return text.strip(F.get("f", F.lit(position)))

    rows = data.where(F.size("f") > BALANCE_AT).select(
        "ano_mes",
        field(CNPJ_AT).alias("cnpj"),
        field(NAME_AT).alias("nome_inst"),
        F.lit("").alias("atributo"),
        F.lit(INDIVIDUAL).alias("documento"),
        field(ACCOUNT_AT).alias("code"),
        field(ACCOUNT_NAME_AT).alias("nome_conta"),
        field(BALANCE_AT).alias("saldo_txt"),
    )
    return (
        rows.where((F.length("code") == 8) & (F.col("saldo_txt") != ""))
        .withColumns(
            {
                "cnpj8": text.cnpj8(F.col("cnpj")),
                "conta": text.dotted_account(F.col("code")),
                "saldo": text.parse_number(F.col("saldo_txt")),
            }
        )
        .select(*BALANCETES_RAW.schema.names)
    )
