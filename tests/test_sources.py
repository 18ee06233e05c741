"""Reading published files."""

from __future__ import annotations

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from prudentia.operators.quality import split_valid
from prudentia.schemas import BALANCETES_RAW, CADASTRO
from prudentia.sources import balance_files, registry_files, report_files
from tests.builders import frame, institution

CONSOLIDATED = (
    "CNPJ;NomeInst;Atrib;Documento;Conta;NomeConta;Saldo\n"
    "00000000000100;BANCO SÃO;A;4040;6.0.0.00.00-2;Patrimônio Líquido;1.234.567,89\n"
    "00000000000100;BANCO SÃO;A;4040;1.0.0.00.00-7;Ativo Total;-9.876.543,21;extra\n"
    '00000000000100;"BANCO; SÃO";A;4040;1.1.0.00.00-7;Outro;x\n'
    "99999999000100;OUTRO;A;7777;6.0.0.00.00-2;Patrimonio Liquido;100,00\n"
).encode("latin-1")

INDIVIDUAL = (
    "\n  BANCO CENTRAL\nBALANCETE\n202501\n"
    "#DATA_BASE;DOCUMENTO;CNPJ;AGENCIA;NOME;COD;NOME;TAX;CONTA;NOME_CONTA;SALDO\n"
    "202501;4010;12345678000199 ;1;BANCO É\xa0;1;G;T;71100001; RENDAS ;7.043.370,57;x\n"
    "202501;4010;12345678000199;1;BANCO É;1;G;T;7110000;SHORT ACCOUNT;1,00\n"
    "202501;4010;12345678000199;1;BANCO É;1;G;T;81000005;NO BALANCE; \n"
    "202501;4010;too;short\n"
    " \n"
    "202501;4010;12345678000199;1;BANCO É;1;G;T;81000005;DESPESAS;-5,5\r\n"
).encode("latin-1")


def _zip(path, members: dict[str, bytes]) -> None:
    with zipfile.ZipFile(path, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)


def _check_consolidated(rows):
    good, bad = split_valid(rows, BALANCETES_RAW.required)
    found = {r.conta: r for r in good.collect()}
    assert set(found) == {"6.0.0.00.00-2", "1.0.0.00.00-7"}
    row = found["6.0.0.00.00-2"]
    assert (row.ano_mes, row.cnpj8, row.saldo) == (202501, "00000000", 1234567.89)
    assert (row.nome_inst, row.nome_conta) == ("BANCO SÃO", "Patrimônio Líquido")
    assert found["1.0.0.00.00-7"].saldo == -9876543.21
    # a number that cannot be read is kept apart, not an error
    assert [(r.nome_inst, r.saldo) for r in bad.collect()] == [("BANCO; SÃO", None)]


def test_consolidated_csv(spark, tmp_path):
    (tmp_path / "202501.csv").write_bytes(CONSOLIDATED)
    fields = balance_files.consolidated_csv(spark, str(tmp_path))
    _check_consolidated(balance_files.parse_consolidated(fields))


def test_consolidated_archive(spark, tmp_path):
    _zip(tmp_path / "b202501.zip", {"readme.txt": b"x", "DATA.CSV": CONSOLIDATED})
    lines = balance_files.archive_lines(spark, str(tmp_path))
    _check_consolidated(balance_files.parse_consolidated(balance_files.consolidated_fields(lines)))


def test_consolidated_header_only(spark, tmp_path):
    (tmp_path / "202501.csv").write_bytes(CONSOLIDATED.split(b"\n")[0] + b"\n")
    fields = balance_files.consolidated_csv(spark, str(tmp_path))
    assert balance_files.parse_consolidated(fields).count() == 0


def test_archives_without_csv_are_reported(spark, tmp_path):
    _zip(tmp_path / "202501.zip", {"readme.txt": b"x"})
    (tmp_path / "202502.zip").write_bytes(b"not an archive")
    _zip(tmp_path / "202503.zip", {"a.csv": CONSOLIDATED})
    lines = balance_files.archive_lines(spark, str(tmp_path))
    errors = {r.path[-10:]: r.error for r in balance_files.archive_errors(lines).collect()}
    assert set(errors) == {"202501.zip", "202502.zip"}
    assert "no CSV" in errors["202501.zip"]
    rows = balance_files.parse_consolidated(balance_files.consolidated_fields(lines))
    assert {r.ano_mes for r in rows.collect()} == {202503}


class Watched(io.FileIO):
    """A file that counts what is read from it at a time and in all."""

    largest = total = 0

    def read(self, size=-1):
        got = super().read(size)
        self.largest, self.total = max(self.largest, len(got)), self.total + len(got)
        return got


@pytest.mark.parametrize("held", [True, False])
def test_archives_are_read_in_parts(tmp_path, monkeypatch, held):
    if not held:
        monkeypatch.setattr(balance_files, "HELD_BYTES", 1000)
    lines = [f"{i};{random.Random(i).random()}" for i in range(100_000)]
    path = tmp_path / "202501.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("other.bin", random.Random(1).randbytes(8_000_000))
        archive.writestr("a.csv", "\n".join(lines))
    file = Watched(path)
    assert list(balance_files.member_lines(file)) == lines
    size = path.stat().st_size
    assert size > 8_000_000 and file.total < size - 7_900_000 + (0 if held else 2_000_000)
    if not held:
        assert file.largest <= balance_files.READ_BYTES
    damaged = bytearray(path.read_bytes())
    damaged[8_200_000] ^= 255
    with pytest.raises((zipfile.BadZipFile, zlib.error)):
        next(balance_files.member_lines(io.BytesIO(bytes(damaged))))


@pytest.mark.parametrize("by_path", [False, True])
def test_individual_file(spark, tmp_path, by_path):
    _zip(tmp_path / "202501-4010-12345678.ZIP", {"x.csv": INDIVIDUAL})
    if by_path:
        lines = balance_files.archive_lines(spark, str(tmp_path))
    else:
        files = spark.read.format("binaryFile").load(str(tmp_path))
        listed = balance_files.archives(files, "abfss://elsewhere/landing")
        assert listed.columns == ["path", "content"]
        lines = balance_files.unpack_lines(listed)
    rows = {r.conta: r for r in balance_files.parse_individual(lines).collect()}
    assert set(rows) == {"7.1.1.00.00-1", "8.1.0.00.00-5"}
    row = rows["7.1.1.00.00-1"]
    assert (row.saldo, row.cnpj, row.cnpj8) == (7043370.57, "12345678000199", "12345678")
    assert (row.nome_inst, row.nome_conta) == ("BANCO É", "RENDAS")
    assert (row.atributo, row.documento, row.ano_mes) == ("", "4010", 202501)
    assert rows["8.1.0.00.00-5"].saldo == -5.5


def test_long_archive_is_read_whole(spark, tmp_path):
    many = 45_000  # more than two batches of lines
    body = CONSOLIDATED.split(b"\n")[0] + b"\n" + b"".join(
        b"%014d;B;A;4040;6.0.0.00.00-2;PL;1,00\n" % i for i in range(many)
    )
    _zip(tmp_path / "202501.zip", {"a.csv": body})
    lines = balance_files.archive_lines(spark, str(tmp_path))
    rows = balance_files.parse_consolidated(balance_files.consolidated_fields(lines))
    assert rows.select("cnpj").distinct().count() == many


# --- registry ---


def test_registry(spark, tmp_path):
    entries = [
        {"c0": "100", "c1": "202412", "c2": "BANCO A", "c10": "SP", "c11": "SAO PAULO", "c12": "S1"},
        {"c0": "200", "c2": "BANCO B"},
    ]
    (tmp_path / "cadastro202412_1009.json").write_text(json.dumps(entries))
    rows = registry_files.read_registry(spark, str(tmp_path))
    assert rows.schema.names == CADASTRO.schema.names
    first, second = rows.orderBy("cod_inst").collect()
    assert (first.ano_mes, first.cod_conglomerado, first.cod_inst, first.cnpj) == (202412, 100, 100, "100")
    assert (first.segmento, first.tipo_instituicao, first.uf) == ("S1", 1009, "SP")
    assert (second.segmento, second.cidade, second.uf) == ("", "", "")


def test_mapping_takes_the_first_entry(spark, tmp_path):
    entries = [
        {"c0": "1234", "c2": "BANCO A", "c15": "80099", "c16": "GRUPO"},
        {"c0": 1234, "c2": "BANCO A DE NOVO", "c15": "1"},
        {"c0": "12345678", "c2": "SOZINHO", "c15": " "},
        {"c0": "999", "c2": "SEM GRUPO"},
    ]
    (tmp_path / "cadastro202412_1006.json").write_text(json.dumps(entries))
    rows = registry_files.read_institution_mapping(spark, str(tmp_path))
    found = {r.cnpj8: (r.nome_inst, r.cod_conglomerado, r.nome_conglomerado) for r in rows.collect()}
    assert found == {
        "00001234": ("BANCO A", 1000080099, "GRUPO"),
        "12345678": ("SOZINHO", 1012345678, "SOZINHO"),
        "00000999": ("SEM GRUPO", 1000000999, "SEM GRUPO"),
    }
    codes = spark.createDataFrame([(1000080099,), (1000080099,)], "cod_conglomerado int")
    assert registry_files.of_groups(rows, codes).count() == 1


# --- reports ---


def index_entry(dt: int, layouts: list[tuple[int, str]] = (), tipo: int = 1009) -> dict:
    files = [{"f": f"x/{dt}/{name}{dt}{rest}.json"} for name, rest in (
        ("cadastro", f"_{tipo}"), ("info", ""), ("dados", "_1"), ("dados", "_5"))]
    files += [{"f": f"x/{dt}/trel{dt}_{i}.json", "trel": {"id": i, "n": n, "s": [{"id": tipo}]}}
              for i, n in layouts]
    return {"dt": dt, "files": files}


def test_lines_of_an_archive_lose_outer_blanks_only():
    text = "\n \n  a \x85 b\n\n  \nc\r\n \n\n"
    found = list(balance_files.stripped(text.splitlines(keepends=True)))
    assert [line.strip() for line in found] == [line.strip() for line in text.strip().splitlines()]
    assert (found[0], found[-1]) == ("a ", "c")
    assert list(balance_files.stripped(["\n", " "])) == []


def _index(spark, tmp_path, first, second):
    paths = []
    for name, entries in (("old.json", first), ("new.json", second)):
        (tmp_path / name).write_text(json.dumps(entries))
        paths.append(str(tmp_path / name))
    return report_files.period_index(spark, paths)


def test_indexes_merge_newest_first(spark, tmp_path):
    replaced = index_entry(202412)
    replaced["files"] = [{"f": "replaced.json"}]
    index = _index(
        spark, tmp_path, [index_entry(202409), index_entry(202412)], [index_entry(202503), replaced]
    )
    periods = [r.ano_mes for r in report_files.index_periods(index).collect()]
    assert periods == [202503, 202412, 202409]
    found = report_files.find_files(index, F.lit(".json")).collect()
    assert {r.ano_mes: r.f for r in found}[202412] == "replaced.json"
    assert {r.ano_mes: r.f for r in found}[202409] == "x/202409/cadastro202409_1009.json"


def test_layout_is_found_by_name_and_type(spark, tmp_path):
    entry = index_entry(202412, [(104, " Resumo "), (105, "Resumo 2"), (106, "Informações de Capital 4966")])
    other = index_entry(202409, [(90, "Resumo")], tipo=1005)
    index = _index(spark, tmp_path, [entry], [other])
    found = {(r.ano_mes, r.relatorio): r.trel_id for r in report_files.find_layouts(index).collect()}
    assert found == {(202412, "1"): 104, (202412, "5"): 106}
    files = {r.trel_id: r.f for r in report_files.layout_files(index).collect()}
    assert files == {104: "x/202412/trel202412_104.json", 106: "x/202412/trel202412_106.json"}


def test_layout_columns_skip_metadata(spark, tmp_path):
    (tmp_path / "info202412.json").write_text(json.dumps([
        {"id": 1, "n": "Código", "a": 1, "lid": 12}, {"id": 2, "n": "Composta", "lid": -1},
        {"id": 3, "n": " Ativo Total \n(a)", "lid": 78182}, {"id": 4, "n": " ", "lid": 79000},
        {"id": 5, "n": "Velho", "lid": 80000, "a": 1}, {"id": 5, "n": "Índice", "lid": 80000, "a": 5},
    ]))
    (tmp_path / "trel202412_104.json").write_text(json.dumps(
        {"id": 104, "n": "Resumo", "c": [{"ifd": i, "o": 10 + i} for i in (1, 2, 3, 4, 6)] + [{"ifd": 5}]}
    ))
    columns = report_files.layout_columns(
        report_files.read_layouts(spark, f"{tmp_path}/trel*.json"),
        report_files.read_indicators(spark, f"{tmp_path}/info*.json"),
    )
    found = {(r.nome, r.lid, r.grupo, r.ordenacao) for r in columns.collect()}
    assert found == {("Ativo Total", 78182, 1, 13), ("Índice", 80000, 5, 0)}


def _values(spark, tmp_path, group: int, entities: list) -> None:
    (tmp_path / f"dados202412_{group}.json").write_text(json.dumps({
        "id": group,
        "values": [{"e": e, "v": [{"i": i, "v": v} for i, v in vs]} for e, vs in entities],
    }))


def _columns(spark, *rows):
    return spark.createDataFrame(
        list(rows), "ano_mes int, relatorio string, pos int, nome string, lid bigint, "
        "grupo int, ordenacao int",
    )


def test_reports_join_layout_values_and_registry(spark, tmp_path):
    _values(spark, tmp_path, 1, [
        (0, [(101, 1.0)]), (100, [(101, 10.0), (101, 11.0), (102, None)]), (999, [(101, 9.0)]), (300, []),
    ])
    _values(spark, tmp_path, 5, [(100, [(101, 12.0)]), (400, [(501, 0.5)])])
    columns = _columns(
        spark,
        (202412, "1", 0, "Ativo Total", 101, 1, 9), (202412, "1", 1, "Captações", 102, 1, 14),
        (202412, "5", 0, "Ativo Total", 101, 1, 1), (202412, "5", 1, "Índice", 501, 5, 2),
    )
    registry = frame(spark, CADASTRO, [institution(c, c, 202412) for c in (100, 300, 400)])
    rows = report_files.assemble_reports(
        columns, report_files.read_values(spark, f"{tmp_path}/dados*.json"), registry
    )
    found = {(r.relatorio, r.cod_conglomerado, r.nome_linha): r.valor_a for r in rows.collect()}
    assert found == {
        # the last value of an entity wins; report 1 reads group 1 only
        ("1", 100, "Ativo Total"): 11.0, ("1", 100, "Captações"): None,
        ("1", 300, "Ativo Total"): None, ("1", 300, "Captações"): None,
        # report 5 reads both groups, the later group wins
        ("5", 100, "Ativo Total"): 12.0, ("5", 100, "Índice"): None,
        ("5", 300, "Ativo Total"): None, ("5", 300, "Índice"): None,
        ("5", 400, "Ativo Total"): None, ("5", 400, "Índice"): 0.5,
    }
    one = rows.where("cod_conglomerado = 100 and nome_linha = 'Captações'").first()
    assert (one.codigo_coluna, one.nome_coluna, one.ordenacao) == ("102", "Captações", 14)
    assert one.nome_conglomerado == "BANCO 100"


def test_repeated_entities_are_reduced_before_they_are_collected(spark):
    """One entity repeated 20,000 times keeps one value per shown indicator."""
    entry = F.struct(F.lit(101).cast("long").alias("i"), F.col("id").cast("double").alias("v"))
    other = F.struct((F.col("id") + 1000).alias("i"), F.lit(1.0).alias("v"))
    values = spark.range(20_000).select(
        F.lit(202412).alias("ano_mes"), F.lit(1).alias("grupo"), F.col("id").cast("int").alias("pos"),
        F.lit(100).alias("e"), F.array(entry, other).alias("v"),
    )
    columns = _columns(spark, (202412, "1", 0, "Ativo Total", 101, 1, 9))
    row = report_files.entity_values(values, columns).first()
    assert [(p.grupo, p.i, p.v) for p in row.parts if p.i] == [(1, 101, 19_999.0)]
    assert len(row.parts) == 2


def test_period_without_registry_keeps_all(spark, tmp_path):
    _values(spark, tmp_path, 1, [(100, [(101, 1.0)]), (999, [(101, 2.0)])])
    registry = frame(spark, CADASTRO, [institution(100, 100, 202409)])
    rows = report_files.assemble_reports(
        _columns(spark, (202412, "1", 0, "Ativo Total", 101, 1, 9)),
        report_files.read_values(spark, f"{tmp_path}/dados*.json"), registry,
    )
    assert {(r.cod_conglomerado, r.nome_conglomerado) for r in rows.collect()} == {(100, "100"), (999, "999")}
