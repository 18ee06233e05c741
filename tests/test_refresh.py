"""From a landing folder to queries, by refresh and by stream."""

from __future__ import annotations

import json
import zipfile
from datetime import date
from unittest.mock import ANY

from prudentia import schemas
from prudentia.plans import rankings, ratios
from prudentia.refresh import main, refresh_balances, refresh_individual, refresh_reports
from prudentia.sinks import load
from prudentia.streaming.landing import watch_balances, watch_individual, watch_reports
from tests.builders import frame, mapping
from tests.test_sources import CONSOLIDATED, index_entry


def _publish(landing, period: int, value: float) -> None:
    folder = landing / "x" / str(period)
    folder.mkdir(parents=True, exist_ok=True)

    def write(name, content):
        (folder / name).write_text(json.dumps(content))

    write(f"cadastro{period}_1009.json", [{"c0": "100", "c2": "BANCO A", "c12": "S1"},
                                          {"c0": "200", "c2": "BANCO B", "c12": "S2"}])
    write(f"info{period}.json", [
        {"id": 1, "n": "Ativo Total", "lid": 101, "a": 1}, {"id": 2, "n": "Lucro Líquido", "lid": 102, "a": 1},
        {"id": 3, "n": "Patrimônio Líquido", "lid": 103, "a": 1},
        {"id": 9, "n": "Índice de Basileia", "lid": 901, "a": 5},
    ])
    write(f"trel{period}_104.json", {"id": 104, "n": "Resumo", "c": [
        {"ifd": 1, "o": 1}, {"ifd": 2, "o": 2}, {"ifd": 3, "o": 3}]})
    write(f"trel{period}_106.json", {"id": 106, "n": "Informações de Capital", "c": [{"ifd": 9, "o": 1}]})
    write(f"dados{period}_1.json", {"id": 1, "values": [
        {"e": 100, "v": [{"i": 101, "v": 1000.0}, {"i": 102, "v": value}, {"i": 103, "v": 100.0}]},
        {"e": 200, "v": [{"i": 101, "v": 500.0}, {"i": 103, "v": 50.0}]},
        {"e": 999, "v": [{"i": 103, "v": 1e9}]}]})
    write(f"dados{period}_5.json", {"id": 5, "values": [{"e": 100, "v": [{"i": 901, "v": 0.15}]}]})


def _index(landing, *periods: int) -> None:
    landing.mkdir(parents=True, exist_ok=True)
    entries = [index_entry(p, [(104, "Resumo"), (106, "Informações de Capital")]) for p in periods]
    (landing / "relatorios2000a2024.json").write_text(json.dumps(entries[:1]))
    (landing / "relatorios2025a2030.json").write_text(json.dumps(entries[1:]))


def test_reports_end_to_end(spark, store, tmp_path):
    landing = tmp_path / "landing"
    for period in (202412, 202503):
        _publish(landing, period, 15.0)
    _index(landing, 202412, 202503)
    steps = refresh_reports(spark, str(landing), store)
    assert [(s.name, s.rows, s.error) for s in steps] == [
        ("registry", 4, None), ("reports", 14, None), ("top50", 4, None)]
    row = ratios.financial_ratios(store, 100).where("ano_mes = 202412").first()
    assert (row.roe, row.leverage, row.basileia, row.tax_rate) == (30.0, 10.0, 15.0, None)
    assert [r.cnpj8 for r in rankings.top50(store).collect()] == ["100", "200"]
    # loaded periods are skipped, unless forced
    _publish(landing, 202503, 30.0)
    assert [s.rows for s in refresh_reports(spark, str(landing), store)] == [0, 0, 4]
    refresh_reports(spark, str(landing), store, quarters=1, force=True)
    assert ratios.financial_ratios(store, 100).where("ano_mes = 202503").first().roe == 120.0


def test_a_failing_step_does_not_stop_the_next(spark, store, tmp_path):
    landing = tmp_path / "landing"
    _publish(landing, 202412, 15.0)
    _index(landing, 202412)
    registry = landing / "x" / "202412" / "cadastro202412_1009.json"
    registry.write_text(json.dumps([{"c0": "100", "c2": "A"}, {"c0": "100", "c2": "A"}]))
    steps = refresh_reports(spark, str(landing), store)
    assert steps[0].error and "repeats" in steps[0].error
    assert steps[1].rows > 0 and steps[1].error is None


def test_a_bad_period_does_not_stop_the_others(spark, store, tmp_path):
    landing = tmp_path / "landing"
    for period in (202412, 202503):
        _publish(landing, period, 15.0)
    _index(landing, 202412, 202503)
    (landing / "x" / "202412" / "cadastro202412_1009.json").write_text(
        json.dumps([{"c0": "100", "c2": "A"}, {"c0": "100", "c2": "A"}]))
    (landing / "x" / "202503" / "dados202503_5.json").unlink()
    registry, reports, top50 = refresh_reports(spark, str(landing), store)
    assert registry.rows == 2 and "202412" in registry.error
    assert {r.ano_mes for r in store.cadastro.collect()} == {202503}
    assert spark.read.parquet(f"{store.root}/_quarantine/cadastro").count() == 2
    assert reports.rows > 0 and "dados202503_5.json is missing" in reports.error
    assert {r.ano_mes for r in store.report_lines().collect()} == {202412}
    assert top50.error is None
    # what was left out is still due
    _publish(landing, 202503, 15.0)
    _publish(landing, 202412, 15.0)
    assert [s.error for s in refresh_reports(spark, str(landing), store)] == [None] * 3
    assert {r.ano_mes for r in store.report_lines().collect()} == {202412, 202503}


def test_an_unreadable_value_file_is_reported(spark, store, tmp_path):
    landing = tmp_path / "landing"
    for period in (202412, 202503):
        _publish(landing, period, 15.0)
    _index(landing, 202412, 202503)
    (landing / "x" / "202503" / "dados202503_5.json").write_text("{broken")
    reports = refresh_reports(spark, str(landing), store)[1]
    assert reports.error == "no lines of report 5 in 202503"
    assert [r.ano_mes for r in store.report_lines("5").collect()] == [202412]


def test_a_missing_index_is_one_failed_step(spark, store, tmp_path):
    landing = tmp_path / "landing"
    _publish(landing, 202412, 15.0)
    _index(landing, 202412)
    (landing / "relatorios2025a2030.json").unlink()
    steps = refresh_reports(spark, str(landing), store)
    assert [bool(s.error) for s in steps] == [True, False, False, False]
    assert store.report_lines().count() > 0
    (landing / "relatorios2000a2024.json").unlink()
    assert [bool(s.error) for s in refresh_reports(spark, str(landing), store)] == [True, True]


def test_report_stream_reloads_touched_periods(spark, store, tmp_path):
    landing = tmp_path / "landing"
    _publish(landing, 202412, 15.0)
    _index(landing, 202412, 202503)

    def roe() -> list[float]:
        watch_reports(spark, str(landing), store, f"{tmp_path}/checks").awaitTermination()
        return [r.roe for r in ratios.financial_ratios(store, 100).collect()]

    assert roe() == [30.0]
    log = store.fetch_log.collect()
    assert roe() == [30.0] and store.fetch_log.collect() == log  # nothing new, nothing loaded
    _publish(landing, 202503, 15.0)
    assert roe() == [30.0, 60.0]


def test_report_stream_passes_a_bad_period(spark, store, tmp_path):
    landing = tmp_path / "landing"

    def run() -> tuple[set, dict]:
        watch_reports(spark, str(landing), store, f"{tmp_path}/checks").awaitTermination()
        notes = {r.item: r.error for r in store.dead_letters.collect()}
        return {r.ano_mes for r in store.report_lines().select("ano_mes").distinct().collect()}, notes

    _publish(landing, 202412, 15.0)
    _index(landing, 202412, 202503, 202506)
    assert run() == ({202412}, {"202503": ANY, "202506": ANY})  # listed, not there yet
    _publish(landing, 202503, 15.0)
    (landing / "x" / "202503" / "info202503.json").unlink()
    periods, notes = run()
    assert periods == {202412} and "info202503.json is missing" in notes["202503"]
    _publish(landing, 202506, 15.0)
    periods, notes = run()
    assert periods == {202412, 202506} and set(notes) == {"202503"}
    assert run() == (periods, notes)  # nothing new, nothing tried
    _publish(landing, 202503, 15.0)
    assert run() == ({202412, 202503, 202506}, {})


def test_report_stream_with_one_index_missing(spark, store, tmp_path):
    landing = tmp_path / "landing"

    def run() -> tuple[int, set]:
        watch_reports(spark, str(landing), store, f"{tmp_path}/checks").awaitTermination()
        return store.report_lines().select("ano_mes").distinct().count(), {r.item for r in store.dead_letters.collect()}

    _publish(landing, 202412, 15.0)
    _publish(landing, 202503, 15.0)
    assert run() == (0, {"202412", "202503", "index relatorios2000a2024.json", "index relatorios2025a2030.json"})
    _index(landing, 202412, 202503)
    late = (landing / "relatorios2025a2030.json").read_text()
    (landing / "relatorios2025a2030.json").unlink()
    assert run() == (1, {"202503", "index relatorios2025a2030.json"})
    (landing / "relatorios2025a2030.json").write_text(late)
    assert run() == (2, set())


def test_a_failed_swap_leaves_a_mapping(spark, store, monkeypatch):
    rows = frame(spark, schemas.INSTITUTION_MAPPING, [mapping("11111111", 1), mapping("22222222", 2)])
    load.load_mapping(store, rows)
    system, now = store.file(store.path(schemas.INSTITUTION_MAPPING))
    system.rename(now, store.file(store.path(schemas.INSTITUTION_MAPPING) + "_before")[1])  # as if it ended there
    assert store.institution_mapping.count() == 2
    assert load.load_mapping(store, rows.limit(1)) == 1
    assert store.institution_mapping.count() == 1 and not system.exists(store.file(
        store.path(schemas.INSTITUTION_MAPPING) + "_before")[1])


def _zip(path, content: bytes) -> None:
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("x.csv", content)


def _individual(root: str, period: int, amount: str) -> bytes:
    return ("a\nb\nc\n#header\n" + f"{period};4010;{root}000199;1;B;1;G;T;71000008;RENDAS;{amount}\n").encode()


def test_balances_from_archives(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    _zip(landing / "202501.zip", CONSOLIDATED)
    (landing / "b202412.zip").write_bytes(b"broken")
    today = date(2025, 3, 20)
    steps = refresh_balances(spark, str(landing), store, months=3, today=today)
    assert [(s.rows, s.error) for s in steps] == [(2, None)]
    assert rankings.top50(store, 202501).count() == 1
    assert spark.read.parquet(f"{store.root}/_quarantine/archives").count() == 1
    assert spark.read.parquet(f"{store.root}/_quarantine/balancetes_raw").count() == 1
    _zip(landing / "202412.zip", CONSOLIDATED)
    assert refresh_balances(spark, str(landing), store, months=3, today=today)[0].rows == 2
    assert {r.ano_mes for r in store.balances().collect()} == {202412, 202501}


def test_individual_balances_of_a_peer_group(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "cadastro202412_1006.json").write_text(json.dumps(
        [{"c0": "11111111", "c2": "A", "c15": "85317"}, {"c0": "22222222", "c2": "B", "c15": "1"}]))
    for root in ("11111111", "22222222"):
        _zip(landing / f"202501-4010-{root}.ZIP", _individual(root, 202501, "1.000,50"))
    today = date(2025, 7, 20)
    steps = refresh_individual(spark, str(landing), store, months=2, today=today)
    assert [(s.rows, s.error) for s in steps] == [(2, None), (1, None)]
    assert [r.cnpj8 for r in store.balances().collect()] == ["11111111"]
    steps = refresh_individual(
        spark, str(landing), store, months=2, every_institution=True, force=True, today=today)
    assert steps[1].rows == 2


def test_unwanted_archives_are_not_opened(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "cadastro202412_1006.json").write_text(json.dumps(
        [{"c0": "11111111", "c2": "A", "c15": "85317"}, {"c0": "22222222", "c2": "B", "c15": "1"}]))
    _zip(landing / "202501-4010-11111111.ZIP", _individual("11111111", 202501, "1,00"))
    (landing / "202501-4010-22222222.ZIP").write_bytes(b"broken")
    steps = refresh_individual(spark, str(landing), store, months=2, today=date(2025, 7, 20))
    assert [(s.rows, s.error) for s in steps] == [(2, None), (1, None)]
    assert not (tmp_path / "warehouse" / "_quarantine").exists()
    assert refresh_individual(spark, str(landing), store, only=[202501], peer_group="?")[1].error


def test_streams_reload_touched_periods(spark, store, tmp_path):
    landing, checks = tmp_path / "landing", tmp_path / "checks"
    landing.mkdir()
    (landing / "cadastro202412_1006.json").write_text(json.dumps(
        [{"c0": "11111111", "c2": "A", "c15": "1"}, {"c0": "22222222", "c2": "B", "c15": "1"}]))
    _zip(landing / "202501.zip", CONSOLIDATED)
    watch_balances(spark, str(landing), store, f"{checks}/balances").awaitTermination()
    assert store.balances("4040").count() == 2

    def individual() -> set:
        watch_individual(
            spark, str(landing), store, f"{checks}/individual", every_institution=True
        ).awaitTermination()
        return {(r.cnpj8, r.saldo) for r in store.balances("4010").collect()}

    _zip(landing / "202501-4010-11111111.ZIP", _individual("11111111", 202501, "1,00"))
    assert individual() == {("11111111", 1.0)}
    # an institution that arrives later joins the ones already loaded
    _zip(landing / "202501-4010-22222222.ZIP", _individual("22222222", 202501, "2,00"))
    assert individual() == {("11111111", 1.0), ("22222222", 2.0)}
    assert store.balances("4040").count() == 2


def test_command_line(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    _publish(landing, 202412, 15.0)
    _index(landing, 202412)
    monkeypatch.setattr("prudentia.refresh.build_session", lambda _: spark)
    args = ["--landing", str(landing), "--warehouse", str(tmp_path / "w")]
    assert main(["reports", *args, "--quarters", "1"]) == 0
    assert main(["balances", *args, "--months", "1"]) == 0
