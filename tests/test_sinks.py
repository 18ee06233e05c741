"""Loads replace partitions, log themselves and can be repeated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prudentia import schemas
from prudentia.operators.quality import KeyViolation
from prudentia.plans import rankings
from prudentia.plans.maintenance import pending
from prudentia.sinks import load
from tests.builders import A, B, C, balance, frame, institution, line, mapping


def test_empty_tables_have_their_schema(store):
    for name, spec in schemas.TABLES.items():
        assert store.read(name).schema.names == spec.schema.names
        assert store.read(name).count() == 0


def test_registry_replaces_its_periods_only(spark, store):
    rows = [institution(1, 10, 202403), institution(2, 20, 202403), institution(1, 10, 202406)]
    first = load.load_registry(store, frame(spark, schemas.CADASTRO, rows))
    again = load.load_registry(
        store, frame(spark, schemas.CADASTRO, [institution(3, 30, 202406, "S3")])
    )
    assert (first.rows, first.periods, again.rows) == (3, [202403, 202406], 1)
    stored = {(r.ano_mes, r.cod_conglomerado) for r in store.cadastro.collect()}
    assert stored == {(202403, 1), (202403, 2), (202406, 3)}
    log = {(r.ano_mes, r.relatorio, r.row_count) for r in store.fetch_log.collect()}
    assert log == {(202403, "cadastro", 2), (202406, "cadastro", 1)}


def test_registry_key_must_be_unique(spark, store):
    twice = [institution(1, 10, 202403), institution(2, 10, 202403)]
    with pytest.raises(KeyViolation):
        load.load_registry(store, frame(spark, schemas.CADASTRO, twice))
    assert store.cadastro.count() == 0


def test_other_periods_of_a_registry_are_loaded(spark, store):
    rows = [institution(1, 10, 202403), institution(2, 10, 202403), institution(3, 30, 202406)]
    for _ in range(2):
        with pytest.raises(KeyViolation) as problem:
            load.load_registry(store, frame(spark, schemas.CADASTRO, rows))
        assert problem.value.rows == 1
    assert [r.ano_mes for r in store.cadastro.collect()] == [202406]
    assert spark.read.parquet(f"{store.root}/_quarantine/cadastro").count() == 2


def test_periods_of_any_report_count(spark, store):
    load.load_report_values(store, frame(spark, schemas.REPORT_VALUES, [line(1, 1.0, "X", 202406, "9")]))
    load.load_registry(store, frame(spark, schemas.CADASTRO, [institution(1, 10, 202409)]))
    assert [r.ano_mes for r in store.report_periods.collect()] == [202406]


def test_empty_input_changes_nothing(spark, store):
    load.load_report_values(
        store, frame(spark, schemas.REPORT_VALUES, [line(1, 1.0, "X", 202403, "1")])
    )
    assert load.load_report_values(store, frame(spark, schemas.REPORT_VALUES, [])) == load.NOTHING
    assert load.load_mapping(store, frame(spark, schemas.INSTITUTION_MAPPING, [])) == 0
    assert store.report_lines().count() == 1


def test_reports_replace_period_and_report(spark, store):
    lines = [line(1, 1.0, "X", 202403, "1"), line(1, 2.0, "X", 202403, "5"),
             line(2, None, "X", 202403, "5")]
    rows = frame(spark, schemas.REPORT_VALUES, lines)
    assert load.load_report_values(store, rows).rows == 3
    assert load.load_report_values(store, rows).rows == 3  # the same table again
    load.load_report_values(
        store, frame(spark, schemas.REPORT_VALUES, [line(9, 9.0, "X", 202403, "5")])
    )
    assert sorted(r.cod_conglomerado for r in store.report_lines().collect()) == [1, 9]
    assert [r.cod_conglomerado for r in store.report_lines("5").collect()] == [9]
    assert load.is_loaded(store, 202403, "5")
    assert not load.is_loaded(store, 202403, "4")
    # report codes stay text although their folders look like numbers
    assert dict(store.report_lines().dtypes)["relatorio"] == "string"
    assert [r.ano_mes for r in store.report_periods.collect()] == [202403]


def test_pending_is_what_the_log_lacks(spark, store):
    load.load_report_values(
        store, frame(spark, schemas.REPORT_VALUES, [line(1, 1.0, "X", 202403, "1")])
    )
    wanted = spark.createDataFrame(
        [(202403, "1"), (202403, "5"), (202406, "1")], "ano_mes int, relatorio string"
    )
    left = {tuple(r) for r in pending(wanted, store.fetch_log).collect()}
    assert left == {(202403, "5"), (202406, "1")}
    assert pending(wanted, store.fetch_log, force=True).count() == 3


def test_rows_breaking_a_rule_are_quarantined(spark, store):
    bad = balance(A, None)
    rows = frame(spark, schemas.BALANCETES_RAW, [balance(A, 5.0), bad])
    assert load.load_balances(store, rows).rows == 1
    assert load.load_balances(store, rows).rows == 1  # again: the reject is kept once
    kept = spark.read.parquet(f"{store.root}/_quarantine/balancetes_raw")
    assert kept.count() == 1


def test_balances_rebuild_top50_with_bridge(spark, store):
    load.load_registry(
        store, frame(spark, schemas.CADASTRO, [institution(99, 10, 202501, cnpj=A)])
    )
    rows = [balance(A, 5e6), balance(B, 3e6), balance(C, 1e6)]
    loaded = load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, rows))
    assert loaded.rows == 3
    top = rankings.top50(store, 202501).collect()
    assert [(r.rank, r.cnpj8, r.cod_conglomerado) for r in top] == [
        (1, "11111111", 99), (2, "22222222", None), (3, "33333333", None),
    ]
    log = {(r.ano_mes, r.relatorio): r.row_count for r in store.fetch_log.collect()}
    assert log[(202501, "balancetes")] == 3


def test_period_scope_drops_other_documents(spark, store):
    individual = frame(
        spark, schemas.BALANCETES_RAW,
        [balance(A, 1.0, conta="7.1.0.00.00-8", documento="4010")],
    )
    consolidated = frame(spark, schemas.BALANCETES_RAW, [balance(A, 5e6)])
    load.load_individual_balances(store, individual)
    load.load_balances(store, consolidated, scope="document")
    assert {r.documento for r in store.balances().collect()} == {"4010", "4040"}
    load.load_balances(store, consolidated)
    assert {r.documento for r in store.balances().collect()} == {"4040"}
    with pytest.raises(ValueError, match="scope"):
        load.load_balances(store, consolidated, scope="year")


def test_individual_load_leaves_the_rest(spark, store):
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, [balance(A, 5e6)]))
    rows = [balance(B, 2.0, conta="7.1.0.00.00-8", documento="4010"), balance(B, 7e6)]
    loaded = load.load_individual_balances(store, frame(spark, schemas.BALANCETES_RAW, rows))
    assert loaded.rows == 1
    assert store.balances("4040").count() == 1
    assert rankings.top50(store).count() == 1  # not rebuilt
    assert load.is_loaded(store, 202501, "4010")


def test_zero_digits_are_repaired_on_load(spark, store):
    old = [balance(A, 1.0, 202412, "7.1.0.00.00-8"), balance(A, 5e6, 202412)]
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, old))
    new = [balance(A, 2.0, 202501, "7.1.0.00.00-0"), balance(A, 6e6, 202501, "6.0.0.00.00-0"),
           balance(A, 3.0, 202501, "9.9.9.00.00-0")]
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, new))
    stored = {r.conta for r in store.balances().where("ano_mes = 202501").collect()}
    assert stored == {"7.1.0.00.00-8", "6.0.0.00.00-2", "9.9.9.00.00-0"}
    assert rankings.top50(store, 202501).count() == 1


def test_account_index_follows_the_balances(spark, store):
    def indexed() -> set:
        return {tuple(r) for r in store.read("account_index").collect()}

    raw = [balance(A, 1.0, 202412, "7.1.0.00.00-8", "4010")]
    load.replace_partitions(  # stored before there was an index
        store, schemas.BALANCETES_RAW, frame(spark, schemas.BALANCETES_RAW, raw)
    )
    new = [balance(A, 2.0, 202501, "7.1.0.00.00-0", "4010")]
    load.load_individual_balances(store, frame(spark, schemas.BALANCETES_RAW, new))
    assert indexed() == {(202412, "4010", "7.1.0.00.00-8"), (202501, "4010", "7.1.0.00.00-8")}
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, [balance(A, 5e6, 202412)]))
    assert indexed() == {(202412, "4040", "6.0.0.00.00-2"), (202501, "4010", "7.1.0.00.00-8")}


def test_fallback_repairs_without_history(spark, store):
    rows = [balance(A, 6e6, conta="6.0.0.00.00-0"), balance(A, 1.0, conta="7.1.0.00.00-0")]
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, rows))
    assert {r.conta for r in store.balances().collect()} == {"6.0.0.00.00-2", "7.1.0.00.00-0"}


def test_balances_are_not_shuffled_by_account(spark, store, monkeypatch):
    """There are few accounts: the rows of a load meet the small repair map where they are read."""
    plans, replace = [], store.replace

    def noted(spec, rows):
        if spec is schemas.BALANCETES_RAW:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        replace(spec, rows)

    monkeypatch.setattr(store, "replace", noted)
    old = [balance(A, 1.0, 202412, "7.1.0.00.00-8", "4010"), balance(A, 5e6, 202412)]
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, old))
    new = [balance(A, 2.0, 202501, "7.1.0.00.00-0", "4010"), balance(B, 3.0, 202501, "9.9.9.00.00-0", "4010")]
    load.load_individual_balances(store, frame(spark, schemas.BALANCETES_RAW, new))
    assert len(plans) == 2
    for text in plans:
        assert "BroadcastHashJoin" in text and "hashpartitioning(conta" not in text
    stored = {(r.ano_mes, r.conta) for r in store.balances("4010").collect()}
    assert stored == {(202412, "7.1.0.00.00-8"), (202501, "7.1.0.00.00-8"), (202501, "9.9.9.00.00-0")}
    system, root = store.file(store.root)
    left = [f.getPath().getName() for f in system.listStatus(root)]
    assert not [name for name in left if name.startswith("_digit_repairs")]


def test_stored_accounts_are_repaired_once(spark, store):
    raw = [balance(A, 5e6, 202412), balance(A, 6e6, 202501, "6.0.0.00.00-0"),
           balance(B, 7e6, 202501, "6.0.0.00.00-0"), balance(B, 1.0, 202501, "9.9.9.00.00-0")]
    load.replace_partitions(
        store, schemas.BALANCETES_RAW, frame(spark, schemas.BALANCETES_RAW, raw)
    )
    assert load.repair_stored_accounts(store) == 2
    assert [r.cnpj8 for r in rankings.top50(store, 202501).collect()] == ["22222222", "11111111"]
    assert store.balances().count() == 4
    assert rankings.top50(store, 202412).count() == 0  # before the digits were dropped
    assert load.repair_stored_accounts(store) == 0


def test_top50_from_reports_wins_when_last(spark, store):
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, [balance(A, 5e6, 202412)]))
    lines = [line(i, float(100 - i), "Patrimônio Líquido", 202412, "1") for i in range(1, 61)]
    load.load_report_values(store, frame(spark, schemas.REPORT_VALUES, lines))
    assert load.rebuild_top50(store, [202412], source="reports") == 50
    assert load.rebuild_top50(store, [202412], source="reports") == 50
    top = rankings.top50(store, 202412)
    assert top.count() == 50
    assert top.first().cnpj8 == "1"
    # a period left without candidates is emptied
    load.load_report_values(
        store, frame(spark, schemas.REPORT_VALUES, [line(1, None, "Outra", 202412, "1")])
    )
    assert load.rebuild_top50(store, [202412], source="reports") == 0
    assert rankings.top50(store, 202412).count() == 0
    with pytest.raises(ValueError, match="source"):
        load.rebuild_top50(store, [202412], source="other")


def test_mapping_is_replaced_whole(spark, store):
    rows = [mapping("11111111", 1), mapping("22222222", 2)]
    assert load.load_mapping(store, frame(spark, schemas.INSTITUTION_MAPPING, rows)) == 2
    assert load.load_mapping(store, frame(spark, schemas.INSTITUTION_MAPPING, rows[:1])) == 1
    assert store.institution_mapping.count() == 1


def test_records_use_published_names(spark):
    published = spark.createDataFrame(
        [(202403, 1, "BANCO", 10, "BANCO SA", "00", "S1", 1009)],
        "ano_mes int, CodConglomerado int, NomeConglomerado string, CodInst int, "
        "NomeInst string, CNPJ string, Segmento string, TipoInstituicao int",
    )
    row = load.from_records(published, schemas.CADASTRO).first()
    assert (row.cod_inst, row.cnpj, row.cidade, row.uf) == (10, "00", "", "")


def test_hot_period_is_split_into_several_files(spark, store):
    """A period holding nearly all rows is written by more than one task."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") < 10, 202401).otherwise(202402).alias("ano_mes"),
        F.lit("1").alias("relatorio"), F.col("id").cast("int").alias("cod_conglomerado"),
        F.md5(F.col("id").cast("string")).alias("nome_conglomerado"),
        F.lit("c").alias("codigo_coluna"), F.lit("c").alias("nome_coluna"),
        F.col("id").cast("double").alias("valor_a"), F.lit("X").alias("nome_linha"),
        F.lit(1).alias("ordenacao"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "2m")
    try:
        assert load.load_report_values(store, rows).rows == 400_000
    finally:
        spark.conf.set(size, before)
    files = store.report_lines().where("ano_mes = 202402").select(F.input_file_name()).distinct()
    assert files.count() > 1


def test_lookups_skip_row_groups(spark, store):
    """Every row group spans all tax-id roots; their Bloom filters tell which ones hold one."""
    rows = spark.range(60_000).select(
        F.lit(202401).alias("ano_mes"), F.lit("x").alias("cnpj"),
        F.left(F.md5(F.col("id").cast("string")), F.lit(8)).alias("cnpj8"), F.lit("B").alias("nome_inst"),
        F.lit("A").alias("atributo"), F.lit("4040").alias("documento"),
        F.format_string("1.%d", (F.col("id") / 600).cast("int")).alias("conta"), F.lit("N").alias("nome_conta"),
        F.col("id").cast("double").alias("saldo"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.row.count.limit", "2000")
    try:
        load.replace_partitions(store, schemas.BALANCETES_RAW, rows)
    finally:
        hadoop.unset("parquet.block.row.count.limit")

    def read(condition: str) -> tuple[int, int]:
        found = store.balances().where(condition)
        answer = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return answer, scan.metrics().apply("numOutputRows").value()

    known = rows.where("saldo = 31415").first().cnpj8
    answer, scanned = read(f"cnpj8 = '{known}'")
    assert answer == 1 and scanned <= 8_000
    assert read("cnpj8 = '8-absent'")[1] <= 4_000


def test_views_answer_sql(spark, store):
    load.load_balances(store, frame(spark, schemas.BALANCETES_RAW, [balance(A, 5e6)]))
    store.create_views()
    assert spark.sql("SELECT sum(saldo) s FROM balancetes_raw WHERE documento = '4040'").first().s == 5e6
