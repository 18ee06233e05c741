"""The pipeline against its stages worked out by hand."""

from __future__ import annotations

import collections
import random
import re

import public_tokenizers

import corpus_pipeline
from prudentia.llm import mixing, quality
from tests.llm.test_operators import slow_components, slow_fingerprint


def test_run_equals_the_stages_by_hand(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    vocabulary = [a + b for a in ("the", "of", "and", "in", "run", "cat", "dog") for b in ("", "s", "er", "ly", "ing")]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        head = "Subscribe now\n" if i % 2 else ("A rare line\n" if i in (2, 8, 14) else "")
        rows.append((i, head + " ".join(words), "en", f"src{i % 3}"))
    rows += [(200 + i, rows[i % 10][1], "en", "src1") for i in range(40)]
    near = "Of an article with many words that stand in all copies\n" + " ".join(rng.choice(vocabulary) for _ in range(400))
    rows += [(300 + i, f"{near} end{i}", "en", "src0") for i in range(3)]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    rows = [list(r) for r in rows if r[0] in kept]
    texts = {(r[3], r[1]) for r in rows}  # copies in a source are one page
    pages = collections.Counter(source for source, _ in texts)
    lines = collections.Counter((source, x) for source, t in texts for x in {x.strip() for x in t.split("\n")} - {""})
    for r in rows:
        r[1] = "\n".join(x for x in r[1].split("\n") if not (
            lines[r[3], x.strip()] >= 3 and lines[r[3], x.strip()] > 0.1 * pages[r[3]]))
    assert len({r[1] for r in rows if "A rare line" in r[1]}) == 3  # three of forty
    groups = slow_components({r[0]: slow_fingerprint(r[1]) for r in rows})
    assert {groups[i] for i in (300, 301, 302)} == {300} and groups[200] == 0
    rows = [r for r in rows if groups[r[0]] == r[0]]
    copies = {r.doc_id: r.copies for r in mixing.mix(documents([tuple(r) for r in rows])).collect()}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    expected = sorted((r[0], len(library.encode(r[1], add_special_tokens=False).ids)) for r in rows for _ in range(copies[r[0]]))
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected
    assert "Subscribe" not in {w for r in rows for w in re.findall(r"\w+", r[1])}


def test_stages_return_the_columns_of_documents(spark, odd):
    for docs in odd:
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == columns
            stage(spark, docs, "").count()


def test_queries_match_their_sql(spark):
    from prudentia.llm import registered
    from tests.compare import difference, duck, duck_rows, spark_rows

    sf_dir = "/root/testdata/sf0.001"
    con = duck(sf_dir)
    for name, sql in registered.oracle_sql().items():
        assert difference(spark_rows(registered.queries()[name](spark, sf_dir)), duck_rows(con, sql)) is None, name
