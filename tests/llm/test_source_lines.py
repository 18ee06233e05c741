"""Lines that a broad source repeats, in the pipeline, and text of pages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from prudentia.llm import line_dedup


def test_pipeline_drops_lines_of_a_tenth_of_the_distinct_texts(spark, documents):
    rows = [(i, f"own text {i} with words of its own\nLicensed line" if i < 40 else f"own text {i} with words of its own", "en", "a") for i in range(200)]
    rows += [(1000 + i, "one copied text\nof two lines", "en", "a") for i in range(300)]
    rows += [(2000 + i, f"a near copy of many words that stand in all of them\nand more\n{i}", "en", "a") for i in range(15)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, documents(rows), "").collect()}
    assert got[3] == "own text 3 with words of its own" and got[150] == rows[150][1]
    assert got[1000] == rows[200][1] and got[2000] == rows[500][1]
    short = documents([(i, "Menu", "en", "b") for i in range(9)] + [(10 + i, f"Menu\nown {i}", "en", "b") for i in range(9)])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, short, "").collect()}
    assert got[0] == "" and got[10] == "own 0"  # a page that is all boilerplate loses all of it


def test_text_of_pages(spark):
    html = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t=\"</p>\";\nx()</script></head>"
            "<BODY class=x><nav><li><a href='/a'>A</a></li></nav><!-- ad\n <p> --><p>one <b>two</b><br/>three</p></body></html>")
    frame = spark.createDataFrame([(html,), (None,), ("plain",)], "html string")
    got = [r[0] for r in frame.select(line_dedup.page_text(F.col("html"))).collect()]
    assert [x for x in got[0].split("\n") if x] == ["T &amp; t", "A", "one two", "three"] and got[1:] == [None, "plain"]


CLASHES = ["_text", "_words", "_q", "_rest", "_d", "_lang", "_site", "_keys", "_row", "_own", "_kept", "own", "site", "content",
           "keys", "left", "of", "id", "size", "hash", "s", "n_tokens", "own_site", "classes", "common", "component_id", "threshold"]


def test_columns_of_any_name_keep_their_values(spark):
    from prudentia.llm import mixing, quality, simhash

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("the", "of", "and", f"w{rng.randint(0, 99)}")) for _ in range(120)) + f"\nown {i}", "en", "a", *[f"{c}-{i}" for c in CLASHES]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    results = [quality.good_documents(docs), line_dedup.drop_repeated_lines(docs, F.col("source")).drop("lines_dropped"),
               simhash.one_of_each(docs), mixing.mixed(docs), *(f(spark, docs, "") for _, f in corpus_pipeline.STAGES[:-1][:1])]
    for result in results:
        assert result.columns == docs.columns
        found = result.collect()
        assert len(found) > 3
        for r in found:
            assert [r[c] for c in CLASHES] == [f"{c}-{r.doc_id}" for c in CLASHES] and r.text.endswith(f"own {r.doc_id}")
