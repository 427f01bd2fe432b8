"""Null ids, repeated rows, texts above a chunk, empty tables and clashing names: every operator and every stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import decontamination, html_extract, language_id, line_dedup, mixing, pii, quality_classifier, quality_rules, simhash, toxicity
from tests.llm.test_pairs import brute_fingerprint, prose

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, h1 bigint, place string, lines int, row string, b int, found_id bigint"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil their very green soup"


def rows():
    import random

    rng = random.Random(20)
    long = f"{' '.join(prose(rng, 1000) for _ in range(230))} mail a.long@example.org {ITEM}"
    texts = {1: "one short text of a few words", 2: long, 3: None, 4: "", 5: " \n\t ", 6: f"before {ITEM} after"}
    assert len(long) > 1 << 20
    out = [(i, t, None if i == 3 else "en", None if i % 2 else "s", len(t or ""), 0.5, 1, 2, "x", 3, "y", 4, 5) for i, t in texts.items()]
    return out + [out[0], out[5], (None, texts[1], "en", None, 1, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, spark.createDataFrame([(7, ITEM), (None, None), (8, "")], "item_id bigint, text string")


def operators(spark, docs, labels, bench):
    return {
        "decontamination": decontamination.contamination(docs, bench), "line_dedup": line_dedup.repeated_lines(docs), "language_id": language_id.identify(docs, language_id.fit(docs)),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, labels)), "quality_rules": quality_rules.quality_rules(docs), "quality_classifier": quality_classifier.score(docs, quality_classifier.fit(docs, labels)),
        "simhash": simhash.simhash_components(docs), "pii": pii.find_pii(docs), "mixing": mixing.mix(docs),
    }


def test_operators_return_every_row_and_treat_copies_alike(spark, tables):
    docs, labels, bench = tables
    want = sorted(str(r[0]) for r in rows())
    for name, result in operators(spark, docs, labels, bench).items():
        got = [r.asDict() for r in result.collect()]
        assert sorted(str(r["doc_id"]) for r in got) == want, name
        for i in (1, 6):
            one, two = (r for r in got if r["doc_id"] == i)
            if name == "mixing":  # each of equal rows is a row of the mix
                one, two = ({k: v for k, v in r.items() if k != "taken"} for r in (one, two))
            assert one == two, name
        by_id = {r["doc_id"]: r for r in got if r["doc_id"]}
        if name == "decontamination":
            assert {i for i, r in by_id.items() if r["contaminated"]} == {2, 6}
        if name == "simhash":
            assert {i: r["fp"] & (2**64 - 1) for i, r in by_id.items()} == {r[0]: brute_fingerprint(r[1]) for r in rows() if r[0]}
        if name == "pii":
            assert by_id[2]["n_email"] == 1 and by_id[3]["spans"] == ""
        if name == "quality_rules":
            assert by_id[2]["n_words"] == len(rows()[1][1].split()) and not by_id[3]["kept"]
        if name == "language_id":
            assert by_id[3]["lang_pred"] == by_id[5]["lang_pred"] == "und" and by_id[2]["lang_pred"] == "en"


def test_operators_on_empty_tables(spark, tables):
    docs, labels, bench = (t.limit(0) for t in tables)
    for name, result in operators(spark, docs, labels, bench).items():
        assert result.count() == 0, name


def test_rows_without_an_id_are_one_document_to_decontamination(spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, ITEM, 1), (None, "clean", 2), (3, "clean", 3)], "doc_id bigint, text string, n int")
    assert [r.contaminated for r in decontamination.contamination(docs, bench).orderBy("doc_id").collect()] == [True, True, False]
    assert [r.n for r in decontamination.decontaminate(docs, bench).collect()] == [3]


def test_one_row_of_each_group_stays(spark):
    t, u, v = "the same text of a few words", "another text of other words", "yet other words stand here"
    docs = spark.createDataFrame([(2, t, 1), (1, t, 2), (1, t, 3), (None, t, 4), (None, t, 5), (None, u, 6), (None, u, 7), (3, v, 8), (3, t, 9)], "doc_id bigint, text string, key int")
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(docs).collect())
    assert kept == sorted([(1, t), (0, u), (3, v)])


def test_a_null_id_is_not_a_null_host(spark):
    lines = "a line of a notice that stands in many documents"
    rows = [(None, str(k), lines) for k in range(40)] + [(k, None, lines) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = quality_rules.quality_rules(docs).select("doc_id", "n_boilerplate_words").collect()
    assert {r.n_boilerplate_words > 0 for r in found if r.doc_id is None} == {False} and {r.n_boilerplate_words > 0 for r in found if r.doc_id is not None} == {True}


def test_pages_above_a_chunk_and_without_ids(spark):
    body = "words of a very long article " * 50_000
    pages = spark.createDataFrame([(1, "u", f"<nav>menu</nav><article><p>{body}</p></article>", "x"), (None, None, None, "y"), (None, None, None, "y")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages, html_extract.Weights()).collect()}
    assert got == {1: body.strip(), None: ""} and html_extract.extract_text(pages, html_extract.Weights()).count() == 3


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, tables, tmp_path, name, stage):
    docs, labels, bench = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = stage(spark, docs, str(tmp_path))
    if name != "mixture":
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    else:
        assert kept.count() == docs.count()
    if name == "leaks":
        assert {r.doc_id for r in kept.select("doc_id").collect()} == {1, 3, 4, 5, None}
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 3, 6]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
