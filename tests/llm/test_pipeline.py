from __future__ import annotations

import corpus_pipeline
from sessionlake.llm import decontamination, quality_classifier, simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "leaks", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "mixture":
            assert docs.columns == columns and 0 < docs.count() <= before.count()
    assert docs.count() == before.count()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, docs.collect()))


def test_stages_match_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))

    def ids(df):
        return {r.doc_id for r in df.select("doc_id").collect()}

    stages = dict(corpus_pipeline.STAGES)
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    assert ids(stages["quality"](spark, docs, SF)) == ids(scored.where("score >= 0.3"))
    assert ids(stages["leaks"](spark, docs, SF)) == ids(decontamination.contamination(docs, bench).where("not contaminated"))
    assert ids(stages["near_duplicates"](spark, docs, SF)) == ids(simhash.simhash_components(docs).where("doc_id = component_id"))
