"""The pipeline's stages against the plain reading of their rules."""

import corpus_pipeline
from heightfield.llm import common as C
from heightfield.llm import suite

SMALL = "/root/testdata/sf0.001"


def test_stages_hand_on_what_they_keep(spark):
    docs = C.table(spark, SMALL, "documents")
    columns, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = C.stored(stage(spark, docs, SMALL), "t")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            found = suite.minhash.duplicates(docs)
            assert found.filter("doc_id <> component_id").count() == 0  # nothing that is left is linked
        if k == 2:
            assert suite.decontaminate.leaks(docs, C.table(spark, SMALL, "benchmark")).count() == 0
            clean = docs.count()
        if k == 3:
            assert docs.count() == clean and docs.filter("n_chars <> length(text)").count() == 0
            assert docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3]
    assert docs.select("doc_id").distinct().count() == sizes[3]


def test_stages_bear_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs, before = C.stored(stage(spark, docs, SMALL), "t"), docs
            assert docs.dtypes == before.dtypes, name
            rest = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert docs.select(rest).exceptAll(before.select(rest)).count() == 0, name
        last = corpus_pipeline.STAGES[4][1](spark, docs, SMALL)
        assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_language_stage_rejects_what_has_no_letters(spark, odd):
    kept = corpus_pipeline.language(spark, odd, SMALL)
    assert {r["doc_id"] for r in kept.collect()} == {1, 6, 7, 8, 9, None}
