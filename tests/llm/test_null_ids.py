"""Documents without a doc_id through the pipeline's near-dedup."""

import corpus_pipeline


def test_near_dedup_keeps_documents_without_id(spark):
    texts = [(1, "alpha"), (2, "beta"), (3, "alpha"), (None, "gamma")]
    rows = [(i, " ".join(f"{t}{k}" for k in range(80)), "en", "s", 0) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in got} == {1, 2, None} and len(got) == 3
