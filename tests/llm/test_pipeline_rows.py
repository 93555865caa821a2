"""Rows that a stage of the pipeline must not lose: documents without an id, and texts with nothing to remove."""

import corpus_pipeline as P

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_documents_without_an_id_stay_in_the_join(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c"))
    got = P.near_duplicates(spark, docs(spark, [(None, one), (None, two), (7, three), (9, three), (3, ""), (4, None)]), "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [
        (False, 3, ""), (False, 4, ""), (False, 7, three), (True, 0, one), (True, 0, two)
    ]


def test_texts_without_words_stay_in_the_span_stage(spark):
    passage = " ".join(f"word{i}" for i in range(120)) + "."
    got = {r["doc_id"]: r["text"] for r in P.repeated_spans(spark, docs(spark, [(1, passage), (2, passage), (3, None), (4, "  \n"), (5, "one two")]), "").collect()}
    assert set(got) == {1, 3, 4, 5} and got[1] == passage and got[5] == "one two" and not (got[3] or "") and not got[4].strip()
