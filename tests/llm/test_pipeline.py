"""Stages of the pipeline against plain versions, each on its own input."""

import corpus_pipeline
from millrace.llm import language, pieces
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_passages import plain as plain_lines
from tests.llm.test_similar import plain_components

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentence_pieces"]

    def step(name, docs):
        made = steps[name](spark, docs, SF)
        assert name == "sentence_pieces" or made.columns == docs.columns
        return spark.createDataFrame(made.collect(), made.schema)

    one = step("language_id", docs)
    judged = language.predict(docs, language.fit(docs)).collect()
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.35}
    assert one.count() >= 0.98 * docs.count()
    two = step("line_dedup", one)
    kept = {i: t for i, t, gone in plain_lines([(r.doc_id, r.text) for r in one.collect()], 3, 50) if not gone or t.strip(" ")}
    assert {r.doc_id: r.text for r in two.collect()} == kept
    three = step("near_duplicates", two)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {i for (i, _), g in zip(rows, plain_components(rows)) if i == g}
    four = step("decontamination", three)
    hits = plain_hits([(r.doc_id, r.text) for r in three.collect()], items)
    assert {r.doc_id for r in four.collect()} == {h[0] for h in hits if not h[4]}
    five = step("sentence_pieces", four)
    model = pieces.compile_model(corpus_pipeline.MODEL)
    assert five.count() == four.count()
    for r in five.collect():
        assert r.round_trip and model.decode(r.ids) == r.text and r.n_ids == len(r.ids)
    assert sorted(rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "ids"))) == sorted(rows_of(five.select("doc_id", "ids")))


def test_odd_rows(spark):
    rows = [(1, "one text of words here", None, None, None), (1, "one text of words here", None, None, None), (None, "one text of words here", "en", "s", 1), (2, None, "en", None, 3),
            (3, "", "en", "s", 0), (4, "Other words, many of them, in this text", "en", "s", 9), (4, "this is a different text of the same id", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert got == [(0, rows[0][1]), (1, rows[0][1]), (4, rows[5][1]), (4, rows[6][1])]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        assert docs.collect() == []
