"""Held-out accuracy, and what counts as unknown."""

import zlib

import numpy as np

from millrace.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.fit(docs)
    rows = language.predict(docs, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "text", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(40)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["yy"]
    assert len(language.sample(docs, "doc_id", "text", "lang", 800)) < 40


def test_edges(spark):
    rows = [(1, "words here", "en"), (1, "words here", "en"), (2, None, "en"), (3, "", None), (4, "123 ... \n", "en"), (None, "mots ici", "fr"),
            (5, "日本語", None), (6, "é", None), (7, "a" * 300_000, "en"), (8, "mots", "fr")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, Score double")
    net = language.fit(docs)
    made = language.predict(docs, net)
    assert made.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    got = {(r.doc_id, r.text): r for r in made.collect()}
    for (_, text), r in got.items():
        known = bool(text) and any(c.isalpha() for c in text)
        assert (r.lang_pred in net.languages) if known else (r.lang_pred == "und" and r.score == 0)
    assert made.count() == len(rows)
    other = language.predict(docs.withColumnRenamed("lang", "source"), net).collect()
    assert {(r.doc_id, r.text, r.lang_pred, r.score) for r in other} == {(r.doc_id, r.text, r.lang_pred, r.score) for r in got.values()}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None and language.fit(docs.limit(0)) is None
    assert language.predict(docs, None).first().lang_pred == "und"
    assert language.predict(docs.limit(0), None).collect() == []


def test_windows_cover_the_text():
    data = np.arange(1, 1001, dtype=np.uint32).astype(np.uint8)
    windows, owner, size = language.cut_windows(data, np.array([0, 0, 256, 300, 1000]))
    assert size.sum() == 1000 and owner.tolist() == [1, 2, 3, 3, 3]
    assert np.array_equal(np.concatenate([w[:n] for w, n in zip(windows, size)]), data)
