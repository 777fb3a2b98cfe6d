"""What a caller's function is given at a time is bounded."""

from millrace.operators import tokens as T


def test_functions_get_parts_of_bounded_size(spark):
    texts = ["x" * 100_000] * 40 + ["", None, "y" * 3_000_000, "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def sizes(frame):
        size = int(frame["text"].str.len().fillna(0).sum())
        assert list(frame.index) == list(range(len(frame)))
        return frame.assign(rows=len(frame), size=size)

    rows = T.map_batches(docs, sizes, "id int, text string, rows int, size long").collect()
    assert [(r.id, r.text) for r in rows] == list(enumerate(texts))
    assert all(r.size <= 1 << 20 or r.rows == 1 for r in rows)
    assert max(r.rows for r in rows) >= 10


def test_any_tokenizer_over_parts(spark):
    texts = ["ab" * 200_000, "", "ü", "c" * 900_000, "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    made = T.tokenize_with(docs, lambda given: [list(t.encode()) for t in given], ["id"], max_length=5)
    assert [(r.id, r.input_ids) for r in made.collect()] == [(i, list(t.encode())[:5]) for i, t in enumerate(texts)]
