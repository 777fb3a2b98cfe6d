"""Long repeated passages of one or two lines, against a plain statement of the rule."""

import random
import re

import pytest

import corpus_pipeline
from millrace.llm import lines


def plain(rows, size, passage):
    """rows: (id, text) of different ids. Runs of ``size`` lines, and shorter ones of more than ``passage`` words."""
    first, hits = {}, []
    for i, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        w = t.split("\n")
        count = [len(re.findall(r"[^ \t-\r]+", x)) for x in w]
        for n in range(1, size + 1):
            for p in range(len(w) - n + 1):
                if (n == size or sum(count[p : p + n]) > passage) and first.setdefault((n, *w[p : p + n]), (i, p)) != (i, p):
                    hits.append((i, p, n))
    gone = {}
    for i, p, n in hits:
        gone.setdefault(i, set()).update(range(p, p + n))
    return sorted(((i, t and "\n".join(x for q, x in enumerate(t.split("\n")) if q not in gone.get(i, ())), len(gone.get(i, ()))) for i, t in rows), key=repr)


@pytest.mark.parametrize("gram,window,passage,seed", [(2, 2, 4, 1), (2, 2, 0, 2), (1, 1, 3, 3), (3, 2, 7, 4)])
def test_random_texts(spark, gram, window, passage, seed):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(["a", "b", "é"]) for _ in range(rnd.randint(0, 5))) + rnd.choice(["", " ", "\t", "\r"])
    rows = [(i, "\n".join(rnd.choice([line(), f"u{rnd.randrange(2000)} x y"]) for _ in range(rnd.randint(1, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, rows[0][1])]
    got = lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string"), gram=gram, window=window, passage=passage)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=repr) == plain(rows, gram + window - 1, passage)


def test_stage_takes_one_line_documents(spark):
    long, half = " ".join(f"w{i}" for i in range(51)), " ".join(f"h{i}" for i in range(26))
    rows = [(1, long), (2, long), (3, f"own\n{long}\nend"), (4, f"{half}\n{half} x"), (5, f"{half}\n{half} x\nother"), (6, half), (7, long[: long.rindex(" ")]), (8, long[: long.rindex(" ")])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = {1: long, 3: "own\nend", 4: rows[3][1], 5: "other", 6: half, 7: rows[6][1], 8: rows[7][1]}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = [(r.doc_id, r.text, r.n_removed) for r in lines.remove_lines(docs, passage=50).collect()]
    assert sorted(got, key=repr) == plain(rows, 3, 50)
