"""Windows of benchmark items in documents against a plain search."""

import re

import pytest

from millrace.llm import decontaminate

COLUMNS = "doc_id long, text string, n_hit string, Items int"


def words(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, size=10):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            for p in range(max(1, len(v) - size + 1)) if v else ():
                window = v[p : p + size]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.update([str(item_id)] if item_id is not None else [])
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, ITEM), (10, ITEM), (2, "short item"), (3, ""), (4, None), (None, "no id words here"), (2, "short item"), (7, "a a a a a a a a a a a a")]
DOCS = [
    (1, ITEM.upper(), "x", 1), (2, "zero " + ITEM.replace(" ", ",\n") + " end", None, None), (3, "one two three four five six seven eight nine", "x", 2),
    (4, None, None, None), (5, "", None, None), (6, "...", None, None), (7, "a short item and a short, ITEM", None, None),
    (7, "a short item and a short, ITEM", None, None), (None, "no id words here", None, None), (8, "a " * 30, None, None),
    (9, "filler " * 20_000 + ITEM + " filler" * 20_000, None, None), (10, "three four five six seven eight nine ten eleven twelve thirteen", None, None),
    (11, "four five six seven eight nine ten eleven twelve é", None, None),
]


@pytest.mark.parametrize("block", [200_000, 2])
def test_small(spark, block):
    docs = spark.createDataFrame(DOCS, COLUMNS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = decontaminate.decontaminate(docs, items, block_windows=block)
    assert made.columns == ["doc_id", "text", "n_words", "n_hit", "items", "contaminated"]
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in made.collect()]
    assert sorted(got, key=repr) == plain(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, COLUMNS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, items.limit(0)).collect())
