"""Pieces against the library's own, and exact round trips."""

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pieces

PATH = "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"
MODEL = pieces.compile_model(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def codes(text, model=MODEL):
    return memoryview(model.encode(text)).cast("i").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\te▁.,'s(){}=日é😀\u0000"), st.characters(codec="utf-8")), max_size=60))
def test_as_the_library(text):
    ids = LIBRARY.encode(text)
    assert codes(text) == ids
    assert MODEL.decode(ids) == LIBRARY.decode(ids)
    if pieces.SPACE_MARK not in text:
        assert MODEL.decode(ids) == text


def test_code_and_long_texts():
    source = open(pieces.__file__).read()
    for text in (source, source.replace("\n", " "), "x" * 40_000, " " * 3000, "ab" * 20_000 + "\n\n", "日本" * 5000):
        assert codes(text) == LIBRARY.encode(text)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 5)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 3)
    small = pieces.compile_model(PATH)
    words = open(pieces.__file__).read().split()
    random.Random(3).shuffle(words)
    text = " ".join(words)
    assert codes(text, small) == LIBRARY.encode(text) and len(small.paths) <= 5


def unigram(scores, squeeze=False):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.pieces.add(piece="<unk>", score=0, type=2)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    return m.SerializeToString()


@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_weights(squeeze):
    rnd = random.Random(1)
    scores = {p: -rnd.uniform(1, 9) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab", "▁ab", "bb")}
    data = unigram(scores, squeeze)
    weight = [0, *scores.values()]
    own, library = pieces.compile_model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for _ in range(300):
        text = "".join(rnd.choice("abc  ") for _ in range(rnd.randint(0, 25)))
        mine, theirs = codes(text, own), library.encode(text)  # paths of equal weight may differ
        assert own.decode(mine) == library.decode(theirs)
        assert sum(weight[i] for i in mine) == pytest.approx(sum(weight[i] for i in theirs)), text


def test_frames(spark):
    rows = [(1, "One two\n", "k"), (1, "One two\n", "k"), (None, None, None), (3, "", None), (4, "a " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    made = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    at_once = pieces.encode(docs, MODEL, decoded=True)
    assert made.columns == at_once.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(map(repr, made.collect())) == sorted(map(repr, at_once.collect()))
    got = {(r.doc_id, r.text): r for r in made.collect()}
    assert all(r.ids == (None if t is None else LIBRARY.encode(t)) and r.decoded == t for (_, t), r in got.items())
    assert made.count() == 5
    assert pieces.encode(docs.limit(0), MODEL).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pieces.encode(docs, MODEL).collect():
        assert r.ids == LIBRARY.encode(r.text)
