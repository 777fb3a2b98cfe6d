import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import chunks as C
from millrace.functions import text as X
from millrace.options import ChunkOptions

ALPHABET = " \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0  　ab_é日²😀(){}:;#/*\"'="


def random_texts(n, longest, seed=7, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("path, suffix", [
    ("a/b.PY", ".py"), (".bashrc", ""), ("x.tar.gz", ".gz"), ("foo.", ""), ("..py", ".py"), ("a.d/x", ""),
    ("d/.hidden.py", ".py"), ("d/__init__.py", ".py"),
])
def test_file_extension(values, path, suffix):
    assert values([(path,)], "p string", X.file_extension(F.col("p"))) == [suffix]


def test_detect_language(values):
    got = values([(".py",), (".exs",), (".yml",), (".md",), ("",)], "e string", X.detect_language(F.col("e")))
    assert got == ["python", "elixir", "yaml", None, None]


@pytest.mark.parametrize("raw, text", [
    ("61ff62", "a�b"), ("61e28262", "a�b"), ("f09f98", "�"), ("eda08078", "���x"),
    ("610d0a620d63", "a\nb\nc"), ("0d0d0a0a", "\n\n\n"),
])
def test_decode_text(values, raw, text):
    assert values([(bytes.fromhex(raw),)], "b binary", X.decode_text(F.col("b"))) == [text]


def test_decode_matches_python(values):
    rng = random.Random(3)
    raws = [bytes(rng.choices([0x61, 0x0d, 0x0a, 0xc3, 0xa9, 0xe2, 0x82, 0xac, 0xf0, 0x9f, 0x98, 0x80, 0xff], k=12)) for _ in range(500)]
    want = [r.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n") for r in raws]
    assert values([(r,) for r in raws], "b binary", X.decode_text(F.col("b"))) == want


def test_line_count_matches_splitlines(values):
    texts = ["", "a", "a\n", "\n", "a\r\nb", "\r\n", "a\rb\n", "\x85", "a "] + random_texts(600, 30)
    assert values([(t,) for t in texts], "t string", X.line_count(F.col("t"))) == [len(t.splitlines()) for t in texts]


def test_size_is_rounded_half_even(values):
    got = values([(64,), (192,), (512_000,)], "b long", F.bround(X.size_kb(F.col("b")), 3))
    assert got == [0.062, 0.188, 500.0]


def test_content_hash_is_of_utf8(values):
    assert values([("é日",)], "t string", X.content_hash(F.col("t"))) == [hashlib.sha256("é日".encode()).hexdigest()]


@pytest.mark.parametrize("url, name", [
    ("https://x.org/a/my.repo/", "my_repo"), ("https://x.org/a/b-c_d", "b-c_d"), ("x///", "x"), ("https://x.org/a/日本 x", "日本_x"),
])
def test_repo_name(values, url, name):
    assert values([(url,)], "u string", X.repo_name(F.col("u"))) == [name]


def test_safe_name(values):
    assert values([("a/b\\c.py",)], "p string", X.safe_name(F.col("p"))) == ["a_b_c.py"]


def squeezed(text):
    """Independent statement of the whitespace rule."""
    stripped = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{4,}", "\n\n\n", stripped).strip()


def test_normalize_whitespace(values):
    texts = ["\n\n  a \x1c\n \n\n \n\nb\xa0\n\n\nc\r\n\t\n", "", " \n\t"] + random_texts(2000, 40, alphabet=" \t\n\n\n\x1c\xa0　ab")
    got = values([(t,) for t in texts], "t string", X.normalize_whitespace(F.col("t")))
    assert got[0] == "a\n\n\nb\n\n\nc"
    assert got == [squeezed(t) for t in texts]


def test_main_block_takes_the_next_line_after_a_blank_one(values):
    text = "x=1\nif __name__ == '__main__':\n    a()\n\nfoo()\nbar()\n"
    got = values([(text, "python"), (text, "go"), ('"use strict";\nx', "typescript"), ("'use strict'\ny", "javascript")],
                 "t string, l string", X.remove_boilerplate(F.col("t"), F.col("l")))
    assert got == ["x=1\nbar()\n", text, "x", "y"]


def test_word_count_thresholds(values):
    texts = ["x² 日本_1", "", "a b c", "ab", "...", "a.b.c.d"] + random_texts(500, 25)
    for k in (1, 2, 3, 5):
        got = values([(t,) for t in texts], "t string", X.has_words(F.col("t"), k))
        assert got == [len(re.findall(r"\w+", t)) >= k for t in texts]


def test_token_estimate(values):
    texts = ["", "a b　c\x1cd", " x "] + random_texts(300, 40)
    assert values([(t,) for t in texts], "t string", X.token_estimate(F.col("t"))) == [len(t.split()) * 1.3 for t in texts]


def test_remove_comments(values):
    rows = [
        ("a # b\n'#' c", "python"), ('"""d"""\nx', "python"), ("u = 'http://x'\n/* a\n*/b/*c", "java"),
        ("/*/ x */ y */", "c"), ("-- a\nb /* c */", "sql"), ("# a", "haskell"), ("# a\nb", "ruby"),
    ]
    got = values(rows, "t string, l string", X.remove_comments(F.col("t"), F.col("l")))
    assert got == ["a \n'", '"""d"""\nx', "u = 'http:\nb/*c", " y */", "\nb ", "# a", "\nb"]
    everything = values([('a"""d\n"""b\'\'\'e\'\'\'# c', "python")], "t string, l string",
                        X.remove_comments(F.col("t"), F.col("l"), preserve_docstrings=False))
    assert everything == ["ab"]


def test_block_comments_match_a_plain_pattern(values):
    texts = random_texts(800, 30, alphabet="/*ab\n")
    got = values([(t, "go") for t in texts], "t string, l string", X.remove_comments(F.col("t"), F.col("l")))
    assert got == [re.sub(r"/\*[\s\S]*?\*/", "", re.sub(r"(?m)//.*$", "", t)) for t in texts]


@pytest.mark.parametrize("size, overlap", [(5, 2), (4, 0), (7, 6), (3, -2)])
def test_char_windows(values, size, overlap):
    texts = ["", "abc", "😀" * 11] + random_texts(400, 40)
    got = values([(t,) for t in texts], "t string", C.char_windows(F.col("t"), ChunkOptions(size, overlap)))
    step = size - overlap
    assert got == [[t[i:i + size] for i in range(0, len(t), step)] for t in texts]


@pytest.mark.parametrize("size, overlap", [(3, 1), (2, 0)])
def test_line_windows(values, size, overlap):
    texts = ["", "a\nb\nc\nd"] + random_texts(200, 30, alphabet="a\n\n ")
    got = values([(t,) for t in texts], "t string", C.line_windows(F.col("t"), ChunkOptions(size, overlap)))
    step = size - overlap
    want = []
    for t in texts:
        lines = t.split("\n")
        want.append(["\n".join(lines[i:i + size]) for i in range(0, len(lines), step)])
    assert got == want


def test_default_windows_of_a_thousand_characters(values):
    got = values([("x" * 1000,)], "t string", F.transform(C.char_windows(F.col("t")), F.length))
    assert got == [[1000, 104]]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        ChunkOptions(128, 128)


def functions_of(values, code, language):
    rows = values([(code, language)], "t string, l string", C.extract_functions(F.col("t"), F.col("l")))[0]
    return [(r["name"], r["code"]) for r in rows]


def test_python_functions_end_their_header_at_the_first_colon(values):
    code = "def g(a: int):\n    return a\n\ndef f(x):\n    y\n \n    z\nk=1\n"
    assert functions_of(values, code, "python") == [("g", "def g(a:"), ("f", "def f(x):\n    y\n \n    z")]


def test_script_functions(values):
    code = "function f(a){ if(a){b} } function g(){ {x{y}} }\nconst h = async (x) => x + 1;"
    assert functions_of(values, code, "javascript") == [
        ("anonymous", "function f(a){ if(a){b} }"), ("anonymous", "const h = async (x) => x + 1;")]
    assert functions_of(values, code, "go") == []


def test_long_repetitions_do_not_exhaust_the_stack(values):
    n = 20_000
    rows = [("if __name__ == '__main__':\n" + "    a()\n" * n, "python"), ("def f(x):\n" + "    y\n" * n, "python"),
            ("function f() {" + " {a} b" * n + "}", "javascript"), ("/*" + "x\n" * n + "*/", "java")]
    cleaned, functions, bare = zip(*values(
        rows, "t string, l string", F.length(X.remove_boilerplate(F.col("t"), F.col("l"))),
        F.size(C.extract_functions(F.col("t"), F.col("l"))), F.length(X.remove_comments(F.col("t"), F.col("l")))))
    assert cleaned[0] == 0 and functions[1:3] == (1, 1) and bare[3] == 0


def test_large_unfriendly_texts_stay_linear(values):
    n = 400_000
    rows = [(" " * n + "x", "java"), ("/* a" * (n // 4), "java"), ("x" * n, "java"), ("\t \n" * (n // 3), "python")]
    got = values(rows, "t string, l string", F.length(X.normalize_whitespace(F.col("t"))),
                 F.length(X.remove_comments(F.col("t"), F.col("l"))), X.has_words(F.col("t"), 20),
                 F.size(C.char_windows(F.col("t"))))
    assert [g[0] for g in got] == [1, n, n, 0]
    assert got[1][1] == n and [g[2] for g in got] == [False, True, False, False]


def test_extraction_is_linear_in_open_text(spark):
    """Half a megabyte that never closes what it opens."""
    import time

    texts = [("python", "def a " * 85_000), ("javascript", "const f = x => y\n" * 30_000), ("javascript", "function f (\n" * 38_000),
             ("javascript", "function f() {{ {\n" * 28_000)]
    frame = spark.createDataFrame(texts, "language string, text string").coalesce(1)
    frame.select(F.size(C.extract_functions(F.col("text"), F.col("language")))).collect()
    begun = time.time()
    counts = frame.select(F.size(C.extract_functions(F.col("text"), F.col("language"))).alias("n")).collect()
    assert [r.n for r in counts] == [0, 0, 0, 0] and time.time() - begun < 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["def f", "def g(x)", ":", "\n", "  a\n", "function f", "async ", "(a)", "{", "}", "const k = ", "x ", "=> ", ";", " "]), max_size=25).map("".join))
def test_extraction_as_plain_patterns(text):
    import re

    def java(pattern):
        return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].rjust(4, "0"), pattern))

    ws, word = r"\s", r"\w"
    plain = [
        (C.PYTHON_DEF, rf"(?m)(def{ws}+{word}+[^:]*:(?:\n(?:[ \t]+.+|{ws}*$))*)"),
        (C.JS_FUNCTION, rf"((?:async{ws}+)?function{ws}+{word}+[^{{]*\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})"),
        (C.JS_ARROW, rf"(const{ws}+{word}+{ws}*={ws}*(?:async{ws}+)?(?:\([^)]*\)|{word}+){ws}*=>[^;]+;)"),
    ]
    for ours, theirs in plain:
        pattern = re.sub(r"\[[^\]]*x1c[^\]]*\]", r"\\s", ours.replace("(?dm)", "(?m)"))
        pattern = re.sub(r"\[\\p\{L\}[^\]]*\]", r"\\w", pattern).replace("\\z", "\\Z")
        assert [m for m in re.findall(pattern, text) if m] == re.findall(theirs, text)
