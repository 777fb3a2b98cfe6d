r"""Column expressions for file text and paths.

Java and Python disagree on ``\s``, ``\w``, ``.`` and ``$``, so the classes are spelled out:
WS is Python's whitespace set, WORD its ``\w``; ``(?d)`` lets only ``\n`` end a line.
Every pattern is linear: runs are possessive, and trimming is left to the string functions,
which look at the ends only.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.constants import (
    COMMENT_SYNTAX,
    LANGUAGE_BY_EXTENSION,
    MAIN_BLOCK,
    TOKENS_PER_WORD,
    USE_STRICT,
    WORD,
    WS,
)

WS_CHARACTERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
LINE_BREAKS = r"\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}"


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace costly columns so that each is evaluated exactly once per row.

    A filter on a projected column is pushed below the projection and repeats the expression
    there, below a repartition even in the few tasks of the scan. Filters on generated columns
    stay above their generator, so the columns pass through a one-row ``inline``.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def decode_text(raw: Column) -> Column:
    """Bytes to valid UTF-8 text, every line break written as a single line feed."""
    valid = F.make_valid_utf8(raw.cast("string"))
    return F.replace(F.replace(valid, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def file_extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def detect_language(extension: Column) -> Column:
    """Null for an unknown suffix."""
    pairs = [F.lit(part) for pair in LANGUAGE_BY_EXTENSION.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), extension)


def size_kb(byte_count: Column) -> Column:
    return byte_count / F.lit(1024.0)


def line_count(text: Column) -> Column:
    """Lines as a reader that knows all Unicode line breaks sees them."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    controls = F.regexp_replace(text, r"[^\p{Cc}\p{Zl}\p{Zp}]++", "")
    breaks = F.regexp_replace(controls, rf"[^{LINE_BREAKS}]++", "")
    unfinished = (text != "") & ~F.right(text, F.lit(1)).rlike(f"[{LINE_BREAKS}]")
    return (F.length(breaks) + unfinished.cast("int")).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def repo_name(url: Column) -> Column:
    last = F.regexp_extract(url, r"(?s)([^/]*)/*\z", 1)
    return F.regexp_replace(last, rf"[^{WORD}\-]", "_")


def safe_name(path: Column) -> Column:
    return F.translate(path, "/\\", "__")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def normalize_whitespace(text: Column) -> Column:
    """Right-strip each line, keep at most two blank lines in a row, strip both ends."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(WS_CHARACTERS)))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{4,}", "\n\n\n"))


def remove_boilerplate(text: Column, language: Column) -> Column:
    strict = reduce(lambda c, pattern: F.regexp_replace(c, pattern, ""), USE_STRICT, text)
    return (
        F.when(language.isin("javascript", "typescript"), strict)
        .when(language == "python", F.regexp_replace(text, MAIN_BLOCK, ""))
        .otherwise(text)
    )


def _remove_between(text: Column, opening: str, closing: str) -> Column:
    """Drop shortest opening...closing spans.

    No span can end after the last closing mark, so the search is confined to the part before
    it; otherwise each unclosed opening would be searched to the end of the file.
    """
    tail = F.substring_index(text, closing, -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, rf"\Q{opening}\E[\s\S]*?\Q{closing}\E", ""), tail)


def remove_comments(text: Column, language: Column, preserve_docstrings: bool = True) -> Column:
    """Purely textual removal; languages without a rule are returned unchanged."""
    def cleaned(name: str) -> Column:
        rules = COMMENT_SYNTAX[name]
        if name == "python" and preserve_docstrings:
            rules = rules[:1]
        out = text
        for rule in rules:
            if isinstance(rule, str):
                out = F.regexp_replace(out, f"(?dm){rule}", "")
            else:
                out = _remove_between(out, *rule)
        return out

    by_rules: dict[tuple, list[str]] = {}
    for name, rules in COMMENT_SYNTAX.items():
        by_rules.setdefault((rules, name == "python"), []).append(name)
    branches = F
    for names in by_rules.values():
        branches = branches.when(language.isin(*names), cleaned(names[0]))
    return branches.otherwise(text)


def has_words(text: Column, at_least: int) -> Column:
    """At least so many word tokens; stops reading at the last one needed."""
    if at_least <= 0:
        return text.isNotNull()
    lead = rf"\A[^{WORD}]*+(?:[{WORD}]++[^{WORD}]++){{{at_least - 1}}}[{WORD}]"
    return text.rlike(lead)


def token_estimate(text: Column) -> Column:
    pieces = F.size(F.regexp_extract_all(text, F.lit(f"[^{WS}]++"), F.lit(0)))
    return pieces * F.lit(TOKENS_PER_WORD)
