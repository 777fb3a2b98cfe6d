"""One-to-many text expressions: windows over characters or lines, function bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import JS_ARROW, JS_FUNCTION, PYTHON_DEF, WORD, WS
from millrace.functions.text import strip
from millrace.options import ChunkOptions


def char_windows(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Array of windows, one starting every ``step`` code points.

    The lookahead captures the window and the match itself advances by one step, so the text is
    passed once; a substring per window would walk the text from its start each time.
    """
    pattern = rf"(?s)(?=(.{{1,{options.chunk_size}}}+)).{{1,{options.step}}}+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def line_windows(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(options.step))
    return F.transform(
        starts,
        lambda i: F.array_join(F.slice(lines, i + 1, F.lit(options.chunk_size)), "\n"),
    )


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def extract_functions(text: Column, language: Column) -> Column:
    """Array of (name, code); empty for languages without a rule."""
    empty = F.expr("cast(array() as array<struct<name:string,code:string>>)")

    def found(pattern):
        return F.array_remove(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), "")

    python = F.transform(
        found(PYTHON_DEF),
        lambda code: F.struct(
            F.regexp_extract(code, rf"\Adef[{WS}]+([{WORD}]+)", 1).alias("name"),
            strip(code).alias("code"),
        ),
    )
    script = F.transform(
        F.concat(found(JS_FUNCTION), found(JS_ARROW)),
        lambda code: F.struct(F.lit("anonymous").alias("name"), strip(code).alias("code")),
    )
    return (
        F.when(language == "python", python)
        .when(language.isin("javascript", "typescript"), script)
        .otherwise(empty)
    )
