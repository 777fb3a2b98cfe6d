"""Sample templates, prompts and generated text."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.constants import (
    COMPLETION_STOPS,
    EXPLAIN_LEAD,
    EXPLAIN_TEMPLATE,
    INSTRUCTION_FOOTER,
    INSTRUCTION_HEADER,
    SAMPLE_TEMPLATES,
)


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Concatenate literal pieces and columns; KeyError when a field is not given."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name])
    return F.concat(*parts)


def format_sample(
    code: Column,
    language: Column,
    template: str = "instruction",
    file_path: Column | None = None,
    **fields: Column,
) -> Column:
    """An unknown template name means ``instruction``; a missing field leaves the raw code."""
    text = SAMPLE_TEMPLATES.get(template, SAMPLE_TEMPLATES["instruction"])
    known = {"code": code, "language": language, "file_path": F.lit("") if file_path is None else file_path}
    try:
        return fill(text, known | fields)
    except KeyError:
        return code


def instruction_wrap(code: Column, language: Column) -> Column:
    return fill(INSTRUCTION_HEADER + "{code}" + INSTRUCTION_FOOTER, {"code": code, "language": language})


def completion_prompt(prefix: Column, language: Column) -> Column:
    """The instruction header and the prefix, left open for the model to continue."""
    return fill(INSTRUCTION_HEADER + "{prefix}", {"prefix": prefix, "language": language})


def explain_prompt(code: Column) -> Column:
    return fill(EXPLAIN_TEMPLATE, {"code": code})


def cut_stop_sequences(text: Column, stops: Sequence[str] = COMPLETION_STOPS) -> Column:
    """Each stop in the order given cuts what the earlier ones left."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def explain_postprocess(text: Column) -> Column:
    return F.concat(F.lit(EXPLAIN_LEAD), text)
