"""Bulk generation: request tables to model-ready rows, model output to result rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.constants import COMPLETE_LIMITS, COMPLETION_STOPS, GENERATE_LIMITS, PROMPT_MAX_TOKENS
from millrace.functions import prompts as P
from millrace.functions import requests as R
from millrace.operators.tokens import map_batches, pieces, token_ids, truncate_prompt
from millrace.options import GenerationDefaults

DEFAULTS = GenerationDefaults()
MODEL_OUTPUT = (
    T.StructField("raw_text", T.StringType()),
    T.StructField("tokens_generated", T.IntegerType()),
    T.StructField("elapsed", T.DoubleType()),
)


def validate_requests(requests: DataFrame, limits=GENERATE_LIMITS) -> DataFrame:
    checked = requests.withColumn("violations", R.violations(limits))
    return checked.withColumn("valid", F.size("violations") == 0)


def _or_default(requests: DataFrame, name: str, default):
    """A missing column or a null value takes the default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in requests.columns else F.lit(default)


def fill_request_defaults(requests: DataFrame, defaults: GenerationDefaults = DEFAULTS) -> DataFrame:
    """A zero temperature or length counts as missing too."""
    return requests.withColumns({
        "max_new_tokens": R.or_default(_or_default(requests, "max_new_tokens", 0), defaults.max_new_tokens),
        "temperature": R.or_default(_or_default(requests, "temperature", 0.0), defaults.temperature),
        **{name: _or_default(requests, name, getattr(defaults, name)) for name in ("top_p", "top_k", "repetition_penalty", "do_sample")},
    })


def apply_sampling(requests: DataFrame, defaults: GenerationDefaults = DEFAULTS) -> DataFrame:
    return requests.withColumns(R.effective_sampling(F.col("do_sample"), defaults))


def prepare_generate(requests: DataFrame, defaults: GenerationDefaults = DEFAULTS) -> DataFrame:
    """Valid requests with their effective values; invalid ones are turned away."""
    limits = [limit for limit in GENERATE_LIMITS if limit[0] in requests.columns]
    valid = validate_requests(requests, limits).filter("valid").drop("valid", "violations") if limits else requests
    return apply_sampling(fill_request_defaults(valid, defaults), defaults)


def _fixed(requests: DataFrame, max_new_tokens, temperature: float, defaults: GenerationDefaults) -> DataFrame:
    return requests.withColumns({
        "language": _or_default(requests, "language", defaults.language),
        "max_new_tokens": max_new_tokens,
        "temperature": F.lit(temperature),
        "top_p": F.lit(defaults.top_p),
        "top_k": F.lit(defaults.top_k),
        "repetition_penalty": F.lit(defaults.repetition_penalty),
        "do_sample": F.lit(defaults.do_sample),
    })


def prepare_completion(requests: DataFrame, defaults: GenerationDefaults = DEFAULTS) -> DataFrame:
    """code_prefix, language, max_new_tokens, temperature: the temperature is checked, but
    completion always runs with the default one."""
    limits = [limit for limit in COMPLETE_LIMITS if limit[0] in requests.columns]
    valid = validate_requests(requests, limits).filter("valid").drop("valid", "violations") if limits else requests
    length = _or_default(valid, "max_new_tokens", defaults.complete_max_new_tokens)
    ready = _fixed(valid, length, defaults.temperature, defaults)
    return ready.withColumn("prompt", P.completion_prompt(F.col("code_prefix"), F.col("language")))


def prepare_explain(requests: DataFrame, defaults: GenerationDefaults = DEFAULTS) -> DataFrame:
    """code, language."""
    ready = _fixed(requests, F.lit(defaults.explain_max_new_tokens), defaults.explain_temperature, defaults)
    return ready.withColumn("prompt", P.explain_prompt(F.col("code")))


def prompt_tokens(requests: DataFrame, vocabulary: DataFrame | Broadcast, keep: list[str],
                  limit: int = PROMPT_MAX_TOKENS) -> DataFrame:
    """``keep`` columns and the prompt's first ids."""
    tokens = truncate_prompt(pieces(F.col("prompt")), limit)
    return token_ids(requests, vocabulary, keep, tokens)


def run_model(prepared: DataFrame, generate: Callable) -> DataFrame:
    """``generate(pandas frame)`` adds raw_text, tokens_generated and elapsed (seconds)."""
    return map_batches(prepared, generate, T.StructType([*prepared.schema.fields, *MODEL_OUTPUT]))


@dataclass(frozen=True)
class Served:
    """A model that is set up once in a task: ``setup()`` returns what ``run_model`` takes as ``generate``."""

    setup: Callable
    batch_rows: int = 16


def run_served(prepared: DataFrame, model: Served, length: str = "input_ids") -> DataFrame:
    """As ``run_model``, with one set-up for each task and an ``error`` column.

    Of the rows of an Arrow batch those of similar length go through the model together, ``batch_rows`` at a
    time. If the model fails on some rows they are tried one by one; a row that fails alone has nulls and
    the message, and the others are not affected. A set-up that fails fails the task, which Spark tries again.
    """
    columns, made = prepared.columns, [f.name for f in MODEL_OUTPUT]
    setup, step = model.setup, model.batch_rows

    def run(batches):
        import pandas as pd

        generate = None

        def answered(rows):
            try:
                out = generate(rows.copy())[[*columns, *made]]
                if len(out) != len(rows):
                    raise ValueError(f"{len(out)} results for {len(rows)} rows")
                return [out.assign(error=None)]
            except Exception as problem:  # of the caller's model: reported by row
                if len(rows) == 1:
                    return [rows.assign(**dict.fromkeys(made), error=f"{type(problem).__name__}: {problem}")]
                return [x for i in range(len(rows)) for x in answered(rows.iloc[i : i + 1])]

        for frame in batches:
            if not len(frame):
                continue
            generate = generate or setup()
            frame = frame.iloc[frame[length].str.len().fillna(0).argsort(kind="stable")] if length in columns else frame
            for at in range(0, len(frame), step):
                for out in answered(frame.iloc[at : at + step]):
                    yield out.astype({"error": object})

    schema = T.StructType([*prepared.schema.fields, *MODEL_OUTPUT, T.StructField("error", T.StringType())])
    return prepared.mapInPandas(run, schema)


def finish(results: DataFrame, stops: Sequence[str] = ()) -> DataFrame:
    """raw_text, tokens_generated, elapsed to the reported values. Cutting the text at a stop
    does not lower the token count."""
    return results.withColumns({
        "generated_text": P.cut_stop_sequences(F.col("raw_text"), stops),
        "time_seconds": F.bround(F.col("elapsed"), 3),
        "tokens_per_second": R.tokens_per_second(F.col("tokens_generated"), F.col("elapsed")),
    }).drop("raw_text", "elapsed")


def finish_completion(results: DataFrame) -> DataFrame:
    return finish(results, COMPLETION_STOPS)


def finish_explain(results: DataFrame) -> DataFrame:
    return finish(results).withColumn("generated_text", P.explain_postprocess(F.col("generated_text")))


def answer(prepared: DataFrame, vocabulary: DataFrame | Broadcast, generate: Callable | Served) -> DataFrame:
    """Prepared requests with input_ids (the prompt's first 1,800) through the caller's model."""
    asked = prompt_tokens(prepared, vocabulary, prepared.columns)
    return run_served(asked, generate) if isinstance(generate, Served) else run_model(asked, generate)


def generate_all(requests: DataFrame, vocabulary: DataFrame | Broadcast, generate: Callable | Served, stops: Sequence[str] = ()) -> DataFrame:
    """Every valid generation request to its reported result."""
    return finish(answer(prepare_generate(requests), vocabulary, generate), stops)


def complete_all(requests: DataFrame, vocabulary: DataFrame | Broadcast, generate: Callable | Served) -> DataFrame:
    """Every valid completion request to its reported result."""
    return finish_completion(answer(prepare_completion(requests), vocabulary, generate))


def explain_all(requests: DataFrame, vocabulary: DataFrame | Broadcast, generate: Callable | Served) -> DataFrame:
    return finish_explain(answer(prepare_explain(requests), vocabulary, generate))


def throughput_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Roll-up of the per-row numbers; rate over the total time, null when there was none."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.sum("tokens_generated").alias("tokens"),
        F.sum("elapsed").alias("seconds"),
    ).withColumn("tokens_per_second", R.tokens_per_second(F.col("tokens"), F.col("seconds")))
