"""From file text to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.constants import CHUNK_MIN_WORDS, FILE_MIN_WORDS
from millrace.functions import chunks as C
from millrace.functions import text as X
from millrace.functions.prompts import format_sample, instruction_wrap
from millrace.options import BuildOptions, ChunkOptions


def clean_text(files: DataFrame, min_words: int = FILE_MIN_WORDS) -> DataFrame:
    """Whitespace, then boilerplate, then the word test. Comments stay."""
    text = X.remove_boilerplate(X.normalize_whitespace(F.col("content")), F.col("language"))
    return X.compute_once(files, content=text).filter(X.has_words(F.col("content"), min_words))


def explode_chunks(
    files: DataFrame, options: ChunkOptions = ChunkOptions(), unit: str = "chars", column: str = "content"
) -> DataFrame:
    """One row per window that is not blank; ``chunk_idx`` is the window's position."""
    windows = C.line_windows if unit == "lines" else C.char_windows
    kept = [c for c in files.columns if c != column]
    exploded = files.select(*kept, F.posexplode(windows(F.col(column), options)).alias("chunk_idx", "chunk"))
    return exploded.filter(~C.is_blank(F.col("chunk")))


def preprocess(files: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """Clean, chunk and format; every column but ``content`` is carried along.

    Needs language and content. A narrow stage: no shuffle.
    """
    chunks = explode_chunks(clean_text(files), options.chunks)
    chunks = chunks.filter(X.has_words(F.col("chunk"), CHUNK_MIN_WORDS))
    return chunks.withColumns({
        "text": format_sample(F.col("chunk"), F.col("language"), options.template),
        "chunk_size": F.length("chunk"),
        "token_estimate": X.token_estimate(F.col("chunk")),
    }).drop("chunk")


def with_sample_ids(samples: DataFrame) -> DataFrame:
    """A stable id and the source file. Needs repo, rel_path and chunk_idx."""
    return samples.withColumns({
        "id": F.sha2(F.concat_ws(":", "repo", "rel_path", "chunk_idx"), 256),
        "source_file": F.concat_ws("/", "repo", "language", X.safe_name(F.col("rel_path"))),
    }).select("id", "text", "language", "chunk_idx", "chunk_size", "token_estimate", "source_file")


def version_label(*inputs) -> F.Column:
    """Eight characters that depend only on the inputs."""
    return F.left(F.sha2(F.concat_ws(":", *inputs), 256), F.lit(8))


def build_samples(files: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    return with_sample_ids(preprocess(files, options))


def language_counts(samples: DataFrame, languages: DataFrame) -> DataFrame:
    """Samples per language; a language whose files gave none keeps a row with 0."""
    counted = samples.groupBy("language").agg(F.count("*").alias("samples"))
    named = languages.select("language").distinct()
    return named.join(counted, "language", "left").na.fill(0, ["samples"])


def language_counts_from_files(files: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """The same counts straight from files in one pass and one small shuffle."""
    marker = files.select("language", F.lit(0).alias("n"))
    made = preprocess(files.select("language", "content"), options).select("language", F.lit(1).alias("n"))
    return marker.unionByName(made).groupBy("language").agg(F.sum("n").alias("samples"))


def languages_json(counts: DataFrame) -> DataFrame:
    """One row: a JSON object of language -> samples, keys in order."""
    pairs = F.sort_array(F.collect_list(F.struct("language", "samples")))
    return counts.agg(F.to_json(F.map_from_entries(pairs)).alias("languages"))


def extract_functions(files: DataFrame) -> DataFrame:
    """One row per function found: fn_idx, name, code."""
    kept = [c for c in files.columns if c != "content"]
    found = C.extract_functions(F.col("content"), F.col("language"))
    return files.select(*kept, F.posexplode(found).alias("fn_idx", "fn")).select(*kept, "fn_idx", "fn.name", "fn.code")


def instruction_rows(samples: DataFrame) -> DataFrame:
    """Wrap rows for fine-tuning. A row without ``text`` falls back to its ``code``, then to
    nothing; one without a ``language`` to the word code. Already formatted text is wrapped again."""
    columns = samples.columns
    body = F.coalesce(*[F.col(c) for c in ("text", "code") if c in columns], F.lit(""))
    language = F.coalesce(*[F.col(c) for c in ("language",) if c in columns], F.lit("code"))
    return samples.withColumns({"text": instruction_wrap(body, language), "language": language})
