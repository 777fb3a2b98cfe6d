"""Model-ready inputs from dataset versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.samples import instruction_rows
from millrace.operators.tokens import share_vocabulary, tokenize
from millrace.options import TokenOptions
from millrace.plans.build import METADATA, dataset_path, newest_version
from millrace.sources.stores import load_split_dataset


def training_input(
    splits: dict[str, DataFrame] | None, vocabulary: DataFrame, options: TokenOptions = TokenOptions()
) -> dict[str, DataFrame]:
    """Tokenized splits; ``eval`` is validation, or test where there is no validation."""
    if not splits:
        raise ValueError("no dataset found: build one first")
    shared = share_vocabulary(vocabulary)
    tokenized = {
        name: tokenize(rows, shared, ["id", "text"], max_length=options.max_length)
        for name, rows in splits.items()
    }
    evaluation = tokenized.get("validation", tokenized.get("test"))
    return tokenized if evaluation is None else tokenized | {"eval": evaluation}


def newest_dataset(versions: DataFrame, output_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The splits and the one row of metadata of the newest version."""
    spark = versions.sparkSession
    path = newest_version(versions, output_dir)
    if path is None:
        raise ValueError("no dataset found: build one first")
    return load_split_dataset(spark, dataset_path(path)), spark.read.schema(METADATA).json(f"{path}/metadata")


def total_samples(splits: dict[str, DataFrame]) -> DataFrame:
    """What a training run records: the rows of the training split."""
    return splits["train"].agg(F.count("*").alias("total_samples"))


def finetune_input(samples: DataFrame | None = None, splits: dict[str, DataFrame] | None = None) -> DataFrame:
    """Wrapped rows from inline samples, or else from the training split of a dataset."""
    if samples is not None:
        return instruction_rows(samples)
    if splits:
        train = splits["train"]
        columns = ["text"] + (["language"] if "language" in train.columns else [])
        return instruction_rows(train.select(*[c for c in ("id",) if c in train.columns], *columns))
    raise ValueError("give samples or a dataset")
