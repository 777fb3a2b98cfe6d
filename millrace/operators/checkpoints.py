"""Checkpoint listing, choice and retention, for many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_loss(log_history: Column) -> Column:
    """Loss of the last log entry that has one; an entry with a null loss counts as having it."""
    with_loss = F.filter(log_history, lambda entry: F.map_contains_key(entry, "loss"))
    return F.try_element_at(with_loss, F.lit(-1))["loss"].cast("double")


def list_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy("run_id", "step")


def best_checkpoint(checkpoints: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """One row per run: the recorded best if it is still there, else the lowest loss (ties:
    lowest step), else the highest step.

    ``recorded`` is (run_id, step), at most one row per run. Keeping rank 1 is pushed below the
    shuffle, so a run with very many checkpoints sends one row per task.
    """
    if recorded is not None:
        marks = recorded.select("run_id", "step", F.lit(True).alias("is_recorded"))
        checkpoints = checkpoints.join(marks, ["run_id", "step"], "left")
    else:
        checkpoints = checkpoints.withColumn("is_recorded", F.lit(None).cast("boolean"))
    chosen = F.coalesce("is_recorded", F.lit(False))
    by_step = F.when(F.col("loss").isNull(), -F.col("step")).otherwise(F.col("step"))
    order = Window.partitionBy("run_id").orderBy(
        F.desc(chosen), F.col("loss").asc_nulls_last(), by_step
    )
    ranked = checkpoints.withColumn("_place", F.row_number().over(order))
    return ranked.filter(F.col("_place") == 1).drop("_place", "is_recorded")


def checkpoint_retention(checkpoints: DataFrame, keep_last: int = 3) -> DataFrame:
    """Checkpoints a clean-up would drop: all but the last ``keep_last`` of each run.
    ``keep_last=0`` drops nothing. Nothing is deleted here.

    The oldest kept step per run comes from a top-k; rows are then compared with it, so no task
    has to sort a whole run.
    """
    if keep_last < 0:
        raise ValueError("keep_last must not be negative")
    if keep_last == 0:
        return checkpoints.limit(0)
    newest = Window.partitionBy("run_id").orderBy(F.desc("step"))
    kept = (
        checkpoints.select("run_id", "step")
        .withColumn("_place", F.row_number().over(newest))
        .filter(F.col("_place") <= keep_last)
    )
    oldest_kept = kept.groupBy("run_id").agg(F.min("step").alias("_oldest"))
    return (
        checkpoints.join(oldest_kept, "run_id")
        .filter(F.col("step") < F.col("_oldest"))
        .drop("_oldest")
    )
