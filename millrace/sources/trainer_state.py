"""Checkpoint folders with their trainer state files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import decode_text
from millrace.operators.checkpoints import last_loss
from millrace.schemas import TRAINER_STATE
from millrace.sources.tree import read_contents

STATE_FILE = "trainer_state.json"
CHECKPOINT_FOLDER = r"\Acheckpoint-[^/]*\z"


def _folders(listing: DataFrame) -> DataFrame:
    folders = listing.filter("is_dir").filter(F.col("rel_path").rlike(CHECKPOINT_FOLDER))
    step = F.substring_index("rel_path", "-", -1).try_cast("long")
    return folders.select(F.col("repo").alias("run_id"), "rel_path", "path", step.alias("step"))


def _states(files: DataFrame) -> DataFrame:
    """A broken file gives a null state, not a failure."""
    state = F.from_json(decode_text(F.col("content")), TRAINER_STATE)
    return read_contents(files).select(F.col("repo").alias("run_id"), "rel_path", state.alias("state"))


def read_trainer_state(listing: DataFrame) -> DataFrame:
    """run_id, path, step, loss for every checkpoint-<step> folder of every run.

    ``listing`` comes from sources.tree.list_tree with the run as ``repo``. A folder without a
    readable state file stays, with a null loss.
    """
    name = F.substring_index("rel_path", "/", 1)
    files = listing.filter(
        ~F.col("is_dir") & name.rlike(CHECKPOINT_FOLDER) & (F.col("rel_path") == F.concat(name, F.lit(f"/{STATE_FILE}")))
    )
    losses = _states(files).select("run_id", name.alias("rel_path"), last_loss(F.col("state.log_history")).alias("loss"))
    return _folders(listing).join(losses, ["run_id", "rel_path"], "left").select("run_id", "path", "step", "loss")


def recorded_best(listing: DataFrame) -> DataFrame:
    """(run_id, step) of the best checkpoint a run's own state file names, where it still exists.
    The state may name it by a relative or moved path, so its last part decides."""
    states = _states(listing.filter(F.col("rel_path") == STATE_FILE))
    step = F.regexp_extract("state.best_model_checkpoint", r"checkpoint-(\d+)/*$", 1).try_cast("long")
    return states.select("run_id", step.alias("step")).join(_folders(listing), ["run_id", "step"]).select("run_id", "step")
