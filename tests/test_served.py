"""A model that is set up once a task, with errors by row."""

import os
import uuid

from pyspark.sql import functions as F

from millrace.plans import generation as G


def served(folder, sizes, batch_rows=4):
    def setup():
        open(os.path.join(folder, f"setup-{uuid.uuid4().hex}"), "w").close()

        def generate(frame):
            open(os.path.join(sizes, f"{len(frame)}-{uuid.uuid4().hex}"), "w").close()
            if (frame["prompt"] == "bad").any():
                raise RuntimeError("no answer")
            return frame.assign(raw_text=frame["prompt"] + "|", tokens_generated=frame["input_ids"].str.len(), elapsed=0.5)

        return generate

    return G.Served(setup, batch_rows)


def test_one_setup_a_task_and_errors_by_row(spark, tmp_path):
    folder, sizes = tmp_path / "setups", tmp_path / "sizes"
    folder.mkdir(), sizes.mkdir()
    rows = spark.range(0, 60, numPartitions=3).select(
        F.when(F.col("id") % 20 == 7, "bad").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("prompt"),
        F.when(F.col("id") != 9, F.sequence(F.lit(0), F.col("id") % 5)).alias("input_ids"), "id")
    got = G.run_served(rows, served(str(folder), str(sizes))).collect()
    assert len(os.listdir(folder)) == 3 and len(got) == 60
    for r in got:
        if r.prompt == "bad":
            assert r.raw_text is None and r.tokens_generated is None and r.error == "RuntimeError: no answer"
        elif r.id != 9:
            assert (r.raw_text, r.tokens_generated, r.error) == (f"{r.prompt}|", r.id % 5 + 1, None)
    assert max(int(name.split("-")[0]) for name in os.listdir(sizes)) == 4


def test_empty_tasks_set_nothing_up_and_whole_requests(spark, tmp_path):
    folder, sizes = tmp_path / "setups", tmp_path / "sizes"
    folder.mkdir(), sizes.mkdir()
    model = served(str(folder), str(sizes))
    empty = spark.createDataFrame([], "prompt string, input_ids array<int>, id long")
    assert G.run_served(empty, model).collect() == [] and not os.listdir(folder)
    words = spark.createDataFrame([("a", 5, 0), ("b", 3, 1)], "token string, n long, token_id int")
    asked = spark.createDataFrame([("a b", "go"), ("b", None)], "code_prefix string, language string")
    done = G.complete_all(asked, words, model).collect()
    assert len(done) == 2 and all(r.error is None and r.generated_text for r in done)
