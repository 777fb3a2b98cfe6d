import random

import pytest
from pyspark.sql import functions as F

from millrace.constants import COMPLETE_LIMITS
from millrace.functions import prompts as P
from millrace.functions import requests as R
from millrace.operators import samples as S
from millrace.plans import generation as G

HEADER = "### Language: go\n### Task: Complete the following code\n### Code:\n"


def one(values, **kwargs):
    return values([("c{x}", "go")], "c string, l string", P.format_sample(F.col("c"), F.col("l"), **kwargs))[0]


def test_templates(values):
    assert one(values) == HEADER + "c{x}\n### End"
    assert one(values, template="no such") == HEADER + "c{x}\n### End"
    assert one(values, template="completion") == "c{x}"
    assert one(values, template="explain") == "### Code:\nc{x}\n### Explanation:\nThis code"
    assert one(values, template="fim") == "c{x}"
    assert one(values, template="fim", prefix=F.lit("a"), suffix=F.lit("b")) == "<fim_prefix>a<fim_suffix>b<fim_middle>"
    assert one(values, template="docstring") == "c{x}"
    assert one(values, template="docstring", docstring=F.lit("d")) == "### Code:\nc{x}\n### Docstring:\nd"


def test_custom_template_needs_its_fields(values):
    assert values([("p",)], "c string", P.fill("<{{{name}}}>", {"name": F.col("c")})) == ["<{p}>"]
    with pytest.raises(KeyError):
        P.fill("{absent}", {})


def test_completion_prompt_is_left_open(values):
    assert values([("x", "go")], "c string, l string", P.completion_prompt(F.col("c"), F.col("l"))) == [HEADER + "x"]


def test_instruction_rows_fall_back(spark):
    code = spark.createDataFrame([("x",)], "code string")
    assert S.instruction_rows(code).first().text == HEADER.replace("go", "code") + "x\n### End"
    nothing = spark.createDataFrame([("go",)], "language string")
    assert S.instruction_rows(nothing).first().text == HEADER + "\n### End"
    both = spark.createDataFrame([("go", "t", "c")], "language string, text string, code string")
    assert S.instruction_rows(both).first().text == HEADER + "t\n### End"


def test_stops_cut_in_the_order_given(values):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc", k=12)) for _ in range(200)] + ["", "x### End y"]
    stops = ["ab", "c", "### End"]

    def cut(text):
        for stop in stops:
            text = text.split(stop)[0]
        return text

    assert values([(t,) for t in texts], "t string", P.cut_stop_sequences(F.col("t"), stops)) == [cut(t) for t in texts]


REQUEST = "max_new_tokens int, temperature double, top_p double, top_k int, repetition_penalty double, do_sample boolean"


def test_request_limits(spark):
    rows = [(1, 0.0, 0.0, 1, 1.0, True), (4096, 2.0, 1.0, 200, 2.0, True), (0, 2.1, 1.01, 0, 0.9, True), (4097, -0.1, -0.1, 201, 2.1, False)]
    checked = G.validate_requests(spark.createDataFrame(rows, REQUEST)).collect()
    everything = ["max_new_tokens", "temperature", "top_p", "top_k", "repetition_penalty"]
    assert [r.violations for r in checked] == [[], [], everything, everything]
    assert [r.valid for r in checked] == [True, True, False, False]
    short = spark.createDataFrame([(2049, 0.5)], "max_new_tokens int, temperature double")
    assert G.validate_requests(short, COMPLETE_LIMITS).first().violations == ["max_new_tokens"]


def test_zero_counts_as_missing(values):
    got = values([(0.0,), (None,), (0.2,)], "t double", R.or_default(F.col("t"), 0.7))
    assert got == [0.7, 0.7, 0.2]


def test_greedy_requests_run_with_neutral_values(spark):
    rows = [(5, 0.3, 0.4, 7, 1.1, False), (5, 0.3, 0.4, 7, 1.1, True)]
    got = G.apply_sampling(spark.createDataFrame(rows, REQUEST)).collect()
    assert [(r.temperature, r.top_p, r.top_k) for r in got] == [(1.0, 1.0, 50), (0.3, 0.4, 7)]


def test_bulk_generation(spark):
    rows = [("p1", 0, 0.0, 0.9, 5, 1.1, True), ("p2", 8, 0.0, 0.9, 5, 1.1, True), ("p3", 8, 0.5, 0.9, 5, 1.1, False)]
    prepared = G.prepare_generate(spark.createDataFrame(rows, "prompt string, " + REQUEST))

    def model(frame):
        return frame.assign(raw_text=frame["prompt"] + "### End rest", tokens_generated=frame["max_new_tokens"], elapsed=[0.0] * len(frame))

    done = {r.prompt: r for r in G.finish_completion(G.run_model(prepared, model)).collect()}
    assert set(done) == {"p2", "p3"}
    assert done["p2"].temperature == 0.7 and done["p3"].temperature == 1.0
    assert done["p2"].generated_text == "p2" and done["p2"].tokens_generated == 8
    assert done["p2"].tokens_per_second is None


def test_completion_ignores_the_requested_temperature(spark):
    rows = spark.createDataFrame([("x", "go", 16, 0.1)], "code_prefix string, language string, max_new_tokens int, temperature double")
    row = G.prepare_completion(rows).first()
    assert (row.temperature, row.max_new_tokens, row.prompt) == (0.7, 16, HEADER + "x")


def test_explain(spark):
    row = G.prepare_explain(spark.createDataFrame([("x", "go")], "code string, language string")).first()
    assert (row.max_new_tokens, row.temperature) == (300, 0.3)
    out = spark.createDataFrame([(" adds", 3, 1.5)], "raw_text string, tokens_generated int, elapsed double")
    done = G.finish_explain(out).first()
    assert (done.generated_text, done.tokens_per_second, done.time_seconds) == ("This code adds", 2.0, 1.5)


def test_rows_fall_back_one_by_one(spark):
    rows = [("t", "c", "go"), (None, "c", None), (None, None, "go")]
    made = S.instruction_rows(spark.createDataFrame(rows, "text string, code string, language string")).collect()
    assert [r.text.split("### Code:\n")[1] for r in made] == ["t\n### End", "c\n### End", "\n### End"]
    assert [r.language for r in made] == ["go", "code", "go"]


def test_requests_end_to_end(spark):
    def model(frame):
        frame["raw_text"] = [f"{len(ids)} {n} {t}### End more" for ids, n, t in zip(frame["input_ids"], frame["max_new_tokens"], frame["temperature"])]
        frame["tokens_generated"] = frame["max_new_tokens"].astype("int32")
        frame["elapsed"] = 2.0
        return frame

    words = spark.createDataFrame([("w", 2)], "token string, token_id int")
    long = "w " * 3000
    asked = spark.createDataFrame([(1, long, None, None), (2, "w", 9000, None), (3, "w", 7, 0.0)], "id long, prompt string, max_new_tokens int, temperature double")
    made = {r.id: r for r in G.generate_all(asked, words, model, ["### End"]).collect()}
    assert set(made) == {1, 3} and made[1].generated_text == "1800 512 0.7" and made[3].generated_text == "1 7 0.7"
    assert made[1].do_sample and made[1].top_p == 0.95 and made[1].top_k == 50 and made[1].repetition_penalty == 1.1
    completed = {r.id: r for r in G.complete_all(asked.withColumnRenamed("prompt", "code_prefix"), words, model).collect()}
    assert set(completed) == {1, 3} and completed[1].max_new_tokens == 256 and completed[1].language == "python"
    explained = G.explain_all(spark.createDataFrame([("w",)], "code string"), words, model).first()
    assert explained.generated_text.startswith("This code") and explained.max_new_tokens == 300 and explained.language == "python"
