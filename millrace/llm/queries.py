"""One query per operator: (spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import audit, chat, decontaminate, fingerprints, language, lines, pieces, repair, repeats, shards, simhash, substrings, urls

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = decontaminate.decontaminate(docs, table(spark, sf, "benchmark"), keep=["doc_id"])
    return made.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op2_simhash(spark, sf):
    made = simhash.near_duplicates(table(spark, sf, "documents"))
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op3_sentencepiece(spark, sf):
    docs, model = table(spark, sf, "documents").select("doc_id", "text"), pieces.compile_model(MODEL)
    made = pieces.encode(docs, model, decoded=True)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.col("ids").cast("string"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query
def op5_substrings(spark, sf):
    made = substrings.remove_repeats(table(spark, sf, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_lines(spark, sf):
    made = lines.remove_lines(table(spark, sf, "documents").select("doc_id", "text"), passage=50)
    return made.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op7_language(spark, sf):
    docs = table(spark, sf, "documents")
    return language.predict(docs, language.fit(docs), keep=["doc_id"])


@query
def op9_sharding(spark, sf):
    made = shards.assign(table(spark, sf, "documents"))
    return made.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_fingerprints(spark, sf):
    return fingerprints.fingerprints(table(spark, sf, "documents"))


RULES = [
    urls.Rule("org", "/", urls.ALLOW), urls.Rule("example.org", "/es/", urls.BLOCK), urls.Rule("example.org", "/en/1", urls.BLOCK),
    urls.Rule("com", "/fr/", urls.ALLOW), urls.Rule("com", "/de/", urls.BLOCK),
]


@query
def op4_urls(spark, sf):
    """The URLs that a rule decides are the labelled ones; the trees judge the others."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    parts = urls.with_parts(pages, "url")
    known = parts.withColumn("verdict", urls.rule_columns(RULES, F.col("host"), F.col("path"))[1]).filter("verdict IS NOT NULL")
    model = urls.fit(known.select("url", (F.col("verdict") == urls.BLOCK).cast("int").alias("blocked")))
    return urls.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict")


@query
def op8_chat(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    quote = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", quote), (-1, 1, "assistant", quote)], rows.schema)
    made = chat.format_conversations(chat.as_events(rows.unionByName(extra)))
    read = made.select("conv_id", "formatted", chat.read_back(F.col("formatted"), F.col("loss")).alias("turns"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op11_repeats(spark, sf):
    made = repeats.judge(table(spark, sf, "documents"), keep=["doc_id"])
    return made.drop("longest_repeat", "spans")


@query
def op12_audit(spark, sf):
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op13_repair(spark, sf):
    return repair.repair(repair.damaged(table(spark, sf, "conversations")))
