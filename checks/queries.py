"""One query per operator: (spark, folder of the given tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import trees as TW
from checks.adapters import CODE_DOCS, documents, table, view
from millrace.constants import COMPLETE_LIMITS
from millrace.functions import chunks as C
from millrace.functions import prompts as P
from millrace.functions import requests as R
from millrace.functions import text as X
from millrace.operators import catalog as K
from millrace.operators import checkpoints as H
from millrace.operators import files as FI
from millrace.operators import merge as M
from millrace.operators import ordering as O
from millrace.operators import samples as S
from millrace.operators import tokens as T
from millrace.options import BuildOptions, ChunkOptions, ScanOptions
from millrace.plans import build as B
from millrace.plans import generation as G
from millrace.plans import growth as GR
from millrace.plans import ingest as I
from millrace.plans import training as N
from millrace.session import stage, work_path
from millrace.sources import code_tree as CT
from millrace.sources import stores as ST
from millrace.sources.buckets import BucketedTable
from millrace.sources import trainer_state as TS
from millrace.sources import tree as TR
from millrace.streaming import live as L

Q = {}
SCAN = ScanOptions()
IDS = ("doc_id", "rel_path")


def query(fn):
    Q[fn.__name__] = fn
    return fn


# ---- shared inputs ---------------------------------------------------------------------------

def docs(spark, sf, name="code_docs"):
    return view(spark, sf, name)


def with_bytes(df):
    return df.withColumn("bytes", F.octet_length("content"))


def with_language(df):
    return df.withColumn("language", X.detect_language(X.file_extension(F.col("rel_path"))))


def code_files(spark, sf):
    """Decoded files of known language."""
    known = with_language(docs(spark, sf)).filter("language IS NOT NULL")
    return X.compute_once(known, content=X.decode_text(F.col("content")))


def digest(column="content"):
    return F.sha2(column, 256).alias("digest")


def earlier(spark, sf, df):
    """What an earlier run saw: the labelled documents. The new run sees all of them again."""
    return df.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def joined(column):
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


# ---- scans, sources, sinks -------------------------------------------------------------------

def tree(spark, sf):
    """The files written out by tasks; returns (repo, path) roots."""
    root = TW.mounted(work_path(spark, "files"))
    TW.write_tree(docs(spark, sf), root)
    return docs(spark, sf).select("repo").distinct().withColumn("path", F.concat_ws("/", F.lit(root), "repo"))


@query
def scan_code_tree(spark, sf):
    found = TR.scan_code_tree(tree(spark, sf), SCAN)
    return found.select("repo", "rel_path", "extension", "language", "size_kb", "line_count", "content_hash")


@query
def read_code_tree(spark, sf):
    """The same files through the ``code_tree`` format."""
    root = TW.mounted(work_path(spark, "files"))
    TW.write_tree(docs(spark, sf), root)
    found = CT.read_code_tree(spark, root, SCAN)
    return found.select("repo", "rel_path", "extension", "language", "size_kb", "line_count", "content_hash")


@query
def decode_text(spark, sf):
    raw = documents(spark, sf).select(
        "doc_id",
        F.concat(F.unhex(F.lit("61FF62E28263")), F.encode("text", "UTF-8"), F.unhex(F.lit("0D0A0D7A"))).alias("raw"),
    )
    text = X.decode_text(F.col("raw"))
    return raw.select("doc_id", text.alias("text"))


def raw_store(spark, sf):
    path = work_path(spark, "raw")
    ST.write_raw_store(FI.dedupe_content(FI.scan_files(docs(spark, sf), SCAN)), path)
    return path


@query
def write_raw_store(spark, sf):
    stored = ST.scan_raw_store(spark, raw_store(spark, sf))
    return stored.select("repo", "language", "safe_name", "rel_path", digest())


@query
def scan_raw_store(spark, sf):
    stored = ST.scan_raw_store(spark, raw_store(spark, sf))
    return stored.select("repo", "rel_path", "line_count", digest())


def built(spark, sf):
    files = code_files(spark, sf).select("repo", "rel_path", "language", "content")
    return B.build_dataset(files, work_path(spark, "dataset"), "v1")


def version_folder(spark, sf):
    path = work_path(spark, "version")
    samples = stage(S.build_samples(code_files(spark, sf)), "samples")
    ST.write_split_jsonl(O.exact_split(samples, "id"), path)
    return path


@query
def write_split_jsonl(spark, sf):
    path = version_folder(spark, sf)
    return spark.read.schema(ST.SAMPLES).json(path).groupBy("split").agg(
        F.count("*").alias("samples"), F.sum(F.length("text")).alias("chars")
    )


@query
def read_samples_jsonl(spark, sf):
    """Broken and blank lines between the samples are passed over."""
    path = work_path(spark, "jsonl")
    samples = S.build_samples(code_files(spark, sf)).select(F.to_json(F.struct("*")).alias("value"))
    lines = samples.select(F.explode(F.array("value", F.lit(""), F.concat(F.lit("{"), "value"))).alias("value"))
    lines.write.text(path)
    return ST.read_samples_jsonl(spark, path).select("id", "language", "chunk_idx", digest("text"))


@query
def load_split_dataset(spark, sf):
    parts = ST.load_split_dataset(spark, version_folder(spark, sf))
    counts = [d.agg(F.count("*").alias("samples")).withColumn("split", F.lit(s)) for s, d in parts.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query
def write_metadata(spark, sf):
    return built(spark, sf).metadata.select(
        "version", "total_samples", "train_samples", "val_samples", "test_samples", "languages"
    )


@query
def catalog_tables(spark, sf):
    """Rows brought to the four table layouts, with the default of every column left out."""
    repos = K.conform(docs(spark, sf, "repos_in").select("id", "url", X.repo_name(F.col("url")).alias("name")), "repositories")
    files = K.conform(code_files(spark, sf).select("rel_path").withColumnRenamed("rel_path", "file_path"), "code_file_catalog")
    runs = K.conform(docs(spark, sf, "runs_in").drop("status", "total_samples"), "training_runs")
    versions = K.conform(docs(spark, sf, "versions_in").drop("total_samples"), "dataset_versions")

    def row(df, name, *checks):
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in checks])
        return df.select(F.lit(name).alias("table_name"), F.col(checks[0]).alias("key"), text.alias("defaults"))

    return (
        row(repos, "repositories", "id", "name", "branch", "status", "files_count", "total_lines")
        .unionByName(row(files, "code_file_catalog", "file_path", "line_count", "is_processed"))
        .unionByName(row(runs, "training_runs", "id", "status", "total_samples", "epochs_completed"))
        .unionByName(row(versions, "dataset_versions", "id", "total_samples", "train_samples", "val_samples", "test_samples"))
    )


def run_tree(spark, sf):
    """Per user one run with a checkpoint folder per event, each with its state file; error
    events leave a folder whose state has no loss. The files are in archives: as plain ones, an event would take two
    blocks of a disk."""
    runs = docs(spark, sf, "checkpoints_in")
    entry = F.to_json(F.struct("loss", F.col("step").alias("epoch")))
    state = F.concat(F.lit('{"log_history": [{"loss": 9.5}, '), entry, F.lit(', {"eval_loss": 0.5}]}'))
    files = runs.select(
        F.col("run_id").cast("string").alias("repo"),
        F.concat(F.lit("checkpoint-"), "step", F.lit("/trainer_state.json")).alias("rel_path"),
        state.alias("content"),
    )
    best = runs.filter("loss IS NOT NULL").groupBy("run_id").agg(F.min_by("step", F.struct("loss", "step")).alias("step"))
    root = TW.mounted(work_path(spark, "runs"))
    top = best.select(
        F.col("run_id").cast("string").alias("repo"), F.lit("trainer_state.json").alias("rel_path"),
        F.concat(F.lit(f'{{"best_model_checkpoint": "{root}/'), "run_id", F.lit("/checkpoint-"), "step", F.lit('"}')).alias("content"),
    )
    return TR.list_tree(TW.write_archives(files.unionByName(top), root))


@query
def read_trainer_state(spark, sf):
    listing = run_tree(spark, sf)
    found = TS.read_trainer_state(listing)
    best = TS.recorded_best(listing).withColumn("is_best", F.lit(True))
    return found.join(best, ["run_id", "step"], "left").select(
        "run_id", "step", "loss", F.coalesce("is_best", F.lit(False)).alias("is_best")
    )


# ---- projections, filters --------------------------------------------------------------------

@query
def file_extension(spark, sf):
    return docs(spark, sf).select("doc_id", "rel_path", X.file_extension(F.col("rel_path")).alias("extension"))


@query
def detect_language(spark, sf):
    return with_language(docs(spark, sf)).select("doc_id", "rel_path", "language")


@query
def exclude_paths(spark, sf):
    return FI.exclude_paths(docs(spark, sf)).select("doc_id", "rel_path")


@query
def filter_extension(spark, sf):
    return FI.filter_extension(docs(spark, sf)).select("doc_id", "rel_path")


@query
def filter_size(spark, sf):
    return FI.filter_size(with_bytes(docs(spark, sf)), 8).select("doc_id", "rel_path", F.col("bytes").cast("bigint").alias("bytes"))


@query
def filter_min_lines(spark, sf):
    counted = X.compute_once(docs(spark, sf), line_count=X.line_count(X.decode_text(F.col("content"))))
    return FI.filter_min_lines(counted).select("doc_id", "rel_path", F.col("line_count").cast("bigint").alias("line_count"))


@query
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", "rel_path", X.content_hash(X.decode_text(F.col("content"))).alias("content_hash"))


@query
def file_metrics(spark, sf):
    described = FI.scan_files(docs(spark, sf), ScanOptions(exclude=(), max_size_kb=1e9, min_lines=0))
    return described.select("repo", "rel_path", "extension", "size_kb", F.col("line_count").cast("bigint").alias("line_count"))


@query
def repo_name(spark, sf):
    return docs(spark, sf, "repos_in").select("id", X.repo_name(F.col("url")).alias("name"))


@query
def safe_name(spark, sf):
    return docs(spark, sf).select("doc_id", X.safe_name(F.col("rel_path")).alias("safe_name"))


@query
def is_meaningful(spark, sf):
    return docs(spark, sf).select("doc_id", "rel_path", X.has_words(F.col("content"), 20).alias("file_ok"),
                                  X.has_words(F.col("content"), 10).alias("chunk_ok"))


@query
def validate_requests(spark, sf):
    requests = docs(spark, sf, "requests_in")
    checked = G.validate_requests(requests).withColumn("complete_violations", F.array_join(R.violations(COMPLETE_LIMITS), ","))
    return checked.select("conv_id", "turn", "valid", F.array_join("violations", ",").alias("violations"), "complete_violations")


def sparse_requests(spark, sf):
    """Requests in which some fields are not given."""
    requests = docs(spark, sf, "requests_in")
    given = {"max_new_tokens": 5, "temperature": 7, "top_p": 4, "top_k": 3, "repetition_penalty": 6, "do_sample": 8}
    return requests.withColumns({c: F.when((F.col("conv_id") + F.col("turn")) % n != 0, F.col(c)) for c, n in given.items()})


@query
def request_defaults(spark, sf):
    return G.fill_request_defaults(sparse_requests(spark, sf)).select(
        "conv_id", "turn", F.col("max_new_tokens").cast("bigint").alias("max_new_tokens"), "temperature",
        "top_p", F.col("top_k").cast("bigint").alias("top_k"), "repetition_penalty", "do_sample",
    )


@query
def sampling_params(spark, sf):
    return G.apply_sampling(G.fill_request_defaults(sparse_requests(spark, sf))).select(
        "conv_id", "turn", "temperature", "top_p", F.col("top_k").cast("bigint").alias("top_k"), "do_sample"
    )


# ---- joins -----------------------------------------------------------------------------------

def as_catalog(df):
    described = df.select(
        F.col("repo").alias("repository_id"), F.col("rel_path").alias("file_path"), "language",
        X.content_hash(F.col("content")).alias("content_hash"),
    )
    return described


@query
def new_catalog_rows(spark, sf):
    files = code_files(spark, sf)
    catalog = K.conform(as_catalog(earlier(spark, sf, files)), "code_file_catalog")
    added = K.new_catalog_rows(as_catalog(files), catalog)
    return catalog.unionByName(added).select("repository_id", "file_path", "language", "content_hash", "is_processed")


def sides(spark, sf):
    """Formatted samples of the earlier and of all documents, with their document."""
    files = code_files(spark, sf)
    return S.preprocess(earlier(spark, sf, files)), S.preprocess(files)


@query
def incremental_anti_join(spark, sf):
    old, new = sides(spark, sf)
    return M.incremental_anti_join(new, old).select(*IDS, "chunk_idx", digest("text"))


def repository_results(spark, sf):
    urls = docs(spark, sf, "repos_in")
    existing = K.conform(urls.select("id", "url", X.repo_name(F.col("url")).alias("name"), "status", "created_at"), "repositories")
    counts = FI.repo_summary(FI.scan_files(docs(spark, sf), SCAN))
    number = F.regexp_extract("repo", r"(\d+)", 1).cast("bigint")
    results = counts.withColumn("id", number).join(urls.select("id", F.col("url").alias("known")), "id", "left").select(
        F.coalesce("known", F.concat(F.lit("https://example.com/new/"), "repo")).alias("url"),
        F.col("repo").alias("name"), F.lit("main").alias("branch"), "files", "lines", "size_kb",
        F.col("repo").alias("local_path"),
        F.when(F.col("id") % 5 == 3, "not reachable").alias("error"),
    )
    return existing, results


def shown_repositories(rows):
    return rows.select(
        "url", "name", "branch", "status", F.col("files_count").cast("bigint").alias("files_count"),
        F.col("total_lines").cast("bigint").alias("total_lines"), F.round("size_kb", 3).alias("size_kb"),
        "local_path", "error_message",
    )


@query
def upsert_repositories(spark, sf):
    return shown_repositories(K.upsert_repositories(*repository_results(spark, sf)))


@query
def bucketed_repositories(spark, sf):
    """The same upsert into a table of buckets, of which only those of the results are written anew."""
    existing, results = repository_results(spark, sf)
    table_ = BucketedTable(spark, work_path(spark, "catalogue"), "repositories", "url")
    table_.merge(existing, lambda old, new: new)
    table_.merge(results, K.upsert_repositories)
    return shown_repositories(table_.read())


@query
def language_lookup_join(spark, sf):
    files = docs(spark, sf).withColumn("extension", X.file_extension(F.col("rel_path")))
    return FI.language_lookup_join(files).select("doc_id", "rel_path", "language")


# ---- aggregations ----------------------------------------------------------------------------

@query
def dedupe_content(spark, sf):
    return FI.dedupe_content(FI.scan_files(docs(spark, sf), SCAN)).select("repo", "rel_path", "content_hash")


@query
def repo_summary(spark, sf):
    kept = FI.dedupe_content(FI.scan_files(docs(spark, sf), SCAN))
    return FI.repo_summary(kept).select("repo", "files", "lines", F.round("size_kb", 3).alias("size_kb"))


@query
def language_counts(spark, sf):
    return S.language_counts_from_files(with_language(docs(spark, sf)).filter("language IS NOT NULL"))


@query
def split_counts(spark, sf):
    return O.split_counts(O.exact_split(docs(spark, sf).select(*IDS), *IDS))


@query
def token_stats(spark, sf):
    stats = T.token_stats(documents(spark, sf), "doc_id")
    return stats.withColumn("mean", F.round("mean", 6))


@query
def generation_throughput(spark, sf):
    rows = docs(spark, sf, "generations_in").join(documents(spark, sf).select(F.col("doc_id").alias("conv_id"), "lang"), "conv_id")
    total = G.throughput_summary(rows, "lang")
    return total.select("lang", "requests", "tokens", F.round("seconds", 3).alias("seconds"), "tokens_per_second")


@query
def repo_catalog_summary(spark, sf):
    repos = K.conform(docs(spark, sf, "repos_in").select("id", "url", "status"), "repositories")
    return K.repo_catalog_summary(repos)


# ---- ordered selections ----------------------------------------------------------------------

@query
def exact_split(spark, sf):
    return O.exact_split(docs(spark, sf).select(*IDS), *IDS)


@query
def latest_dataset(spark, sf):
    versions = docs(spark, sf, "versions_in").select(
        "id", "created_at", F.concat(F.lit("dataset/"), "version").alias("path"), (F.col("path_exists") == 1).alias("path_exists"))
    folders = docs(spark, sf, "versions_in").select(
        F.concat(F.lit("folder/"), "version").alias("path"), F.col("created_at").alias("modified_at"))
    return K.latest_dataset(versions, folders)


@query
def last_loss(spark, sf):
    """A log of three entries per event; the last one of an error event has no loss."""
    def entry(name, value):
        return F.create_map(name, value.cast("string"))

    value = F.col("value")
    last = F.when(F.col("event_type") == "error", F.lit("epoch")).otherwise(F.lit("loss"))
    log = F.array(entry(F.lit("loss"), value), entry(F.lit("eval_loss"), value + 1), entry(last, value / 2))
    return table(spark, sf, "events").select("event_id", H.last_loss(log).alias("loss"))


@query
def best_checkpoint(spark, sf):
    recorded = table(spark, sf, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("event_id").alias("step"))
    return H.best_checkpoint(docs(spark, sf, "checkpoints_in"), recorded).select("run_id", "step", "loss")


@query
def checkpoint_retention(spark, sf):
    return H.checkpoint_retention(docs(spark, sf, "checkpoints_in")).select("run_id", "step")


# ---- listings --------------------------------------------------------------------------------

@query
def list_repositories(spark, sf):
    repos = docs(spark, sf, "repos_in").withColumns({
        "name": X.repo_name(F.col("url")), "url": F.concat("url", F.repeat(F.lit("/x"), F.lit(20)))})
    listed = K.list_repositories(K.conform(repos, "repositories"))
    return listed.select("id", "url", K.short_url().alias("short_url"), "name", "branch", "status", "files_count", "created_at")


@query
def list_datasets(spark, sf):
    versions = K.conform(docs(spark, sf, "versions_in").withColumn("path", F.concat(F.lit("dataset/"), "version")), "dataset_versions")
    return K.list_datasets(versions).select(
        "id", "version", "path", F.col("total_samples").cast("bigint").alias("total_samples"), "languages", "created_at")


@query
def list_training_runs(spark, sf):
    listed = K.list_training_runs(K.conform(docs(spark, sf, "runs_in"), "training_runs"))
    return listed.select(
        "id", "name", "status", "base_model", K.short_model().alias("short_model"), "output_path",
        K.shown_path().alias("shown_path"), "total_samples", "created_at")


@query
def list_checkpoints(spark, sf):
    return H.list_checkpoints(docs(spark, sf, "checkpoints_in"))


@query
def shuffle(spark, sf):
    """Where each row ended up: rows counted inside a partition, from the partition's lowest rank."""
    ranked = O.global_rank(docs(spark, sf).select(*IDS), *IDS)
    moved = O.shuffle(ranked, *IDS).withColumn("position", F.monotonically_increasing_id())
    partition = Window.partitionBy(F.shiftright("position", 33))
    place = F.row_number().over(partition.orderBy("position"))
    return moved.select(*IDS, "rank", (F.min("rank").over(partition) + place - 1).alias("shuffled_at"))


@query
def union_incremental(spark, sf):
    old, new = sides(spark, sf)
    return M.union_incremental(new, old).select(*IDS, "chunk_idx", digest("text"))


# ---- scalar text -----------------------------------------------------------------------------

@query
def remove_comments(spark, sf):
    files = code_files(spark, sf)
    return files.select(
        *IDS, digest_of(X.remove_comments(F.col("content"), F.col("language"))).alias("digest"),
        digest_of(X.remove_comments(F.concat(F.lit('"""doc\nstring"""\n'), "content"), F.col("language"), False)).alias("digest_all"),
    )


def digest_of(column):
    return F.sha2(column, 256)


@query
def normalize_whitespace(spark, sf):
    return docs(spark, sf).select(*IDS, digest_of(X.normalize_whitespace(F.col("content"))).alias("digest"))


@query
def remove_boilerplate(spark, sf):
    files = code_files(spark, sf)
    return files.select(*IDS, digest_of(X.remove_boilerplate(F.col("content"), F.col("language"))).alias("digest"))


@query
def chunk_chars(spark, sf):
    return S.explode_chunks(docs(spark, sf).select(*IDS, "content")).select(
        *IDS, F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.length("chunk").cast("bigint").alias("chars"), digest("chunk"))


@query
def chunk_lines(spark, sf):
    return S.explode_chunks(docs(spark, sf).select(*IDS, "content"), ChunkOptions(8, 2), unit="lines").select(
        *IDS, F.col("chunk_idx").cast("bigint").alias("chunk_idx"), digest("chunk"))


@query
def extract_functions_python(spark, sf):
    files = code_files(spark, sf).filter("language = 'python'")
    return S.extract_functions(files.select(*IDS, "language", "content")).select(
        *IDS, F.col("fn_idx").cast("bigint").alias("fn_idx"), "name", digest("code"))


@query
def extract_functions_js(spark, sf):
    files = code_files(spark, sf).filter("language <> 'python'")
    return S.extract_functions(files.select(*IDS, "language", "content")).select(
        *IDS, F.col("fn_idx").cast("bigint").alias("fn_idx"), "name", digest("code"))


@query
def format_sample(spark, sf):
    code, language = F.col("content"), F.col("language")
    half = F.floor(F.length("content") / 2).cast("int")
    fields = {"prefix": F.substring("content", F.lit(1), half), "suffix": F.substring("content", half + 1, F.length("content")),
              "docstring": F.col("rel_path")}
    made = {
        "completion": P.format_sample(code, language, "completion"),
        "instruction": P.format_sample(code, language, "instruction"),
        "fim": P.format_sample(code, language, "fim", **fields),
        "fim_bare": P.format_sample(code, language, "fim"),
        "docstring": P.format_sample(code, language, "docstring", **fields),
        "explain": P.format_sample(code, language, "explain"),
        "unknown": P.format_sample(code, language, "no such template"),
    }
    return code_files(spark, sf).select(*IDS, *[digest_of(c).alias(n) for n, c in made.items()])


@query
def token_estimate(spark, sf):
    return docs(spark, sf).select(
        *IDS, F.round(X.token_estimate(F.col("content")), 6).alias("token_estimate"),
        F.length("content").cast("bigint").alias("chunk_size"))


@query
def instruction_wrap(spark, sf):
    """Some rows have no text and fall back to their code, some have no language."""
    rows = code_files(spark, sf).select(
        *IDS, "language", F.col("content").alias("code"), F.when(F.col("doc_id") % 3 != 0, F.reverse("content")).alias("text"))
    wrapped = S.instruction_rows(rows.withColumn("language", F.when(F.col("doc_id") % 5 != 0, F.col("language"))))
    return wrapped.select(*IDS, "language", digest("text"))


@query
def completion_prompt(spark, sf):
    rows = docs(spark, sf, "requests_in")
    return rows.select("conv_id", "turn", P.completion_prompt(F.col("prompt"), F.lit("python")).alias("prompt"))


@query
def explain_prompt(spark, sf):
    rows = docs(spark, sf, "requests_in")
    return rows.select("conv_id", "turn", P.explain_prompt(F.col("prompt")).alias("prompt"))


@query
def cut_stop_sequences(spark, sf):
    rows = docs(spark, sf, "generations_in")
    return rows.select(
        "conv_id", "turn", P.cut_stop_sequences(F.col("raw_text")).alias("generated_text"),
        P.cut_stop_sequences(F.col("raw_text"), [".", "e", "### End"]).alias("several"),
        F.col("tokens_generated").cast("bigint").alias("tokens_generated"))


@query
def explain_postprocess(spark, sf):
    done = G.finish_explain(docs(spark, sf, "generations_in").withColumn("language", F.lit("python")))
    return done.select("conv_id", "turn", "language", "generated_text")


@query
def languages_json(spark, sf):
    counts = S.language_counts_from_files(code_files(spark, sf))
    return S.languages_json(counts)


@query
def run_metrics_json(spark, sf):
    """Numbers and options out of JSON text carried by the given events."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.to_json(F.struct(F.col("value").alias("eval_loss"))).alias("metrics"), F.col("props").alias("config"))
    return events.select("id", *K.metric_columns("eval_loss", "missing"), *K.config_columns(k="$.k", absent="$.a.b"))


@query
def run_metrics_variant(spark, sf):
    """Nested, listed and textual metrics; broken and missing JSON."""
    value, kind = F.col("value"), F.col("event_id") % 5
    flat, nested = F.struct(value.alias("eval_loss")), F.struct(F.struct(value.alias("loss"), F.array("event_id", F.lit(7)).alias("steps")).alias("eval"))
    text = (F.when(kind == 0, F.to_json(flat)).when(kind == 1, F.to_json(nested))
            .when(kind == 2, F.to_json(F.struct(F.col("event_type").alias("eval_loss"), value.cast("string").alias("note"))))
            .when(kind == 3, F.rtrim(F.to_json(flat), F.lit("}"))))
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("metrics"), "event_id")
    return events.select(
        "id", *K.metric_columns("eval_loss", "eval.loss", "note", "eval.steps[0]"), F.when(kind == 2, K.metric_texts("eval_loss")[0]).alias("shown"),
    ).withColumnsRenamed({"eval.loss": "nested_loss", "eval.steps[0]": "first_step"})


@query
def iso_timestamps(spark, sf):
    return table(spark, sf, "events").select("event_id", K.iso_timestamp(F.col("ts")).alias("ts"))


@query
def sample_ids(spark, sf):
    made = S.build_samples(code_files(spark, sf))
    return made.select("id", "source_file", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
                       S.version_label("id", "source_file").alias("version"))


# ---- tokens ----------------------------------------------------------------------------------

def vocabulary(spark, sf):
    """With gaps: the ids are the table's, not the places in it."""
    return T.build_vocabulary(documents(spark, sf)).withColumn("token_id", F.col("token_id") * 3)


@query
def build_vocabulary(spark, sf):
    return T.build_vocabulary(documents(spark, sf), size=2000).withColumn("token_id", F.col("token_id").cast("bigint"))


@query
def tokenize(spark, sf):
    made = T.tokenize(documents(spark, sf), vocabulary(spark, sf), ["doc_id"])
    return made.select(
        "doc_id", joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).cast("bigint").alias("mask_sum"),
        (F.col("labels") == F.col("input_ids")).alias("labels_copy"))


@query
def truncate_prompt(spark, sf):
    rows = docs(spark, sf).withColumnRenamed("content", "prompt")
    made = G.prompt_tokens(rows, vocabulary(spark, sf), list(IDS))
    return made.select(*IDS, F.size("input_ids").cast("bigint").alias("tokens"), digest_of(joined("input_ids")).alias("digest"))


@query
def pad_batches(spark, sf):
    made = T.tokenize(documents(spark, sf), vocabulary(spark, sf), ["doc_id"])
    return T.pad_batches(made, "doc_id").select(
        "doc_id", "batch_id", F.col("slot").cast("bigint").alias("slot"), joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"), joined("labels").alias("labels"))


# ---- user functions --------------------------------------------------------------------------

@query
def map_batches(spark, sf):
    """A tokenizer of the caller: one id for each byte."""
    def encode(texts):
        return [list(text.encode()) for text in texts]

    made = T.tokenize_with(documents(spark, sf), encode, ["doc_id"])
    return made.select("doc_id", F.size("input_ids").cast("bigint").alias("tokens"), digest_of(joined("input_ids")).alias("digest"))


@query
def custom_template(spark, sf):
    fields = {"code": F.col("content"), "repo": F.col("repo"), "path": F.col("rel_path")}
    return docs(spark, sf).select(*IDS, digest_of(P.fill("<{repo}>{path}\n{code}", fields)).alias("digest"))


# ---- whole plans -----------------------------------------------------------------------------

def ingest_inputs(spark, sf):
    files = docs(spark, sf)
    requests = files.select("repo").distinct().select(
        F.concat(F.lit("https://example.com/org/"), "repo").alias("url"), "repo", F.lit("main").alias("branch"),
        F.lit(None).cast("string").alias("error"))
    return requests, files


@query
def ingest_repositories(spark, sf):
    """Two rounds into one store: what an earlier run saw, then everything, with each request twice."""
    requests, files = ingest_inputs(spark, sf)
    path = work_path(spark, "raw")
    first = I.ingest(requests, earlier(spark, sf, files), path, options=SCAN)
    done = I.ingest(requests.unionByName(requests), files, path, first.repositories, first.catalog, SCAN)
    catalogued = done.catalog.groupBy("repository_id").agg(F.count("*").alias("catalogued"))
    return done.repositories.join(catalogued, F.col("id") == F.col("repository_id"), "left").select(
        "url", "name", "status", F.col("files_count").alias("files"), F.col("total_lines").alias("lines"),
        F.round("size_kb", 3).alias("size_kb"), F.coalesce("catalogued", F.lit(0)).alias("catalogued"))


@query
def preprocess_files(spark, sf):
    return S.preprocess(code_files(spark, sf)).select(
        *IDS, "language", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.col("chunk_size").cast("bigint").alias("chunk_size"), F.round("token_estimate", 6).alias("token_estimate"), digest("text"))


def dataset_rows(result):
    return result.dataset.select(
        "id", "language", F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.col("chunk_size").cast("bigint").alias("chunk_size"), "source_file", "split", digest("text"))


@query
def build_dataset(spark, sf):
    return dataset_rows(built(spark, sf))


@query
def incremental_build(spark, sf):
    files = code_files(spark, sf)
    inputs = ["repo", "rel_path", "language", "content"]
    output = work_path(spark, "dataset")
    first = B.build_dataset(earlier(spark, sf, files).select(*inputs), output, "v1")
    return dataset_rows(B.incremental_build(files.select(*inputs), output, "v2", first.version))


@query
def grow_dataset(spark, sf):
    """The same growth by parts and manifests: no earlier text is read or written."""
    files = code_files(spark, sf)
    inputs = ["repo", "rel_path", "language", "content"]
    output = work_path(spark, "grown")
    GR.grow_dataset(earlier(spark, sf, files).select(*inputs), output)
    return dataset_rows(GR.grow_dataset(files.select(*inputs), output))


@query
def training_input(spark, sf):
    """Every split of the newest version, and the evaluation part once more."""
    output = work_path(spark, "dataset")
    files = code_files(spark, sf).select("repo", "rel_path", "language", "content")
    version = B.build_dataset(files, output, "v1").version
    splits, metadata = N.newest_dataset(version, output)
    made = N.training_input(splits, stage(vocabulary(spark, sf), "vocabulary"))

    def rows(name):
        return made[name].select("id", F.lit(name).alias("part"), F.size("input_ids").cast("bigint").alias("tokens"),
                                 digest_of(joined("input_ids")).alias("digest"))

    parts = [rows(name) for name in made]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("total_samples", F.lit(metadata.first().train_samples).cast("bigint"))


@query
def finetune_input(spark, sf):
    splits = ST.load_split_dataset(spark, version_folder(spark, sf))
    return N.finetune_input(splits=splits).select("id", "language", digest("text"))


@query
def bulk_completion_frame(spark, sf):
    """Every valid request through defaults, prompt, token cut, a model that repeats its prompt, and
    the reported values."""
    def repeat(frame):
        frame["raw_text"] = frame["prompt"] + "|### End|" + frame["prompt"]
        frame["tokens_generated"] = frame["max_new_tokens"].clip(upper=frame["input_ids"].str.len()).astype("int32")
        frame["elapsed"] = frame["input_ids"].str.len() / 64.0
        return frame

    requests = sparse_requests(spark, sf).select(
        "conv_id", "turn", F.col("prompt").alias("code_prefix"), F.when(F.col("conv_id") % 2 == 0, "go").alias("language"),
        F.col("max_new_tokens").cast("int").alias("max_new_tokens"), "temperature")
    done = G.complete_all(requests, vocabulary(spark, sf), repeat)
    return done.select(
        "conv_id", "turn", "language", F.col("max_new_tokens").cast("bigint").alias("max_new_tokens"), "temperature",
        digest_of(F.col("prompt")).alias("prompt"), digest_of(F.col("generated_text")).alias("generated_text"),
        digest_of(joined("input_ids")).alias("input_ids"),
        F.col("tokens_generated").cast("bigint").alias("tokens_generated"), "time_seconds", "tokens_per_second")


# ---- streams ---------------------------------------------------------------------------------

def file_stream(spark, sf, *more):
    """All documents as a stream, and the arrivals of its four slices and of ``more`` rows, one after the other. Run the stream
    after each: a slice is one batch, however many files it has, so the number of batches does not grow with the table."""
    path, given = work_path(spark, "slices"), table(spark, sf, "documents")

    def write(arriving):
        given.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == arriving).write.mode("append").parquet(path)

    def arrivals():
        yield 0
        for arriving in range(1, 4):
            write(arriving)
            yield arriving
        if more:
            spark.createDataFrame(more, given.schema).coalesce(1).write.mode("append").parquet(path)
            yield 4

    write(0)  # a stream begins on a folder that exists
    stream = spark.readStream.schema(given.schema).parquet(path)
    return spark.sql(CODE_DOCS, documents=stream), arrivals()


def run_stream(writer, arrivals):
    """A run for what has arrived, again after each arrival; it goes on from its checkpoint."""
    for _ in arrivals:
        writer.start().awaitTermination()


@query
def stream_ingest(spark, sf):
    """Which copy is kept depends on arrival, so keys are compared."""
    store = work_path(spark, "live")
    files, arrivals = file_stream(spark, sf)
    run_stream(L.stream_ingest(files, store, work_path(spark, "live-log"), SCAN), arrivals)
    return spark.read.schema(L.STREAM_FILES).parquet(store).select("repo", "content_hash")


@query
def stream_dedupe_state(spark, sf):
    """Which copy survives depends on arrival, so keys are compared."""
    out = work_path(spark, "state")
    files, arrivals = file_stream(spark, sf)
    kept = L.stream_dedupe_state(files, SCAN).select("repo", "content_hash")
    run_stream(kept.writeStream.format("parquet").option("checkpointLocation", work_path(spark, "state-log")).trigger(
        availableNow=True).option("path", out), arrivals)
    return spark.read.schema("repo string, content_hash string").parquet(out)


@query
def stream_first_copies(spark, sf):
    """Slices arrive a minute apart; a file ten days later lets the watermark pass and closes their sessions."""
    late, out = 7 * 10**12 + 7, work_path(spark, "copies")
    files, arrivals = file_stream(spark, sf, (late, "A last file.\n" * 9, "en", "late", 117))
    minute = F.when(F.col("doc_id") == late, 14_400).otherwise(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)))
    timed = files.withColumn("arrived_at", F.timestamp_seconds(1_700_000_000 + 60 * minute)).drop("doc_id")
    kept = L.stream_first_copies(timed, "arrived_at", "1 day", SCAN).select("repo", "rel_path", "content_hash")
    run_stream(kept.writeStream.format("parquet").option("checkpointLocation", work_path(spark, "copies-log")).trigger(
        availableNow=True).option("path", out), arrivals)
    return spark.read.schema(kept.schema).parquet(out)


@query
def stream_dataset_build(spark, sf):
    output = work_path(spark, "grow")
    stream, arrivals = file_stream(spark, sf)
    known = with_language(stream).filter("language IS NOT NULL")
    files = X.compute_once(known, content=X.decode_text(F.col("content"))).select("repo", "rel_path", "language", "content")
    run_stream(L.stream_dataset_build(files, output, work_path(spark, "grow-log")), arrivals)
    return L.read_version(spark, output).select("id", "language", "split", digest("text"))
