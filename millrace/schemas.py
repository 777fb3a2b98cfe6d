"""Fixed schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

CODE_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size_kb", T.DoubleType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("content_hash", T.StringType()),
])

SAMPLES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("chunk_size", T.IntegerType()),
    T.StructField("token_estimate", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
])

REPOSITORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("files_count", T.LongType()),
    T.StructField("total_lines", T.LongType()),
    T.StructField("size_kb", T.DoubleType()),
    T.StructField("local_path", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CODE_FILE_CATALOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("repository_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("size_kb", T.DoubleType()),
    T.StructField("line_count", T.IntegerType()),
    T.StructField("is_processed", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

TRAINING_RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("metrics", T.StringType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("epochs_completed", T.IntegerType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("completed_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

DATASET_VERSIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("total_samples", T.LongType()),
    T.StructField("train_samples", T.LongType()),
    T.StructField("val_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("languages", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

# Column defaults of the catalogue tables; "now" is the time of the insert.
DEFAULTS = {
    "repositories": {"branch": "main", "status": "pending", "files_count": 0, "total_lines": 0,
                     "size_kb": 0.0, "created_at": "now", "updated_at": "now"},
    "code_file_catalog": {"size_kb": 0.0, "line_count": 0, "is_processed": False, "created_at": "now"},
    "training_runs": {"status": "pending", "total_samples": 0, "epochs_completed": 0, "created_at": "now"},
    "dataset_versions": {"total_samples": 0, "train_samples": 0, "val_samples": 0, "test_samples": 0,
                         "created_at": "now"},
}

CATALOG_TABLES = {
    "repositories": REPOSITORIES,
    "code_file_catalog": CODE_FILE_CATALOG,
    "training_runs": TRAINING_RUNS,
    "dataset_versions": DATASET_VERSIONS,
}

# log_history entries are kept as maps so that "loss is null" and "no loss" stay distinct.
TRAINER_STATE = T.StructType([
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("log_history", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])
