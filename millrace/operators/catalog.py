"""Catalogue tables: defaults, inserts, upserts and listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.schemas import CATALOG_TABLES, DEFAULTS


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Bring rows to a catalogue table's schema: missing columns become null, nulls the default."""
    def column(field) -> Column:
        value = F.col(field.name) if field.name in rows.columns else F.lit(None)
        default = DEFAULTS[table].get(field.name)
        if default is not None:
            value = F.coalesce(value, F.current_timestamp() if default == "now" else F.lit(default))
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in CATALOG_TABLES[table].fields])


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], CATALOG_TABLES[table])


def row_id(*parts) -> Column:
    """36 characters, as wide as the id columns."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(36))


def new_catalog_rows(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows for files whose (repository_id, file_path) is not catalogued. A known file keeps its
    row even if its content changed. The key holds the path, so one large repository spreads."""
    known = catalog.select("repository_id", "file_path")
    fresh = files.join(known, ["repository_id", "file_path"], "left_anti")
    return conform(fresh.withColumn("id", row_id("repository_id", "file_path")), "code_file_catalog")


def refreshed_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue with new files added and rows of changed content brought up to date, to be
    processed again. ``new_catalog_rows`` leaves such rows as they are."""
    keys, values = ["repository_id", "file_path"], ["language", "content_hash", "size_kb", "line_count"]
    present = [c for c in values if c in files.columns]
    fresh = files.select(*keys, *[F.col(c).alias(f"new_{c}") for c in present], F.lit(True).alias("seen"))
    both = catalog.join(fresh, keys, "full_outer")
    changed = F.col("seen") & ~F.col("new_content_hash").eqNullSafe(F.col("content_hash"))
    rows = both.select(
        F.coalesce("id", row_id(*keys)).alias("id"), *keys,
        *[F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in present],
        *[c for c in values if c not in present],
        F.when(changed, F.lit(False)).otherwise(F.col("is_processed")).alias("is_processed"), "created_at",
    )
    return conform(rows, "code_file_catalog")


def upsert_repositories(existing: DataFrame, results: DataFrame) -> DataFrame:
    """A new snapshot of the repositories table, matched by url.

    ``results``: url, name, branch, files, lines, size_kb, local_path, error. Success sets the
    counts and clears an old error; failure keeps the counts and records the message.
    """
    new = results.select(
        "url", F.lit(True).alias("seen"), *[F.col(c).alias(f"new_{c}") for c in (
            "name", "branch", "files", "lines", "size_kb", "local_path", "error")]
    )
    both = existing.join(new, "url", "full_outer")
    done = F.col("seen") & F.col("new_error").isNull()

    def counted(old: str, fresh: str) -> Column:
        return F.when(done, F.coalesce(F.col(fresh), F.lit(0))).otherwise(F.col(old)).alias(old)

    merged = both.select(
        F.coalesce("id", row_id("url")).alias("id"),
        "url",
        F.coalesce("name", "new_name").alias("name"),
        F.coalesce("branch", "new_branch").alias("branch"),
        F.when(done, "completed").when(F.col("seen"), "failed").otherwise(F.col("status")).alias("status"),
        counted("files_count", "new_files"),
        counted("total_lines", "new_lines"),
        counted("size_kb", "new_size_kb"),
        F.when(done, F.col("new_local_path")).otherwise(F.col("local_path")).alias("local_path"),
        F.when(F.col("seen"), F.col("new_error")).otherwise(F.col("error_message")).alias("error_message"),
        "metadata",
        "created_at",
        F.when(F.col("seen"), F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return conform(merged, "repositories")


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601; the fraction only when there is one, as date-time printers do."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def list_repositories(repositories: DataFrame) -> DataFrame:
    """Newest first."""
    return repositories.orderBy(F.desc("created_at"), "id").select(
        "id", "url", "name", "branch", "status", "files_count", "total_lines", "size_kb",
        iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def short_url() -> Column:
    return F.substring("url", 1, 60)


def short_model() -> Column:
    return F.substring("base_model", 1, 40)


def shown_path() -> Column:
    """A dash for no output path."""
    return F.coalesce(F.nullif(F.col("output_path"), F.lit("")), F.lit("-"))


def repositories_view(repositories: DataFrame) -> DataFrame:
    """The console columns; the url is cut to 60 characters."""
    return repositories.select(
        "name", short_url().alias("url"), "status", "files_count", "total_lines"
    )


def list_datasets(versions: DataFrame) -> DataFrame:
    """Newest first; the test count is not part of this listing."""
    return versions.orderBy(F.desc("created_at"), "id").select(
        "id", "version", "path", "total_samples", "train_samples", "val_samples", "languages",
        iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def list_training_runs(runs: DataFrame) -> DataFrame:
    """Newest first."""
    return runs.orderBy(F.desc("created_at"), "id").select(
        "id", "name", "status", "base_model", "output_path", "total_samples", "epochs_completed",
        "metrics", iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def training_runs_view(runs: DataFrame) -> DataFrame:
    """The console columns: model name cut to 40 characters, a dash for no output path."""
    return runs.orderBy(F.desc("created_at"), "id").select(
        "name", "status", short_model().alias("base_model"), "total_samples", shown_path().alias("output_path"),
    )


def repo_catalog_summary(repositories: DataFrame, *keys: str) -> DataFrame:
    """Repositories, files, lines and size per status (or other columns)."""
    return repositories.groupBy(*(keys or ("status",))).agg(
        F.count("*").alias("repositories"),
        F.sum("files_count").alias("files"),
        F.sum("total_lines").alias("lines"),
        F.sum(F.col("size_kb").cast("decimal(18,3)")).cast("double").alias("size_kb"),
    )


def latest_dataset(versions: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """At most one row (path): the newest version if its path exists, otherwise the newest
    directory. Only the newest version is tried, never the one before it.

    ``versions`` carries path_exists; ``directories`` is (path, modified_at).
    """
    newest = versions.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    found = newest.filter("path_exists").select("path", F.lit(0).alias("choice"))
    if directories is not None:
        fallback = directories.orderBy(F.desc("modified_at"), "path").limit(1)
        found = found.unionByName(fallback.select("path", F.lit(1).alias("choice")))
    return found.orderBy("choice").limit(1).select("path")


def variant_path(name: str) -> str:
    """The path of a metric: dots lead into nested objects, ``[n]`` into lists."""
    steps = [re.split(r"(?=\[\d+\])", step) for step in name.split(".")]
    return "$" + "".join((f'["{key}"]' if "'" in key else f"['{key}']") + "".join(places) for key, *places in steps)


def metric_texts(*names: str) -> list[Column]:
    """Values out of the JSON ``metrics`` column as text, null where absent; broken JSON has none, and
    what follows a complete value is not read."""
    fields = F.try_parse_json("metrics")
    return [F.try_variant_get(fields, variant_path(n), "string").alias(n) for n in names]


def metric_columns(*names: str) -> list[Column]:
    """Numbers out of the JSON ``metrics`` column by name or path, also those written as text; null where absent
    or something else."""
    return [text.try_cast("double").alias(n) for n, text in zip(names, metric_texts(*names))]


def metrics_schema(runs: DataFrame) -> DataFrame:
    """One row: the type that all metrics together have."""
    return runs.agg(F.schema_of_variant_agg(F.try_parse_json("metrics")).alias("schema"))


def config_columns(**paths: str) -> list[Column]:
    """Values out of the JSON ``config`` column by JSON path."""
    return [F.get_json_object("config", path).alias(name) for name, path in paths.items()]


def metric_values(runs: DataFrame, *names: str) -> DataFrame:
    return runs.select("id", *metric_columns(*names))


def config_values(runs: DataFrame, **paths: str) -> DataFrame:
    return runs.select("id", *config_columns(**paths))


def languages_map(versions: DataFrame) -> DataFrame:
    """(id, language, samples) rows out of the JSON ``languages`` column."""
    parsed = F.from_json("languages", "map<string,bigint>")
    return versions.select("id", F.explode(parsed).alias("language", "samples"))
