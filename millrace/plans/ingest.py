"""Ingestion of many repositories in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import repo_name
from millrace.operators.catalog import empty_table, new_catalog_rows, refreshed_catalog, upsert_repositories
from millrace.operators.files import dedupe_content, repo_summary, scan_files
from millrace.options import ScanOptions
from millrace.session import stage
from millrace.sources.stores import FOLDERS, folder_column, replace_repositories, scan_raw_store


@dataclass
class IngestResult:
    files: DataFrame         # all stored files
    catalog: DataFrame       # code_file_catalog after the run
    repositories: DataFrame  # repositories after the run
    summary: DataFrame       # one row per requested url


def repo_key(url) -> F.Column:
    """Folder of a repository: readable name and a hash of the url, so that repositories of the
    same name but different owners stay apart."""
    return F.concat_ws("-", repo_name(url), F.left(F.sha2(url, 256), F.lit(8)))


def ingest(
    requests: DataFrame,
    files: DataFrame,
    raw_path: str,
    repositories: DataFrame | None = None,
    catalog: DataFrame | None = None,
    options: ScanOptions = ScanOptions(),
    refresh: bool = False,
    folders: tuple[str, ...] = FOLDERS,
) -> IngestResult:
    """Filter, describe, deduplicate and store files; then catalogue and summarise what is stored.

    ``requests``: url, repo (the folder name in ``files``), branch, error (null, or why the
    repository could not be fetched). ``files``: repo, rel_path, content. Files may name their url instead of
    repo: each url then has a folder of its own (``repo_key``), so that repositories of one name and different
    owners stay apart; ``requests`` need no repo. Without urls, requests of different urls for one folder are
    an error, since each would count the other's files.

    ``folders`` is the layout of the store, the same for every ingest; with very many repositories, ``BUCKETED``:
    local paths then name the store.

    ``refresh`` brings catalogue rows of changed files up to date; by default they stay as they are.
    Other repositories of the store stay; an asked one is replaced. A url asked for twice counts once,
    and it is an error if the two requests differ. Text is read once and shuffled twice: for the dedupe
    and for the folder layout. Catalogue and summary read narrow columns of the stored result.
    """
    spark = files.sparkSession
    repositories = empty_table(spark, "repositories") if repositories is None else repositories
    catalog = empty_table(spark, "code_file_catalog") if catalog is None else catalog

    if "url" in files.columns:
        own = repo_key(F.col("url"))
        requests, files = requests.withColumn("repo", own), files.withColumn("repo", own).drop("url")
    requests = requests.distinct()
    if not requests.groupBy("url").count().filter("count > 1").isEmpty():
        raise ValueError("requests for one url differ")
    if not requests.filter("repo IS NOT NULL").groupBy("repo").count().filter("count > 1").isEmpty():
        raise ValueError("requests of different urls share a folder: let files name their url")
    replace_repositories(dedupe_content(scan_files(files, options)), raw_path, requests, folders)
    everything = scan_raw_store(spark, raw_path)
    stored = everything.join(requests.select("repo").distinct(), "repo", "left_semi")

    counts = repo_summary(stored)
    own_folder = F.concat(F.lit("repo="), folder_column(F.col("repo")))
    local = F.concat_ws("/", F.lit(raw_path), own_folder) if "repo" in folders else F.lit(raw_path)
    results = requests.join(counts, "repo", "left").select(
        "url",
        repo_name(F.col("url")).alias("name"),
        "branch",
        "repo",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("size_kb", F.lit(0.0)).alias("size_kb"),
        local.alias("local_path"),
        "error",
    )
    summary = stage(results, "ingest-summary")  # one row per repository, read several times below
    after = upsert_repositories(repositories, summary)
    owners = after.select(F.col("id").alias("repository_id"), "url").join(
        summary.select("url", "repo"), "url"
    ).select("repository_id", "repo")
    described = stored.select(
        "repo", F.col("rel_path").alias("file_path"), "language", "content_hash", "size_kb", "line_count"
    ).join(owners, "repo").drop("repo")
    # written, so that the result does not change with the store and later ingests do not read it again
    if refresh:
        return IngestResult(everything, stage(refreshed_catalog(described, catalog), "catalog"), after, summary)
    added = stage(new_catalog_rows(described, catalog), "catalog-rows")
    return IngestResult(everything, catalog.unionByName(added), after, summary)
