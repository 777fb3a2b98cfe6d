"""Catalogue tables in hash buckets of their key, of which a change writes only those it touches.

A snapshot is a small table of (bucket, folder). A merge reads the folders of the touched buckets, writes the
merged rows to a new folder, and then the next snapshot, in which these buckets point there; the others stay
where they are. Readers of an earlier snapshot keep their files, and a merge that fails changes nothing. One
writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.catalog import conform, empty_table
from millrace.schemas import CATALOG_TABLES
from millrace.session import list_directories, path_exists, stage, work_path

BUCKETS = 256


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    base: str
    name: str  # of a catalogue table
    key: str   # rows of one key share a bucket
    buckets: int = BUCKETS

    @property
    def path(self) -> str:
        return f"{self.base}/{self.name}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def snapshots(self) -> list[int]:
        folders = [path for path, _ in list_directories(self.spark, self.path) if "/snapshot-" in path]
        return sorted(int(p.rsplit("-", 1)[-1]) for p in folders if path_exists(self.spark, f"{p}/_SUCCESS"))

    def folders(self, snapshot: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows, one entry a bucket at most."""
        found = self.snapshots()
        if not found:
            return {}
        chosen = found[-1] if snapshot is None else snapshot
        rows = self.spark.read.schema("bucket int, folder string").json(f"{self.path}/snapshot-{chosen}").collect()
        return {r.bucket: r.folder for r in rows}

    def read(self, snapshot: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        held = self.folders(snapshot)
        paths = [f"{self.path}/{f}" for b, f in held.items() if buckets is None or b in set(buckets)]
        if not paths:
            return empty_table(self.spark, self.name)
        return self.spark.read.schema(CATALOG_TABLES[self.name]).parquet(*paths)

    def merge(self, rows: DataFrame, into: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``into(their rows, new rows)``. Returns the buckets written.

        ``into`` gives rows whose keys are in the touched buckets only, as a merge by key does."""
        rows = stage(rows, f"{self.name}-new", work_path(self.spark, f"{self.name}-new"))
        touched = sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())
        found = self.snapshots()
        number, held = (found[-1] + 1 if found else 0), self.folders()
        merged = conform(into(self.read(buckets=touched), rows), self.name).withColumn("bucket", self.bucket())
        data = f"data-{number}"
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{data}")
        written = [b for b in touched if path_exists(self.spark, f"{self.path}/{data}/bucket={b}")]
        now = {b: f for b, f in held.items() if b not in set(touched)} | {b: f"{data}/bucket={b}" for b in written}
        manifest = self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.path}/snapshot-{number}")
        return written
