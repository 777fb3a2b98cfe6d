"""Keys of a growing store in sorted runs that are merged by levels.

Keys are uniform hex strings. Batch N adds a run of its own; when ``fan`` runs of a level are complete they are
merged into one of the next level, so which runs hold the batches before N is read off the digits of N to
the base ``fan``: at most ``fan - 1`` a level, whatever has been stored, and no folder is listed to find them.
Inside a run keys are dealt into equal ranges and sorted, so that a filter on a range of keys skips all other
files and pages.

A run is written in overwrite mode from the batch, or from runs that stay until the following batch has
begun; a batch that is run again after a failure finds what it found the first time and writes the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ordering import key_share
from millrace.session import drop_path

FAN = 8
KEYS_PER_FILE = 4_000_000


def covering(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Runs (first batch, last batch) that hold the batches before n, oldest first."""
    out, at, size = [], 0, 1
    while size * fan <= n:
        size *= fan
    while size:
        while at + size <= n:
            out.append((at, at + size - 1))
            at += size
        size //= fan
    return out


@dataclass(frozen=True)
class KeyLevels:
    """Kinds of keys under ``path``: a table of (kind, key) for each run."""

    spark: SparkSession
    path: str
    fan: int = FAN
    keys_per_file: int = KEYS_PER_FILE

    def folder(self, first: int, last: int) -> str:
        return f"{self.path}/run-{first}-{last}"

    def read(self, before: int, kind: str) -> DataFrame:
        """All keys of a kind that batches before this one stored."""
        return self._runs(covering(before, self.fan)).filter(F.col("kind") == kind).select("key")

    def add(self, batch_id: int, keys: DataFrame, n: int) -> None:
        """Store a batch's (kind, key) rows, about n of them, and merge what is complete."""
        self._write(keys, self.folder(batch_id, batch_id), n)
        for first, last in self._merges(batch_id):
            merged = self._runs(self._parts(first, last))
            self._write(merged, self.folder(first, last), merged.count())

    def _runs(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = "key string, kind string"
        found = [self.spark.read.schema(schema).parquet(self.folder(*run)) for run in runs]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _parts(self, first: int, last: int) -> list[tuple[int, int]]:
        size = (last - first + 1) // self.fan
        return [(a, a + size - 1) for a in range(first, last + 1, size)]

    def _write(self, keys: DataFrame, path: str, n: int) -> None:
        files = max(1, -(-n // self.keys_per_file))
        dealt = keys.select("kind", "key").repartitionById(files, key_share("key", files))
        dealt.sortWithinPartitions("kind", "key").write.mode("overwrite").partitionBy("kind").parquet(path)

    def _merges(self, batch_id: int) -> list[tuple[int, int]]:
        """Runs that are complete with this batch, smaller ones first."""
        out, size = [], self.fan
        while (batch_id + 1) % size == 0:
            out.append((batch_id + 1 - size, batch_id))
            size *= self.fan
        return out

    def sweep(self, batch_id: int) -> None:
        """Drop runs that went into those which the batch before this one merged: it has been committed."""
        for first, last in self._merges(batch_id - 1) if batch_id else ():
            for part in self._parts(first, last):
                drop_path(self.spark, self.folder(*part))
