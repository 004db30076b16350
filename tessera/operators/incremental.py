"""Processing only new or changed records.

The state of the last successful run is a table of key and content hash. A run hashes its current rows, joins them
with the state, hands out what is new or changed, and on success swaps the state's version by one rename. A run that
fails before the swap leaves the old state: its rows are handed out again, and none is skipped or repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.snapshots import PointerFile
from tessera.session import work_path
from tessera.sources.tables import clean_path


class IncrementalState:
    """Key-and-hash state with versions. `select` then `commit`; nothing is visible before `commit`.

    NULL in a content column is a value of its own. Rows must be unique by key (see `listing_of`).
    """

    def __init__(self, spark: SparkSession, key: str, content: list[str], root: str | None = None) -> None:
        self.spark, self.key, self.content = spark, key, content
        self.root = root or work_path(spark, "incremental-state")
        self.pointer = PointerFile(spark, self.root)

    def state(self) -> DataFrame | None:
        version = self.pointer.read()
        return self.spark.read.schema(f"{self.key} STRING, _hash BIGINT").parquet(f"{self.root}/{version}") if version else None

    def hashed(self, rows: DataFrame) -> DataFrame:
        # the position goes into the hash, and NULL differs from every string
        parts = [F.coalesce(F.concat(F.lit(f"{i}="), F.col(c).cast("string")), F.lit(f"{i}:null")) for i, c in enumerate(self.content)]
        return rows.withColumn("_hash", F.xxhash64(*parts))

    def stage(self, rows: DataFrame) -> str:
        """Write the next state (all current keys); returns its version. Not yet current."""
        version = f"state-{uuid.uuid4().hex}"
        self.hashed(rows).select(self.key, "_hash").write.parquet(f"{self.root}/{version}")
        return version

    def select(self, rows: DataFrame) -> DataFrame:
        """The rows that are new or changed against the current state; all rows if there is none."""
        now, last = self.hashed(rows), self.state()
        if last is None:
            return now.drop("_hash")
        return now.join(last, [self.key, "_hash"], "left_anti").drop("_hash")

    def commit(self, version: str) -> None:
        self.pointer.swap(version)


def listing_of(files: DataFrame, scan_id: int | None = None) -> DataFrame:
    """One row per scan and path, the latest listed_at; paths without `./`, rows without a path dropped."""
    rows = files.where("path IS NOT NULL")
    if scan_id is not None:
        rows = rows.where(F.col("scan_id") == scan_id)
    rows = rows.select("scan_id", clean_path("path").alias("path"), "listed_at", "size_bytes", "mtime_ns")
    pick = F.max(F.struct("listed_at", "size_bytes", "mtime_ns")).alias("r")
    return rows.groupBy("scan_id", "path").agg(pick).select("scan_id", "path", "r.size_bytes", "r.mtime_ns")


def successful_runs(runs: DataFrame) -> list[int]:
    """Ids of the succeeded runs in order. The table of runs is one row per run."""
    return [r["scan_id"] for r in runs.where("lower(trim(status)) = 'succeeded' AND scan_id IS NOT NULL").select("scan_id", "started_at").distinct().orderBy("started_at", "scan_id").collect()]


def changed_per_run(spark: SparkSession, files: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """scan_id, path: for each succeeded run but the first, what it has to handle. Failed runs never touch the state."""
    work = IncrementalState(spark, "path", ["size_bytes", "mtime_ns"], root)
    out = None
    for nth, scan_id in enumerate(successful_runs(runs)):
        version = work.stage(listing_of(files, scan_id))
        if nth:
            # the staged table has the hashes already; selecting from it reads two narrow tables
            now = spark.read.schema("path STRING, _hash BIGINT").parquet(f"{work.root}/{version}")
            part = now.join(work.state(), ["path", "_hash"], "left_anti").select(F.lit(scan_id).cast("int").alias("scan_id"), "path")
            out = part if out is None else out.unionByName(part)
        work.commit(version)
    return out if out is not None else spark.createDataFrame([], "scan_id INT, path STRING")
