"""Streams of index events and file changes, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.incremental import IncrementalState
from tessera.operators.snapshots import PointerFile

EVENTS = "path STRING, kind STRING, at TIMESTAMP, payload STRING"


def read_events(spark: SparkSession, folder: str, per_batch: int = 32) -> DataFrame:
    """Event files of a folder as a stream, at most `per_batch` a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_batch).json(folder)


def sessions(changes: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """repo, start, stop, paths: changes of a repository closer than `gap` in event time are one batch.

    Changes later than `late` are dropped. The paths of a batch are what one quiet period holds; a path counts once. The
    repository is what stands before the colon of a path, '' without one.
    """
    repo = F.regexp_extract("path", "^([^:]*):", 1).alias("repo")
    once = changes.withWatermark("at", late).groupBy(repo, F.session_window("at", gap)).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return once.select("repo", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "paths")


def tally(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running counts of events per kind: reused, parsed, error."""
    n = state.get[0] if state.exists else 0
    n += sum(len(b) for b in batches)
    state.update((n,))
    yield pd.DataFrame({"kind": [key[0]], "n": [n]})


def running_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").applyInPandasWithState(tally, "kind STRING, n BIGINT", "n BIGINT", "update", GroupStateTimeout.NoTimeout)


class LatestByPath:
    """The last event of each path: a file clears its error, an error its file, a deletion both.

    `apply` is a foreachBatch function. Versions are whole tables behind a pointer; a batch that is given again after a
    failure finds its number in the pointer and is passed over, so every batch counts once.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root, PointerFile(spark, root)

    def current(self) -> DataFrame | None:
        name = self.pointer.read()
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/{name}") if name else None

    def last_batch(self) -> int:
        name = self.pointer.read()
        return int(name.split("-")[1]) if name else -1

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.last_batch():
            return
        rows = batch.select("path", "kind", "at", "payload")
        before = self.current()
        # a tombstone stays out of the table, for the fold of later batches has nothing to clear
        both = rows if before is None else rows.unionByName(before)
        last = both.groupBy("path").agg(F.max(F.struct("at", "kind", "payload")).alias("r")).select("path", "r.kind", "r.at", "r.payload")
        name = f"batch-{number}"
        last.where("kind <> 'deleted'").write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.pointer.swap(name)


def emit_changes(state: IncrementalState, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on only rows whose content differs from what was handed on before."""

    def run(batch: DataFrame, number: int) -> None:
        version = f"stream-{number}"
        if (state.pointer.read() or "") == version:
            return
        once = batch.groupBy(state.key).agg(*(F.max_by(c, "at").alias(c) for c in state.content))
        new = state.select(once).persist()
        try:
            if new.isEmpty():
                return
            sink(new, number)
            last = state.state()
            hashed = state.hashed(new).select(state.key, "_hash")
            whole = hashed if last is None else hashed.unionByName(last.join(hashed.select(state.key), state.key, "left_anti"))
            whole.write.mode("overwrite").parquet(f"{state.root}/{version}")
            state.commit(version)
        finally:
            new.unpersist()

    return run


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a foreachBatch stream; without an interval it drains what is there and ends."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


__all__ = ["EVENTS", "LatestByPath", "emit_changes", "read_events", "running_stats", "sessions", "start"]
