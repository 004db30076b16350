"""Keeping an index between runs: versioned tables, the hashes of its configuration, validation, trends, enrichment."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"


def config_hashes(paths: list[str]) -> dict[str, str]:
    """SHA-256 of each configuration file that exists, by its base name."""
    out = {}
    for p in paths:
        if os.path.isfile(p):
            with open(p, "rb") as f:
                out[os.path.basename(p)] = hashlib.sha256(f.read()).hexdigest()
    return out


def save_index(spark: SparkSession, tables: dict[str, DataFrame], path: str, configs: dict[str, str] | None = None) -> None:
    """Parquet per table; the meta row is written last, so an index without one is unfinished."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.createDataFrame([(SCHEMA_VERSION, sorted(tables), configs or {})], "schema_version STRING, tables ARRAY<STRING>, configs MAP<STRING, STRING>")
    meta.withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str, configs: dict[str, str] | None = None, strict: bool = True) -> dict[str, DataFrame] | None:
    """The tables, or None where there is no finished index or its configuration has changed since.

    Another schema version raises in strict mode and is taken as it is otherwise.
    """
    from tessera.session import exists

    if not exists(spark, f"{path}/meta/_SUCCESS"):
        return None
    meta = spark.read.parquet(f"{path}/meta").first()  # one row
    if meta["schema_version"] != SCHEMA_VERSION and strict:
        raise ValueError(f"the index has schema {meta['schema_version']}, not {SCHEMA_VERSION}")
    if configs is not None and dict(meta["configs"]) != configs:
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def validation(files: DataFrame, now: DataFrame) -> DataFrame:
    """state (ok, stale, missing), files: indexed files against a listing. files, now: path, mtime_ns."""
    seen = now.select("path", F.col("mtime_ns").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") > F.col("mtime_ns"), "stale").otherwise("ok")
    return files.join(seen, "path", "left").groupBy(state.alias("state")).agg(F.count("*").alias("files"))


def append_trend(metrics: DataFrame, path: str, commit: str) -> None:
    """One more line of metrics, stamped with the time and the commit."""
    metrics.withColumn("commit", F.lit(commit)).withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def workspace_root(start: str, names: tuple[str, ...]) -> str | None:
    """The first directory upwards that holds one of the files."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.isfile(os.path.join(at, n)) for n in names):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


class Enrichers:
    """Named functions from index to index, run by priority; one that fails three times in a row is left out after."""

    def __init__(self, most: int = 3) -> None:
        self.most, self._all, self.failures = most, [], {}

    def register(self, name: str, run: Callable[[DataFrame], DataFrame], priority: int = 0, supports: Callable[[str], bool] = lambda _: True) -> None:
        self._all.append((priority, name, supports, run))
        self._all.sort(key=lambda e: e[:2])

    def apply(self, df: DataFrame, what: str = "") -> DataFrame:
        for _, name, supports, run in self._all:
            if self.failures.get(name, 0) >= self.most or not supports(what):
                continue
            try:
                new = run(df)
                new.schema  # noqa: B018 - a wrong plan fails here, not in a later run
                df, self.failures[name] = new, 0
            except Exception:  # noqa: BLE001 - an enricher may fail in any way
                self.failures[name] = self.failures.get(name, 0) + 1
        return df
