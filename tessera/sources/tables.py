"""Readers of the catalog: one Parquet table per name below a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def clean_path(c: Column | str) -> Column:
    """The path without a leading `./`, which listings sometimes carry."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^(?:\./)+", "")


def trim_ws(c: Column | str) -> Column:
    """Trim any white space at both ends (Spark's trim removes blanks only)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def latest(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest `by`.

    Repeated rows collapse and equal `by` is settled by the values themselves, so the result doesn't depend on row
    order. A NULL `by` ranks below every other. One shuffle, with partial aggregation before it.
    """
    pick = F.max(F.struct(by, *values)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *(F.col("_r")[v].alias(v) for v in values))
