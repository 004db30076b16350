"""Differences of two tables or graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, change (added, removed, modified), old_*, new_*: rows unique by key, NULL keys meet each other."""
    a = before.select(*(F.col(k).alias(f"_a_{k}") for k in keys), *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("_a"))
    b = after.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
    met = a.join(b, on, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "modified")
    cols = [F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys]
    return met.select(*cols, change.alias("change"), *(f"old_{v}" for v in values), *(f"new_{v}" for v in values)).where("change IS NOT NULL")


def set_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """columns, change: distinct rows only one side has."""
    a, b = before.select(*columns).distinct(), after.select(*columns).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))
