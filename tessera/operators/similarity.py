"""Function similarity: exact bodies by digest, others by shared runs of three tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def normalised(text) -> Column:
    """Addresses as ADDR and white space runs as single blanks. Local names are kept (see `renamed`)."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "0x[0-9a-fA-F]+", "ADDR"), r"\s+", " "))


def exact_groups(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """digest, members, first_key of normalised texts that occur more than once. Members are counted, not gathered."""
    rows = bodies.where(F.col(text).isNotNull()).select(key, F.sha2(normalised(F.col(text)), 256).alias("digest")).distinct()
    return rows.groupBy("digest").agg(F.count("*").alias("members"), F.min(key).alias("first_key")).where("members > 1")


def similar(bodies: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """a < b, score: one row per pair of different normalised texts (each named by its least key) of that score or more.

    Runs of tokens are ordered from rare to frequent; only the prefix that any match must touch is joined, and pairs of
    too different lengths are dropped before they are scored. threshold above 0; texts of under three tokens match none.
    """
    rows = bodies.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), normalised(F.col(text)).alias("t"))
    words = materialise(rows.groupBy("t").agg(F.min("id").alias("id")).select("id", F.split("t", " ").alias("w")), "words")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.slice("w", i, 3)))
    sets = materialise(words.where("size(w) >= 3").select("id", F.array_distinct(runs).alias("g")), "runs")
    often = sets.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    long = sets.select("id", F.size("g").alias("n"), F.explode("g").alias("x")).join(often, "x")
    order = materialise(long.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "x"))).alias("o")), "order")
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - F.lit(1e-9)) + 1).cast("int")
    post = order.select("id", "n", F.explode(F.slice("o", F.lit(1), keep)).alias("p")).where("p.df > 1").select("id", "n", F.col("p.x").alias("x"))
    a, b = post.alias("a"), post.alias("b")
    near = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9
    pairs = a.join(b, F.col("a.x") == F.col("b.x")).where(F.col("a.id") < F.col("b.id")).where(near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return met.select("a", "b", (both / (F.size("ga") + F.size("gb") - both)).alias("score")).where(F.col("score") >= threshold - 1e-12)
