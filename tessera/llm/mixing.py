"""Mixing sources to target weights by Poisson replication.

Sizes are tokens of a public tokenizer over whole texts. A source's repetition rate is its share of the mix divided by
what it holds, at most its cap. Every document's number of copies is drawn from a Poisson distribution by inverting its
distribution function at a hash of document and seed; for a cap the distribution is cut at it and its parameter raised
so that the mean stays the rate. The copies are exploded and put in a global random order. The result depends on the
seed and the documents only, not on partitions or retries.
"""

from __future__ import annotations

import base64
import importlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Sources up to which targets and plans are broadcast and planned on the driver; the table of targets is one row each.
MOST_SOURCES = 100_000
SEED = 20_240
_encodings: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def _encoding(path: str):
    """The tokenizer of a ranks file, loaded once per Python worker."""
    if path not in _encodings:
        import tiktoken

        pattern = importlib.import_module("public_tokenizers").PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


#: Longest stretch without white space given to the tokenizer at once: its time grows with the square of a word's length.
#: A longer stretch, and only it, is cut; a cut adds at most one token, as does each end of the stretch.
_WORD = 20_000
_LONG = re.compile(r"(\S{%d,})" % (_WORD + 1))


def _count(encoding, text: str) -> int:
    n = 0
    for k, part in enumerate(_LONG.split(text) if len(text) > _WORD else [text]):
        pieces = [part[i : i + _WORD] for i in range(0, len(part), _WORD)] if k % 2 else [part]
        n += sum(len(encoding.encode_ordinary(x)) for x in pieces)
    return n


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source (trimmed, lower case), tokens of the whole text; a NULL text has none."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [_count(encoding, t or "") for t in b["text"]]})

    rows = documents.select("doc_id", F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), "text")
    return rows.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source STRING, tokens BIGINT")


def capped_parameter(rate: float, cap: int) -> float:
    """Parameter of the Poisson distribution that, cut at cap, has the mean rate; infinite for rate = cap."""
    if rate <= 0:
        return 0.0
    if rate >= cap:
        return math.inf

    def mean(x: float) -> float:
        total = below = 0.0
        for k in range(cap):
            p = _poisson(x, k)
            total += k * p
            below += p
        return total + cap * (1 - below)

    low, high = 0.0, 1.0
    while mean(high) < rate and high < 64.0 * cap + 1024:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return high


def _poisson(x: float, k: int) -> float:
    """Probability of k, by logarithms: e^-x alone would vanish for a great x."""
    return math.exp(k * math.log(x) - x - math.lgamma(k + 1)) if x > 0 else float(k == 0)


def steps(parameter: float, cap: int) -> list[float]:
    """Distribution function at 0 .. cap - 1: the number of copies is the number of steps not above the draw."""
    if math.isinf(parameter):
        return [0.0] * cap
    out, total = [], 0.0
    for k in range(cap):
        total += _poisson(parameter, k)
        out.append(min(total, 1.0))
    return out


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source as given, key, target_share, max_repeats, tokens, wanted, rate, reachable, steps.

    The mix is to hold as many tokens as all documents together, those of other sources included. Targets without a
    source or share are dropped; repeated targets count once; a source without pages is not reachable.
    """
    spark = sizes.sparkSession
    key = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    once = targets.where("source IS NOT NULL AND target_share IS NOT NULL").select("source", key.alias("key"), F.col("target_share").cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats")).distinct()
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pages"))
    all_tokens = per_source.agg(F.sum("tokens").alias("n")).first()["n"] or 0  # one number
    met = once.join(per_source.withColumnRenamed("source", "key"), "key", "left")
    rows = met.limit(MOST_SOURCES + 1).collect()  # one row per source of the targets, refused beyond a bound
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    out = []
    for r in rows:
        have, wanted = r["tokens"] or 0, r["target_share"] * all_tokens
        reachable = bool(r["pages"]) and r["max_repeats"] * have >= wanted
        # pages without a token can be repeated as often as allowed and stay short of any target above 0
        rate = float(min(wanted / have, r["max_repeats"])) if have else float(r["max_repeats"] if wanted > 0 else 0)
        out.append((r["source"], r["key"], r["target_share"], r["max_repeats"], have, wanted, rate, reachable, steps(capped_parameter(rate, r["max_repeats"]), r["max_repeats"])))
    return spark.createDataFrame(out, "source STRING, key STRING, target_share DOUBLE, max_repeats INT, tokens BIGINT, wanted DOUBLE, rate DOUBLE, reachable BOOLEAN, steps ARRAY<DOUBLE>")


def replicate(sizes: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source (as in the targets), tokens, copies (0 and up). Documents of other sources are left out."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    small = F.broadcast(planned.select("key", F.col("source").alias("as"), "steps"))  # at most MOST_SOURCES rows
    met = sizes.withColumn("u", draw).join(small, sizes["source"] == F.col("key"))
    return met.select("doc_id", F.col("as").alias("source"), "tokens", F.size(F.filter("steps", lambda s: s <= F.col("u"))).alias("copies"))


def mix(copies: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copy (1 and up), place: the mix in global random order (range-partitioned by place)."""
    rows = copies.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    placed = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return placed.repartitionByRange("place").sortWithinPartitions("place", "doc_id", "copy")


def shares(copies: DataFrame, planned: DataFrame) -> DataFrame:
    """source, target_share, rate, reachable, mixed_tokens, actual_share: what the mix really holds."""
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    all_mixed = got.agg(F.sum("mixed_tokens").alias("n")).first()["n"] or 0  # one number
    met = planned.join(got, "source", "left")
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    return met.select("source", "target_share", "rate", "reachable", mixed.alias("mixed_tokens"), (mixed / F.lit(float(max(all_mixed, 1)))).alias("actual_share"))


def short_of_target(copies: DataFrame, planned: DataFrame) -> DataFrame:
    """source: targets the replicated mix can't reach, as its copies show: every page of the source is in it as often as
    allowed, and all copies together hold fewer tokens than wanted; or the source has no page at all."""
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.min("copies").alias("least"))
    met = planned.join(got, "source", "left")
    return met.where("least IS NULL OR (least >= max_repeats AND mixed_tokens < wanted)").select("source").distinct()
