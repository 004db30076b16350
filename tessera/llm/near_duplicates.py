"""Near-duplicate records with small edits: a grouped prefix join on token shingles.

1. Texts are normalised; equal ones become one class and take part once.
2. A text is the set of its shingles, ordered from rare to frequent over the whole collection. Two sets of similarity t
   or more share a shingle within their prefixes of size - ceil(t * size) + 1.
3. Texts with identical prefix and size are collapsed into one group. The join on prefix shingles pairs groups, not
   texts, and drops pairs whose sizes or first common position can't reach t.
4. Surviving group pairs are expanded to their members and every pair of texts is verified on the full sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

_HEX = re.compile(r"0x[0-9a-fA-F]+")
_LOCAL = re.compile(r"(?:var|local)_[0-9]+")
_SPACE = re.compile(r"\s+")


def normalise_body(body: str) -> str:
    """Addresses become ADDR, locals v0, v1, ... by first appearance, white space single blanks."""
    names: dict[str, str] = {}
    text = _LOCAL.sub(lambda m: names.setdefault(m[0], f"v{len(names)}"), _HEX.sub("ADDR", body))
    return _SPACE.sub(" ", text).strip()


def normalised(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, norm, words: one row per key (the least text of it, should a key come with several); NULL texts dropped."""
    once = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            norm = [normalise_body(x) for x in b["_t"]]
            yield pd.DataFrame({key: b[key], "norm": norm, "words": [x.split(" ") for x in norm]})

    return once.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, norm STRING, words ARRAY<STRING>")


def shingles(words: Column, size: int) -> Column:
    """Distinct hashes of runs of `size` successive words; empty for fewer words.

    words must be a stored column: an expression would be computed again for every run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def needed(size: Column, threshold: float) -> Column:
    """Least number of shingles of the smaller set that must be shared (with a guard for rounding)."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: pairs of ids (a < b) whose sets have a Jaccard similarity of at least threshold (above 0).

    sets: id bigint (unique), grams array<bigint> (distinct). Empty sets are similar to nothing.
    """
    full = sets.where(F.size("grams") > 0)
    frequency = full.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    # a shingle of one text joins nothing but must keep its place in the order: it comes first, as df 1
    often = frequency.where("df > 1")
    long = full.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    ranked = long.join(often, "g", "left").select("id", "n", "g", F.coalesce("df", F.lit(1)).alias("df"))
    ordered = ranked.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"))
    ordered = materialise(ordered.select("id", "n", F.transform("o", lambda x: x["g"]).alias("o"), F.transform("o", lambda x: x["df"]).alias("dfs")), "ordered")
    keep = (F.col("n") - needed(F.col("n"), threshold) + 1).cast("int")
    cut = ordered.select("id", "n", F.slice("o", F.lit(1), keep).alias("prefix"), F.slice("dfs", F.lit(1), keep).alias("dfs"))
    group = F.xxhash64("n", "prefix")
    members = cut.select("id", group.alias("grp"))
    groups = cut.groupBy(group.alias("grp")).agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("dfs").alias("dfs"), F.count("*").alias("m"))
    zipped = groups.select("grp", "n", "m", F.posexplode(F.arrays_zip("prefix", "dfs")).alias("pos", "z"))
    postings = materialise(zipped.where("z.dfs > 1").select("grp", "n", "pos", F.col("z.prefix").alias("g")), "postings")
    x, y = postings.alias("x"), postings.alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    overlap = F.ceil((n1 + n2) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    room = 1 + F.least(n1 - F.col("x.pos") - 1, n2 - F.col("y.pos") - 1)
    lengths = (F.least(n1, n2) >= needed(F.greatest(n1, n2), threshold))
    met = x.join(y, F.col("x.g") == F.col("y.g")).where(F.col("x.grp") < F.col("y.grp")).where(lengths)
    # the first common shingle of two prefixes is the join's least position: from it the overlap can be bounded
    first = met.groupBy(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).agg(F.max(F.struct(room.alias("room"), overlap.alias("overlap"))).alias("r"))
    group_pairs = first.where("r.room >= r.overlap").select("ga", "gb")
    within = groups.where("m > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    expanded = group_pairs.unionByName(within).join(members.select(F.col("grp").alias("ga"), F.col("id").alias("i")), "ga").join(members.select(F.col("grp").alias("gb"), F.col("id").alias("j")), "gb")
    pairs = expanded.where("ga <> gb OR i < j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    left = ordered.select(F.col("id").alias("a"), F.col("o").alias("oa"))
    right = ordered.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    common = F.size(F.array_intersect("oa", "ob"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("oa") + F.size("ob")).alias("s"))
    return scored.select("a", "b", (F.col("c") / (F.col("s") - F.col("c"))).alias("score")).where(F.col("score") >= F.lit(threshold - 1e-12))


def classes(norm: DataFrame, key: str) -> DataFrame:
    """key, words, cls: equal texts share the class, the least key of them."""
    reps = norm.groupBy("norm").agg(F.min(key).alias("cls"))
    return norm.join(reps, "norm").select(key, "words", "cls")


def near_duplicate_classes(rows: DataFrame, key: str, text: str, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(membership key, cls) and (links a, b, score between classes).

    NULL texts and keys are left out; an empty text is a class like any other; texts of fewer than `size` words are
    linked to equal texts only. Other columns are ignored.
    """
    member = materialise(classes(normalised(rows, key, text), key), "classes")
    heads = member.where(F.col(key) == F.col("cls"))
    # counted and ranked in two passes: written once, for hashing the shingles costs more than reading them
    sets = materialise(heads.select(F.col("cls").alias("id"), shingles(F.col("words"), size).alias("grams")), "shingles")
    return member.select(key, "cls"), similar_sets(sets, threshold)


def matches(member: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """a, b, score, method: copies linked to the least key of their class (exact), classes linked by shingles (ngram)."""
    exact = member.where(F.col(key) != F.col("cls")).select(F.col("cls").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("score"), F.lit("exact").alias("method"))
    return exact.unionByName(links.select("a", "b", "score", F.lit("ngram").alias("method")))


def all_pairs(member: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key_a < key_b, score: the links and equal texts expanded to their members, as a stated result demands."""
    names = [f"{key}_a", f"{key}_b"]
    m1, m2 = member.select(F.col(key).alias("i"), F.col("cls").alias("a")), member.select(F.col(key).alias("j"), F.col("cls").alias("b"))
    across = links.join(m1, "a").join(m2, "b").select(F.least("i", "j").alias(names[0]), F.greatest("i", "j").alias(names[1]), "score")
    repeated = member.groupBy("cls").agg(F.count("*").alias("m")).where("m > 1").select("cls")
    some = member.join(repeated, "cls")
    equal = some.alias("x").join(some.alias("y"), F.col("x.cls") == F.col("y.cls")).where(F.col(f"x.{key}") < F.col(f"y.{key}"))
    return across.unionByName(equal.select(F.col(f"x.{key}").alias(names[0]), F.col(f"y.{key}").alias(names[1]), F.lit(1.0).alias("score")))
