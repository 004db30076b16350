"""Aggregates over functions, packages and components: rankings, percentiles, coupling, hotspots, risk, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

#: Floor of a factor in a geometric mean, so that one zero doesn't wipe out the others.
FLOOR = 0.01


def p90_at_floor(df: DataFrame, by: list[str], value: str, name: str = "p90") -> DataFrame:
    """by, name: the value at position floor((n - 1) * 0.9) of each group in order, NULL left out.

    Values are counted first, so a group is as many rows as it has different values, and ranked by running counts.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    run = counted.withColumn("_n", F.sum("_c").over(whole)).withColumn("_to", F.sum("_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    at = F.floor((F.col("_n") - 1) * F.lit(9) / F.lit(10))
    return run.where(F.col("_to") > at).groupBy(*by).agg(F.min(value).alias(name))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, average, greatest, p90 of a value per group."""
    agg = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.max(value).alias("greatest"))
    return agg.join(p90_at_floor(df, by, value), by)


def geometric(*factors: Column) -> Column:
    product = F.greatest(factors[0], F.lit(FLOOR))
    for f in factors[1:]:
        product = product * F.greatest(f, F.lit(FLOOR))
    return F.pow(product, F.lit(1.0 / len(factors)))


def ranked(df: DataFrame, value: str, name: str, single: float) -> DataFrame:
    """df with the share of rows that have a strictly smaller value, among the others; NULL is the smallest.

    Ranks come from the counts of the distinct values. These are range-partitioned and summed within their partition;
    what lies in the partitions before, one number each, is added. No task orders more than its own range.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c")).select(F.col(value).alias("_v"), "_c")
    placed = materialise(counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "counts")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = placed.groupBy("_p").agg(F.sum("_c").alias("_s"))  # a row per partition
    parts = parts.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"), F.sum("_s").over(whole).alias("_n"))
    less = Window.partitionBy("_p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_less", F.coalesce(F.sum("_c").over(less), F.lit(0))).join(F.broadcast(parts), "_p")
    share = F.when(F.col("_n") <= 1, F.lit(single)).otherwise((F.col("_less") + F.col("_before")) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return df.join(inside.select("_v", share.alias(name)), df[value].eqNullSafe(F.col("_v"))).drop("_v")


def hotspots(functions: DataFrame, churn: DataFrame) -> DataFrame:
    """functions (id, file, cyclomatic, fan_in) with score: geometric mean of the ranks of churn, complexity, fan-in."""
    met = functions.join(churn.select("file", (F.col("commits") + F.col("authors") * 0.5).alias("_churn")), "file", "left").withColumn("_churn", F.coalesce("_churn", F.lit(0.0)))
    for value, name in (("_churn", "churn_rank"), ("cyclomatic", "complexity_rank"), ("fan_in", "fan_rank")):
        met = ranked(met, value, name, 1.0)
    return met.withColumn("score", geometric(F.col("churn_rank"), F.col("complexity_rank"), F.col("fan_rank"))).drop("_churn")


def risks(functions: DataFrame, churn: DataFrame, tested: DataFrame) -> DataFrame:
    """functions (id, file, cyclomatic, fan_out) with risk: ranks of complexity, fan-out and churn, and untestedness."""
    met = functions.join(churn.select("file", (F.col("commits") + F.col("authors") * 0.5).alias("_churn")), "file", "left").withColumn("_churn", F.coalesce("_churn", F.lit(0.0)))
    for value, name in (("cyclomatic", "complexity_rank"), ("fan_out", "fan_rank"), ("_churn", "churn_rank")):
        met = ranked(met, value, name, 0.5)
    met = met.join(tested.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    untested = F.when(F.col("_t"), F.lit(FLOOR)).otherwise(F.lit(1.0))
    return met.withColumn("risk", geometric(F.col("complexity_rank"), F.col("fan_rank"), F.col("churn_rank"), untested)).drop("_t", "_churn")


def coupling(packages: DataFrame, package_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """package, ca, ce, instability, abstractness, distance. Packages without edges stay, with zeros.

    packages: package; package_edges: src, dst; symbols: package, kind.
    """
    other = package_edges.where("src <> dst").select("src", "dst").distinct()
    ce = other.groupBy(F.col("src").alias("package")).agg(F.count("*").alias("ce"))
    ca = other.groupBy(F.col("dst").alias("package")).agg(F.count("*").alias("ca"))
    kinds = symbols.groupBy("package").agg(F.sum(F.col("kind").contains("interface").cast("int")).alias("_i"), F.sum(F.col("kind").contains("type_definition").cast("int")).alias("_t"))
    met = packages.select("package").distinct().join(ca, "package", "left").join(ce, "package", "left").join(kinds, "package", "left").na.fill(0)
    inst = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    abst = F.when(F.col("_t") > 0, F.col("_i") / F.col("_t")).otherwise(0.0)
    out = met.select("package", "ca", "ce", inst.alias("instability"), abst.alias("abstractness"))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1.0))


def type_methods(types: DataFrame, methods: DataFrame) -> DataFrame:
    """types with method_set_size: methods whose receiver's last word, without stars, is the type's name."""
    name = F.regexp_extract(F.regexp_replace("receiver", r"[*&]", ""), r"([^\s.]+)\s*$", 1)
    sizes = methods.where("receiver IS NOT NULL AND receiver <> ''").groupBy(name.alias("name")).agg(F.count("*").alias("method_set_size"))
    return types.join(sizes, "name", "left").withColumn("method_set_size", F.coalesce("method_set_size", F.lit(0)))


def top(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    return df.orderBy(*order).limit(most)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group; Spark's window group limit keeps no more than `most` rows of a group per task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def bridges(edges: DataFrame, most: int | None = None) -> DataFrame:
    """from_component, to_component, links, samples (the first three distinct): edges between different components.

    edges: from_component, to_component, sample. At most three samples per pair are ever gathered.
    """
    across = edges.where("from_component <> to_component")
    counted = across.groupBy("from_component", "to_component").agg(F.count("*").alias("links"))
    by = ["from_component", "to_component"]
    few = top_per_group(across.select(*by, "sample").distinct(), by, [F.col("sample")], 3).groupBy(*by).agg(F.sort_array(F.collect_list("sample")).alias("samples"))
    out = counted.join(few, by)
    return out if most is None else out.orderBy(F.desc("links"), *by).limit(most)


def trend(series: DataFrame, at: str, values: list[str]) -> DataFrame:
    """metric, first, last, change, percent: each value at the first and the last time (ties: the least value)."""
    out = series.agg(*(F.min_by(v, F.struct(at, v)).alias(f"_f_{v}") for v in values), *(F.max_by(v, F.struct(F.col(at), -F.col(v))).alias(f"_l_{v}") for v in values))
    pairs = ", ".join(f"'{v}', CAST(_f_{v} AS DOUBLE), CAST(_l_{v} AS DOUBLE)" for v in values)
    long = out.selectExpr(f"stack({len(values)}, {pairs}) AS (metric, first, last)")
    return long.select("metric", "first", "last", (F.col("last") - F.col("first")).alias("change"), F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")).alias("percent"))


def packed(items: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose costs (not below 0) stay within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def component_metrics(files: DataFrame, imports: DataFrame) -> DataFrame:
    """component, packages, files, internal_imports, external_imports (distinct per file).

    files: path, package, component; imports: file, import, internal.
    """
    base = files.groupBy("component").agg(F.countDistinct("package").alias("packages"), F.countDistinct("path").alias("files"))
    per = imports.select("file", "import", "internal").distinct().join(files.select(F.col("path").alias("file"), "component").distinct(), "file")
    tally = per.groupBy("component").agg(F.sum(F.col("internal").cast("bigint")).alias("internal_imports"), F.sum((~F.col("internal")).cast("bigint")).alias("external_imports"))
    return base.join(tally, "component", "left").na.fill(0, ["internal_imports", "external_imports"])


def external_tops(imports: DataFrame, by: str = "component", most: int = 3) -> DataFrame:
    """by, external, top: imports of other projects, and the most frequent of them. imports: by, import."""
    counted = imports.groupBy(by, "import").agg(F.count("*").alias("n"))
    total = counted.groupBy(by).agg(F.sum("n").alias("external"))
    best = top_per_group(counted, [by], [F.desc("n"), F.asc("import")], most)
    return total.join(best.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "import"))), lambda x: x["import"]).alias("top")), by)


def dependency_report(edges: DataFrame) -> DataFrame:
    """nodes, edges, internal_edges, external_edges of an import graph (src, dst, internal) in one row."""
    e = edges.select("src", "dst", "internal").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("nodes")).withColumn("_k", F.lit(1))
    counts = e.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.col("internal").cast("bigint")), F.lit(0)).alias("internal_edges")).withColumn("_k", F.lit(1))
    return ends.join(counts, "_k").select("nodes", "edges", "internal_edges", (F.col("edges") - F.col("internal_edges")).alias("external_edges"))
