"""Cross references: the callable a reference lies in, its callee by tiers, call edges and what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

CALLABLE = ("function_definition", "method_definition")
TIERS = ("file", "import", "package", "global")


def enclosing(refs: DataFrame, spans: DataFrame, key: str = "file", at: str = "line", ref_id: str = "ref_id", width: int = 64) -> DataFrame:
    """refs with the columns of the innermost span (id, start, end) of the same key that holds `at`.

    The least span wins, then the later start, then the least id; refs outside of all spans get NULLs. Spans are cut
    into bins of `width` lines, so a key with very many spans is spread over equi-joins on (key, bin).
    """
    bins = spans.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    placed = refs.withColumn("_bin", F.floor(F.col(at) / width))
    met = placed.join(bins.select(F.col(key), "_bin", "id", "start", "end"), [key, "_bin"]).where(f"{at} BETWEEN start AND end")
    best = met.groupBy(ref_id).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), "id", "start", "end")).alias("_b"))
    return refs.join(best.select(ref_id, F.col("_b.id").alias("span_id"), F.col("_b.start").alias("span_start"), F.col("_b.end").alias("span_end")), ref_id, "left")


def first_containing(refs: DataFrame, spans: DataFrame, key: str = "file", at: str = "line", ref_id: str = "ref_id", width: int = 64) -> DataFrame:
    """As enclosing, with the first span in order (column ord) that holds the line, else the first span of the key."""
    bins = spans.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = refs.withColumn("_bin", F.floor(F.col(at) / width)).join(bins.select(key, "_bin", "id", "start", "end", "ord"), [key, "_bin"]).where(f"{at} BETWEEN start AND end")
    best = met.groupBy(ref_id).agg(F.min(F.struct("ord", "id")).alias("_b")).select(ref_id, F.col("_b.id").alias("_in"))
    first = spans.groupBy(key).agg(F.min(F.struct("ord", "id")).alias("_f")).select(key, F.col("_f.id").alias("_first"))
    return refs.join(best, ref_id, "left").join(first, key, "left").withColumn("span_id", F.coalesce("_in", "_first")).drop("_in", "_first")


def _candidates(definitions: DataFrame, *by: str) -> DataFrame:
    """Number of definitions by name and scope, one of them, and whether all are methods with a receiver."""
    method = (F.col("kind") == "method_definition") & (F.coalesce("receiver", F.lit("")) != "")
    return definitions.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("one"), F.min(method).alias("methods"))


def resolve(refs: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """file, package, name, tier, n, one, methods for each distinct (file, package, name) among refs.

    The first tier with a candidate decides: the same file, an imported package, the same package, anywhere. Names are
    looked up in counted tables, not joined with their definitions, so a name with very many definitions costs one row.
    definitions: id, file, package, name, kind, receiver; imports: file, package.
    """
    keys = refs.select("file", "package", "name").distinct()
    defs = definitions.where(F.col("kind").isin(*CALLABLE))
    by_package = _candidates(defs, "package", "name")
    imported = keys.join(imports.select("file", F.col("package").alias("_p")).distinct(), "file").join(by_package.withColumnRenamed("package", "_p"), ["_p", "name"])
    imported = imported.groupBy("file", "name").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.min("methods").alias("methods"))
    tables = [_candidates(defs, "file", "name"), imported, by_package, _candidates(defs, "name")]
    out = keys
    for tier, t, by in zip(TIERS, tables, (["file", "name"], ["file", "name"], ["package", "name"], ["name"])):
        out = out.join(t.select(*by, F.struct(F.lit(tier).alias("tier"), F.col("n").cast("bigint").alias("n"), "one", "methods").alias(f"_{tier}")), by, "left")
    pick = F.coalesce(*(F.col(f"_{t}") for t in TIERS))
    return out.select("file", "package", "name", pick["tier"].alias("tier"), pick["n"].alias("n"), pick["one"].alias("one"), pick["methods"].alias("methods"))


def call_edges(refs: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """caller_id, callee_id, resolution, count: refs (file, package, name, caller_id) resolved and counted.

    A single candidate makes an edge; several make edges to all if they are methods with receivers (poly_<tier>). Each
    tier meets the definitions on its own scope and name, so that only names nothing nearer has meet all definitions.
    """
    counted = refs.where("caller_id IS NOT NULL").groupBy("file", "package", "name", "caller_id").agg(F.count("*").alias("k"))
    found = materialise(resolve(refs, definitions, imports).where("n = 1 OR (n > 1 AND methods)"), "resolved")
    sure = found.where("n = 1").select("file", "package", "name", F.col("one").alias("callee_id"), F.col("tier").alias("resolution"))
    many = found.where("n > 1").select("file", "package", "name", "tier")
    defs = definitions.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("callee_id"), F.col("file").alias("_f"), F.col("package").alias("_p"), "name")
    linked = imports.select("file", F.col("package").alias("_p")).distinct()
    of = lambda t: many.where(F.col("tier") == t)
    fans = {
        "file": of("file").join(defs.drop("_p").withColumnRenamed("_f", "file"), ["file", "name"]),
        "import": of("import").join(linked, "file").join(defs.drop("_f"), ["_p", "name"]),
        "package": of("package").join(defs.drop("_f").withColumnRenamed("_p", "package"), ["package", "name"]),
        "global": of("global").join(defs.drop("_f", "_p"), "name"),
    }
    every = sure
    for tier, fan_out in fans.items():
        every = every.unionByName(fan_out.select("file", "package", "name", "callee_id", F.lit(f"poly_{tier}").alias("resolution")))
    met = counted.join(every, ["file", "package", "name"])
    order = {t: i for i, t in enumerate(["file", "poly_file", "import", "poly_import", "package", "poly_package", "global", "poly_global"])}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("resolution")]
    return met.groupBy("caller_id", "callee_id").agg(F.min_by("resolution", rank).alias("resolution"), F.sum("k").alias("count"))


def unresolved(refs: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """refs without an edge: reason (outside_callable, no_definition, ambiguous_<tier>) and the number of candidates.

    A reference outside of every callable is unresolved whatever it names.
    """
    placed = refs.where("caller_id IS NOT NULL")
    found = resolve(placed, definitions, imports).where("n IS NULL OR (n > 1 AND NOT methods)")
    reason = F.when(F.col("n").isNull(), F.lit("no_definition")).otherwise(F.concat(F.lit("ambiguous_"), "tier"))
    named = placed.join(found.select("file", "package", "name", reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("candidates")), ["file", "package", "name"])
    outside = refs.where("caller_id IS NULL").withColumns({"reason": F.lit("outside_callable"), "candidates": F.lit(0).cast("bigint")})
    return named.unionByName(outside.select(*named.columns))


def call_samples(refs: DataFrame, edges: DataFrame, definitions: DataFrame, most: int = 3) -> DataFrame:
    """edges with samples: the first `most` references of each, as (file, line, col, name) in their order.

    refs: caller_id, file, line, col, name. A reference belongs to the edges from its caller to definitions of its name.
    """
    named = edges.select("caller_id", "callee_id").join(definitions.select(F.col("id").alias("callee_id"), "name"), "callee_id")
    met = refs.where("caller_id IS NOT NULL").select("caller_id", "file", "line", "col", "name").join(named, ["caller_id", "name"])
    by = ["caller_id", "callee_id"]
    few = samples(met, by, ["file", "line", "col", "name"], most)
    return edges.join(few.select(*by, F.transform("samples", lambda x: F.struct(x["file"], x["line"], x["col"], x["name"])).alias("samples")), by, "left")


def edge_order(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """edges in the order of the caller's file, line and name, then the callee's."""
    at = definitions.select("id", "file", "start_line", "name")
    out = edges
    for end in ("caller", "callee"):
        out = out.join(at.select(F.col("id").alias(f"{end}_id"), *(F.col(c).alias(f"_{end}_{c}") for c in ("file", "start_line", "name"))), f"{end}_id", "left")
    return out.orderBy(*(f"_{end}_{c}" for end in ("caller", "callee") for c in ("file", "start_line", "name"))).select(*edges.columns)


def resolution_rate(edges: DataFrame, left: DataFrame) -> DataFrame:
    """edges, unresolved, rate: distinct edges against edges and unresolved references, 0 where there are neither."""
    e = edges.agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1))
    u = left.agg(F.count("*").alias("unresolved")).withColumn("_k", F.lit(1))
    total = F.col("edges") + F.col("unresolved")
    return e.join(u, "_k").select("edges", "unresolved", F.when(total > 0, F.col("edges") / total).otherwise(0.0).alias("rate"))


def fan(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: sums of call counts."""
    into = edges.groupBy(F.col("callee_id").alias("id")).agg(F.sum("count").alias("fan_in"))
    out = edges.groupBy(F.col("caller_id").alias("id")).agg(F.sum("count").alias("fan_out"))
    return into.join(out, "id", "full_outer").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def dead(definitions: DataFrame, edges: DataFrame, entry_points: tuple[str, ...] = ("main", "init")) -> DataFrame:
    """Definitions nothing calls, entry points left out."""
    return definitions.join(edges.select(F.col("callee_id").alias("id")).distinct(), "id", "left_anti").where(~F.coalesce(F.col("name"), F.lit("")).isin(*entry_points))


def import_paths(text) -> Column:
    """Paths an import text names: itself without white space; else its quoted parts; else its words, cut at separators."""
    from tessera.functions.text import quoted_parts, trimmed

    t = trimmed(text)
    words = F.filter(F.split(t, r"[\s:.\\]+"), lambda w: w != "")
    return F.when(~t.rlike(r"\s"), F.array(F.regexp_replace(t, r"""^["'`]|["'`]$""", ""))).when(F.size(quoted_parts(t)) > 0, quoted_parts(t)).otherwise(words)


def local_package(path, module: str | None) -> Column:
    """Package of an import below the module; NULL for another project's."""
    p = F.col(path) if isinstance(path, str) else path
    if not module:
        return F.when(~p.rlike(r"^[^/]+\.[^/]+/"), p)
    return F.when(p == module, F.lit(".")).when(p.startswith(module + "/"), F.substring(p, len(module) + 2, 1 << 30))


def import_scope(imports: DataFrame, packages: DataFrame, module: str | None) -> DataFrame:
    """file, package: the packages of the index that a file's imports reach.

    imports: file, import (raw text); packages: package. An import that names paths reaches the package of each path. Where
    none of a file's imports names a path, the words of its imports reach every package with such a word in its path.
    """
    t = F.trim("import")
    rows = imports.where(t != "").select("file", t.alias("import"))
    is_path = ~F.col("import").rlike(r"\s") | F.col("import").rlike(r"""["'`][^"'`]+["'`]""")
    paths = rows.where(is_path).select("file", F.explode(import_paths(F.col("import"))).alias("_p"))
    named = paths.select("file", F.explode(F.array_distinct(F.array(local_package("_p", module), F.col("_p")))).alias("package")).where("package IS NOT NULL")
    words = rows.where(~is_path).join(paths.select("file").distinct(), "file", "left_anti").select("file", F.explode(import_paths(F.col("import"))).alias("_w")).distinct()
    parts = packages.select("package").distinct().withColumn("_w", F.explode(F.array_distinct(F.filter(F.split("package", r"[/.:\\]+"), lambda w: w != ""))))
    return named.unionByName(words.join(parts, "_w").select("file", "package")).distinct()


def samples(refs: DataFrame, by: list[str], order: list[str], most: int = 3) -> DataFrame:
    """by, samples: the first rows of each group in order. Ranked, not collected, so a large group stays spread."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = refs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", *order))).alias("samples"))


def infer_modules(imports: DataFrame, directories: DataFrame) -> DataFrame:
    """repo, module, votes: the import prefix that most often leaves a directory of the repository (ties: the least).

    imports: repo, import; directories: repo, dir. Every split of an import is a row, looked up by equality.
    """
    parts = F.split("import", "/")
    cut = imports.select("repo", "import").distinct().where(F.size(parts) > 1).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    splits = cut.select("repo", F.array_join(F.slice(parts, F.lit(1), F.col("_k")), "/").alias("module"), F.array_join(F.slice(parts, F.col("_k") + 1, F.size(parts)), "/").alias("dir"))
    votes = splits.join(directories.select("repo", "dir").distinct(), ["repo", "dir"], "left_semi").groupBy("repo", "module").agg(F.count("*").alias("votes"))
    best = votes.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("votes"), "module"))).where("_n = 1")
    return best.select("repo", "module", "votes")
