"""Rules over the catalog: thresholds, smells, boundaries, capabilities, text patterns, suppressions, gates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fixed import CAPABILITIES, CONFIDENCE, GATE, SMELLS, THRESHOLDS  # noqa: F401
from tessera.functions.globs import package_matches
from tessera.functions.text import parameter_list

# What looks like a credential, or like a licence's text.
SECRETS = [
    ("assigned_secret", r"""(?i)\b(password|passwd|secret|api[_-]?key|token)\b\s*[:=]+\s*["'][^"']{4,}["']"""),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("access_key", r"\bAKIA[0-9A-Z]{16}\b"),
]
LICENCES = [("spdx", r"SPDX-License-Identifier:\s*(\S+)"), ("mit", r"(?i)\bMIT licen[cs]e\b"), ("apache", r"(?i)apache licen[cs]e"), ("all_rights", r"(?i)all rights reserved")]


def unpivoted(functions: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', CAST({m} AS BIGINT)" for m in metrics)
    return functions.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, value)").where("value IS NOT NULL")


def violations(functions: DataFrame, limits: dict[str, int], keys: list[str], scope: str = "*") -> DataFrame:
    """keys, metric, value, threshold: values strictly above their limit, in packages the scope glob names."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rows = unpivoted(functions.where(package_matches("package", scope)), list(limits), keys)
    return rows.withColumn("threshold", limit[F.col("metric")].cast("bigint")).where("value > threshold")


def gate(functions: DataFrame, limits: dict[str, int]) -> DataFrame:
    """metric, threshold, failures, passed: one row per limit above 0; a limit of 0 turns its check off."""
    on = {m: n for m, n in limits.items() if n > 0}
    tally = functions.agg(*(F.coalesce(F.sum((F.col(m) > n).cast("bigint")), F.lit(0)).alias(m) for m, n in on.items()))
    rows = ", ".join(f"'{m}', CAST({n} AS BIGINT), {m}" for m, n in on.items())
    return tally.selectExpr(f"stack({len(on)}, {rows}) AS (metric, threshold, failures)").withColumn("passed", F.col("failures") == 0)


def function_smells(functions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, smell, severity of the smells a function shows by its own metrics."""
    found = F.filter(F.array(*(F.when(F.expr(t), F.struct(F.lit(n).alias("smell"), F.lit(s).alias("severity"))) for n, s, t in SMELLS)), lambda x: x.isNotNull())
    return functions.select(*keys, F.explode(found).alias("_s")).select(*keys, "_s.smell", "_s.severity")


def package_smells(packages: DataFrame) -> DataFrame:
    """package, smell, severity. packages: package, ce, symbols, lcom."""
    return packages.where("ce > 15 AND symbols > 50 AND lcom > 3").select("package", F.lit("god_package").alias("smell"), F.lit("error").alias("severity"))


def type_smells(types: DataFrame) -> DataFrame:
    """file, name, smell, severity. types: file, name, method_set_size, fields, interface_width."""
    god = types.where("method_set_size > 20 AND fields > 15").select("file", "name", F.lit("god_type").alias("smell"), F.lit("error").alias("severity"))
    wide = types.where("interface_width > 8").select("file", "name", F.lit("wide_interface").alias("smell"), F.lit("warning").alias("severity"))
    return god.unionByName(wide)


def package_rules(packages: DataFrame, limits: dict[str, int]) -> DataFrame:
    """package, rule, value, threshold: exported_symbols, import_depth, lcom, and instability and distance in percent.

    packages has the metrics as columns; those without a limit are skipped, NULL values pass.
    """
    percent = {"instability", "distance"} & set(limits)
    scaled = packages.select("package", *(F.floor(F.col(m) * 100).cast("bigint").alias(m) if m in percent else F.col(m).cast("bigint").alias(m) for m in limits))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rows = unpivoted(scaled, list(limits), ["package"]).withColumn("threshold", limit[F.col("metric")].cast("bigint")).where("value > threshold")
    return rows.select("package", F.concat(F.lit("package/"), "metric").alias("rule"), "value", "threshold")


def ignored_by(findings: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """findings (rule, file, name) without those an ignore rule (metric, file, symbol) names; '' or `*` is any.

    A file is named by its path, its base name, a directory above it, or the end of its path.
    """
    out = findings
    for metric, file, symbol in rules:
        hit = F.lit(True) if metric in ("", "*") else F.col("rule") == metric
        if file not in ("", "*"):
            hit = hit & ((F.col("file") == file) | F.col("file").startswith(file.rstrip("/") + "/") | F.col("file").endswith("/" + file))
        if symbol not in ("", "*"):
            hit = hit & (F.coalesce("name", F.lit("")) == symbol)
        out = out.where(~hit)
    return out


def data_clumps(functions: DataFrame, least: int = 3) -> DataFrame:
    """params, members, first_function: parameter lists that at least `least` functions share."""
    rows = functions.select("name", parameter_list("signature").alias("params")).where("params LIKE '%,%'")
    return rows.groupBy("params").agg(F.count("*").alias("members"), F.min("name").alias("first_function")).where(F.col("members") >= least)


def feature_envy(calls: DataFrame) -> DataFrame:
    """caller_id, package, target, calls, own: functions that call another package more often than their own.

    calls: caller_id, package, callee_package, count.
    """
    per = calls.groupBy("caller_id", "package", "callee_package").agg(F.sum("count").alias("calls"))
    own = per.where("package = callee_package").select("caller_id", F.col("calls").alias("own"))
    away = per.where("package <> callee_package").join(own, "caller_id", "left")
    return away.select("caller_id", "package", F.col("callee_package").alias("target"), "calls", F.coalesce("own", F.lit(0)).alias("own")).where("calls > own")


def unstable_dependencies(package_edges: DataFrame, coupling: DataFrame, stable: float = 0.3, unstable: float = 0.7) -> DataFrame:
    """src, dst: stable packages (instability below `stable`) that depend on unstable ones (above `unstable`)."""
    a = coupling.where(F.col("instability") < stable).select(F.col("package").alias("src"))
    b = coupling.where(F.col("instability") > unstable).select(F.col("package").alias("dst"))
    return package_edges.where("src <> dst").select("src", "dst").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def parse_boundaries(text: str) -> list[tuple[int, str, str, str]]:
    """(rule, module, allow or deny, target) of lines `module NAME` followed by `allow GLOB` and `deny GLOB` lines."""
    out, module = [], None
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if len(words) == 2 and words[0] == "module":
            module = words[1]
        elif len(words) == 2 and words[0] in ("allow", "deny") and module:
            out.append((len(out), module, words[0], words[1]))
        elif words:
            raise ValueError(f"not a boundary rule: {line!r}")
    return out


def boundary_violations(edges: DataFrame, rules: list[tuple[int, str, str, str]]) -> DataFrame:
    """src, dst, rule, type: denied edges, and edges of a module that an allow rule of it doesn't name.

    Rules are few and become column expressions: one pass over the edges without a join.
    """
    found = []
    for n, module, kind, target in rules:
        hit = package_matches("src", module) & (package_matches("dst", target) if kind == "deny" else ~package_matches("dst", target))
        found.append(F.when(hit & (F.col("src") != F.col("dst")), F.struct(F.lit(n).alias("rule"), F.lit(kind).alias("type"))))
    if not found:
        return edges.limit(0).select("src", "dst", F.lit(0).alias("rule"), F.lit("").alias("type"))
    each = edges.select("src", "dst").distinct().select("src", "dst", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("_r"))
    return each.select("src", "dst", "_r.rule", "_r.type")


def capabilities(calls: DataFrame, by: list[str], rules: list[tuple] = CAPABILITIES, least: str = "low", category: str = "") -> DataFrame:
    """by, capability, attack_id, category, confidence, matched: groups that make any (or all) of a rule's calls.

    calls: by, name. Rules: name, technique, category, confidence, whether all calls are needed, the calls.
    """
    spark: SparkSession = calls.sparkSession
    used = [r for r in rules if CONFIDENCE[r[3]] >= CONFIDENCE[least] and category in ("", r[2])]
    rows = [(r[0], r[1], r[2], r[3], api, len(set(r[5].split())) if r[4] else 1) for r in used for api in sorted(set(r[5].split()))]
    apis = spark.createDataFrame(rows, "capability STRING, attack_id STRING, category STRING, confidence STRING, name STRING, needed INT")
    met = calls.select(*by, "name").distinct().join(F.broadcast(apis), "name")  # the rules' calls: some dozens
    keys = [*by, "capability", "attack_id", "category", "confidence"]
    return met.groupBy(*keys).agg(F.sort_array(F.collect_set("name")).alias("matched"), F.max("needed").alias("needed")).where("size(matched) >= needed").drop("needed")


def pattern_lines(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """key, line (from 1), rule: lines that match a pattern. Texts without any match are dropped before they are split."""
    for _, p in patterns:
        re.compile(p)
    some = F.lit(False)
    for _, p in patterns:
        some = some | F.col(text).rlike(p)
    lines = texts.where(some).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    hits = F.filter(F.array(*(F.when(F.col("_line").rlike(p), F.lit(n)) for n, p in patterns)), lambda x: x.isNotNull())
    return lines.select(key, (F.col("_at") + 1).alias("line"), F.explode(hits).alias("rule"))


def suppressions(texts: DataFrame, key: str, text: str, word: str = "lint:ignore") -> DataFrame:
    """key, rule, line: the line a comment `<word> RULE` covers (the one after it), or 0 where `<word>-file` covers all."""
    some = texts.where(F.col(text).contains(word)).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line"))
    found = some.withColumn("rule", F.regexp_extract("_line", re.escape(word) + r"(?:-file)?[ \t]+(\S+)", 1)).where("rule <> ''")
    return found.select(key, "rule", F.when(F.col("_line").contains(word + "-file"), 0).otherwise(F.col("_at") + 2).alias("line"))


def unsuppressed(findings: DataFrame, ignored: DataFrame, key: str) -> DataFrame:
    """findings (key, line, rule) without those a suppression covers; `*` names every rule."""
    whole = ignored.where("line = 0").select(key, F.col("rule").alias("_r")).distinct()
    at = ignored.where("line > 0").select(key, "line", F.col("rule").alias("_r")).distinct()
    left = findings.join(whole, (findings[key] == whole[key]) & ((whole["_r"] == findings["rule"]) | (whole["_r"] == "*")), "left_anti")
    return left.join(at, (left[key] == at[key]) & (left["line"] == at["line"]) & ((at["_r"] == left["rule"]) | (at["_r"] == "*")), "left_anti")


def parse_text_rule(text: str) -> tuple[str, int | str]:
    """('lines', n) for `no function longer than N lines`, ('import', name) for `no import NAME`."""
    m = re.fullmatch(r"\s*no function longer than (\d+) lines?\s*", text, re.I)
    if m:
        return "lines", int(m[1])
    m = re.fullmatch(r"\s*no import [\"']?([^\"'\s]+)[\"']?\s*", text, re.I)
    if m:
        return "import", m[1]
    raise ValueError(f"not a text rule: {text!r}")
