"""Registered queries over the index: searches, listings, statistics, metrics, rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.functions import fixed, globs, selector, text
from tessera.operators import diff, lookup, metrics, rules, similarity, snapshots
from tessera.operators import chunks as cut
from tessera.plans import relations as R
from tessera.session import materialise
from tessera.sources import extract, scopes, structural
from tessera.sources.tables import clean_path, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- searches and listings ---


@query(rf"WITH {R.SYMBOLS} SELECT file, kind, receiver, name, start_line FROM s WHERE kind = 'function_definition' AND regexp_matches(name, '^(load|store)') AND regexp_matches(file, '\.(go|rs)$') AND start_line >= 10 AND end_line <= 900")
def selector_filter(spark: SparkSession, d: str) -> DataFrame:
    s = selector.parse(r"function_definition[name=/^(load|store)/,file=/\.(go|rs)$/,start>=10,end<=900]")
    return R.current_symbols(spark, d).where(s).select("file", "kind", "receiver", "name", "start_line")


@query(f"WITH {R.SYMBOLS} SELECT file, kind, name, signature FROM s WHERE kind = 'class_definition' AND contains(lower(name), 'ledger')")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return R.current_symbols(spark, d).where((F.col("kind") == "class_definition") & F.lower("name").contains("ledger")).select("file", "kind", "name", "signature")


@query(f"WITH {R.SYMBOLS} SELECT file, name, start_line FROM (SELECT * FROM s WHERE kind = 'method_definition' ORDER BY file, start_line, name, receiver LIMIT 100)")
def selector_first(spark: SparkSession, d: str) -> DataFrame:
    """A limited search takes the first matches in the order of the index."""
    found = R.current_symbols(spark, d).where(selector.parse("method_definition"))
    return found.orderBy("file", "start_line", "name", "receiver").limit(100).select("file", "name", "start_line")


@query(f"WITH {R.SYMBOLS} SELECT name, kind, file FROM s WHERE start_line <= 100 AND end_line >= 100")
def symbols_at_line(spark: SparkSession, d: str) -> DataFrame:
    return R.current_symbols(spark, d).where(selector.parse("*[line=100]")).select("name", "kind", "file")


@query(f"WITH {R.IMPORTS} SELECT repo, file, import FROM i WHERE regexp_matches(import, '/ledger$')")
def import_search(spark: SparkSession, d: str) -> DataFrame:
    return R.current_imports(spark, d).where(F.col("import").rlike("/ledger$")).select("repo", "file", "import")


@query(f"WITH {R.IMPORTS} SELECT import, count(*) AS files, count(DISTINCT repo) AS repos FROM i GROUP BY 1")
def import_search_reverse(spark: SparkSession, d: str) -> DataFrame:
    return R.current_imports(spark, d).groupBy("import").agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


@query(f"""WITH {R.SYMBOLS}, {R.IMPORTS}, {R.FILES}, a AS (SELECT file AS path, count(*) AS symbols FROM s GROUP BY 1), b AS (SELECT file AS path, count(*) AS imports FROM i GROUP BY 1)
  SELECT path, language, size_bytes, coalesce(symbols, 0) AS symbols, coalesce(imports, 0) AS imports FROM cf LEFT JOIN a USING (path) LEFT JOIN b USING (path) ORDER BY symbols DESC, path LIMIT 50""")
def file_density(spark: SparkSession, d: str) -> DataFrame:
    a = R.current_symbols(spark, d).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    b = R.current_imports(spark, d).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("imports"))
    met = R.current_files(spark, d).join(a, "path", "left").join(b, "path", "left").na.fill(0, ["symbols", "imports"])
    return metrics.top(met.select("path", "language", "size_bytes", "symbols", "imports"), [F.desc("symbols"), F.asc("path")], 50)


@query(f"WITH {R.SYMBOLS} SELECT kind, count(*) AS symbols, count(DISTINCT file) AS files FROM s GROUP BY 1")
def stats_kind(spark: SparkSession, d: str) -> DataFrame:
    return R.current_symbols(spark, d).groupBy("kind").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))


@query(f"WITH {R.FILES} SELECT coalesce(nullif(language, ''), 'unknown') AS language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(gen_reason) AS generated FROM cf GROUP BY 1")
def stats_language(spark: SparkSession, d: str) -> DataFrame:
    lang = F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit("unknown"))
    return R.current_files(spark, d).groupBy(lang.alias("language")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count("gen_reason").alias("generated"))


@query(f"WITH {R.FILES} SELECT gen_generator AS generator, gen_reason AS reason, count(*) AS files FROM cf WHERE gen_reason IS NOT NULL GROUP BY 1, 2")
def generator_tally(spark: SparkSession, d: str) -> DataFrame:
    return R.current_files(spark, d).where("gen_reason IS NOT NULL").groupBy(F.col("gen_generator").alias("generator"), F.col("gen_reason").alias("reason")).agg(F.count("*").alias("files"))


@query(f"WITH {R.FILES} SELECT path, package FROM cf WHERE gen_reason IS NULL")
def human_files(spark: SparkSession, d: str) -> DataFrame:
    return R.current_files(spark, d).where("gen_reason IS NULL").select("path", "package")


_IGNORE = "*.min.js\nledger/\n!aldermoor:internal/**\nnode_modules\n/aldermoor:pkg/*/*.go\n"


@query(rf"""WITH {R.FILES}, c AS (SELECT path, CASE WHEN regexp_matches(path, '^aldermoor:pkg/[^/]*/[^/]*\.go(/|$)') THEN true WHEN regexp_matches(path, '(^|/)node_modules(/|$)') THEN true
  WHEN regexp_matches(path, '^aldermoor:internal/.*(/|$)') THEN false WHEN regexp_matches(path, '(^|/)ledger/') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\.min\.js(/|$)') THEN true ELSE false END AS x FROM cf)
  SELECT path FROM c WHERE x""")
def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.current_files(spark, d).where(globs.ignored("path", globs.parse_ignore(_IGNORE))).select("path")


@query(rf"""WITH {R.FILES} SELECT path FROM cf WHERE NOT regexp_matches(split_part(path, ':', 2), '(^|/)\.[^/]') AND NOT regexp_matches(split_part(path, ':', 2), '(^|/)({'|'.join(map(re.escape, globs.SKIPPED_DIRS))})/')""")
def indexable_paths(spark: SparkSession, d: str) -> DataFrame:
    return R.current_files(spark, d).where(globs.indexable(F.split_part("path", F.lit(":"), F.lit(2)))).select("path")


@query(f"WITH {R.FUNCTIONS} SELECT package, count(*) AS functions FROM f WHERE package = 'aldermoor:internal' OR starts_with(package, 'aldermoor:internal/') GROUP BY 1")
def glob_scope(spark: SparkSession, d: str) -> DataFrame:
    return R.functions(spark, d).where(globs.package_matches("package", "aldermoor:internal/*")).groupBy("package").agg(F.count("*").alias("functions"))


@query(r"""SELECT regexp_replace(path, '^(\./)+', '') AS path, count(*) AS messages, count(DISTINCT error) AS different FROM errors WHERE path IS NOT NULL AND coalesce(error, '') <> '' GROUP BY 1""")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "errors").where("path IS NOT NULL AND coalesce(error, '') <> ''")
    return e.groupBy(clean_path("path").alias("path")).agg(F.count("*").alias("messages"), F.countDistinct("error").alias("different"))


@query(rf"""WITH {R.FILES}, g AS (SELECT DISTINCT regexp_replace(path, '^(\./)+', '') AS path FROM sources) SELECT CASE WHEN g.path IS NULL THEN 'missing' ELSE 'ok' END AS state, count(*) AS files FROM cf LEFT JOIN g USING (path) GROUP BY 1""")
def index_validation(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files against the texts that are there."""
    there = table(spark, d, "sources").select(clean_path("path").alias("path")).distinct().withColumn("_t", F.lit(1))
    return R.current_files(spark, d).join(there, "path", "left").groupBy(F.when(F.col("_t").isNull(), "missing").otherwise("ok").alias("state")).agg(F.count("*").alias("files"))


# --- metrics ---


@query(f"""WITH {R.FUNCTIONS}, v AS (SELECT language, cyclomatic, row_number() OVER (PARTITION BY language ORDER BY cyclomatic) - 1 AS k, count(*) OVER (PARTITION BY language) AS n FROM f WHERE cyclomatic >= 0)
  SELECT language, any_value(n) AS n, round(avg(cyclomatic), 6) AS average, max(cyclomatic) AS greatest, max(CASE WHEN k = (n - 1) * 9 // 10 THEN cyclomatic END) AS p90 FROM v GROUP BY 1""")
def complexity_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(R.functions(spark, d).where("cyclomatic >= 0"), ["language"], "cyclomatic").withColumn("average", F.round("average", 6))


@query(f"""WITH {R.FUNCTIONS}, v AS (SELECT package, risk, row_number() OVER (PARTITION BY package ORDER BY risk) - 1 AS k, count(*) OVER (PARTITION BY package) AS n FROM f WHERE risk IS NOT NULL)
  SELECT package, any_value(n) AS n, (CAST(sum(CAST(round(risk * 1000000) AS BIGINT)) AS BIGINT) // count(*)) / 1000000.0::DOUBLE AS average, max(risk) AS greatest, max(CASE WHEN k = (n - 1) * 9 // 10 THEN risk END) AS p90, count(*) FILTER (WHERE risk > 0.6) AS high FROM v GROUP BY 1""")
def risk_by_package(spark: SparkSession, d: str) -> DataFrame:
    f = R.functions(spark, d).where("risk IS NOT NULL")
    # the average goes over whole millionths: a sum of doubles depends on the order of the rows
    millionths = F.sum(F.round(F.col("risk") * 1_000_000).cast("bigint"))
    high = f.groupBy("package").agg(F.sum((F.col("risk") > 0.6).cast("bigint")).alias("high"), millionths.alias("_s"), F.count("*").alias("_n"))
    met = metrics.summary(f, ["package"], "risk").drop("average").join(high, "package")
    return met.withColumn("average", F.expr("_s div _n") / F.lit(1_000_000.0)).drop("_s", "_n")


@query(f"WITH {R.FUNCTIONS} SELECT file, name, start_line, cyclomatic FROM f WHERE cyclomatic >= 0 ORDER BY cyclomatic DESC, file, start_line, name LIMIT 20")
def most_complex(spark: SparkSession, d: str) -> DataFrame:
    f = R.functions(spark, d).where("cyclomatic >= 0").select("file", "name", "start_line", "cyclomatic")
    return metrics.top(f, [F.desc("cyclomatic"), F.asc("file"), F.asc("start_line"), F.asc("name")], 20)


@query(f"""WITH {R.FUNCTIONS}, x AS (SELECT package, name, fan_in, fan_out, function_id FROM f WHERE fan_in >= 1),
  y AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY fan_in DESC, function_id) AS rank FROM x)
  SELECT package, name, fan_in, fan_out, CASE WHEN fan_out = 0 THEN CAST('inf' AS DOUBLE) ELSE round(fan_in / fan_out, 6) END AS ratio, CAST(rank AS INT) AS rank FROM y WHERE rank <= 3""")
def fan_in_ranking(spark: SparkSession, d: str) -> DataFrame:
    f = R.functions(spark, d).where("fan_in >= 1")
    best = metrics.top_per_group(f, ["package"], [F.desc("fan_in"), F.asc("function_id")], 3)
    ratio = F.when(F.col("fan_out") == 0, F.lit(float("inf"))).otherwise(F.round(F.try_divide("fan_in", "fan_out"), 6))
    return best.select("package", "name", "fan_in", "fan_out", ratio.alias("ratio"), "rank")


_CHURN = "ch AS (SELECT regexp_replace(path, '^(\\./)+', '') AS file, count(DISTINCT mtime_ns) AS commits, count(DISTINCT scan_id) AS authors FROM files WHERE path IS NOT NULL GROUP BY 1)"


def _churn(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a file: its different modification times and the scans that list it."""
    return table(spark, d, "files").where("path IS NOT NULL").groupBy(clean_path("path").alias("file")).agg(F.countDistinct("mtime_ns").alias("commits"), F.countDistinct("scan_id").alias("authors"))


_RANKS = """g AS (SELECT f.*, coalesce(commits + authors * 0.5, 0) AS churn FROM f LEFT JOIN ch USING (file)),
  p AS (SELECT *, count(*) OVER () AS n, percent_rank() OVER (ORDER BY churn NULLS FIRST) AS rc, percent_rank() OVER (ORDER BY cyclomatic NULLS FIRST) AS rx, percent_rank() OVER (ORDER BY fan_in NULLS FIRST) AS ri, percent_rank() OVER (ORDER BY fan_out NULLS FIRST) AS ro FROM g)"""


@query(f"WITH {R.FUNCTIONS}, {_CHURN}, {_RANKS} SELECT function_id, round(pow(greatest(rc, 0.01) * greatest(rx, 0.01) * greatest(ri, 0.01), 1.0 / 3), 6) AS score FROM p")
def hotspot_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hotspots(R.functions(spark, d), _churn(spark, d)).select("function_id", F.round("score", 6).alias("score"))


@query(f"""WITH {R.FUNCTIONS}, {_CHURN}, {_RANKS}, t AS (SELECT DISTINCT a AS function_id FROM pairs WHERE a IS NOT NULL)
  SELECT function_id, round(pow(greatest(rx, 0.01) * greatest(ro, 0.01) * greatest(rc, 0.01) * CASE WHEN t.function_id IS NULL THEN 1.0 ELSE 0.01 END, 0.25), 6) AS risk FROM p LEFT JOIN t USING (function_id)""")
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    f = R.functions(spark, d).drop("risk").withColumn("id", F.col("function_id"))
    tested = table(spark, d, "pairs").where("a IS NOT NULL").select(F.col("a").alias("id"))
    return metrics.risks(f, _churn(spark, d), tested).select("function_id", F.round("risk", 6).alias("risk"))


@query(f"""WITH {R.SYMBOLS}, m AS (SELECT repo, receiver AS name, count(*) AS n FROM s WHERE kind = 'method_definition' AND receiver <> '' GROUP BY 1, 2), k AS (SELECT name, CAST(sum(n) AS BIGINT) AS method_set_size FROM m GROUP BY 1)
  SELECT file, s.name, kind, coalesce(method_set_size, 0) AS method_set_size FROM s LEFT JOIN k ON k.name = s.name WHERE kind = 'type_definition'""")
def type_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = R.current_symbols(spark, d)
    types = s.where("kind = 'type_definition'").select("file", "name", "kind")
    return metrics.type_methods(types, s.where("kind = 'method_definition'")).select("file", "name", "kind", "method_set_size")


@query(f"""WITH {R.PACKAGES_SQL}, o AS (SELECT DISTINCT src, dst FROM pe WHERE src <> dst), ce AS (SELECT src AS package, count(*) AS ce FROM o GROUP BY 1), ca AS (SELECT dst AS package, count(*) AS ca FROM o GROUP BY 1),
  k AS (SELECT package, count(*) FILTER (WHERE kind = 'method_definition') AS i, count(*) AS t FROM defs GROUP BY 1),
  m AS (SELECT package, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, i / t AS abstractness FROM k LEFT JOIN ca USING (package) LEFT JOIN ce USING (package))
  SELECT package, ca, ce, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0 END, 6) AS instability, round(abstractness, 6) AS abstractness, round(abs(abstractness + CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0 END - 1), 6) AS distance FROM m""")
def package_coupling(spark: SparkSession, d: str) -> DataFrame:
    defs = R.definitions(spark, d)
    # every part is a type here, and the methods stand for the interfaces among them
    kinds = defs.select("package", F.when(F.col("kind") == "method_definition", "interface_type_definition").otherwise("type_definition").alias("kind"))
    out = metrics.coupling(defs.select("package"), R.package_edges(spark, d), kinds)
    return out.select("package", "ca", "ce", *(F.round(c, 6).alias(c) for c in ("instability", "abstractness", "distance")))


@query(f"""WITH {R.IMPORTS}, x AS (SELECT DISTINCT repo AS f, split_part(import, '/', 1) AS t, file FROM i WHERE contains(import, '/') AND split_part(import, '/', 1) <> repo),
  r AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY file) AS k FROM x)
  SELECT f AS from_component, t AS to_component, count(*) AS links, list(file ORDER BY file) FILTER (WHERE k <= 3) AS samples FROM r GROUP BY 1, 2""")
def bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    i = R.current_imports(spark, d).where(F.col("import").contains("/"))
    e = i.select(F.col("repo").alias("from_component"), F.split_part("import", F.lit("/"), F.lit(1)).alias("to_component"), F.col("file").alias("sample")).distinct()
    return metrics.bridges(e)


@query(f"""WITH {R.IMPORTS}, m AS (SELECT DISTINCT repo AS module FROM snapshots) SELECT repo, module AS target, count(DISTINCT file) AS files, count(*) AS imports FROM i JOIN m ON i.import = module OR starts_with(i.import, module || '/') WHERE repo <> module GROUP BY 1, 2""")
def service_edges(spark: SparkSession, d: str) -> DataFrame:
    """Imports of other repositories: every prefix of an import is looked up among the modules, by equality."""
    i = R.current_imports(spark, d)
    parts = F.split("import", "/")
    prefixes = i.withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    modules = table(spark, d, "snapshots").select(F.col("repo").alias("module")).distinct()
    met = prefixes.join(modules, "module").where("module <> repo")
    return met.groupBy("repo", F.col("module").alias("target")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("imports"))


_TREND = ["cyclomatic", "cognitive", "functions"]


@query("""WITH x AS (SELECT measured_at::DATE AS day, function_id, max(cyclomatic) AS c, max(cognitive) AS g FROM function_metrics GROUP BY 1, 2), y AS (SELECT day, CAST(sum(c) AS BIGINT) AS cyclomatic, CAST(sum(g) AS BIGINT) AS cognitive, count(*) AS functions FROM x GROUP BY 1),
  u AS (UNPIVOT y ON cyclomatic, cognitive, functions INTO NAME metric VALUE v)
  SELECT metric, CAST(arg_min(v, day) AS DOUBLE) AS first, CAST(arg_max(v, day) AS DOUBLE) AS last, CAST(arg_max(v, day) - arg_min(v, day) AS DOUBLE) AS change, round((arg_max(v, day) - arg_min(v, day)) * 100.0 / arg_min(v, day), 6) AS percent FROM u GROUP BY 1""")
def trend_deltas(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "function_metrics").groupBy(F.to_date("measured_at").alias("day"), "function_id").agg(F.max("cyclomatic").alias("c"), F.max("cognitive").alias("g"))
    daily = per.groupBy("day").agg(F.sum("c").alias("cyclomatic"), F.sum("g").alias("cognitive"), F.count("*").alias("functions"))
    return metrics.trend(daily, "day", _TREND).withColumn("percent", F.round("percent", 6))


_OWNERS = [("aldermoor:internal", "core"), ("*.js", "web"), ("ledger", "money")]


@query(rf"""WITH {R.FUNCTIONS}, o AS (SELECT *, CASE WHEN regexp_matches(file, '(^|/)ledger(/|$)') THEN 'money' WHEN regexp_matches(file, '(^|/)[^/]*\.js(/|$)') THEN 'web' WHEN regexp_matches(file, '(^|/)aldermoor:internal(/|$)') THEN 'core' ELSE '(unowned)' END AS team FROM f)
  SELECT team, count(DISTINCT file) AS files, count(*) AS functions, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive FROM o GROUP BY 1""")
def team_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = R.functions(spark, d).withColumn("team", globs.owner("file", _OWNERS))
    return f.groupBy("team").agg(F.countDistinct("file").alias("files"), F.count("*").alias("functions"), F.max("cyclomatic").alias("max_cyclomatic"), F.max("cognitive").alias("max_cognitive"))


@query(f"""WITH {R.FUNCTIONS}, {R.SYMBOLS}, {R.FILES} SELECT (SELECT count(*) FROM cf) AS files, (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM f) AS functions, (SELECT max(cyclomatic) FROM f) AS max_cyclomatic,
  (SELECT round(avg(cyclomatic), 6) FROM f WHERE cyclomatic >= 0) AS avg_cyclomatic, (SELECT count(*) * 100 // (SELECT count(*) FROM cf) FROM cf WHERE gen_reason IS NOT NULL) AS generated_percent""")
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals: each part is one aggregate, and the three meet on a constant key."""
    one = F.lit(1).alias("_k")
    files = R.current_files(spark, d).groupBy(one).agg(F.count("*").alias("files"), F.expr("count(gen_reason) * 100 div count(*)").alias("generated_percent"))
    symbols = R.current_symbols(spark, d).groupBy(one).agg(F.count("*").alias("symbols"))
    fs = R.functions(spark, d).groupBy(one).agg(F.count("*").alias("functions"), F.max("cyclomatic").alias("max_cyclomatic"), F.round(F.avg(F.when(F.col("cyclomatic") >= 0, F.col("cyclomatic"))), 6).alias("avg_cyclomatic"))
    return files.join(symbols, "_k").join(fs, "_k").select("files", "symbols", "functions", "max_cyclomatic", "avg_cyclomatic", "generated_percent")


_COMPONENTS = f"""{R.FILES}, {R.IMPORTS}, ff AS (SELECT path, package, split_part(path, ':', 1) AS component FROM cf)"""


@query(f"""WITH {_COMPONENTS}, a AS (SELECT component, count(DISTINCT package) AS packages, count(DISTINCT path) AS files FROM ff GROUP BY 1),
  b AS (SELECT component, CAST(sum(CAST(starts_with(import, component || '/') AS INT)) AS BIGINT) AS internal_imports, CAST(sum(CAST(NOT starts_with(import, component || '/') AS INT)) AS BIGINT) AS external_imports FROM i JOIN ff ON ff.path = i.file GROUP BY 1)
  SELECT component, packages, files, coalesce(internal_imports, 0) AS internal_imports, coalesce(external_imports, 0) AS external_imports FROM a LEFT JOIN b USING (component)""")
def component_metrics(spark: SparkSession, d: str) -> DataFrame:
    repo = F.split_part("path", F.lit(":"), F.lit(1))
    f = R.current_files(spark, d).select("path", "package", repo.alias("component"))
    i = R.current_imports(spark, d).select("file", "import", F.col("import").startswith(F.concat("repo", F.lit("/"))).alias("internal"))
    return metrics.component_metrics(f, i)


@query(f"""WITH {R.IMPORTS}, c AS (SELECT repo AS component, import, count(*) AS n FROM i WHERE NOT starts_with(import, repo || '/') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, import) AS k FROM c)
  SELECT component, CAST(sum(n) AS BIGINT) AS external, list(import ORDER BY k) FILTER (WHERE k <= 3) AS top FROM r GROUP BY 1""")
def external_imports(spark: SparkSession, d: str) -> DataFrame:
    i = R.current_imports(spark, d).where(~F.col("import").startswith(F.concat("repo", F.lit("/"))))
    return metrics.external_tops(i.select(F.col("repo").alias("component"), "import"))


@query(rf"""WITH {R.IMPORTS}, e AS (SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS src, import AS dst, starts_with(import, repo || '/') AS internal FROM i)
  SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, count(*) AS edges, CAST(sum(CAST(internal AS INT)) AS BIGINT) AS internal_edges, count(*) - CAST(sum(CAST(internal AS INT)) AS BIGINT) AS external_edges FROM e""")
def dependency_report(spark: SparkSession, d: str) -> DataFrame:
    i = R.current_imports(spark, d)
    return metrics.dependency_report(i.select(text.dirname("file").alias("src"), F.col("import").alias("dst"), F.col("import").startswith(F.concat("repo", F.lit("/"))).alias("internal")))


# --- rules ---


@query(rf"""WITH {R.SYMBOLS} SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS package, 'package/exported_symbols' AS rule, count(*) AS value, CAST(5 AS BIGINT) AS threshold FROM s WHERE regexp_matches(name, '^\p{{Lu}}') GROUP BY 1 HAVING count(*) > 5""")
def package_rules(spark: SparkSession, d: str) -> DataFrame:
    p = R.current_symbols(spark, d).where(text.exported("name")).groupBy(text.dirname("file").alias("package")).agg(F.count("*").alias("exported_symbols"))
    return rules.package_rules(p, {"exported_symbols": 5})


_LIMITS = rules.THRESHOLDS


@query(f"WITH {R.FUNCTIONS}, u AS (" + " UNION ALL ".join(f"SELECT function_id, '{m}' AS metric, CAST({m} AS BIGINT) AS value, CAST({n} AS BIGINT) AS threshold FROM f" for m, n in _LIMITS.items()) + ") SELECT * FROM u WHERE value > threshold")
def threshold_lint(spark: SparkSession, d: str) -> DataFrame:
    return rules.violations(R.functions(spark, d), _LIMITS, ["function_id"])


@query(f"WITH {R.FUNCTIONS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({n} AS BIGINT) AS threshold, count(*) FILTER (WHERE {m} > {n}) AS failures, count(*) FILTER (WHERE {m} > {n}) = 0 AS passed FROM f" for m, n in rules.GATE.items()))
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return rules.gate(R.functions(spark, d), rules.GATE)


@query(f"""WITH {R.FUNCTIONS} SELECT function_id, 'god_function' AS smell, 'error' AS severity FROM f WHERE cyclomatic > 30 AND lines > 200 AND fan_out > 20 UNION ALL SELECT function_id, 'shotgun_surgery', 'warning' FROM f WHERE fan_in > 30
  UNION ALL SELECT function_id, 'long_params', 'warning' FROM f WHERE parameters > 5 UNION ALL SELECT function_id, 'deep_nesting', 'warning' FROM f WHERE max_nesting > 4""")
def function_smells(spark: SparkSession, d: str) -> DataFrame:
    return rules.function_smells(R.functions(spark, d), ["function_id"])


@query(rf"""WITH {R.SYMBOLS}, p AS (SELECT name, trim(regexp_replace(regexp_extract(signature, '(?s)\((.*)\)', 1), '\s+', ' ', 'g')) AS params FROM s WHERE kind IN ('function_definition', 'method_definition'))
  SELECT params, count(*) AS members, min(name) AS first_function FROM p WHERE params LIKE '%,%' GROUP BY 1 HAVING count(*) >= 3""")
def data_clumps(spark: SparkSession, d: str) -> DataFrame:
    return rules.data_clumps(R.current_symbols(spark, d).where(F.col("kind").isin("function_definition", "method_definition")))


@query(f"""WITH {R.PACKAGES_SQL}, c AS (SELECT e.src AS caller_id, p.package, q.package AS callee_package, CAST(sum(e.count) AS BIGINT) AS calls FROM e JOIN defs p ON p.id = e.src JOIN defs q ON q.id = e.dst GROUP BY 1, 2, 3)
  SELECT c.caller_id, c.package, c.callee_package AS target, c.calls, coalesce(o.calls, 0) AS own FROM c LEFT JOIN c o ON o.caller_id = c.caller_id AND o.callee_package = o.package WHERE c.package <> c.callee_package AND c.calls > coalesce(o.calls, 0)""")
def feature_envy(spark: SparkSession, d: str) -> DataFrame:
    defs = R.definitions(spark, d).select("id", "package")
    e = R.edges(spark, d).join(defs.withColumnRenamed("id", "src"), "src").join(defs.select(F.col("id").alias("dst"), F.col("package").alias("callee_package")), "dst")
    return rules.feature_envy(e.select(F.col("src").alias("caller_id"), "package", "callee_package", "count"))


@query(f"""WITH {R.DEFINITIONS}, {R.EDGES_SQL}, o AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), ce AS (SELECT src AS p, count(*) AS n FROM o GROUP BY 1), ca AS (SELECT dst AS p, count(*) AS n FROM o GROUP BY 1),
  x AS (SELECT id, coalesce(ce.n, 0) / nullif(coalesce(ce.n, 0) + coalesce(ca.n, 0), 0) AS i FROM defs LEFT JOIN ce ON ce.p = id LEFT JOIN ca ON ca.p = id)
  SELECT src, dst FROM o JOIN x a ON a.id = src JOIN x b ON b.id = dst WHERE a.i < 0.4 AND b.i > 0.6""")
def unstable_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Every definition as a package of its own, for the packages call each other too evenly; limits 0.4 and 0.6."""
    edges = R.edges(spark, d)
    defs = R.definitions(spark, d).select(F.col("id").alias("package"), "kind")
    return rules.unstable_dependencies(edges, metrics.coupling(defs.select("package"), edges, defs), 0.4, 0.6)


_BOUNDARIES = "module Brand#1\n  deny Brand#2\n  deny Brand#3\nmodule Brand#4\n  allow Brand#4\n  allow Brand#5\n"


@query(f"""WITH {R.PACKAGES_SQL}, o AS (SELECT DISTINCT src, dst FROM pe WHERE src <> dst)
  SELECT src, dst, 0 AS rule, 'deny' AS type FROM o WHERE src = 'Brand#1' AND dst = 'Brand#2' UNION ALL SELECT src, dst, 1, 'deny' FROM o WHERE src = 'Brand#1' AND dst = 'Brand#3'
  UNION ALL SELECT src, dst, 2, 'allow' FROM o WHERE src = 'Brand#4' AND dst <> 'Brand#4' UNION ALL SELECT src, dst, 3, 'allow' FROM o WHERE src = 'Brand#4' AND dst <> 'Brand#5'""")
def boundary_check(spark: SparkSession, d: str) -> DataFrame:
    parsed = rules.parse_boundaries(_BOUNDARIES.replace("#", "\x00"))
    return rules.boundary_violations(R.package_edges(spark, d), [(n, m.replace("\x00", "#"), k, t.replace("\x00", "#")) for n, m, k, t in parsed])


_API_RULES = [("logging", "", "io", "high", False, "log"), ("queue_use", "", "io", "high", False, "queue.store queue.flush queue.load"), ("log_and_fold", "", "mix", "low", True, "log window.fold")]


@query(r"""WITH c AS (SELECT DISTINCT file, unnest(regexp_extract_all(body, '([A-Za-z_.]+)\s*\(', 1)) AS name FROM prints),
  a AS (SELECT * FROM (VALUES ('logging', 'io', 'log', 1), ('queue_use', 'io', 'queue.store', 1), ('queue_use', 'io', 'queue.flush', 1), ('queue_use', 'io', 'queue.load', 1), ('log_and_fold', 'mix', 'log', 2), ('log_and_fold', 'mix', 'window.fold', 2)) t(capability, category, name, needed))
  SELECT file, capability, category, list(name ORDER BY name) AS matched FROM c JOIN a USING (name) GROUP BY file, capability, category HAVING count(*) >= max(needed)""")
def capability_scan(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_.]+)\s*\("), F.lit(1))))
    calls = table(spark, d, "prints").select("file", names.alias("name"))
    return rules.capabilities(calls, ["file"], _API_RULES).select("file", "capability", "category", "matched")


@query(r"""WITH t AS (SELECT path, any_value(content) AS content FROM sources GROUP BY path), l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t)
  SELECT path, CAST(line AS INT) AS line, 'mit' AS rule FROM l WHERE regexp_matches(x, '(?i)\bMIT licen[cs]e\b') UNION ALL SELECT path, CAST(line AS INT), 'all_rights' FROM l WHERE regexp_matches(x, '(?i)all rights reserved')
  UNION ALL SELECT path, CAST(line AS INT), 'spdx' FROM l WHERE regexp_matches(x, 'SPDX-License-Identifier:\s*(\S+)') UNION ALL SELECT path, CAST(line AS INT), 'apache' FROM l WHERE regexp_matches(x, '(?i)apache licen[cs]e')""")
def licence_lines(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    return rules.pattern_lines(once, "path", "content", rules.LICENCES)


@query(r"""WITH t AS (SELECT path, any_value(content) AS content FROM sources GROUP BY path), l AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM t)
  SELECT path, CAST(line AS INT) AS line, 'assigned_secret' AS rule FROM l WHERE regexp_matches(x, '(?i)\b(password|passwd|secret|api[_-]?key|token)\b\s*[:=]+\s*["''][^"'']{4,}["'']') UNION ALL SELECT path, CAST(line AS INT), 'private_key' FROM l WHERE regexp_matches(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
  UNION ALL SELECT path, CAST(line AS INT), 'access_key' FROM l WHERE regexp_matches(x, '\bAKIA[0-9A-Z]{16}\b')""")
def secret_lines(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    return rules.pattern_lines(once, "path", "content", rules.SECRETS)


# --- texts ---


@query(r"""WITH b AS (SELECT DISTINCT print_id, sha256(trim(regexp_replace(regexp_replace(body, '0x[0-9a-fA-F]+', 'ADDR', 'g'), '\s+', ' ', 'g'))) AS digest FROM prints WHERE body IS NOT NULL) SELECT digest, count(*) AS members, min(print_id) AS first_key FROM b GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_groups(table(spark, d, "prints"), "print_id", "body")


@query(r"""WITH b AS (SELECT print_id, trim(regexp_replace(regexp_replace(body, '0x[0-9a-fA-F]+', 'ADDR', 'g'), '\s+', ' ', 'g')) AS t FROM prints WHERE body IS NOT NULL), u AS (SELECT t, min(print_id) AS id FROM b GROUP BY 1),
  w AS (SELECT id, string_split(t, ' ') AS w FROM u), g AS (SELECT DISTINCT id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM w)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
  c AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM g p JOIN g q ON p.x = q.x AND p.id < q.id GROUP BY 1, 2) SELECT a, b, round(c / (m.n + k.n - c), 6) AS score FROM c JOIN n m ON m.id = a JOIN n k ON k.id = b WHERE c >= 0.8 * (m.n + k.n - c)""")
def similar_bodies(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar(table(spark, d, "prints"), "print_id", "body", 0.8).withColumn("score", F.round("score", 6))


@query()
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return cut.line_chunks(table(spark, d, "documents"), "doc_id", "text", 100)


@query(r"""WITH t AS (SELECT path, split_part(path, ':', 1) AS repo, CAST(ceil(strlen(regexp_replace(max(content), '^\s+|\s+$', '', 'g')) / 4) AS BIGINT) AS cost FROM sources GROUP BY 1), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM t)
  SELECT repo, path, cost, used FROM r WHERE used <= 4000""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(text.token_estimate(F.max("content")).alias("cost")).withColumn("repo", F.split_part("path", F.lit(":"), F.lit(1)))
    return metrics.packed(once, ["repo"], ["path"], "cost", 4000).select("repo", "path", "cost", "used")


@query(rf"""WITH {R.SYMBOLS}, x AS (SELECT file, name, trim(regexp_extract(signature, '(?s)\((.*)\)', 1)) AS p FROM s WHERE kind = 'function_definition') SELECT file, name, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, ',')) END::INT AS parameters, regexp_matches(name, '^\p{{Lu}}') AS exported FROM x""")
def signature_facts(spark: SparkSession, d: str) -> DataFrame:
    s = R.current_symbols(spark, d).where("kind = 'function_definition'")
    return s.select("file", "name", text.parameter_count("signature").alias("parameters"), text.exported("name").alias("exported"))


_TESTS = " ".join(f"WHEN language = '{k}' THEN regexp_matches(lower(path), '{v}')" for k, v in fixed.TEST_FILES.items() if k != "any")


@query(f"""WITH {R.FILES} SELECT package, count(*) AS files, count(*) FILTER (WHERE CASE {_TESTS} ELSE regexp_matches(lower(path), '{fixed.TEST_FILES["any"]}') END) AS tests FROM cf GROUP BY 1""")
def test_file_rates(spark: SparkSession, d: str) -> DataFrame:
    return R.current_files(spark, d).groupBy("package").agg(F.count("*").alias("files"), F.sum(text.is_test_file("path", "language").cast("bigint")).alias("tests"))


@query()
def structural_matches(spark: SparkSession, d: str) -> DataFrame:
    """Guarded returns in any language of braces, with what is compared and returned."""
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    return structural.structural_grep(once, "if $A > $B { return $$$R }", where={"B": r"^\d+$"}).select("path", "line", "captures")


@query()
def tree_matches(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    return structural.tree_query(once, "(Raise exc: (Call func: (Name) @kind) @raised)")


@query()
def extracted_index(spark: SparkSession, d: str) -> DataFrame:
    """Symbols read from the texts themselves, by language and kind."""
    found = extract.extracted(table(spark, d, "sources"))
    return found.select("language", F.explode("symbols").alias("s")).groupBy("language", "s.kind").agg(F.count("*").alias("symbols"), F.sum("s.cyclomatic").alias("cyclomatic"))


@query()
def source_call_graph(spark: SparkSession, d: str) -> DataFrame:
    """The call graph of the texts: extraction, enclosing spans, tiers, edges."""
    found = materialise(extract.extracted(table(spark, d, "sources")), "extracted")
    edges = Engine(spark, extract.index_tables(found)).edges()
    return edges.groupBy("resolution").agg(F.count("*").alias("edges"), F.sum("count").alias("calls"))


@query()
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    found = materialise(extract.extracted(once), "extracted")
    return cut.symbol_chunks(once, extract.index_tables(found)["symbols"], 100).select("path", "kind", "name", "start_line", "end_line", "tokens")


@query()
def type_shapes(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    return scopes.type_shapes(once)


@query()
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Names of Python files, resolved through their scopes: how many by kind of definition."""
    once = table(spark, d, "sources").groupBy("path").agg(F.max("content").alias("content"))
    t = scopes.scope_tables(once)
    found = lookup.resolve_in_scopes(t["refs"], t["scopes"], t["defs"]).join(t["defs"].select("def_id", "kind"), "def_id", "left")
    return found.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("refs"))


# --- differences ---


@query(r"""WITH w AS (SELECT snapshot_id, file, kind, coalesce(receiver, '') AS receiver, name, max(struct_pack(a := loaded_at, s := coalesce(signature, ''), b := start_line, e := end_line)) AS v FROM symbols WHERE snapshot_id IN (1, 4) GROUP BY ALL),
  b AS (SELECT * FROM w WHERE snapshot_id = 1), a AS (SELECT * FROM w WHERE snapshot_id = 4)
  SELECT coalesce(a.file, b.file) AS file, coalesce(a.kind, b.kind) AS kind, coalesce(a.receiver, b.receiver) AS receiver, coalesce(a.name, b.name) AS name,
    CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' ELSE 'modified' END AS change, b.v.s AS old_signature, a.v.s AS new_signature
  FROM b FULL OUTER JOIN a ON a.file = b.file AND a.kind = b.kind AND a.receiver = b.receiver AND a.name = b.name WHERE b.file IS NULL OR a.file IS NULL OR a.v.s <> b.v.s""")
def symbol_diff(spark: SparkSession, d: str) -> DataFrame:
    """Any two snapshots: the first and the last one."""
    s = snapshots.symbols_of(table(spark, d, "symbols")).drop("scope")
    keys = ["file", "kind", "receiver", "name"]
    return diff.table_diff(s.where("snapshot_id = 1"), s.where("snapshot_id = 4"), keys, ["signature"])


@query(r"""WITH i AS (SELECT DISTINCT snapshot_id, file, regexp_replace(import_path, '^\s+|\s+$', '', 'g') AS import FROM imports WHERE regexp_replace(import_path, '^\s+|\s+$', '', 'g') <> '')
  SELECT file, import, 'added' AS change FROM (SELECT file, import FROM i WHERE snapshot_id = 4 EXCEPT SELECT file, import FROM i WHERE snapshot_id = 1) UNION ALL SELECT file, import, 'removed' FROM (SELECT file, import FROM i WHERE snapshot_id = 1 EXCEPT SELECT file, import FROM i WHERE snapshot_id = 4)""")
def import_diff(spark: SparkSession, d: str) -> DataFrame:
    i = snapshots.imports_of(table(spark, d, "imports")).withColumnRenamed("name", "import")
    return diff.set_diff(i.where("snapshot_id = 1"), i.where("snapshot_id = 4"), ["file", "import"])
