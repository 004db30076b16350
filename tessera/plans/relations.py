"""The relations the registered queries run over, as DataFrames and as the same SQL.

The tables hold an index (files, symbols, imports, metrics) but no references between symbols. Call graphs are therefore
projected from the order tables: a part as one supplier has it is a definition, successive ones of an order are a call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import snapshots
from tessera.sources.tables import clean_path, table

METRICS = ["file", "package", "name", "kind", "language", "start_line", "end_line", "lines", "cyclomatic", "cognitive", "max_nesting", "parameters", "fan_in", "fan_out", "return_count", "bool_depth", "risk"]


def functions(spark: SparkSession, d: str) -> DataFrame:
    """The last measurement of each function."""
    rows = table(spark, d, "function_metrics").groupBy("function_id").agg(F.max(F.struct("measured_at", "loaded_at", *METRICS)).alias("r"))
    return rows.select("function_id", *(F.col(f"r.{m}").alias(m) for m in METRICS))


FUNCTIONS = "f AS (SELECT function_id, " + ", ".join(f"r.{m} AS {m}" for m in METRICS) + " FROM (SELECT function_id, max(struct_pack(measured_at := measured_at, loaded_at := loaded_at, " + ", ".join(f"{m} := {m}" for m in METRICS) + ")) AS r FROM function_metrics GROUP BY 1))"


def current_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each repository's last complete delivery."""
    last = snapshots.complete_deliveries(table(spark, d, "snapshots")).groupBy("repo").agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = snapshots.symbols_of(table(spark, d, "symbols")).withColumnRenamed("scope", "repo")
    return rows.join(last, ["repo", "snapshot_id"])


SYMBOLS = """last_ AS (SELECT repo, max(snapshot_id) AS snapshot_id FROM snapshots WHERE complete GROUP BY 1),
  s AS (SELECT repo, snapshot_id, file, kind, receiver, name, v.s AS signature, v.b AS start_line, v.e AS end_line FROM (
    SELECT repo, snapshot_id, file, kind, coalesce(receiver, '') AS receiver, name,
           max(struct_pack(a := loaded_at, s := coalesce(signature, ''), b := start_line, e := end_line)) AS v
    FROM symbols GROUP BY ALL) JOIN last_ USING (repo, snapshot_id))"""


def current_imports(spark: SparkSession, d: str) -> DataFrame:
    last = snapshots.complete_deliveries(table(spark, d, "snapshots")).groupBy("repo").agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = snapshots.imports_of(table(spark, d, "imports")).select("snapshot_id", F.col("scope").alias("repo"), "file", F.col("name").alias("import"))
    return rows.join(last, ["repo", "snapshot_id"])


IMPORTS = r"""lasti AS (SELECT repo, max(snapshot_id) AS snapshot_id FROM snapshots WHERE complete GROUP BY 1),
  i AS (SELECT DISTINCT repo, snapshot_id, file, regexp_replace(import_path, '^\s+|\s+$', '', 'g') AS import FROM imports
    JOIN lasti USING (repo, snapshot_id) WHERE regexp_replace(import_path, '^\s+|\s+$', '', 'g') <> '')"""


def current_files(spark: SparkSession, d: str) -> DataFrame:
    """The last listing of each path over all scans."""
    cols = ["package", "language", "size_bytes", "mtime_ns", "gen_generator", "gen_reason", "gen_marker"]
    rows = table(spark, d, "files").where("path IS NOT NULL").groupBy(clean_path("path").alias("path")).agg(F.max(F.struct("scan_id", "listed_at", *cols)).alias("r"))
    return rows.select("path", *(F.lower(F.col(f"r.{c}")).alias(c) if c == "language" else F.col(f"r.{c}").alias(c) for c in cols))


FILES = r"""cf AS (SELECT path, r.package AS package, lower(r.language) AS language, r.size_bytes AS size_bytes, r.mtime_ns AS mtime_ns,
    r.gen_generator AS gen_generator, r.gen_reason AS gen_reason, r.gen_marker AS gen_marker FROM (
    SELECT regexp_replace(path, '^(\./)+', '') AS path, arg_max(struct_pack(package := package, language := language, size_bytes := size_bytes,
      mtime_ns := mtime_ns, gen_generator := gen_generator, gen_reason := gen_reason, gen_marker := gen_marker),
      struct_pack(scan_id := scan_id, listed_at := listed_at)) AS r FROM files WHERE path IS NOT NULL GROUP BY 1))"""


#: A definition is a part as one supplier has it; the number of its row in both columns.
_ID = "l_partkey * 1000000 + l_suppkey"


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Parts by supplier as definitions: id, file, package, name, kind, receiver, start_line."""
    kind = F.when(F.col("p_size") <= 25, "function_definition").otherwise("method_definition")
    offers = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.expr(_ID).alias("id")).distinct()
    p = offers.join(table(spark, d, "part"), "p_partkey").select("id", F.concat_ws("/", "p_brand", F.col("l_suppkey").cast("string")).alias("file"), F.col("p_brand").alias("package"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_type").alias("_t"), F.col("p_size").alias("start_line"))
    return p.withColumn("receiver", F.when(F.col("kind") == "method_definition", F.col("_t")).otherwise("")).drop("_t")


DEFINITIONS = f"""defs AS (SELECT id, p_brand || '/' || l_suppkey AS file, p_brand AS package, p_name AS name, CASE WHEN p_size <= 25 THEN 'function_definition' ELSE 'method_definition' END AS kind,
    CASE WHEN p_size <= 25 THEN '' ELSE p_type END AS receiver, p_size AS start_line FROM (SELECT DISTINCT l_partkey, l_suppkey, {_ID} AS id FROM lineitem) JOIN part ON p_partkey = l_partkey)"""


def hops(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    """a, b: successive different offers of an order, with the return flag of the first; of the lines before a date for the
    drift between two states of the tables."""
    rows = table(spark, d, "lineitem")
    if before:
        rows = rows.where(F.col("l_shipdate") < F.lit(before).cast("timestamp"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return rows.select(F.expr(_ID).alias("a"), F.lead(F.expr(_ID)).over(w).alias("b"), F.col("l_returnflag").alias("flag")).where("b IS NOT NULL AND a <> b")


def hops_sql(before: str | None = None) -> str:
    return f"""hops AS (SELECT a, b, flag FROM (SELECT {_ID} AS a, lead({_ID}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS b,
    l_returnflag AS flag FROM lineitem {f"WHERE l_shipdate < TIMESTAMP '{before}'" if before else ''}) WHERE b IS NOT NULL AND a <> b)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, count: the calls between definitions, of all lines."""
    return hops(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("count"))


EDGES_SQL = hops_sql() + ", e AS (SELECT a AS src, b AS dst, count(*) AS count FROM hops GROUP BY 1, 2)"


def package_edges(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d).select("id", "package")
    e = edges(spark, d)
    return e.join(defs.select(F.col("id").alias("src"), F.col("package").alias("p")), "src").join(defs.select(F.col("id").alias("dst"), F.col("package").alias("q")), "dst").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.sum("count").alias("count"))


PACKAGES_SQL = f"{DEFINITIONS}, {EDGES_SQL}, pe AS (SELECT p.package AS src, q.package AS dst, CAST(sum(count) AS BIGINT) AS count FROM e JOIN defs p ON p.id = e.src JOIN defs q ON q.id = e.dst GROUP BY 1, 2)"


def calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """refs (file, package, name, caller_id), definitions, imports (file, package): names of successive offers as calls."""
    defs = definitions(spark, d)
    by_id = defs.select("id", "file", "package", "name")
    h = hops(spark, d)
    refs = h.join(by_id.select(F.col("id").alias("a"), "file", "package"), "a").join(by_id.select(F.col("id").alias("b"), "name"), "b").select("file", "package", "name", F.col("a").alias("caller_id"))
    back = h.where("flag = 'R'")
    imports = back.join(by_id.select(F.col("id").alias("a"), "file"), "a").join(by_id.select(F.col("id").alias("b"), F.col("package")), "b").select("file", "package").distinct()
    return refs, defs, imports


CALLS_SQL = f"""{DEFINITIONS}, {hops_sql()},
  refs AS (SELECT x.file, x.package, y.name, a AS caller_id FROM hops JOIN defs x ON x.id = a JOIN defs y ON y.id = b),
  imps AS (SELECT DISTINCT x.file, y.package FROM hops JOIN defs x ON x.id = a JOIN defs y ON y.id = b WHERE flag = 'R'),
  keys AS (SELECT DISTINCT file, package, name FROM refs),
  cand AS (SELECT k.*, CASE WHEN d.file = k.file THEN 1 WHEN i.package IS NOT NULL THEN 2 WHEN d.package = k.package THEN 3 ELSE 4 END AS t, d.id, d.kind, d.receiver
    FROM keys k JOIN defs d ON d.name = k.name LEFT JOIN imps i ON i.file = k.file AND i.package = d.package),
  best AS (SELECT file, package, name, min(t) AS tier FROM cand GROUP BY ALL),
  kept AS (SELECT c.* FROM cand c JOIN best b ON c.file = b.file AND c.package = b.package AND c.name = b.name AND c.t = b.tier),
  res AS (SELECT b.file, b.package, b.name, (['file', 'import', 'package', 'global'])[b.tier] AS tier, count(*) AS n, min(k.id) AS one, bool_and(k.kind = 'method_definition' AND k.receiver <> '') AS methods
    FROM best b JOIN kept k ON k.file = b.file AND k.package = b.package AND k.name = b.name GROUP BY ALL)"""


def span_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(refs: ref_id, file, line) clicks and (spans: file, id, start, end, ord) errors of a user, in minutes."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("line"), "event_type", "value")
    refs = e.where("event_type = 'click'").select(F.col("event_id").alias("ref_id"), "file", "line")
    spans = e.where("event_type = 'error'").select("file", F.col("event_id").alias("id"), F.col("line").alias("start"), (F.col("line") + F.floor(F.col("value") * 20)).alias("end"), F.col("event_id").alias("ord"))
    return refs, spans


SPANS_SQL = """ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS file, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS line, event_type, value FROM events),
  refs AS (SELECT event_id AS ref_id, file, line FROM ev WHERE event_type = 'click'),
  spans AS (SELECT file, event_id AS id, line AS start, line + CAST(floor(value * 20) AS BIGINT) AS stop FROM ev WHERE event_type = 'error')"""
