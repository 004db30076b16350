"""Registered queries over call and package graphs, spans and event streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, xref
from tessera.plans import relations as R
from tessera.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ENCLOSED = f"""{R.SPANS_SQL}, c AS (SELECT r.ref_id, s.id, s.start, s.stop, row_number() OVER (PARTITION BY r.ref_id ORDER BY s.stop - s.start, s.start DESC, s.id) AS k FROM refs r JOIN spans s ON s.file = r.file AND r.line BETWEEN s.start AND s.stop)"""


@query(f"WITH {_ENCLOSED} SELECT r.ref_id, c.id AS span_id, c.start AS span_start, c.stop AS span_end FROM refs r LEFT JOIN c ON c.ref_id = r.ref_id AND c.k = 1")
def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    refs, spans = R.span_events(spark, d)
    return xref.enclosing(refs, spans).select("ref_id", "span_id", "span_start", "span_end")


@query(f"""WITH {R.SPANS_SQL}, c AS (SELECT r.ref_id, min(s.id) AS inside FROM refs r JOIN spans s ON s.file = r.file AND r.line BETWEEN s.start AND s.stop GROUP BY 1), f AS (SELECT file, min(id) AS first FROM spans GROUP BY 1)
  SELECT r.ref_id, coalesce(c.inside, f.first) AS span_id FROM refs r LEFT JOIN c USING (ref_id) LEFT JOIN f USING (file)""")
def first_containing_span(spark: SparkSession, d: str) -> DataFrame:
    refs, spans = R.span_events(spark, d)
    return xref.first_containing(refs, spans).select("ref_id", "span_id")


@query(f"WITH {R.CALLS_SQL} SELECT file, package, name, tier, n, one, methods FROM res")
def tiered_resolution(spark: SparkSession, d: str) -> DataFrame:
    return xref.resolve(*R.calls(spark, d))


_EDGES_SQL = f"""{R.CALLS_SQL}, linked AS (SELECT r.caller_id, k.id AS callee_id, CASE WHEN res.n = 1 THEN res.tier ELSE 'poly_' || res.tier END AS resolution,
    list_position(['file', 'poly_file', 'import', 'poly_import', 'package', 'poly_package', 'global', 'poly_global'], CASE WHEN res.n = 1 THEN res.tier ELSE 'poly_' || res.tier END) AS o
    FROM refs r JOIN res ON res.file = r.file AND res.package = r.package AND res.name = r.name JOIN kept k ON k.file = r.file AND k.package = r.package AND k.name = r.name WHERE res.n = 1 OR res.methods),
  edges AS (SELECT caller_id, callee_id, arg_min(resolution, o) AS resolution, count(*) AS count FROM linked GROUP BY 1, 2)"""


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return xref.call_edges(*R.calls(spark, d)).select("caller_id", "callee_id", "resolution", "count")


@query(f"WITH {R.CALLS_SQL} SELECT CASE WHEN res.n IS NULL THEN 'no_definition' ELSE 'ambiguous_' || res.tier END AS reason, res.n AS candidates, count(*) AS refs FROM refs LEFT JOIN res USING (file, package, name) WHERE res.n IS NULL OR (res.n > 1 AND NOT res.methods) GROUP BY 1, 2")
def unresolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return xref.unresolved(*R.calls(spark, d)).groupBy("reason", "candidates").agg(F.count("*").alias("refs"))


@query(f"WITH {_EDGES_SQL}, a AS (SELECT callee_id AS id, CAST(sum(count) AS BIGINT) AS fan_in FROM edges GROUP BY 1), b AS (SELECT caller_id AS id, CAST(sum(count) AS BIGINT) AS fan_out FROM edges GROUP BY 1) SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM a FULL OUTER JOIN b USING (id)")
def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    return xref.fan(xref.call_edges(*R.calls(spark, d)))


@query(f"WITH {R.DEFINITIONS}, {R.EDGES_SQL} SELECT id, file, name FROM defs WHERE id NOT IN (SELECT dst FROM e) AND name NOT IN ('main', 'init')")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d).withColumnRenamed("dst", "callee_id")
    return xref.dead(R.definitions(spark, d), e).select("id", "file", "name")


def _bfs(roots: str, depth: int, a: str = "src", b: str = "dst") -> str:
    return f"w AS (SELECT id, 0 AS dist FROM ({roots}) UNION SELECT e.{b}, w.dist + 1 FROM w JOIN e ON e.{a} = w.id WHERE w.dist < {depth}), n AS (SELECT id, min(dist) AS dist FROM w GROUP BY 1)"


_ROOTS = "SELECT id FROM defs WHERE name LIKE 'red %'"


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return R.definitions(spark, d).where("name LIKE 'red %'").select("id")


@query(f"WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, {_bfs(_ROOTS, 2)} SELECT e.src, e.dst, e.count FROM e JOIN n ON n.id = e.src WHERE n.dist < 2")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d)
    return graph.walk_edges(e, graph.distances(e, _roots(spark, d), 2), 2).select("src", "dst", "count")


@query(f"WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, {_bfs(_ROOTS, 2, 'dst', 'src')} SELECT e.src, e.dst, e.count FROM e JOIN n ON n.id = e.dst WHERE n.dist < 2")
def walk_reverse(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d)
    return graph.walk_edges(e, graph.distances(e, _roots(spark, d), 2, reverse=True), 2, reverse=True).select("src", "dst", "count")


@query(f"WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, {_bfs(_ROOTS, 10, 'dst', 'src')} SELECT id, dist, round(1.0 / (dist + 1), 6) AS risk FROM n WHERE dist > 0")
def impact_distance(spark: SparkSession, d: str) -> DataFrame:
    n = graph.distances(R.edges(spark, d), _roots(spark, d), 10, reverse=True).where("dist > 0")
    return n.select("id", "dist", F.round(F.lit(1.0) / (F.col("dist") + 1), 6).alias("risk"))


@query(f"""WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, w AS (SELECT id AS test, id, 0 AS dist FROM ({_ROOTS}) UNION SELECT w.test, e.dst, w.dist + 1 FROM w JOIN e ON e.src = w.id WHERE w.dist < 3),
  m AS (SELECT test, id, min(dist) AS dist FROM w GROUP BY 1, 2), c AS (SELECT id, min(dist) AS dist FROM m WHERE dist > 0 GROUP BY 1)
  SELECT defs.id, CASE WHEN c.dist = 1 THEN 'tested' WHEN c.dist > 1 THEN 'indirectly_tested' ELSE 'untested' END AS coverage FROM defs LEFT JOIN c USING (id) WHERE defs.name NOT LIKE 'red %'""")
def test_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Walks from every test of its own, three calls deep; a function is tested at distance 1, indirectly beyond."""
    tests = _roots(spark, d).withColumn("test", F.col("id"))
    m = graph.distances(R.edges(spark, d), tests, 3, keys=("test",)).where("dist > 0")
    best = m.groupBy("id").agg(F.min("dist").alias("dist"))
    state = F.when(F.col("dist") == 1, "tested").when(F.col("dist") > 1, "indirectly_tested").otherwise("untested")
    return R.definitions(spark, d).where("name NOT LIKE 'red %'").join(best, "id", "left").select("id", state.alias("coverage"))


@query(f"""WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, w AS (SELECT id AS root, id, 0 AS k FROM ({_ROOTS}) UNION SELECT w.root, e.dst, w.k + 1 FROM w JOIN e ON e.src = w.id WHERE w.k < 3)
  SELECT root, w.id AS target, CAST(min(k) + 1 AS BIGINT) AS steps FROM w JOIN defs ON defs.id = w.id AND defs.name LIKE '% ring' WHERE root <> w.id GROUP BY 1, 2""")
def reach_targets(spark: SparkSession, d: str) -> DataFrame:
    """From each root the capabilities it reaches, with the length of a shortest call path."""
    targets = R.definitions(spark, d).where("name LIKE '% ring'").select("id")
    found = graph.reach_paths(R.edges(spark, d), _roots(spark, d), targets, 3)
    return found.select("root", "target", F.size("path").cast("bigint").alias("steps"))


_LCOM_EDGES = "pe2 AS (SELECT e.src, e.dst, p.package FROM e JOIN defs p ON p.id = e.src JOIN defs q ON q.id = e.dst AND q.package = p.package)"


@query(f"""WITH RECURSIVE {R.DEFINITIONS}, {R.EDGES_SQL}, {_LCOM_EDGES}, u AS (SELECT src AS a, dst AS b FROM pe2 UNION SELECT dst, src FROM pe2), r AS (SELECT id AS v, id AS g FROM defs UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.v),
  c AS (SELECT v, min(g) AS g FROM r GROUP BY 1) SELECT package, count(DISTINCT g) AS lcom, count(*) AS functions FROM c JOIN defs ON defs.id = c.v GROUP BY 1""")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the calls within each package; functions without such calls count."""
    defs = R.definitions(spark, d).select("id", "package")
    e = R.edges(spark, d).join(defs.select(F.col("id").alias("src"), F.col("package").alias("p")), "src").join(defs.select(F.col("id").alias("dst"), F.col("package").alias("q")), "dst").where("p = q")
    c = graph.components(e.select("src", "dst"), defs.select("id"))
    return c.join(defs, "id").groupBy("package").agg(F.countDistinct("component").alias("lcom"), F.count("*").alias("functions"))


@query(f"""WITH {R.PACKAGES_SQL}, o AS (SELECT DISTINCT src, dst FROM pe WHERE src <> dst)
  SELECT [a.src, a.dst] AS cycle, 2 AS length FROM o a JOIN o b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
  UNION ALL SELECT [a.src, a.dst, b.dst], 3 FROM o a JOIN o b ON b.src = a.dst JOIN o c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(R.package_edges(spark, d), 3)


@query(f"""WITH RECURSIVE {R.PACKAGES_SQL}, o AS (SELECT DISTINCT src, dst FROM pe WHERE src <> dst), r AS (SELECT src, dst FROM o UNION SELECT r.src, o.dst FROM r JOIN o ON o.src = r.dst)
  SELECT a.src AS id, min(a.dst) AS component, count(*) AS size FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY 1""")
def import_cycle_members(spark: SparkSession, d: str) -> DataFrame:
    """Every package on an import cycle of any length; `import_cycles` prints the cycles of two and three of them."""
    return graph.on_cycles(R.package_edges(spark, d))


@query(f"""WITH RECURSIVE {R.EDGES_SQL}, q AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e), w AS (SELECT DISTINCT src AS id, 0 AS depth FROM q WHERE src NOT IN (SELECT dst FROM q) UNION SELECT q.dst, w.depth + 1 FROM w JOIN q ON q.src = w.id) SELECT id, max(depth) AS depth FROM w GROUP BY 1""")
def import_depth(spark: SparkSession, d: str) -> DataFrame:
    """Longest chains, every call read as a dependency of the later definition on the earlier one: no edge is dropped, and
    no cycle can come about."""
    e = R.edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return graph.depths(e)


@query(f"WITH {R.EDGES_SQL}, d AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1) SELECT 'out' AS way, id, k AS degree FROM (SELECT * FROM d ORDER BY k DESC, id LIMIT 10) UNION ALL SELECT 'in', id, k FROM (SELECT * FROM i ORDER BY k DESC, id LIMIT 10)")
def dependency_tops(spark: SparkSession, d: str) -> DataFrame:
    e = R.edges(spark, d)
    parts = [metrics.top(e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("degree")), [F.desc("degree"), F.asc("id")], 10).select(F.lit(w).alias("way"), "id", "degree") for w, c in (("out", "src"), ("in", "dst"))]
    return parts[0].unionByName(parts[1])


@query("""WITH {a}, {b}, x AS (SELECT DISTINCT a, b FROM h1 WHERE a <> b), y AS (SELECT DISTINCT a, b FROM h2 WHERE a <> b)
  SELECT a AS src, b AS dst, 'added' AS change FROM (SELECT * FROM y EXCEPT SELECT * FROM x) UNION ALL SELECT a, b, 'removed' FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""".format(a=R.hops_sql("1995-04-01").replace("hops AS", "h1 AS", 1), b=R.hops_sql("1995-07-01").replace("hops AS", "h2 AS", 1)))
def architecture_drift(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.diff import set_diff

    side = lambda t: R.hops(spark, d, t).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return set_diff(side("1995-04-01"), side("1995-07-01"), ["src", "dst"])


# --- events ---


@query("""WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS changes, count(DISTINCT event_type) AS kinds FROM n GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Changes within half an hour of each other are one batch, per user."""
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("changes"), F.countDistinct("event_type").alias("kinds"))
    return e.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "changes", "kinds")


@query("SELECT user_id AS path, r.event_type AS state, r.event_id AS last_event FROM (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS r FROM events GROUP BY 1)")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    """Last writer wins, per key: a fold of the change stream."""
    r = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r"))
    return r.select(F.col("user_id").alias("path"), F.col("r.event_type").alias("state"), F.col("r.event_id").alias("last_event"))


@query("SELECT user_id AS file, count(*) AS commits, count(DISTINCT event_type) AS authors, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def churn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("commits"), F.countDistinct("event_type").alias("authors"), F.min("ts").alias("first"), F.max("ts").alias("last"))
