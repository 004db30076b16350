"""Registered queries over full snapshots and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental, snapshots
from tessera.session import materialise
from tessera.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    found = snapshots.all_changes(spark, t("symbols"), t("imports"), t("snapshots"))
    return found.select(F.col("version_id").alias("snapshot_id"), "file", "kind", "receiver", "name", "change")


def p1_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts per snapshot and package, beside the published ones and whether those hold."""
    found = p1_found(spark, d)
    count = lambda c: F.sum((F.col("change") == c).cast("bigint")).alias(f"{c}_symbols")
    package = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    own = found.withColumn("package", package).groupBy("snapshot_id", "package").agg(
        *(F.sum(((F.col("kind") != "import") & (F.col("change") == c)).cast("bigint")).alias(f"{c}_symbols") for c in ("added", "removed", "modified")),
        F.countDistinct("file").alias("changed_files"),
    )
    said = table(spark, d, "diff_stats").groupBy("snapshot_id", "package").agg(F.max("modified_symbols").alias("published_modified"))
    joined = own.join(said, ["snapshot_id", "package"], "left")
    return joined.withColumn("differs", F.coalesce(F.col("published_modified") != F.col("modified_symbols"), F.lit(False)))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """The modified symbols with old and new values, fetched for changed keys only."""
    t = lambda n: table(spark, d, n)
    all_rows = materialise(snapshots.deliveries(t("symbols"), t("imports"), t("snapshots")).drop("version_id"), "p1-rows")
    changes = snapshots.all_changes(spark, t("symbols"), t("imports"), t("snapshots")).where("change = 'modified'")
    turn = snapshots.complete_deliveries(t("snapshots")).select(F.col("repo").alias("scope"), F.col("snapshot_id").alias("version_id"), "turn")
    at = changes.join(turn, ["scope", "version_id"])
    old = all_rows.select(*snapshots.KEYS, (F.col("turn") + 1).alias("turn"), *(F.col(v).alias(f"old_{v}") for v in snapshots.VALUES))
    new = all_rows.select(*snapshots.KEYS, "turn", *(F.col(v).alias(f"new_{v}") for v in snapshots.VALUES))
    keys = [*snapshots.KEYS, "turn"]
    return at.join(old, keys).join(new, keys).drop("turn", "scope").withColumnRenamed("version_id", "snapshot_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_per_run(spark, table(spark, d, "files"), table(spark, d, "runs"))


QUERIES = {"p1_found": p1_found, "p1_stats": p1_stats, "p1_values": p1_values, "p5_found": p5_found}

_DELIVERIES = r"""
turns AS (SELECT repo, snapshot_id, row_number() OVER (PARTITION BY repo ORDER BY snapshot_id) AS turn
          FROM (SELECT DISTINCT repo, snapshot_id FROM snapshots WHERE complete)),
rows_ AS (
  SELECT snapshot_id, repo, file, kind, coalesce(receiver, '') AS receiver, name,
         max(struct_pack(a := loaded_at, s := coalesce(signature, ''), b := start_line, e := end_line)) AS v
  FROM symbols GROUP BY ALL
  UNION ALL
  SELECT DISTINCT snapshot_id, repo, file, 'import', '', regexp_replace(import_path, '^\s+|\s+$', '', 'g'), NULL
  FROM imports WHERE regexp_replace(import_path, '^\s+|\s+$', '', 'g') <> ''),
d AS (SELECT t.turn, r.* FROM rows_ r JOIN turns t ON r.repo = t.repo AND r.snapshot_id = t.snapshot_id),
changed AS (
  SELECT t.snapshot_id, coalesce(n.file, o.file) AS file, coalesce(n.kind, o.kind) AS kind,
         coalesce(n.receiver, o.receiver) AS receiver, coalesce(n.name, o.name) AS name,
         CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed' ELSE 'modified' END AS change,
         o.v AS ov, n.v AS nv
  FROM d n FULL OUTER JOIN (SELECT turn + 1 AS turn, * EXCLUDE (turn) FROM d) o
    ON n.turn = o.turn AND n.repo = o.repo AND n.file = o.file AND n.kind = o.kind AND n.receiver = o.receiver AND n.name = o.name
  JOIN turns t ON t.repo = coalesce(n.repo, o.repo) AND t.turn = coalesce(n.turn, o.turn)
  WHERE t.turn > 1 AND (o.file IS NULL OR n.file IS NULL OR o.v.s <> n.v.s OR o.v.b IS DISTINCT FROM n.v.b OR o.v.e IS DISTINCT FROM n.v.e))
"""

ORACLE = {
    "p1_found": f"WITH {_DELIVERIES} SELECT snapshot_id, file, kind, receiver, name, change FROM changed",
    "p1_values": f"""WITH {_DELIVERIES} SELECT snapshot_id, file, kind, receiver, name, change, ov.s AS old_signature, ov.b AS old_start_line,
        ov.e AS old_end_line, nv.s AS new_signature, nv.b AS new_start_line, nv.e AS new_end_line FROM changed WHERE change = 'modified'""",
    "p1_stats": f"""WITH {_DELIVERIES}, own AS (
        SELECT snapshot_id, regexp_extract(file, '^(.*)/[^/]*$', 1) AS package,
               CAST(sum(CAST(kind <> 'import' AND change = 'added' AS INT)) AS BIGINT) AS added_symbols,
               CAST(sum(CAST(kind <> 'import' AND change = 'removed' AS INT)) AS BIGINT) AS removed_symbols,
               CAST(sum(CAST(kind <> 'import' AND change = 'modified' AS INT)) AS BIGINT) AS modified_symbols,
               count(DISTINCT file) AS changed_files FROM changed GROUP BY ALL)
        SELECT own.*, p.published_modified, coalesce(p.published_modified <> own.modified_symbols, false) AS differs
        FROM own LEFT JOIN (SELECT snapshot_id, package, max(modified_symbols) AS published_modified FROM diff_stats GROUP BY ALL) p
          ON own.snapshot_id = p.snapshot_id AND own.package = p.package""",
    "p5_found": r"""WITH l AS (
        SELECT scan_id, regexp_replace(path, '^(\./)+', '') AS path, max(struct_pack(a := listed_at, s := size_bytes, m := mtime_ns)) AS v
        FROM files WHERE path IS NOT NULL GROUP BY ALL),
      r AS (SELECT scan_id, lag(scan_id) OVER (ORDER BY started_at, scan_id) AS before FROM runs WHERE status = 'succeeded')
      SELECT l.scan_id, l.path FROM l JOIN r ON l.scan_id = r.scan_id AND r.before IS NOT NULL
      LEFT JOIN l o ON o.scan_id = r.before AND o.path = l.path
      WHERE o.path IS NULL OR o.v.s IS DISTINCT FROM l.v.s OR o.v.m IS DISTINCT FROM l.v.m""",
}
