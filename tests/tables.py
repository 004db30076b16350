"""Small tables with the schemas of the test data, for tests of whole queries on unusual rows."""

from __future__ import annotations

SCHEMAS = {
    "files": "scan_id INT, path STRING, package STRING, language STRING, size_bytes BIGINT, mtime_ns BIGINT, gen_generator STRING, gen_reason STRING, gen_marker STRING, listed_at TIMESTAMP",
    "sources": "path STRING, content STRING",
    "errors": "path STRING, error STRING",
    "symbols": "snapshot_id INT, repo STRING, file STRING, kind STRING, name STRING, signature STRING, receiver STRING, start_line INT, end_line INT, ord INT, loaded_at TIMESTAMP",
    "imports": "snapshot_id INT, repo STRING, file STRING, import_path STRING, loaded_at TIMESTAMP",
    "function_metrics": "function_id BIGINT, file STRING, package STRING, name STRING, kind STRING, language STRING, start_line INT, end_line INT, lines INT, cyclomatic INT, cognitive INT, max_nesting INT, parameters INT, fan_in BIGINT, fan_out BIGINT, return_count INT, bool_depth INT, risk DOUBLE, measured_at TIMESTAMP, loaded_at TIMESTAMP",
    "prints": "print_id BIGINT, file STRING, name STRING, start_line INT, end_line INT, body_hash STRING, body STRING, indexed_at TIMESTAMP",
    "pairs": "a BIGINT, b BIGINT, score DOUBLE, method STRING",
    "runs": "scan_id INT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING",
    "snapshots": "snapshot_id INT, repo STRING, taken_at TIMESTAMP, complete BOOLEAN",
    "diff_stats": "snapshot_id INT, package STRING, added_symbols BIGINT, removed_symbols BIGINT, modified_symbols BIGINT, changed_files BIGINT",
    "package_risk": "package STRING, max_risk DOUBLE, p90_risk DOUBLE, avg_risk DOUBLE, high_risk_count BIGINT, function_count BIGINT, p90_cyclomatic INT",
    "eval_items": "item_id BIGINT, text STRING, lang STRING, kind STRING",
    "mix_targets": "source STRING, target_share DOUBLE, max_repeats INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, issue_date DATE, page_no INT, column_count INT, scanned_at TIMESTAMP, line_boxes ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT, conf: DOUBLE>>",
}
#: Names the operators use inside, as columns of every table that doesn't have them.
CLASHING = "id cls n h g grp o words norm grams key value weight metric day sketch v p rep seq edge start path tokens copies place u item_words opens ok reasons scope receiver turn vhash version_id _hash _r _t".split()


def rows_of(spark, name: str, how: str):
    """how: empty, nulls (rows of NULL only), or clash (NULL rows with extra columns of clashing names)."""
    df = spark.createDataFrame([], SCHEMAS[name])
    if how != "empty":
        df = spark.createDataFrame([tuple([None] * len(df.columns))] * 3, SCHEMAS[name])
    if how == "clash":
        for c in CLASHING:
            if c not in df.columns:
                df = df.selectExpr("*", f"'clash' AS {c}")
    return df


def write(spark, folder, how: str, given: dict | None = None) -> str:
    """All tables below a folder; given replaces the rows of some, keeping what `how` adds."""
    for name in SCHEMAS:
        df = rows_of(spark, name, how)
        if given and name in given:
            own = spark.createDataFrame(given[name], SCHEMAS[name])
            df = own.unionByName(df, allowMissingColumns=True)
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
