"""Reading source trees, finding what has to be read again, and exchanging indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, globs
from tessera.sources.extract import EXTENSIONS, SCHEMA, extract
from tessera.sources.tables import clean_path

#: Texts of generated files from this size on are read by patterns only.
FAST_FROM = 100 * 1024


def listing(spark: SparkSession, root: str, ignore: str = "", single: bool = False) -> DataFrame:
    """path (below root), size_bytes, mtime_ns, language of the files a tree holds, without reading them.

    Hidden and well-known directories, ignored paths and unsupported extensions are dropped here, before any content is
    read: a filter can't be pushed through the reading pass, so it stands in front of it. single: root is one file, and
    its folder is what paths are below of.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") if not single else root.rpartition("/")[0]
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+://", "", base)) + "/", "")
    rows = files.select(F.col("path").alias("uri"), rel.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = rows.withColumn("language", F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]).where("language IS NOT NULL")
    return rows.where(globs.indexable("path")).where(~globs.ignored("path", globs.parse_ignore(ignore)))


def to_read(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Listed files whose language, size or modification time differ from the last index, and new ones."""
    return now if before is None else now.join(before.select("path", "language", "size_bytes", "mtime_ns"), ["path", "language", "size_bytes", "mtime_ns"], "left_anti")


def read_texts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """path, content of the listed files; only their contents are read."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("uri"), "content")
    return data.join(files.select("uri", "path"), "uri").select("path", F.decode("content", "UTF-8").alias("content"))


def index_tree(spark: SparkSession, root: str, before: DataFrame | None = None, ignore: str = "") -> DataFrame:
    """The extraction of a tree; given the last one, unchanged files are taken over and only the others read.

    before has the columns of this result. Files that are gone fall out; an unreadable one becomes an error.
    """
    now = listing(spark, root, ignore)
    fresh = detected(read_texts(spark, root, to_read(now, before))).withColumn("fast", F.col("gen_reason").isNotNull() & (F.octet_length("content") >= FAST_FROM)).select("path", "content", "fast")

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(p, *extract(p, t, fast)) for p, t, fast in zip(b["path"], b["content"], b["fast"])], columns=["path", "language", "error", "symbols", "refs", "imports"])

    read = fresh.mapInPandas(run, SCHEMA).join(now.select("path", "size_bytes", "mtime_ns"), "path")
    if before is None:
        return read
    return read.unionByName(before.join(now.select("path", "language", "size_bytes", "mtime_ns"), ["path", "language", "size_bytes", "mtime_ns"], "left_semi"))


# --- generated files ---

def parse_generated_config(text: str) -> tuple[list[tuple[str, str]], int]:
    """([(generator, glob)], scan depth) of `generator: pattern` lines; `@scan-depth n` is held to 200 lines."""
    rules, depth = [], 40
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("@scan-depth"):
            depth = min(200, int(s.split()[1]))
        elif ":" in s:
            who, _, pattern = s.partition(":")
            rules.append((who.strip() or "config", pattern.strip()))
        else:
            rules.append(("config", s))
    return rules, depth


def detected(files: DataFrame, config: str = "") -> DataFrame:
    """files (path, content) with gen_generator, gen_reason (config, filename, marker): the first rule that holds.

    Markers are looked for in the first lines with content, the scan depth of them.
    """
    rules, depth = parse_generated_config(config)
    head = F.array_join(F.slice(F.filter(F.split("content", "\n", -1), lambda x: F.trim(x) != ""), 1, depth), "\n")
    found: list[Column] = []
    for who, glob in rules:
        head_of = "^" if "/" in glob else "(?:^|/)"
        found.append(F.when(F.col("path").rlike(head_of + globs.glob_regex(glob) + "$"), F.struct(F.lit(who).alias("g"), F.lit("config").alias("r"))))
    for who, names, _ in fixed.GENERATORS:
        for glob in names:
            found.append(F.when(F.col("path").rlike("(?:^|/)" + globs.glob_regex(glob) + "$"), F.struct(F.lit(who).alias("g"), F.lit("filename").alias("r"))))
    for who, _, markers in fixed.GENERATORS:
        for p in markers:
            found.append(F.when(F.col("_head").rlike(p), F.struct(F.lit(who).alias("g"), F.lit("marker").alias("r"))))
    rows = files.withColumn("_head", head).withColumn("_g", F.coalesce(*found))
    return rows.select(*files.columns, F.col("_g.g").alias("gen_generator"), F.col("_g.r").alias("gen_reason"))


# --- exchange ---


def export_index(tables: dict[str, DataFrame], path: str, repo: str) -> None:
    """Compressed JSON lines per table, each row with its repository and the name of its table."""
    for name, df in tables.items():
        df.withColumn("repo", F.lit(repo)).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}/repo={repo}")


def import_index(spark: SparkSession, path: str, name: str, schema: str, file_column: str) -> DataFrame:
    """A table of all exported repositories; its paths are prefixed with `repo:`."""
    df = spark.read.schema(schema + ", repo STRING").option("recursiveFileLookup", "true").json(f"{path}/{name}")
    return df.withColumn(file_column, F.concat_ws(":", "repo", clean_path(file_column))).drop("repo")


def sarif(findings: list[dict], tool: str = "tessera") -> dict:
    """SARIF 2.1.0 of findings (rule, level, message, path, line): for reports, which are small."""
    rules = sorted({f["rule"] for f in findings})
    results = [
        {"ruleId": f["rule"], "level": f.get("level", "warning"), "message": {"text": f.get("message", f["rule"])}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["path"]}, "region": {"startLine": max(1, f.get("line") or 1)}}}]}
        for f in findings
    ]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": results}]}


def dot(edges: list[tuple], name: str = "graph") -> str:
    """Graphviz text of (from, to) pairs: for reports, which are small."""
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join([f"digraph {quote(name)} {{", *(f"  {quote(a)} -> {quote(b)};" for a, b in edges), "}"])


def markdown(df: DataFrame, most: int = 50) -> str:
    """A report's first rows as a table."""
    rows = df.limit(most).collect()  # a report of bounded length
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)])
